import random

import pytest

from pyspark.sql import functions as F

from marketlake.operators import users as usr


def greedy(requests, names=(), mails=()):
    names, mails, out = set(names), set(mails), {}
    for arrival, u, e in sorted(requests):
        if u in names:
            out[arrival] = "Username already exists"
        elif e in mails:
            out[arrival] = "Email already exists"
        else:
            names.add(u), mails.add(e)
            out[arrival] = None
    return out


def run(spark, requests, users=(), **kw):
    have = spark.createDataFrame(list(users), "username string, email string")
    done = usr.register(have, spark.createDataFrame(requests, "arrival long, username string, email string"), **kw)
    got = {r.arrival: None for r in done.accepted.collect()}
    for r in done.rejected.collect():
        assert r.arrival not in got
        got[r.arrival] = r.reason
    return got


def test_a_rejected_request_reserves_nothing(spark):
    got = run(spark, [(1, "u1", "e1"), (2, "u1", "e2"), (3, "u2", "e2")])
    assert got == {1: None, 2: "Username already exists", 3: None}


@pytest.mark.parametrize("seed", range(3))
def test_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    requests = [(i, f"u{rng.randrange(60)}", f"e{rng.randrange(70)}") for i in range(400)]
    users = [("u1", "e900"), ("u900", "e2")]
    assert run(spark, requests, users) == greedy(requests, ["u1", "u900"], ["e900", "e2"])


def test_one_name_in_a_third_of_all_requests(spark):
    rng = random.Random(4)
    requests = [(i, "hot" if i % 3 == 0 else f"u{rng.randrange(300)}", f"e{rng.randrange(300)}") for i in range(900)]
    assert run(spark, requests) == greedy(requests)


def test_chain_of_clashes(spark):
    requests = [(i, f"u{(i + 1) // 2}", f"e{i // 2}") for i in range(13)]
    assert run(spark, requests) == greedy(requests)


def test_components_and_rounds_agree(spark):
    """Many families that do not touch, one large one, and all ways to settle them."""
    rng = random.Random(7)
    requests = [(i, f"u{i // 40}-{rng.randrange(11)}", f"e{i // 40}-{rng.randrange(13)}") for i in range(600)]
    requests += [(i, f"u{rng.randrange(90)}", f"e{rng.randrange(110)}") for i in range(600, 900)]
    rng.shuffle(requests)
    for largest in (0, 25, 1_000):
        assert run(spark, requests, largest=largest) == greedy(requests), largest


def test_a_long_chain_takes_few_tables(spark, monkeypatch):
    """Each request clashes with the one before by its name or its address: rounds alone would take half as many tables."""
    from marketlake.operators import components

    n, made = 20_000, []
    for module in (usr, components):
        plain = module.stored
        monkeypatch.setattr(module, "stored", lambda df, label, plain=plain: made.append(label) or plain(df, label))
    chain = spark.range(n).select(F.col("id").alias("arrival"), F.concat(F.lit("u"), ((F.col("id") + 1) / 2).cast("long")).alias("username"),
                                  F.concat(F.lit("e"), (F.col("id") / 2).cast("long")).alias("email"))
    done = usr.register(spark.createDataFrame([], "username string, email string"), chain)
    want = greedy([(i, f"u{(i + 1) // 2}", f"e{i // 2}") for i in range(n)])
    assert {r["arrival"] for r in done.accepted.collect()} == {i for i, reason in want.items() if reason is None}
    assert len(made) < 40


def test_components_of_a_graph(spark):
    from marketlake.operators.components import components

    rng = random.Random(11)
    edges = [(rng.randrange(400), 400 + rng.randrange(400)) for _ in range(350)] + [(1_000, 1_001 + i) for i in range(300)]
    edges += [(2_000 + i, 2_001 + i) for i in range(200)] + [(5, 5), (1_000, 1_001)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_no_requests(spark):
    assert run(spark, []) == {}


def test_seed_adds_once(spark, sf):
    from marketlake import fixtures as fx

    users, trades = fx.users(spark, sf), fx.trades(spark, sf)
    once = usr.seed_if_absent(users, trades, "2024-02-01 00:00:00")
    again = usr.seed_if_absent(once.users, once.trades, "2024-02-02 00:00:00")
    assert once.users.count() == users.count() + 1 == again.users.count()
    assert once.trades.count() == trades.count() + 3 == again.trades.count()
    assert once.holdings.count() == 3 and again.holdings.count() == 0


def test_null_names_and_addresses_are_refused(spark):
    none = spark.createDataFrame([], "username string, email string")
    asks = spark.createDataFrame([(1, None, None), (2, "a", None), (3, None, "e"), (4, "a", "e"), (5, "a", "f")],
                                 "arrival long, username string, email string")
    for largest in (0, 10):
        done = usr.register(none, asks, largest=largest)
        assert [r.arrival for r in done.accepted.collect()] == [4]
        assert {r.arrival: r.reason for r in done.rejected.collect()} == {
            1: "Missing required fields", 2: "Missing required fields", 3: "Missing required fields", 5: "Username already exists"}


def test_a_long_chain_of_clashes(spark):
    """Request 2k shares its name with 2k - 1 and its address with 2k + 1: only a fold in order tells who wins."""
    n = 10_000
    asks = spark.range(n).select(
        F.col("id").alias("arrival"), F.concat(F.lit("u"), F.floor((F.col("id") + 1) / 2)).alias("username"),
        F.concat(F.lit("e"), F.floor(F.col("id") / 2)).alias("email"))
    known = spark.createDataFrame([("u4000", "x")], "username string, email string")
    done = usr.register(known, asks)
    names, mails, want = {"u4000"}, {"x"}, []
    for i in range(n):
        u, e = f"u{(i + 1) // 2}", f"e{i // 2}"
        if u not in names and e not in mails:
            want.append(i)
            names.add(u)
            mails.add(e)
    assert sorted(r.arrival for r in done.accepted.collect()) == want
    assert done.rejected.count() == n - len(want)
