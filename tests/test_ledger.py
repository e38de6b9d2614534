import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlake.operators import ledger
from marketlake.schemas import TABLES

SHORT = "Not enough shares to sell"


def loop(trades, opening=()):
    """One trade after the other."""
    held = {(u, s): (q, a) for u, s, q, a in opening}
    refused = {}
    for id_, user, symbol, kind, n, price, at in sorted(trades, key=lambda t: (t[6], t[0])):
        if n is None or n <= 0:
            refused[id_] = ledger.BAD_QUANTITY
            continue
        q, a = held.get((user, symbol), (0, None))
        if kind == "BUY":
            held[user, symbol] = (q + n, price if q == 0 else (q * a + n * price) / (q + n))
        elif q < n:
            refused[id_] = SHORT
        elif q == n:
            del held[user, symbol]
        else:
            held[user, symbol] = (q - n, a)
    return held, refused


def frame(spark, trades):
    rows = spark.createDataFrame(trades, "id long, user_id long, symbol string, transaction_type string, quantity long, price double, t long")
    return rows.withColumn("timestamp", F.timestamp_seconds("t")).drop("t")


def positions(spark, opening):
    rows = [(i, u, s, q, a) for i, (u, s, q, a) in enumerate(opening)]
    return spark.createDataFrame(rows, "id long, user_id long, symbol string, quantity long, average_price double").withColumn(
        "last_updated", F.timestamp_seconds(F.lit(0)))


def check(spark, trades, opening=(), **kw):
    fold = ledger.fold_trades(frame(spark, trades), positions(spark, opening) if opening else None, **kw)
    held, refused = loop(trades, opening)
    got = {(r.user_id, r.symbol): (r.quantity, r.average_price) for r in fold.holdings.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in held.items()}
    for k, (_, a) in held.items():
        assert got[k][1] == pytest.approx(a, rel=1e-9)
    assert {r.id: r.reason for r in fold.rejected.collect()} == refused


def random_trades(seed, n, keys, top=10, sell=0.5):
    rng = random.Random(seed)
    return [(i, rng.randrange(keys), "S", "SELL" if rng.random() < sell else "BUY", rng.randint(1, top),
             round(rng.uniform(1, 500), 2), rng.randrange(n)) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_loop(spark, seed):
    check(spark, random_trades(seed, 3_000, 60))


@pytest.mark.parametrize("sell,top", [(0.5, 10), (0.3, 10), (0.7, 50), (0.48, 1)])
def test_long_positions_in_blocks(spark, sell, top):
    trades = random_trades(5, 2_500, 1, top, sell) + [
        (10_000 + t[0], 7 + t[1], *t[2:]) for t in random_trades(6, 600, 30)]
    check(spark, trades, array_rows=64, block_rows=64)


def test_long_position_with_opening(spark):
    trades = random_trades(8, 1_500, 2, 20, 0.55)
    check(spark, trades, [(0, "S", 300, 12.5), (5, "IDLE", 4, 2.25)], array_rows=50, block_rows=50)


def test_block_summaries_in_levels(spark, monkeypatch):
    monkeypatch.setattr(ledger, "LEVEL", 4)
    check(spark, random_trades(9, 800, 1), array_rows=16, block_rows=16)


@given(st.lists(st.tuples(st.booleans(), st.integers(-1, 6), st.integers(1, 400)), min_size=1, max_size=40))
@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
def test_any_sequence(spark, steps):
    trades = [(i, 1, "S", "BUY" if buy else "SELL", n, p / 4, i) for i, (buy, n, p) in enumerate(steps)]
    check(spark, trades)
    check(spark, trades, array_rows=3, block_rows=3)


def test_close_and_buy_again_restarts_the_average(spark):
    trades = [(1, 1, "A", "BUY", 10, 5.0, 1), (2, 1, "A", "SELL", 10, 9.0, 2), (3, 1, "A", "BUY", 2, 7.0, 3)]
    fold = ledger.fold_trades(frame(spark, trades))
    row = fold.holdings.first()
    assert (row.quantity, row.average_price) == (2, 7.0)
    assert row.last_updated.second == 3


def test_oversell_unknown_and_bad_quantity(spark):
    trades = [(1, 1, "A", "BUY", 3, 5.0, 1), (2, 1, "A", "SELL", 4, 5.0, 2), (3, 2, "A", "SELL", 1, 5.0, 3),
              (4, 1, "A", "BUY", 0, 5.0, 4), (5, 1, "A", "SELL", -1, 5.0, 5), (6, 1, "A", "HOLD", 1, 5.0, 6)]
    fold = ledger.fold_trades(frame(spark, trades))
    assert {r.id: r.reason for r in fold.rejected.collect()} == {
        2: SHORT, 3: SHORT, 4: "bad_quantity", 5: "bad_quantity", 6: "bad_transaction_type"}
    assert [(r.user_id, r.quantity) for r in fold.holdings.collect()] == [(1, 3)]


@pytest.mark.parametrize("kw", [{}, {"array_rows": 2, "block_rows": 3}])
def test_faulty_trades_come_back_whole_and_move_nothing(spark, kw):
    trades = [(1, 1, "A", "BUY", 3, 5.0, 1), (2, 1, "A", "HOLD", 7, 1.0, 2), (3, 1, "A", "BUY", None, 9.0, 3),
              (4, 1, "A", "SELL", 1, None, 4), (5, 1, "A", "BUY", -5, 2.0, 5), (6, 1, "A", "SELL", 2, 8.0, 6),
              (7, 1, "A", None, 2, 8.0, 7), (8, 2, "B", "BUY", 0, 8.0, 8)]
    fold = ledger.fold_trades(frame(spark, trades), **kw)
    assert [(r.user_id, r.quantity, r.average_price) for r in fold.holdings.collect()] == [(1, 1, 5.0)]
    got = {(r.id, r.transaction_type, r.quantity, r.price, r.reason) for r in fold.rejected.collect()}
    assert got == {
        (2, "HOLD", 7, 1.0, "bad_transaction_type"), (3, "BUY", None, 9.0, "bad_quantity"),
        (4, "SELL", 1, None, "bad_price"), (5, "BUY", -5, 2.0, "bad_quantity"),
        (7, None, 2, 8.0, "bad_transaction_type"), (8, "BUY", 0, 8.0, "bad_quantity")}


def test_order_and_partitioning_do_not_matter(spark):
    trades = random_trades(3, 500, 10)
    a = ledger.fold_trades(frame(spark, trades)).holdings.collect()
    b = ledger.fold_trades(frame(spark, trades[::-1]).repartition(9)).holdings.collect()
    assert sorted(a) == sorted(b)


def test_apply_twice_equals_once(spark):
    trades = random_trades(4, 900, 12)
    early, late = [t for t in trades if t[6] < 400], [t for t in trades if t[6] >= 400]
    empty = spark.createDataFrame([], TABLES["holdings"])
    first = ledger.apply_trades(empty, frame(spark, early))
    second = ledger.apply_trades(first.holdings, frame(spark, late))
    whole = ledger.fold_trades(frame(spark, trades))
    a = {(r.user_id, r.symbol): (r.quantity, round(r.average_price, 6)) for r in second.holdings.collect()}
    b = {(r.user_id, r.symbol): (r.quantity, round(r.average_price, 6)) for r in whole.holdings.collect()}
    assert a == b
    kept = first.accepted.count() + second.accepted.count()
    assert kept + whole.rejected.count() == len(trades)


def test_versions_follow_each_other(spark, tmp_path):
    trades, root = random_trades(4, 300, 5), str(tmp_path)
    held = spark.createDataFrame([], TABLES["holdings"])
    for version, part in enumerate((trades[:100], trades[100:200], trades[200:])):
        done = ledger.apply_trades(held, frame(spark, [(*t[:6], t[0]) for t in part]))
        ledger.write_version(done.holdings, root, version)
        held = ledger.read_current(spark, root)
    whole = ledger.fold_trades(frame(spark, [(*t[:6], t[0]) for t in trades])).holdings
    cols = ["user_id", "symbol", "quantity"]
    assert sorted(held.select(cols).collect()) == sorted(whole.select(cols).collect())


def test_buys_only_equal_the_fold(spark):
    trades = [t for t in random_trades(2, 400, 8) if t[3] == "BUY"]
    opening = positions(spark, [(0, "S", 5, 10.0), (99, "S", 1, 2.0)])
    a = ledger.merge_buys(opening, frame(spark, trades)).collect()
    b = ledger.fold_trades(frame(spark, trades), opening).holdings.collect()
    assert {(r.user_id, r.quantity, round(r.average_price, 8)) for r in a} == {
        (r.user_id, r.quantity, round(r.average_price, 8)) for r in b}


def test_large_ids_and_quantities_on_both_paths(spark):
    big = 2**53
    rows = [(big + 2 * i + 1, 1, "S", "BUY" if i % 2 else "SELL", big + i if i % 2 else 3 * big + i, 1.5, i) for i in range(8)]
    rows += [(big + 101, 1, "S", "BUY", None, 1.0, 20), (big + 103, 1, "S", "odd", 5, None, 21)]
    trades = spark.createDataFrame(
        rows, "id long, user_id long, symbol string, transaction_type string, quantity long, price double, t long").withColumn(
        "timestamp", F.timestamp_seconds("t")).drop("t")
    none = spark.createDataFrame([], "id long, user_id long, symbol string, quantity long, average_price double, last_updated timestamp")
    plain = ledger.apply_trades(none, trades)
    blocks = ledger.apply_trades(none, trades, array_rows=2, block_rows=3)
    cols = ["id", "user_id", "symbol", "transaction_type", "quantity", "price", "timestamp", "reason"]
    by_id = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert by_id(plain.rejected, *cols) == by_id(blocks.rejected, *cols)
    assert by_id(plain.accepted, "id") == by_id(blocks.accepted, "id")
    assert by_id(plain.holdings, "quantity", "last_updated") == by_id(blocks.holdings, "quantity", "last_updated")
    assert plain.accepted.count() + plain.rejected.count() == len(rows)
    assert {r.id for r in blocks.rejected.collect()} <= {r[0] for r in rows}
