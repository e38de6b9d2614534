"""Accounts: registration, existence tests, profiles and the sample account."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake import lookups
from marketlake.functions.scalars import iso_timestamp
from marketlake.operators.components import components
from marketlake.operators.ledger import fold_trades
from marketlake.session import stored


COMPONENT = 1_000_000  # clashing requests that one task settles in order


class Registered(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def _in_order(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests by component and arrival: taken if neither the name nor the address is."""
    now, names, mails = None, set(), set()
    for batch in rows:
        free = []
        for label, name, mail in zip(*(batch[c].to_pylist() for c in ("label", "username", "email"))):
            if label != now:
                now, names, mails = label, set(), set()
            free.append(name not in names and mail not in mails)
            if free[-1]:
                names.add(name)
                mails.add(mail)
        yield batch.filter(pa.array(free, pa.bool_()))


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that come first both for their name and for their address, and what is open after them."""
    by_name = left.groupBy("username").agg(F.min(F.struct("arrival", "email")).alias("f")).select(
        "username", "f.arrival", "f.email")
    by_mail = left.groupBy("email").agg(F.min("arrival").alias("arrival")).select("arrival")
    won = stored(by_name.join(by_mail, "arrival", "left_semi"), "taken")
    rest = left.join(won.select("username"), "username", "left_anti").join(won.select("email"), "email", "left_anti")
    return won, stored(rest, "open")


def _labelled(left: DataFrame) -> DataFrame:
    """Requests with the ``label`` of their component: names and addresses are nodes, a request ties two of them.

    Nodes are hashes. If two share one, two components count as one, which settles them together and changes nothing.
    """
    tied = left.withColumns({"u": F.xxhash64(F.lit("name"), "username"), "v": F.xxhash64(F.lit("mail"), "email")})
    labels = components(tied.select("u", "v"))
    return tied.join(labels.withColumnRenamed("node", "u"), "u", "left").select(
        "username", "arrival", "email", F.coalesce("label", "u").alias("label"))


def register(users: DataFrame, requests: DataFrame, largest: int = COMPONENT) -> Registered:
    """Sign-ups in order of ``arrival``: taken iff neither username nor email is used by then.

    A rejected request reserves nothing, so two plain de-duplications would reject too many. First, requests that come
    first both for their name and for their address are taken, and requests that clash with them are settled; the two
    firsts are combined before their shuffle and meet on the unique arrival, so a name shared by very many requests is
    no hot key. What is open falls into connected components of names and addresses, which do not touch: each of up to
    ``largest`` requests is settled in order by one task, all of them at once, however long its chain of clashes. Only
    larger components go on in rounds of firsts, and fall apart. A request without a name or an address is refused first.
    """
    every = requests.select("arrival", "username", "email")
    lacks = F.col("username").isNull() | F.col("email").isNull()
    ask = every.filter(~lacks)
    names, mails = users.select("username"), users.select("email")
    # of equal requests only the first can be taken
    left = stored(
        ask.groupBy("username", "email").agg(F.min("arrival").alias("arrival"))
        .join(names, "username", "left_anti").join(mails, "email", "left_anti"), "open")
    won, left = _round(left)
    taken, n = won, left.count()
    while n:
        if largest:
            labelled = stored(_labelled(left), "components")
            giant = labelled.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > largest).select("label")
            rows = labelled.join(giant, "label", "left_anti").repartition("label").sortWithinPartitions("label", "arrival")
            won = stored(rows.mapInArrow(_in_order, rows.schema), "taken")
            taken = taken.unionByName(won.select(*taken.columns))
            left = stored(labelled.join(giant, "label", "left_semi").drop("label"), "open")
            n = left.count()
        enough = n // 2
        while n > enough:
            won, left = _round(left)
            taken, n = taken.unionByName(won), left.count()
    holders = taken.select("username", F.col("arrival").alias("_since")).unionByName(
        names.withColumn("_since", F.lit(None).cast(ask.schema["arrival"].dataType)))
    refused = ask.join(taken.select("arrival"), "arrival", "left_anti").join(
        holders.withColumn("_held", F.lit(True)), "username", "left")
    name_used = F.col("_held").isNotNull() & (F.col("_since").isNull() | (F.col("_since") < F.col("arrival")))
    rejected = refused.select(
        "arrival", "username", "email",
        F.when(name_used, lookups.USERNAME_TAKEN).otherwise(lookups.EMAIL_TAKEN).alias("reason"))
    rejected = rejected.unionByName(every.filter(lacks).withColumn("reason", F.lit(lookups.MISSING_FIELDS)))
    return Registered(taken.select("arrival", "username", "email"), rejected)


def known_users(requests: DataFrame, users: DataFrame, on: str = "username") -> DataFrame:
    return requests.join(users.select(on), on, "left_semi")


def new_users(requests: DataFrame, users: DataFrame, on: str = "username") -> DataFrame:
    return requests.join(users.select(on), on, "left_anti")


def profiles(users: DataFrame) -> DataFrame:
    return users.select("username", "email", iso_timestamp(F.col("created_at")).alias("created_at"))


class Seeded(NamedTuple):
    users: DataFrame
    trades: DataFrame
    holdings: DataFrame


def seed_if_absent(users: DataFrame, trades: DataFrame, at: str,
                   positions: Sequence[tuple[str, int, float]] = lookups.SEED_POSITIONS,
                   username: str = lookups.SEED_USERNAME, email: str = lookups.SEED_EMAIL) -> Seeded:
    """Add the sample user with its BUY trades unless the username exists; a second run changes nothing."""
    spark = users.sparkSession
    known = not users.filter(F.col("username") == username).isEmpty()
    user_id = (users.agg(F.max("id")).first()[0] or 0) + 1
    trade_id = (trades.agg(F.max("id")).first()[0] or 0) + 1
    when = F.lit(at).cast("timestamp")
    user_rows = [] if known else [(user_id, username, email)]
    trade_rows = [] if known else [
        (trade_id + i, user_id, symbol, "BUY", n, price) for i, (symbol, n, price) in enumerate(positions)]
    fresh = spark.createDataFrame(user_rows, "id bigint, username string, email string")
    added = spark.createDataFrame(
        trade_rows,
        "id bigint, user_id bigint, symbol string, transaction_type string, quantity bigint, price double")
    added = added.withColumn("timestamp", when)
    return Seeded(
        users.unionByName(fresh.withColumn("created_at", when)), trades.unionByName(added),
        fold_trades(added).holdings)
