"""Trades, holdings, users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake import fixtures as fx
from marketlake import lookups
from marketlake.functions.scalars import iso_timestamp
from marketlake.operators import ledger
from marketlake.operators import relational as rel
from marketlake.operators import users as usr
from marketlake.plans.registry import query, r6, shown, six
from marketlake.plans.views import sql
from marketlake.schemas import TABLES
from marketlake.session import scratch_path
from marketlake.sinks import to_api_json
from marketlake.sources.tables import read_table, write_table


def folded_sql(trades: str, start: str = "SELECT DISTINCT user_id, symbol, 0 AS q, 0.0::DOUBLE AS a FROM t") -> str:
    """Trade-by-trade recursion: the definition itself."""
    return f"""+ t AS (SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY timestamp, id) AS n,
        transaction_type = 'BUY' AS buy FROM {trades}),
    k AS ({start}),
    f AS (SELECT user_id, symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(q AS BIGINT) AS q, a,
                 false AS refused FROM k
      UNION ALL
      SELECT t.user_id, t.symbol, t.n, t.id,
        CASE WHEN t.buy THEN f.q + t.quantity WHEN f.q < t.quantity THEN f.q ELSE f.q - t.quantity END,
        CASE WHEN NOT t.buy THEN f.a WHEN f.q = 0 THEN t.price
             ELSE (f.q * f.a + t.quantity * t.price) / (f.q + t.quantity) END,
        NOT t.buy AND f.q < t.quantity
      FROM f JOIN t ON t.user_id = f.user_id AND t.symbol = f.symbol AND t.n = f.n + 1),
    z AS (SELECT user_id, symbol, max_by(q, n) AS quantity, max_by(a, n) AS average_price FROM f GROUP BY 1, 2)"""


SHIFT = 0.0000003  # an average over 16 or 32 shares can end on a rounding tie; this moves it off

BOTH = f""" SELECT 'holding' AS kind, user_id, symbol, CAST(-1 AS BIGINT) AS id, quantity,
      floor((average_price + {SHIFT:.7f}) * 1e6 + 0.5) / 1e6 AS average_price FROM z WHERE quantity > 0
    UNION ALL SELECT 'reject', user_id, symbol, id, -1, -1.0 FROM f WHERE refused"""


def average():
    return r6(F.col("average_price") + SHIFT).alias("average_price")


def _both(holdings: DataFrame, rejected: DataFrame) -> DataFrame:
    kept = holdings.select(
        F.lit("holding").alias("kind"), "user_id", "symbol", "quantity", average())
    refused = rejected.select(F.lit("reject").alias("kind"), "user_id", "symbol", "id")
    return kept.unionByName(refused, allowMissingColumns=True).fillna(-1)


@query("holdings_fold", sql(folded_sql("trades") + BOTH, "trades", recursive=True))
def holdings_fold(spark, sf):
    return _both(*ledger.fold_trades(fx.trades(spark, sf)))


@query("holdings_fold_hot_key", sql(folded_sql("hot_trades") + BOTH, "trades", "hot_trades", recursive=True))
def _(spark, sf):
    return _both(*ledger.fold_trades(fx.hot_trades(spark, sf), array_rows=256, block_rows=500))


OPENED = """SELECT user_id, symbol, coalesce(h.quantity, 0) AS q, coalesce(h.average_price, 0.0) AS a
    FROM (SELECT DISTINCT user_id, symbol FROM t) FULL JOIN holdings h USING (user_id, symbol)"""


@query("apply_trades_to_holdings", sql(
    folded_sql("trades", OPENED) + BOTH + " UNION ALL SELECT 'accepted', user_id, symbol, id, -1, -1.0 FROM f"
    " WHERE NOT refused AND id IS NOT NULL", "trades", "holdings", recursive=True))
def _(spark, sf):
    done = ledger.apply_trades(fx.holdings(spark, sf), fx.trades(spark, sf))
    root = scratch_path(spark, "holdings")
    ledger.write_version(done.holdings, root, 1)
    accepted = done.accepted.select(F.lit("accepted").alias("kind"), "user_id", "symbol", "id")
    return _both(ledger.read_current(spark, root), done.rejected).unionByName(accepted, allowMissingColumns=True).fillna(-1)


@query("buy_lot_merge", sql(f"""+ b AS (SELECT user_id, symbol, quantity AS n, price AS p FROM trades
      WHERE transaction_type = 'BUY' UNION ALL SELECT user_id, symbol, quantity, average_price FROM holdings)
    SELECT user_id, symbol, CAST(sum(n) AS BIGINT) AS quantity, 
      floor((sum(n * p) / sum(n) + {SHIFT:.7f}) * 1e6 + 0.5) / 1e6 AS average_price
    FROM b GROUP BY 1, 2""", "trades", "holdings"))
def _(spark, sf):
    buys = fx.trades(spark, sf).filter(F.col("transaction_type") == "BUY")
    return ledger.merge_buys(fx.holdings(spark, sf), buys).select("user_id", "symbol", "quantity", average())


@query("recent_trades", sql("""SELECT id, user_id, symbol, quantity, price, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY user_id ORDER BY timestamp DESC, id DESC) AS rank FROM trades) WHERE rank <= 20""", "trades"))
def recent_trades(spark, sf):
    return rel.recent_trades(fx.trades(spark, sf)).select("id", "user_id", "symbol", "quantity", "price", "rank")


@query("table_scan", sql("""SELECT 'trades' AS name, id, user_id, symbol AS label, transaction_type AS more, quantity, price,
      epoch_us(timestamp) AS at FROM trades
    UNION ALL SELECT 'users', id, -1, username, email, -1, -1, created * 1000000 FROM users
    UNION ALL SELECT 'holdings', id, user_id, symbol, NULL, quantity, average_price, -1 FROM holdings
    UNION ALL SELECT 'chat_messages', id, -1, session_id, message, is_user::BIGINT, -1, -1 FROM msgs
    UNION ALL SELECT 'chat_sessions', -1, user_id, session_id, NULL, -1, -1, -1 FROM sessions""",
    "trades", "users", "holdings", "msgs", "sessions"))
def _(spark, sf):
    """Each of the five tables, written and scanned again with its declared schema."""
    def scanned(name, rows, **columns):
        path = scratch_path(spark, name)
        for f in TABLES[name]:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        write_table(rows, name, path)
        kinds = {"id": "bigint", "user_id": "bigint", "label": "string", "more": "string", "quantity": "bigint", "price": "double", "at": "bigint"}
        read = read_table(spark, name, path)
        return read.select(F.lit(name).alias("name"), *[columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    c = F.col
    return reduce(DataFrame.unionByName, [
        scanned("trades", fx.trades(spark, sf), id=c("id"), user_id=c("user_id"), label=c("symbol"), more=c("transaction_type"),
                quantity=c("quantity"), price=c("price"), at=F.unix_micros("timestamp")),
        scanned("users", fx.users(spark, sf), id=c("id"), label=c("username"), more=c("email"), at=F.unix_micros("created_at")),
        scanned("holdings", fx.holdings(spark, sf), id=c("id"), user_id=c("user_id"), label=c("symbol"), quantity=c("quantity"),
                price=c("average_price")),
        scanned("chat_messages", fx.chat_messages(spark, sf), id=c("id"), label=c("session_id"), more=c("message"), quantity=c("is_user")),
        scanned("chat_sessions", fx.chat_sessions(spark, sf), user_id=c("user_id"), label=c("session_id")),
    ]).fillna(-1)


@query("holdings_by_user", sql(f"""SELECT user_id, symbol, quantity, {six('average_price')} FROM holdings
    WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')""", "holdings"))
def _(spark, sf):
    asked = fx.table(spark, sf, "events").filter(F.col("event_type") == "error").select("user_id")
    return shown(rel.holdings_for(fx.holdings(spark, sf), asked), "user_id", "symbol", "quantity", r="average_price")


@query("user_holdings", sql(f"""SELECT u.id AS user_id, username, symbol, quantity, {six('average_price')}
    FROM users u JOIN holdings h ON h.user_id = u.id""", "users", "holdings"))
def _(spark, sf):
    both = rel.user_holdings(fx.users(spark, sf), fx.holdings(spark, sf))
    return shown(both, "user_id", "username", "symbol", "quantity", r="average_price")


@query("user_profile", sql("""SELECT username, email, strftime(make_timestamp(created * 1000000), '%Y-%m-%dT%H:%M:%S')
    AS created_at FROM users""", "users"))
def _(spark, sf):
    return usr.profiles(fx.users(spark, sf))


@query("known_users", sql("""SELECT o_orderkey, 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS username
    FROM orders WHERE 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') IN (SELECT username FROM users)""",
    "users"))
def _(spark, sf):
    return usr.known_users(_asks(spark, sf), fx.users(spark, sf)).select("o_orderkey", "username")


@query("new_users", sql("""SELECT o_orderkey, 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') AS username
    FROM orders WHERE 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') NOT IN (SELECT username FROM users)""",
    "users"))
def _(spark, sf):
    return usr.new_users(_asks(spark, sf), fx.users(spark, sf)).select("o_orderkey", "username")


def _asks(spark, sf) -> DataFrame:
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))
    return fx.table(spark, sf, "orders").select("o_orderkey", name.alias("username"))


GREEDY = f"""+ s AS (SELECT *, row_number() OVER (ORDER BY arrival) AS n FROM registrations),
    g AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS us, CAST([] AS VARCHAR[]) AS es,
                 CAST(NULL AS VARCHAR) AS reason
      UNION ALL
      SELECT s.n,
        CASE WHEN list_contains(us, username) OR list_contains(es, email) THEN us ELSE list_append(us, username) END,
        CASE WHEN list_contains(us, username) OR list_contains(es, email) THEN es ELSE list_append(es, email) END,
        CASE WHEN list_contains(us, username) THEN '{lookups.USERNAME_TAKEN}'
             WHEN list_contains(es, email) THEN '{lookups.EMAIL_TAKEN}' ELSE 'accepted' END
      FROM g JOIN s ON s.n = g.n + 1)
    SELECT arrival, username, email, reason FROM g JOIN s USING (n)"""


@query("first_wins_registration", sql(GREEDY, "registrations", recursive=True))
def _(spark, sf):
    none = spark.createDataFrame([], "username string, email string")
    done = usr.register(none, fx.registrations(spark, sf))
    return done.accepted.withColumn("reason", F.lit("accepted")).unionByName(done.rejected)


FAMILIES = GREEDY.replace("registrations", "family_registrations")


@query("first_wins_registration_components", sql(FAMILIES, "family_registrations", recursive=True))
def _(spark, sf):
    """Many components; those of over 30 requests go on in rounds until they fall apart."""
    none = spark.createDataFrame([], "username string, email string")
    done = usr.register(none, fx.family_registrations(spark, sf), largest=30)
    return done.accepted.withColumn("reason", F.lit("accepted")).unionByName(done.rejected)


@query("seed_if_absent", sql("""SELECT 'user' AS kind, id, username AS label FROM users
    UNION ALL SELECT 'user', (SELECT max(id) + 1 FROM users), 'test'
    UNION ALL SELECT 'trade', id, symbol FROM trades
    UNION ALL SELECT 'trade', (SELECT max(id) FROM trades) + i, s FROM (VALUES (1, 'AAPL'), (2, 'MSFT'), (3, 'GOOGL')) v(i, s)
    UNION ALL SELECT 'holding', n, s FROM (VALUES (10, 'AAPL'), (5, 'MSFT'), (3, 'GOOGL')) v(n, s)""",
    "users", "trades"))
def _(spark, sf):
    once = usr.seed_if_absent(fx.users(spark, sf), fx.trades(spark, sf), "2024-02-01 00:00:00")
    again = usr.seed_if_absent(once.users, once.trades, "2024-02-02 00:00:00")  # adds nothing
    return (
        again.users.select(F.lit("user").alias("kind"), "id", F.col("username").alias("label"))
        .unionByName(again.trades.select(F.lit("trade").alias("kind"), "id", F.col("symbol").alias("label")))
        .unionByName(once.holdings.select(
            F.lit("holding").alias("kind"), F.col("quantity").alias("id"), F.col("symbol").alias("label")))
    )


@query("to_api_json", sql("""SELECT '{"id":' || id || ',"symbol":"' || symbol || '","quantity":' || quantity ||
    ',"price":' || CAST(price AS VARCHAR) || ',"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END || '"}' AS value
    FROM trades""", "trades"))
def _(spark, sf):
    return to_api_json(fx.trades(spark, sf).select("id", "symbol", "quantity", "price", "timestamp"))


@query("iso_timestamp", sql("""SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END AS iso FROM
    (SELECT id, CASE WHEN id % 2 = 0 THEN date_trunc('second', timestamp) ELSE timestamp END AS timestamp FROM trades)""",
    "trades"))
def _(spark, sf):
    at = F.when(F.col("id") % 2 == 0, F.date_trunc("second", "timestamp")).otherwise(F.col("timestamp"))
    return fx.trades(spark, sf).select("id", iso_timestamp(at).alias("iso"))
