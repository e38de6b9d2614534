"""Column functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlake import fixtures as fx
from marketlake.functions import scalars as fn
from marketlake.operators import relational as rel
from marketlake.plans.registry import query, r6
from marketlake.plans.views import sql


@query("pct_to_double", """SELECT event_id, floor((value) * 1e6 + 0.5) / 1e6 AS a, floor((value) * 1e6 + 0.5) / 1e6 AS b,
    CASE WHEN event_id % 2 = 0 THEN 5.0::DOUBLE END AS c FROM events""")
def _(spark, sf):
    pct = F.concat(F.col("value").cast("string"), F.lit("%"))
    odd = F.when(F.col("event_id") % 2 == 0, "%5%").otherwise("n/a%")
    return fx.table(spark, sf, "events").select(
        "event_id", r6(fn.pct_to_double(pct)).alias("a"), r6(fn.trailing_pct_to_double(pct)).alias("b"),
        fn.pct_to_double(odd).alias("c"))


@query("numeric_casts", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS d,
    CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END AS n FROM events""")
def _(spark, sf):
    bad = F.col("event_id") % 3 == 0
    return fx.table(spark, sf, "events").select(
        "event_id", fn.to_double(F.when(bad, "x1").otherwise(F.col("value").cast("string"))).alias("d"),
        F.coalesce(fn.to_long(F.when(bad, "1.5").otherwise(F.col("event_id").cast("string"))), F.lit(-1)).alias("n"))


@query("epoch_to_date", """SELECT event_id, strftime(make_timestamp(event_id * 86399 * 1000000), '%Y-%m-%d') AS day FROM events""")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", fn.epoch_to_date(F.col("event_id") * 86399).cast("string").alias("day"))


@query("date_format_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", fn.day_string(F.col("ts")).alias("day"))


@query("parse_dates", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def _(spark, sf):
    text = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return fx.table(spark, sf, "events").select("event_id", fn.parse_day(text).cast("string").alias("day"))


@query("case_fold", "SELECT doc_id, lower(text) AS low, upper(source) AS up FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", fn.lower(F.col("text")).alias("low"), fn.upper(F.col("source")).alias("up"))


@query("contains", "SELECT doc_id, contains(lower(text), 'und') AS a, contains(lower(text), 'license') AS b FROM documents")
def _(spark, sf):
    text = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id", fn.contains_ci(text, "UND").alias("a"), fn.contains_ci(text, "License").alias("b"))


@query("truncate_ellipsis", """SELECT doc_id, CASE WHEN length(text) > 1000 THEN substring(text, 1, 1000) || '...'
    ELSE text END AS cut FROM documents""")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", fn.truncate_ellipsis(F.col("text"), 1000).alias("cut"))


@query("suffix_prefix", """SELECT page_id, ends_with(url, '.pdf') OR ends_with(url, 'x') AS s,
    starts_with(url, 'http://m.') AS p FROM pages""")
def _(spark, sf):
    url = F.col("url")
    return fx.table(spark, sf, "pages").select(
        "page_id", (fn.has_suffix(url, ".pdf") | fn.has_suffix(url, "x")).alias("s"),
        fn.has_prefix(url, "http://m.").alias("p"))


@query("round_abs_mod", """SELECT c_custkey, round(abs(c_acctbal) / 8 + 0.001, 2) AS r, abs(c_acctbal) AS a,
    c_custkey % 900 AS m FROM customer""")
def _(spark, sf):
    bal = F.abs("c_acctbal")
    return fx.table(spark, sf, "customer").select(
        "c_custkey", fn.round2(bal / 8 + 0.001).alias("r"), bal.alias("a"), (F.col("c_custkey") % 900).alias("m"))


@query("symbol_checksum", """SELECT p_partkey, CAST(list_sum(list_transform(string_split(p_name, ''),
    lambda c: CASE WHEN c = '' THEN 0 ELSE unicode(c) END)) AS BIGINT) AS checksum FROM part""")
def _(spark, sf):
    name = F.col("p_name")
    return fx.table(spark, sf, "part").select(
        "p_partkey", fn.symbol_checksum(name).alias("checksum"))


def _fields(spark, sf):
    """Events with a map in which the key 'w' is absent, null or set."""
    k = F.col("event_id")
    base = F.create_map(F.lit("type"), F.col("event_type"))
    w = F.create_map(F.lit("w"), F.when(k % 3 == 1, k.cast("string")))
    none = F.create_map().cast("map<string,string>")
    return fx.table(spark, sf, "events").select(
        "event_id", F.map_concat(base, F.when(k % 3 == 0, none).otherwise(w)).alias("m"))


@query("key_default", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN CAST(event_id AS VARCHAR) END AS w
    FROM events""")
def _(spark, sf):
    return _fields(spark, sf).select("event_id", fn.default_if_missing(F.col("m"), "w", "none").alias("w"))


@query("map_lookup_default", """SELECT event_id, event_type AS t, CASE WHEN event_id % 3 = 1 THEN CAST(event_id AS VARCHAR) END AS w,
    'gone' AS g FROM events""")
def _(spark, sf):
    m = F.col("m")
    return _fields(spark, sf).select(
        "event_id", fn.lookup(m, "type").alias("t"), fn.lookup(m, "w").alias("w"),
        fn.lookup(m, "absent", F.lit("gone")).alias("g"))


@query("json_dump", """SELECT event_id, '{"id":' || CAST(event_id AS VARCHAR) || ',"type":"' || event_type || '"}' AS js FROM events""")
def _(spark, sf):
    both = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))
    return fx.table(spark, sf, "events").select("event_id", fn.json_dump(both).alias("js"))


@query("nested_field", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS name FROM documents""")
def _(spark, sf):
    item = F.struct(F.when(F.col("doc_id") % 4 != 0, F.struct(F.col("source").alias("name"))).alias("source"))
    return fx.table(spark, sf, "documents").select("doc_id", fn.nested_field(item, "source", "name").alias("name"))


@query("string_template", """SELECT s_suppkey, s_name || ' Inc. (' || CAST(s_nationkey AS VARCHAR) || ')' AS label FROM supplier""")
def _(spark, sf):
    return fx.table(spark, sf, "supplier").select(
        "s_suppkey", fn.template("%s Inc. (%s)", F.col("s_name"), F.col("s_nationkey")).alias("label"))


@query("uuid_key", """SELECT event_id, sha256(CAST(user_id AS VARCHAR) || ':' || CAST(event_id AS VARCHAR)) AS key,
    36::BIGINT AS random_length FROM events""")
def _(spark, sf):
    key = fn.session_key(F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return fx.table(spark, sf, "events").select(
        "event_id", key.alias("key"), F.length(fn.session_key()).alias("random_length"))


@query("required_fields_split", sql("""+ r AS (SELECT id, CASE id % 4
      WHEN 0 THEN '{"symbol": "' || symbol || '", "quantity": ' || CAST(quantity AS VARCHAR) || ', "price": 1.5}'
      WHEN 1 THEN '{"symbol": "", "quantity": null, "price": null}'
      WHEN 2 THEN '{"symbol": "' || symbol || '", "quantity": 1}' ELSE '[broken' END AS payload FROM trades),
    j AS (SELECT id, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END AS js FROM r)
    SELECT id, CASE WHEN json_exists(js, '$.symbol') AND json_exists(js, '$.quantity') AND json_exists(js, '$.price')
      THEN 'good' ELSE 'Missing required fields' END AS outcome FROM j""", "trades"))
def _(spark, sf):
    k = F.col("id") % 4
    payload = (
        F.when(k == 0, fn.template('{"symbol": "%s", "quantity": %s, "price": 1.5}', F.col("symbol"), F.col("quantity")))
        .when(k == 1, '{"symbol": "", "quantity": null, "price": null}')
        .when(k == 2, fn.template('{"symbol": "%s", "quantity": 1}', F.col("symbol")))
        .otherwise("[broken"))
    raw = fx.trades(spark, sf).select("id", payload.alias("payload"))
    parts = rel.split_required(raw, ["symbol", "quantity", "price"])
    return parts.good.select("id", F.lit("good").alias("outcome")).unionByName(
        parts.bad.select("id", F.col("reason").alias("outcome")))
