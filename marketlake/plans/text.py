"""News, chat and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlake import fixtures as fx
from marketlake import lookups
from marketlake.functions import text as txt
from marketlake.operators import chat, matching
from marketlake.operators import relational as rel
from marketlake.plans.registry import query
from marketlake.plans.views import VIEWS, sql
from marketlake.sources import documents as src_documents
from marketlake.sources import news as src_news

RULES = [(1, "license", "legal"), (2, "sch", "german"), (3, "und", "german"), (4, "les", "french"),
         (5, "the", "english"), (6, "tion", "any")]
QUERIES = [(1, "license"), (2, "SCH"), (3, "und"), (4, "Les"), (5, "the"), (6, "tion"), (7, "no such words")]
QUERY_ROWS = "(VALUES " + ", ".join(f"({i}::BIGINT, '{q}')" for i, q in QUERIES) + ") AS q(query_id, query)"


def rules(spark):
    return spark.createDataFrame(RULES, "priority bigint, keyword string, tag string")


def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id bigint, query string")


# --- news -------------------------------------------------------------------------------------

HIT = "contains(lower(headline), lower(query)) OR contains(lower(summary), lower(query))"
SEARCH = sql(f"""SELECT query_id, arrival, rank FROM (SELECT query_id, arrival,
    row_number() OVER (PARTITION BY query_id ORDER BY arrival) AS rank
    FROM news JOIN {QUERY_ROWS} ON {HIT}) WHERE rank <= 10""", "news")


@query("news_search", SEARCH)
def news_search(spark, sf):
    return matching.news_search(fx.news(spark, sf), queries(spark)).select("query_id", "arrival", "rank")


@query("news_search_many_queries", sql(f"""+ q AS (SELECT p_partkey AS query_id, split_part(p_name, ' ', 2) || CASE
      WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS word FROM part),
    p AS (SELECT query_id, substring(word, 2, 2 + CAST(query_id % 3 AS INTEGER)) AS query FROM q)
    SELECT query_id, arrival, rank FROM (SELECT query_id, arrival,
      row_number() OVER (PARTITION BY query_id ORDER BY arrival) AS rank
      FROM news JOIN p ON {HIT}) WHERE rank <= 10""", "news"))
def _(spark, sf):
    key = F.col("p_partkey")
    word = F.concat(F.element_at(F.split("p_name", " "), 2), F.when(key % 2 == 0, "").otherwise(key.cast("string")))
    many = fx.table(spark, sf, "part").select(
        key.alias("query_id"), F.substring(word, F.lit(2), (2 + key % 3).cast("int")).alias("query"))
    return matching.news_search(fx.news(spark, sf), many).select("query_id", "arrival", "rank")


@query("rule_contains_join", sql(
    "SELECT arrival, priority, tag FROM news JOIN rules ON contains(lower(summary), keyword)", "news", "rules"))
def _(spark, sf):
    return matching.match_rules(fx.news(spark, sf), "summary", rules(spark)).select("arrival", "priority", "tag")


@query("usable_news", sql("""SELECT arrival FROM news WHERE arrival % 5 <> 0 AND headline <> ''
    AND arrival % 7 <> 0""", "news"))
def _(spark, sf):
    rows = fx.news(spark, sf).withColumns({
        "headline": F.when(F.col("arrival") % 5 != 0, F.col("headline")),
        "url": F.when(F.col("arrival") % 7 == 0, "").otherwise(F.col("url"))})
    return rel.usable_news(rows).select("arrival")


@query("news_top_10", sql("""SELECT source, arrival, rank FROM (SELECT source, arrival,
    row_number() OVER (PARTITION BY source ORDER BY arrival) AS rank FROM news) WHERE rank <= 10""", "news"))
def _(spark, sf):
    return rel.news_top(fx.news(spark, sf), 10, ["source"]).select("source", "arrival", "rank")


@query("limit_then_filter", sql("""SELECT arrival, lang FROM (SELECT * FROM news ORDER BY arrival LIMIT 20)
    WHERE lang = 'en'""", "news"))
def _(spark, sf):
    return rel.limit_then_filter(
        fx.news(spark, sf), 20, [F.col("arrival")], F.col("lang") == "en").select("arrival", "lang")


FEED = """+ f AS (SELECT *, lang || '/' || source || '/' || CAST(arrival // 25 AS VARCHAR) AS feed FROM news),
    o AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY arrival) - 1 AS pos,
                 min(arrival) OVER (PARTITION BY feed) AS first FROM f)
    SELECT feed, pos, headline AS title, url, source, epoch AS at, summary AS content FROM o
    WHERE first % 4 <> 3 AND pos < 10"""


def _feed(df):
    return df.withColumn("at", F.unix_seconds("published_at")).drop("published_at")


@query("news_vendor_a", sql(FEED, "news"))
def _(spark, sf):
    return _feed(src_news.news_vendor_a(fx.news_feed(spark, sf, "a")))


@query("news_vendor_b", sql(FEED, "news"))
def _(spark, sf):
    return _feed(src_news.news_vendor_b(fx.news_feed(spark, sf, "b")))


@query("company_news", sql("""+ r AS (SELECT *, row_number() OVER (PARTITION BY upper(source) ORDER BY arrival) AS rank
      FROM news WHERE epoch // 6 + 1704067200 >= epoch(TIMESTAMP '2024-01-02')
      AND epoch // 6 + 1704067200 < epoch(TIMESTAMP '2024-01-08'))
    SELECT upper(source) AS symbol, rank, headline,
      CASE WHEN arrival % 4 = 0 THEN 'No summary available' WHEN arrival % 5 = 0 THEN NULL
           ELSE summary END AS summary, url,
      CASE WHEN arrival % 3 = 0 THEN 'Financial News' ELSE lang END AS source,
      strftime(make_timestamp((epoch // 6 + 1704067200) * 1000000), '%Y-%m-%dT%H:%M:%S') AS datetime
    FROM r WHERE rank <= 20 AND arrival % 6 <> 0 AND headline <> ''""", "news"))
def _(spark, sf):
    return src_news.company_news(fx.company_items(spark, sf), "2024-01-07", days=5)


@query("documents_from_pages", """SELECT doc_id, text || chr(10) AS text FROM documents WHERE doc_id % 9 <> 0""")
def _(spark, sf):
    return src_documents.documents_from_pages(fx.doc_pages(spark, sf), section=4)


# --- text rules -------------------------------------------------------------------------------

@query("faq_match", sql("""SELECT arrival, coalesce(min_by(tag, priority), 'nothing') AS response
    FROM news LEFT JOIN rules ON contains(lower(summary), keyword) GROUP BY arrival""", "news", "rules"))
def _(spark, sf):
    ordered = [(word, tag) for _, word, tag in RULES]
    return txt.faq_match(fx.news(spark, sf), "summary", ordered, "nothing").select("arrival", "response")


SPOKEN = """SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' Bullish' ELSE '' END
    || CASE WHEN doc_id % 4 = 0 THEN ' bearISH' ELSE '' END AS text FROM documents"""


@query("sentiment_tag", f"""SELECT doc_id, CASE WHEN contains(lower(text), 'bullish') THEN 'Bullish'
    WHEN contains(lower(text), 'bearish') THEN 'Bearish' ELSE 'Neutral' END AS sentiment FROM ({SPOKEN})""")
def _(spark, sf):
    doc = F.col("doc_id")
    text = F.concat("text", F.when(doc % 3 == 0, " Bullish").otherwise(""),
                    F.when(doc % 4 == 0, " bearISH").otherwise(""))
    return fx.table(spark, sf, "documents").select("doc_id", txt.sentiment_tag(text).alias("sentiment"))


@query("topic_tags", sql("""SELECT arrival, coalesce(string_agg(tag, ',' ORDER BY priority), 'x,y') AS tags
    FROM news LEFT JOIN rules ON contains(lower(summary), keyword) GROUP BY arrival""", "news", "rules"))
def _(spark, sf):
    ordered = [(word, tag) for _, word, tag in RULES]
    tags = txt.topic_tags(F.col("summary"), ordered, ["x", "y"])
    return fx.news(spark, sf).select("arrival", F.array_join(tags, ",").alias("tags"))


@query("analysis_prompt", sql("""SELECT symbol, 'Study ' || symbol || '. ' || CASE WHEN CAST(symbol AS BIGINT) % 2 = 0
    THEN 'Here is the available data for ' || symbol || ': {"volume":' || CAST(volume AS VARCHAR) || '}' || chr(10) || chr(10)
    ELSE '' END || 'Be brief.' AS prompt FROM quotes""", "quotes"))
def _(spark, sf):
    symbol = F.col("symbol")
    data = F.when(symbol.cast("bigint") % 2 == 0, F.struct("volume"))
    return fx.quotes(spark, sf).select(
        "symbol", txt.analysis_prompt(symbol, data, "Study %s. ", "Be brief.").alias("prompt"))


# --- chat -------------------------------------------------------------------------------------

def context_sql(msgs: str, *views: str) -> str:
    return sql(f"""+ p AS (SELECT *, max(CASE WHEN NOT is_user THEN seq END) OVER (PARTITION BY session_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {msgs})
      SELECT p.id, p.session_id, CASE WHEN length(r.message) > 1000 THEN substring(r.message, 1, 1000) || '...' END
        AS context FROM p LEFT JOIN {msgs} r ON r.session_id = p.session_id AND r.seq = p.seen WHERE p.is_user""", *views)


@query("chat_context", context_sql("msgs", "msgs"))
def chat_context(spark, sf):
    return chat.chat_context(fx.chat_messages(spark, sf)).select("id", "session_id", "context")


@query("chat_context_hot_session", context_sql("hot_msgs", "hot_msgs"))
def _(spark, sf):
    return chat.chat_context(fx.hot_messages(spark, sf), hot_rows=50, block_rows=32).select("id", "session_id", "context")


@query("latest_context", sql("""SELECT session_id, CASE WHEN length(message) > 1000
    THEN substring(message, 1, 1000) || '...' END AS context FROM (SELECT *, row_number() OVER (
    PARTITION BY session_id ORDER BY seq DESC) AS n FROM msgs WHERE NOT is_user) WHERE n = 1""", "msgs"))
def _(spark, sf):
    return chat.latest_context(fx.chat_messages(spark, sf))


def in_order(df):
    """The place of each message in its session, by the order in which the operator gives the rows."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("_at"))
    return df.withColumn("_at", F.monotonically_increasing_id()).withColumn("place", place).drop("_at", "timestamp")


PLACE = "row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place"


@query("visible_history", sql(f"SELECT id, session_id, message, is_user, {PLACE} FROM msgs WHERE is_user OR length(message) <= 1000", "msgs"))
def _(spark, sf):
    return in_order(chat.chat_history(fx.chat_messages(spark, sf)))


@query("ordered_history", sql(f"SELECT id, session_id, message, is_user, {PLACE} FROM msgs", "msgs"))
def _(spark, sf):
    return in_order(chat.ordered_history(fx.chat_messages(spark, sf)))


@query("session_messages", sql("SELECT id, session_id, user_id, message FROM msgs JOIN sessions USING (session_id)", "msgs", "sessions"))
def _(spark, sf):
    return rel.session_messages(fx.chat_sessions(spark, sf), fx.chat_messages(spark, sf)).select(
        "id", "session_id", "user_id", "message")


@query("prompt_messages", f"""WITH msgs AS ({VIEWS['msgs']}), c AS ({context_sql('msgs', 'msgs')}),
    m AS (SELECT id, message, context FROM c JOIN msgs USING (id))
    SELECT id, 0::BIGINT AS pos, 'system' AS role, 'Be plain.' AS content FROM m
    UNION ALL SELECT id, 1::BIGINT, 'system', '{lookups.CONTEXT_LEAD}' || context FROM m WHERE context IS NOT NULL
    UNION ALL SELECT id, CASE WHEN context IS NULL THEN 1::BIGINT ELSE 2::BIGINT END, 'user', message FROM m""")
def _(spark, sf):
    asked = chat.chat_context(fx.chat_messages(spark, sf))
    built = chat.build_prompts(asked, "Be plain.").select("id", F.posexplode("messages").alias("pos", "m"))
    return built.select("id", "pos", "m.role", "m.content")


def _counted(messages: list[dict]) -> str:
    """Stands for a caller's text service, which fails where there is no context."""
    if len(messages) < 3:
        raise ValueError("no context")
    return f"{len(messages)} {len(messages[-1]['content'])}"


@query("respond", f"""WITH msgs AS ({VIEWS['msgs']}), rules AS ({VIEWS['rules']}), c AS ({context_sql('msgs', 'msgs')}),
    m AS (SELECT id, message, context FROM c JOIN msgs USING (id)),
    d AS (SELECT id, coalesce(min_by(tag, priority), 'nothing') AS fixed
          FROM m LEFT JOIN rules ON contains(lower(message), keyword) GROUP BY id)
    SELECT id, fixed, CASE WHEN context IS NULL THEN fixed ELSE '3 ' || CAST(length(message) AS VARCHAR) END AS response
    FROM m JOIN d USING (id)""")
def _(spark, sf):
    ordered = [(word, tag) for _, word, tag in RULES]
    built = chat.build_prompts(chat.chat_context(fx.chat_messages(spark, sf)), "Be plain.")
    offline = chat.respond(built, None, rules=ordered, default="nothing").withColumnRenamed("response", "fixed")
    return chat.respond(offline, _counted, rules=ordered, default="nothing").select("id", "fixed", "response")


@query("append_messages", sql("""+ k AS (SELECT id, CASE WHEN seq = 0 THEN sha256('7:' || CAST(id AS VARCHAR))
      ELSE session_id END AS session_id, seq FROM msgs)
    SELECT 'message' AS kind, id, session_id FROM k
    UNION ALL SELECT 'session', -1, session_id FROM sessions
    UNION ALL SELECT 'session', -1, session_id FROM k WHERE seq = 0""", "msgs", "sessions"))
def _(spark, sf):
    from marketlake.functions.scalars import session_key
    from marketlake.session import scratch_path

    msgs = fx.chat_messages(spark, sf).withColumns({
        "session_id": F.when(F.unix_seconds("timestamp") != 0, F.col("session_id")),
        "user_id": F.lit(7).cast("bigint")})
    key = session_key(F.col("user_id").cast("string"), F.col("id").cast("string"))
    log = chat.append_messages(msgs, fx.chat_sessions(spark, sf), key)
    path = scratch_path(spark, "messages")
    chat.write_messages(log.messages, path)
    return spark.read.parquet(path).select(F.lit("message").alias("kind"), "id", "session_id").unionByName(
        log.sessions.select(F.lit("session").alias("kind"), F.lit(-1).cast("bigint").alias("id"), "session_id"))
