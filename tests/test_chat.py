import random

import pytest
from pyspark.sql import functions as F

from marketlake import lookups
from marketlake.operators import chat

LONG = "x" * 1001


def frame(spark, rows):
    df = spark.createDataFrame(rows, "id long, session_id string, message string, is_user boolean, t long")
    return df.withColumn("timestamp", F.timestamp_seconds("t")).drop("t")


def one_by_one(rows, limit=1000):
    last, out = {}, {}
    for id_, session, message, is_user, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        if is_user:
            before = last.get(session)
            out[id_] = before[:limit] + "..." if before is not None and len(before) > limit else None
        else:
            last[session] = message
    return out


def got(df):
    return {r.id: r.context for r in df.collect()}


def test_length_limit_is_exact(spark):
    rows = [(1, "a", "y" * 1000, False, 1), (2, "a", "q", True, 2), (3, "b", LONG, False, 1), (4, "b", "q", True, 2)]
    assert got(chat.chat_context(frame(spark, rows))) == {2: None, 4: "x" * 1000 + "..."}


def test_short_reply_shadows_the_document(spark):
    rows = [(1, "a", LONG, False, 1), (2, "a", "q", True, 2), (3, "a", "ok", False, 3), (4, "a", "q", True, 4)]
    assert got(chat.chat_context(frame(spark, rows))) == {2: "x" * 1000 + "...", 4: None}
    assert chat.latest_context(frame(spark, rows)).first().context is None


@pytest.mark.parametrize("seed", range(3))
def test_hot_session_in_blocks(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        user = rng.random() < 0.97 if i > 200 else rng.random() < 0.5  # long stretches without a reply
        rows.append((i, "hot" if i % 3 else f"s{i % 7}", "m" * rng.choice([3, 1000, 1001, 1500]), user, i // 2))
    want = one_by_one(rows)
    assert got(chat.chat_context(frame(spark, rows))) == want
    assert got(chat.chat_context(frame(spark, rows), hot_rows=50, block_rows=16)) == want


def test_visible_history_hides_documents_only(spark):
    rows = [(1, "a", LONG, False, 1), (2, "a", LONG, True, 2), (3, "a", "y" * 1000, False, 3)]
    assert [r.id for r in chat.chat_history(frame(spark, rows)).collect()] == [2, 3]


def test_prompts_with_and_without_context(spark):
    rows = spark.createDataFrame([(1, "hi", "doc..."), (2, "hi", None), (3, "hi", "")], "id long, message string, context string")
    built = {r.id: [(m.role, m.content) for m in r.messages] for r in chat.build_prompts(rows, "SYS").collect()}
    assert built[1] == [("system", "SYS"), ("system", lookups.CONTEXT_LEAD + "doc..."), ("user", "hi")]
    assert built[2] == built[3] == [("system", "SYS"), ("user", "hi")]


def test_respond_falls_back_per_row(spark):
    rows = spark.createDataFrame(
        [(1, "What is a STOCK?", None), (2, "hello", None), (3, "what is a dividend", "c")],
        "id long, message string, context string")
    built = chat.build_prompts(rows, "SYS")

    def fn(messages):
        if len(messages) == 3:
            raise RuntimeError("down")
        return None if "hello" in messages[-1]["content"] else "from fn"

    answers = {r.id: r.response for r in chat.respond(built, fn).collect()}
    faq = dict(lookups.FAQ)
    assert answers == {1: "from fn", 2: lookups.FAQ_DEFAULT, 3: faq["what is a dividend"]}
    offline = chat.respond(built)
    assert {r.id: r.response for r in offline.collect()}[1] == faq["what is a stock"]
    assert "Python" not in offline._jdf.queryExecution().executedPlan().toString()


def test_missing_session_is_opened_once(spark):
    rows = spark.createDataFrame(
        [(1, "s1", 7, "a", True), (2, None, 7, "b", True), (3, "", 8, "c", True)],
        "id long, session_id string, user_id long, message string, is_user boolean").withColumn(
        "timestamp", F.timestamp_seconds(F.col("id")))
    known = spark.createDataFrame([(7, "s1")], "user_id long, session_id string").withColumns(
        {"created_at": F.timestamp_seconds(F.lit(0)), "last_interaction": F.timestamp_seconds(F.lit(0))})
    log = chat.append_messages(rows, known)
    sessions = {r.session_id: r.user_id for r in log.sessions.collect()}
    keys = {r.id: r.session_id for r in log.messages.collect()}
    assert len(sessions) == 3 and keys[1] == "s1" and keys[2] != keys[3]
    assert sessions[keys[2]] == 7 and sessions[keys[3]] == 8
    assert keys == {r.id: r.session_id for r in log.messages.collect()}
