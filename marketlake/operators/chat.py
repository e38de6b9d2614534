"""Chat log operators: context, visible history, prompts and replies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlake import lookups
from marketlake.functions.scalars import session_key
from marketlake.functions.text import faq_answer
from marketlake.operators.groups import BLOCK_ROWS, HOT_ROWS, split_hot, with_places
from marketlake.session import stored

LIMIT = 1000
ORDER = ["timestamp", "id"]


def _reply(limit: int) -> Column:
    """What a non-user message gives as context, in a struct so that 'too short' differs from 'none'."""
    cut = F.when(
        F.length("message") > limit, F.concat(F.substring("message", 1, limit), F.lit("...")))
    return F.when(~F.col("is_user"), F.struct(cut.alias("context")))


def chat_context(msgs: DataFrame, limit: int = LIMIT, hot_rows: int = HOT_ROWS,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each user message with the context from the latest non-user message before it in its session.

    Only a message longer than ``limit`` is a context: its first ``limit`` characters and ``...``.
    """
    marked = msgs.withColumns({  # the whole text of a document goes no further than this
        "_reply": _reply(limit), "message": F.when(F.col("is_user"), F.col("message"))})
    split = split_hot(marked, ["session_id"], hot_rows)
    before = Window.partitionBy("session_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    done = split.calm.withColumn("_last", F.last("_reply", ignorenulls=True).over(before))
    if split.hot is not None:
        done = done.unionByName(_hot_context(split.hot, split.hot_total, block_rows))
    return done.filter("is_user").withColumn("context", F.col("_last.context")).drop("_last", "_reply")


def _hot_context(hot: DataFrame, total: int, block_rows: int) -> DataFrame:
    """Long sessions in blocks; a block without an earlier reply takes the last one of the blocks before."""
    placed = with_places(hot, ["session_id"], [F.col(c) for c in ORDER], total)
    blocks = placed.withColumn("_block", F.floor(F.col("_place") / block_rows))
    inside = Window.partitionBy("session_id", "_block").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, -1)
    ends = blocks.groupBy("session_id", "_block").agg(
        F.max_by("_reply", F.when(F.col("_reply").isNotNull(), F.col("_place"))).alias("_end"))
    earlier = Window.partitionBy("session_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "session_id", "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    return (
        blocks.withColumn("_near", F.last("_reply", ignorenulls=True).over(inside))
        .join(carried, ["session_id", "_block"], "left")
        .withColumn("_last", F.coalesce("_near", "_carried"))
        .drop("_near", "_carried", "_block", "_place")
    )


def latest_context(msgs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The context a session ends with. One row per session that has a non-user message."""
    return (
        msgs.filter(~F.col("is_user"))
        .select("session_id", F.struct(*ORDER).alias("at"), _reply(limit).alias("reply"))
        .groupBy("session_id").agg(F.max_by("reply", "at").alias("reply"))
        .select("session_id", F.col("reply.context").alias("context"))
    )


def ordered_history(msgs: DataFrame) -> DataFrame:
    return msgs.orderBy("session_id", *ORDER)


def chat_history(msgs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Messages to show: long non-user messages (uploaded documents) are left out."""
    return ordered_history(msgs.filter(~((F.length("message") > limit) & ~F.col("is_user"))))


def build_prompts(requests: DataFrame, system_text: str, message: str = "message",
                  context: str | None = "context") -> DataFrame:
    """Add ``messages``: system text, the context if there is one, and the user's message."""
    def part(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))
    parts = [part("system", F.lit(system_text))]
    if context:
        lead = part("system", F.concat(F.lit(lookups.CONTEXT_LEAD), F.col(context)))
        parts.append(F.when(F.coalesce(F.col(context), F.lit("")) != "", lead))
    parts.append(part("user", F.col(message)))
    return requests.withColumn("messages", F.array_compact(F.array(*parts)))


Responder = Callable[[list[dict]], str]


def respond(prompts: DataFrame, fn: Responder | None = None, message: str = "message",
            rules: Sequence[tuple[str, str]] = lookups.FAQ, default: str = lookups.FAQ_DEFAULT) -> DataFrame:
    """Add ``response`` from the caller's function; where it fails or gives nothing, from the rules.

    Without a function the answer is made of columns only and no Python worker starts.
    """
    fallback = faq_answer(F.col(message), rules, default)
    if fn is None:
        return prompts.withColumn("response", fallback)

    @F.pandas_udf("string")
    def ask(batch: pd.Series) -> pd.Series:
        return batch.map(answer)

    def answer(messages) -> str | None:
        try:
            return fn([{"role": m["role"], "content": m["content"]} for m in messages])
        except Exception:
            return None

    return prompts.withColumn("response", F.coalesce(ask("messages"), fallback))


class Log(NamedTuple):
    messages: DataFrame
    sessions: DataFrame


def append_messages(msgs: DataFrame, sessions: DataFrame, key: Column | None = None) -> Log:
    """Rows to append for new messages; a message without a session opens one of its own.

    The keys are random, so the keyed rows are written out once before both results read them.
    """
    fresh = F.coalesce(F.col("session_id"), F.lit("")) == ""
    keyed = stored(msgs.withColumn("_fresh", fresh).withColumn(
        "session_id", F.when(fresh, session_key() if key is None else key).otherwise(F.col("session_id"))), "messages")
    opened = keyed.filter("_fresh").select(
        "user_id", "session_id", F.col("timestamp").alias("created_at"),
        F.col("timestamp").alias("last_interaction"))
    return Log(
        keyed.select("id", "session_id", "message", "is_user", "timestamp"),
        sessions.select(*opened.columns).unionByName(opened),
    )


def write_messages(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
