"""Conversations: shares, feedback, pages, search and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.lanes import bm25, counted
from tessera.operators.running import ranked
from tessera.operators.tables import latest


def share_ceiling(messages: DataFrame) -> DataFrame:
    """Per thread, the last finished message before the first unfinished one; one pass."""
    g = messages.groupBy("thread_id").agg(F.min(F.when(F.col("answer").isNull(), F.col("message_id"))).alias("open"), F.array_sort(F.collect_list(F.when(F.col("answer").isNotNull(), F.col("message_id")))).alias("done"))
    below = F.filter("done", lambda m: F.col("open").isNull() | (m < F.col("open")))
    return g.select("thread_id", F.array_max(below).alias("ceiling"))


def share_counts(messages: DataFrame, ceilings: DataFrame) -> DataFrame:
    """A10: messages up to the ceiling and beyond."""
    m = messages.join(ceilings, "thread_id")
    return m.groupBy("thread_id").agg(F.count_if(F.col("message_id") <= F.col("ceiling")).alias("shared"), F.count_if(~F.coalesce(F.col("message_id") <= F.col("ceiling"), F.lit(False))).alias("beyond"))


def feedback_anchor(messages: DataFrame) -> DataFrame:
    """A12."""
    return messages.where("answer IS NOT NULL").groupBy("thread_id").agg(F.max("message_id").alias("anchor"))


def orphans(messages: DataFrame, clarifications: DataFrame) -> DataFrame:
    """Turns with neither an answer nor a clarification."""
    return messages.where("answer IS NULL").join(clarifications.select("message_id"), "message_id", "left_anti")


def usage_report(usage: DataFrame) -> DataFrame:
    """Totals per step; `cached` and `usd` are null where no call reported them."""
    return usage.groupBy("step").agg(F.count("*").alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("cached").alias("cached"), (F.sum("cost_nano") / 1e9).alias("usd"))


def page(threads: DataFrame, after: int | None, size: int = 30) -> DataFrame:
    """The next page below a cursor; a full page carries the next cursor, a cursor of nobody gives no rows."""
    size = max(1, min(size, 1000))
    rows = threads
    if after is not None:
        known = threads.where(F.col("thread_id") == after).agg(F.count("*").alias("n"))
        rows = threads.where(F.col("thread_id") < after).crossJoin(F.broadcast(known)).where("n > 0").drop("n")
    top = rows.orderBy(F.desc("thread_id")).limit(size)
    return top.withColumn("n", F.count("*").over(Window.partitionBy())).withColumn("next", F.when(F.col("n") == size, F.min("thread_id").over(Window.partitionBy()))).drop("n")


def last_turn(messages: DataFrame, before: DataFrame) -> DataFrame:
    """The last finished turn before an ordinal, of each thread."""
    m = messages.where("answer IS NOT NULL").join(before, "thread_id").where("ordinal < before")
    return m.groupBy("thread_id").agg(F.max_by(F.struct("message_id", "ordinal"), "ordinal").alias("m")).select("thread_id", "m.*")


def said(messages: DataFrame) -> DataFrame:
    """What is searched of messages: `message_id`, `body`."""
    return messages.select("message_id", F.concat_ws(" ", "question", "answer").alias("body"))


def thread_search(threads: DataFrame, messages: DataFrame, terms: list[str], n: int | None = 200, titles=None, bodies=None) -> DataFrame:
    """Threads whose title matches, newest first, then those whose messages do, by bm25; a thread once. The first `n`, or with None all that match, ranked in ranges. `titles`, `bodies`: postings of the titles and of `said(messages)`, else they are counted here."""
    asked = [(terms, True)]
    titled = bm25(titles.counted(asked, "thread_id") if titles else counted(threads.select("thread_id", "title"), asked, "thread_id", "title"), terms, True, True).select("thread_id", F.lit(0).alias("place"), F.lit(0.0).alias("score"))
    scored = bm25(bodies.counted(asked, "message_id") if bodies else counted(said(messages), asked, "message_id", "body"), terms, True, True)
    found = scored.join(messages.select("message_id", "thread_id"), "message_id").groupBy("thread_id").agg(F.max("score").alias("score")).select("thread_id", F.lit(1).alias("place"), "score")
    once = latest(titled.unionByName(found), ["thread_id"], ["place"])
    by = [F.col("place"), F.desc("score"), F.desc("thread_id")]
    if n is None:
        return ranked(once, by).withColumn("rank", F.col("rank") - 1)
    return once.orderBy(*by).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*by)) - 1)


#: Reasons that a verdict may carry.
REASONS = ("", "wrong", "incomplete", "missed_code", "too_long", "wrong_repo")


def feedback(held: DataFrame, given: DataFrame, messages: DataFrame, owners: DataFrame) -> DataFrame:
    """`given(thread_id, user, verdict, reason)` replaces earlier verdicts, pinned to the newest finished, error-free answer; unknown reasons, threads of others and threads without such an answer change nothing."""
    newest = messages.where("answer <> '' AND error = ''").groupBy("thread_id").agg(F.max("message_id").alias("up_to"))
    sound = given.where(F.col("reason").isin(*REASONS)).join(owners.select("thread_id", "user"), ["thread_id", "user"], "left_semi").join(newest, "thread_id").select("thread_id", "verdict", "reason", "up_to")
    return held.join(sound.select("thread_id"), "thread_id", "left_anti").unionByName(sound)


def cited(wanted: DataFrame, citations: DataFrame, messages: DataFrame, ceilings: DataFrame | None = None) -> DataFrame:
    """Whether a turn of `thread_id`, up to its share's ceiling if there is one, cites exactly (repo, path, sha, kind)."""
    turns = messages.select("message_id", "thread_id")
    if ceilings is not None:
        turns = turns.join(ceilings, "thread_id").where("message_id <= ceiling").select("message_id", "thread_id")
    keys = ["thread_id", "repo", "path", "sha", "kind"]
    found = citations.join(turns, "message_id").select(*keys).distinct().withColumn("cited", F.lit(True))
    return wanted.join(found, keys, "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
