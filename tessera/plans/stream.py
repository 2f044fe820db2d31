"""Queries over streams: the incremental index equals the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paths
from tessera.operators.storage import shared_dir
from tessera.plans.fixtures import Corpus, sql
from tessera.plans.search import _out
from tessera.streaming import answers, feed, mirrors


def _scratch(spark) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"


def _feed(c: Corpus):
    e = c.table("events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("repo"), F.hex("event_id").alias("sha"), F.concat(F.lit("f"), (F.col("event_id") % 50).cast("string"), F.lit(".go")).alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("props").alias("body"))


def q04_incremental(spark, sf_dir):
    """Three landings of changes, in their order, applied as they come."""
    folder, rows = _scratch(spark), _feed(Corpus(spark, sf_dir))
    third = rows.agg(F.max("seq")).first()[0] / 3
    store = mirrors.Mirrors(spark, f"{folder}/store", {"files": mirrors.FILES})
    for i in range(3):
        rows.where((F.col("seq") > i * third - (i == 0)) & (F.col("seq") <= (i + 1) * third)).write.mode("append").parquet(f"{folder}/landed")
        feed.run(spark, f"{folder}/landed", store, f"{folder}/offsets")
    return _out(store.visible("files"), "repo", "path", "sha", "size", "skip_reason")


def s21_one_file(spark, sf_dir):
    """Two landings of documents as files, each path put twice or deleted: what the tables of mirrors hold of each file after."""
    folder, d = _scratch(spark), Corpus(spark, sf_dir).table("documents")
    rows = d.select(F.col("doc_id").alias("seq"), F.col("source").alias("repo"), F.hex("doc_id").alias("sha"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 40).cast("string"), F.lit(".go")).alias("path"), F.when(F.col("doc_id") % 9 == 0, "delete").otherwise("put").alias("op"), F.col("text").alias("body"))
    half = rows.agg(F.max("seq")).first()[0] // 2
    store = mirrors.Mirrors(spark, f"{folder}/store", mirrors.TABLES)
    for part in (F.col("seq") <= half, F.col("seq") > half):
        rows.where(part).write.mode("append").parquet(f"{folder}/landed")
        feed.run(spark, f"{folder}/landed", store, f"{folder}/offsets")
    held = store.visible("files").select("repo", "path", "size", "skip_reason")
    reach = store.visible("chunks").groupBy("repo", "path").agg(F.max("last").alias("last_line"))
    words = store.visible("keywords").groupBy("repo", "path").agg(F.count_distinct("term").alias("vocabulary"))
    both = held.join(reach, ["repo", "path"], "left").join(words, ["repo", "path"], "left")
    return _out(both.select("repo", "path", "size", "skip_reason", F.coalesce("last_line", F.lit(0)).alias("last_line"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary")), "repo", "path", "size", "skip_reason", "last_line", "vocabulary")


_BODY = "concat('see [7], [3]\n', {0}, '\nx [1] and [7, 1]\n```\n[3]\n```\n[99] [3]')"


def q09_streamed_answers(spark, sf_dir):
    """Q09: answers in pieces of eleven characters that land in three parts; each part is read by a stream that was started anew."""
    folder, m = _scratch(spark), Corpus(spark, sf_dir).messages().where("answer IS NOT NULL")
    body = m.select(F.col("message_id").alias("answer_id"), F.expr(_BODY.format("answer")).alias("body")).withColumn("n", F.ceil(F.char_length("body") / 11))
    seq = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    pieces = body.select("answer_id", "body", "n", seq.alias("seq")).select("answer_id", "seq", F.substring("body", F.col("seq").cast("int") * 11 + 1, F.lit(11)).alias("piece"), F.lit(9).alias("known"), (F.col("seq") == F.col("n") - 1).alias("last"), F.floor(F.col("seq") * 3 / F.col("n")).alias("part"))
    pieces = pieces.persist()
    for part in range(3):
        pieces.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/landed")
        answers.landed(spark, f"{folder}/landed", answers.PIECES, answers.renumbered, f"{folder}/out", f"{folder}/offsets")
    pieces.unpersist()
    said = spark.read.schema(answers.READY).parquet(f"{folder}/out").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "numbers"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return _out(said.select(F.col("answer_id").alias("message_id"), F.md5(whole.cast("binary")).alias("digest"), F.char_length(whole).alias("n_chars"), F.array_join(F.element_at("p", -1)["numbers"], ",").alias("numbers")), "message_id", "digest", "n_chars", "numbers")


def q10_usage_meter(spark, sf_dir):
    """Q10: calls of turns in two landings; a purchase closes a turn, the others end when nothing is heard of them for ten days of the stream."""
    folder, e = _scratch(spark), Corpus(spark, sf_dir).table("events")
    k = F.get_json_object("props", "$.k").cast("long")
    close = F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(Window.partitionBy("turn"))
    calls = e.withColumn("turn", F.col("user_id") * 100_000 + F.floor(F.col("event_id") / 500)).withColumn("close", close).where("close IS NULL OR event_id <= close")
    calls = calls.select("turn", F.col("event_type").alias("step"), F.col("ts").cast("timestamp").alias("ts"), (k * 10).alias("prompt"), k.alias("completion"), F.when(F.col("event_id") % 3 != 0, F.floor(k / 2)).alias("cached"), (F.col("event_type") == "purchase").alias("closes"), "event_id")
    half, last = calls.agg(F.max("event_id"), F.max("ts")).first()
    end = spark.createDataFrame([(-1, "end", last, 0, 0, None, False)], answers.CALLS).withColumn("ts", F.expr("ts + INTERVAL 40 DAYS"))  # moves the watermark beyond all
    run = lambda: answers.landed(spark, f"{folder}/landed", answers.CALLS, lambda s: answers.metered(s, "10 days", "400 days"), f"{folder}/out", f"{folder}/offsets")
    for part in (calls.where(F.col("event_id") * 2 <= half), calls.where(F.col("event_id") * 2 > half), end.withColumn("ts", F.expr("ts + INTERVAL 400 DAYS"))):
        part.select(*(f.split(" ")[0] for f in answers.CALLS.split(", "))).write.mode("append").parquet(f"{folder}/landed")
        run()
    return _out(spark.read.schema(answers.METER).parquet(f"{folder}/out").where("turn >= 0"), "turn", "calls", "prompt", "completion", "cached", "abandoned")


def q10_sessions(spark, sf_dir):
    """Q10: steps of each user: calls, and the time from the first to the last."""
    e = Corpus(spark, sf_dir).table("events")
    g = e.groupBy("user_id").agg(F.count("*").alias("steps"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"))
    return _out(g, "user_id", "steps", "micros")


QUERIES = [q04_incremental, s21_one_file, q09_streamed_answers, q10_usage_meter, q10_sessions]
_SECRET = " OR ".join(f"regexp_matches(body, '{p}')" for p in paths.SECRET_SHAPES)
SQL = {
    "q09_streamed_answers": sql("""b AS (SELECT message_id, 'see [1], [2]' || chr(10) || answer || chr(10) || 'x [3] and [1, 3]' || chr(10) || '```' || chr(10) || '[3]' || chr(10) || '```' || chr(10) || '[99] [2]' AS body FROM messages WHERE answer IS NOT NULL)
        SELECT message_id, md5(body) AS digest, CAST(length(body) AS BIGINT) AS n_chars, '7,3,1' AS numbers FROM b""", "messages"),
    "q10_usage_meter": """WITH e AS (SELECT *, user_id * 100000 + event_id // 500 AS turn, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
        c AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY turn) AS closing FROM e)
        SELECT turn, count(*) AS calls, CAST(sum(k * 10) AS BIGINT) AS prompt, CAST(sum(k) AS BIGINT) AS completion, CAST(sum(CASE WHEN event_id % 3 <> 0 THEN k // 2 END) AS BIGINT) AS cached, any_value(closing) IS NULL AS abandoned
        FROM c WHERE closing IS NULL OR event_id <= closing GROUP BY turn""",
    "s21_one_file": rf"""WITH f AS (SELECT source AS repo, 'f' || CAST(doc_id // 40 AS VARCHAR) || '.go' AS path, doc_id % 9 = 0 AS gone, coalesce(text, '') AS body FROM documents QUALIFY row_number() OVER (PARTITION BY source, doc_id // 40 ORDER BY doc_id DESC) = 1),
        s AS (SELECT repo, path, body, CASE WHEN strlen(body) > {paths.MOST_BYTES} THEN 'too_large' WHEN {_SECRET} THEN 'secret' WHEN regexp_matches(left(body, 2048), '{paths.GENERATED_MARK}') THEN 'generated' ELSE '' END AS skip_reason FROM f WHERE NOT gone)
        SELECT repo, path, strlen(body)::BIGINT AS size, skip_reason, CASE WHEN skip_reason = '' THEN len(string_split(body, chr(10))) ELSE 0 END::BIGINT AS last_line,
            CASE WHEN skip_reason = '' THEN len(list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(body)), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''))) ELSE 0 END::BIGINT AS vocabulary FROM s""".replace("\\\\", "\\"),
    "q04_incremental": "WITH f AS (SELECT 'u' || CAST(user_id % 20 AS VARCHAR) AS repo, 'f' || CAST(event_id % 50 AS VARCHAR) || '.go' AS path, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20, event_id % 50 ORDER BY event_id DESC) = 1) SELECT repo, path, sha256(props) AS sha, strlen(props)::BIGINT AS size, '' AS skip_reason FROM f WHERE event_type <> 'error'",
    "q10_sessions": "SELECT user_id, count(*) AS steps, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM events GROUP BY 1",
}
