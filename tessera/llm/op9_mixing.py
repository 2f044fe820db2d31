"""Mixing sources to target weights.

Words are summed per source; sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of
all. A target stops at `MOST` times its source's words and what is left over is shared again by weight until no target
is above: so every target is min(MOST * words, level * weight) for one level, which running sums over the sources sorted
by MOST * words / weight give at once. A source's rate is target / words; each of its documents is emitted floor(rate)
times, plus one copy where a hash of seed and doc_id, read as a number in [0, 1), is below the fraction. Nothing depends
on partitions or order, so reruns and lost executors change nothing.

Only sizes are shuffled, summed per source in each task first, so a source with a third of the rows burdens no task. The
table of sources (one row each) is stored and joined back: Spark broadcasts it if its size allows and splits skewed
partitions otherwise.

Nulls and edge cases: a null or blank text has size 0; a source without words has target 0 and its documents are taken 0
times (in `mix` they are not emitted); null is a source of its own; rows with equal doc_id draw the same copy decision;
a null doc_id draws as the text "null"; an empty table gives an empty result; other columns pass through `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import hex_fraction, stored

WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """`(source, size)` rows -> one row per source: source, source_size, weight, target, rate."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1).cast("long"))
    # the first to be capped come first; those with no words at all are capped at 0
    by_cap = Window.orderBy(F.col("source_size") * MOST / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if this source and all after it were uncapped
    level = (F.sum("source_size").over(everything) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    tried = weighed.withColumn("level", level).withColumn("fits", F.col("source_size") * MOST >= F.col("level") * F.col("weight"))
    # the first source that is not capped sets the level of all after it
    settled = tried.withColumn("level", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull() | (F.col("source_size") * MOST <= F.col("level") * F.col("weight")), (F.col("source_size") * MOST).cast("double")).otherwise(F.col("level") * F.col("weight"))
    made = settled.select("source", "source_size", "weight", target.alias("target"))
    return stored(made.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    """How often a document is emitted: floor(rate), and once more where its hash is below the fraction."""
    draw = hex_fraction(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def plan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs(doc_id, source, text)`: doc_id, source, size, source_size, target, rate, copies, taken."""
    sized = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    per = targets(sized)
    joined = sized.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("copies", copies(F.col("doc_id"), F.col("rate"))).withColumn("taken", F.col("size") * F.col("copies")).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every row of `docs` as often as its source's rate says; columns as in `docs`."""
    per = targets(docs.select("source", words(F.col("text")).alias("size"))).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    joined = docs.join(per, docs["source"].eqNullSafe(F.col("__source")))
    many = joined.withColumn("__copies", copies(docs["doc_id"], F.col("__rate")))
    return many.withColumn("__copy", F.explode(F.array_repeat(F.lit(True), F.col("__copies").cast(T.IntegerType())))).select(*[docs[c] for c in docs.columns])


SQL = rf"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM per),
levels AS (SELECT *, (SELECT sum(source_size) FROM weighed)::DOUBLE AS total, source_size * {MOST} / weight AS ratio,
    coalesce(sum(source_size) OVER (ORDER BY source_size * {MOST} / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
    (sum(weight) OVER (ORDER BY source_size * {MOST} / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS uncapped FROM weighed),
tried AS (SELECT *, (total - {MOST} * capped) / uncapped AS level FROM levels),
chosen AS (SELECT level AS l FROM tried WHERE source_size * {MOST} >= level * weight ORDER BY ratio, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN l IS NULL OR source_size * {MOST} <= l * weight THEN (source_size * {MOST})::DOUBLE ELSE l * weight END AS target FROM tried LEFT JOIN chosen ON true),
rated AS (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || left(md5('{SEED}|' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 13))::BIGINT / {float(1 << 52)} AS draw
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""
