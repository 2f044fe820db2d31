"""The evidence walk under a token budget, one DataFrame per phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paths, text
from tessera.operators import edges
from tessera.operators.running import running
from tessera.operators.storage import kept


def _admit(rows: DataFrame, taken: DataFrame, limit: int, by: list) -> DataFrame:
    """New rows in order while what is spent stays within the limit; the first that does not fit ends the phase (W03). Sums run over ranges of the order."""
    before, last = taken.agg(F.coalesce(F.sum("cost"), F.lit(0)), F.coalesce(F.max("place"), F.lit(-1))).first()
    new = rows.join(taken.select("chunk_id"), "chunk_id", "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*by))).where("nth = 1").drop("nth")
    out = running(new, by, __spent="cost", __nth=F.lit(1))
    placed = out.withColumns({"spent": F.col("__spent") + before, "place": F.col("__nth") + last})
    return placed.where(F.col("spent") <= limit).select("chunk_id", "file_id", "repo", "path", "hop", "reason", "cost", "place", "spent")


def gather(hits: DataFrame, chunks: DataFrame, symbols: DataFrame, crossings: DataFrame, budget: int, hops: int = 2) -> DataFrame:
    """`hits(chunk_id, file_id, repo, path, pos)` and what they lead to.

    Hits are always in, and their cost counts. Each hop takes the definitions that sources name (few definers, other files,
    tests last) up to the budget; then files that share a token with a source, crossed once per file, up to a sixth more; the far
    side is walked one reference further.
    """
    cost = text.token_estimate(F.col("raw_text"))
    body = chunks.select("chunk_id", "file_id", "repo", "path", cost.alias("cost"))
    first = running(hits.join(body.select("chunk_id", "cost"), "chunk_id"), ["pos"], __nth=F.lit(1), spent="cost")
    taken = kept(first.select("chunk_id", "file_id", "repo", "path", F.lit(0).alias("hop"), F.lit("hit").alias("reason"), "cost", (F.col("__nth") - 1).alias("place"), "spent"))
    few = edges.few_definers(symbols).select("name")
    defined = symbols.join(few, "name", "left_semi").select("name", F.col("file_id").alias("to_file")).distinct()
    named = edges.mentions(chunks).join(few, "name", "left_semi").select("file_id", "name").distinct()

    def references(sources: DataFrame, hop: int) -> DataFrame:
        to = sources.select("file_id", "place").withColumnRenamed("place", "from_place").join(named, "file_id").join(defined, "name").where("file_id <> to_file")
        return to.select("from_place", "name", F.col("to_file").alias("file_id")).join(body, "file_id").select("chunk_id", "file_id", "repo", "path", F.lit(hop).alias("hop"), F.concat(F.lit("names "), "name").alias("reason"), "cost", "from_place", paths.is_test(F.col("path")).alias("test"))

    by = ["from_place", "test", "repo", "path", "chunk_id", "reason"]
    last = taken
    for hop in range(1, hops + 1):
        last = kept(_admit(references(last, hop), taken, budget, by))
        taken = kept(taken.unionByName(last))
    first = taken.groupBy("file_id").agg(F.min("place").alias("from_place"))
    over = crossings.join(first.withColumnRenamed("file_id", "from_id"), "from_id").select("from_place", "file_id").join(body, "file_id")
    over = over.select("chunk_id", "file_id", "repo", "path", F.lit(hops + 1).alias("hop"), F.lit("shares a token").alias("reason"), "cost", "from_place", paths.is_test(F.col("path")).alias("test"))
    last = kept(_admit(over, taken, budget + budget // 6, by))
    taken = kept(taken.unionByName(last))
    return taken.unionByName(_admit(references(last, hops + 2), taken, budget + budget // 6, by))
