"""Fusion and ordering of lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paths
from tessera.operators.lanes import ADDRESS, PLACES

RRF, TEST_DECAY, DOC_DECAY = 60, 0.35, 0.7


def lane(rows: DataFrame, name: str, weight: float, pos: int) -> DataFrame:
    """A lane's ranked chunks, marked with its name, weight and place among lanes."""
    distance = F.col("distance") if "distance" in rows.columns else F.lit(None).cast("double")
    return rows.select(*ADDRESS, "rank", distance.alias("distance"), F.lit(name).alias("lane"), F.lit(float(weight)).alias("weight"), F.lit(pos).alias("lane_pos"))


def fuse(lanes: DataFrame) -> DataFrame:
    """The sum of weight / (60 + rank) per chunk, its lanes in order of appearance, its first distance that is not 0."""
    open_ = lanes.where("weight > 0")
    seen = F.array_sort(F.collect_list(F.struct("lane_pos", "lane", "distance")))
    total = open_.groupBy(*ADDRESS).agg(F.sum(F.col("weight") / (RRF + F.col("rank"))).alias("score"), seen.alias("seen"))
    distances = F.filter(F.col("seen.distance"), lambda d: d.isNotNull() & (d != 0))
    return total.select(*ADDRESS, "score", F.array_join(F.array_distinct("seen.lane"), ",").alias("lanes"), F.coalesce(F.try_element_at(distances, F.lit(1)), F.lit(0.0)).alias("distance"))


def supporting(path: Column, test: float = TEST_DECAY, doc: float = DOC_DECAY) -> Column:
    """The factor of tests; that of documents only if it is smaller."""
    factor = F.when(paths.is_test(path), F.lit(test)).otherwise(F.lit(1.0))
    return F.when(paths.is_doc(path), F.least(factor, F.lit(doc))).otherwise(factor)


def ordered(fused: DataFrame, k: int = 10, repo_decay: float = 1.0, test: float = TEST_DECAY, doc: float = DOC_DECAY) -> DataFrame:
    """Decays, score then address, then repository decay (W10), then the first k with their rank."""
    scored = fused.withColumn("score", F.round(F.col("score") * supporting(F.col("path"), test, doc), 9))
    if repo_decay < 1.0:
        # picking the best of score * decay^(taken so far) is sorting by it, as scores fall within a repository
        place = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("score"), *ADDRESS)) - 1
        scored = scored.withColumn("decayed", F.round(F.col("score") * F.pow(F.lit(repo_decay), place), 9))
    else:
        scored = scored.withColumn("decayed", F.col("score"))
    top = scored.orderBy(F.desc("decayed"), F.desc("score"), *ADDRESS).limit(k or 10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("decayed"), F.desc("score"), *ADDRESS)) - 1)


def apply_picks(fused: DataFrame, picks: DataFrame, k: int) -> DataFrame:
    """`fused(rank, ...)` in the order of valid, unique 1-based `picks(pos, pick)`; the rest follows in fused order; no valid pick keeps it all."""
    n = fused.select("rank")
    valid = picks.join(n.select((F.col("rank") + 1).alias("pick")), "pick").groupBy("pick").agg(F.min("pos").alias("pos"))
    joined = fused.join(valid.select((F.col("pick") - 1).alias("rank"), "pos"), "rank", "left")
    by = Window.orderBy(F.col("pos").isNull(), "pos", "rank")
    return joined.withColumn("new_rank", F.row_number().over(by) - 1).where(F.col("new_rank") < k).drop("pos")


def module_score(hits: DataFrame, how: str, alpha: float = 0.15) -> DataFrame:
    """`hits(chunk_id, module, score, ...)` scored by what their module gathers: sum, best, count or blend."""
    w = Window.partitionBy("module")
    score = {
        "sum": F.sum("score").over(w),
        "best": F.max("score").over(w),
        "count": F.count("*").over(w).cast("double"),
        "blend": F.col("score") * (1 + alpha * F.log1p((F.count("*").over(w) - 1).cast("double"))),
    }[how]
    return hits.withColumn("module_score", F.round(score, PLACES))
