"""Rows to text (A23, E12, E13, G13, G17, F22, F37-F41): listings and blocks in a defined order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def joined(rows: DataFrame, keys: list[str], by: list[str], line: Column, separator: str = "\n") -> DataFrame:
    """Lines of a group in order."""
    items = F.array_sort(F.collect_list(F.struct(*by, line.alias("__line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(items, lambda s: s["__line"]), separator).alias("text"))


def source_list(sources: DataFrame) -> DataFrame:
    """Numbered sources of a turn: `[n] repo/path:first-last`."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("hop", "repo", "path", "first"))
    rows = sources.withColumn("n", n)
    return joined(rows, ["id"], ["n"], F.format_string("[%d] %s/%s:%d-%d", F.col("n"), "repo", "path", "first", "last"))


def structure(repos: DataFrame) -> DataFrame:
    """Projects with their repositories."""
    return joined(repos, ["project"], ["name"], F.concat(F.lit("- "), "name", F.when(F.col("library"), F.lit(" (library)")).otherwise(F.lit("")), F.when(~F.col("enabled"), F.lit(" (parked)")).otherwise(F.lit(""))))


def unit_text(units: DataFrame, deps: DataFrame) -> DataFrame:
    """Each unit with what it uses."""
    uses = joined(deps, ["repo", "from"], ["to"], F.col("to"), ", ").select("repo", F.col("from").alias("key"), F.col("text").alias("uses"))
    return units.join(uses, ["repo", "key"], "left").select("repo", "key", F.concat("key", F.lit(": "), "kind", F.coalesce(F.concat(F.lit(", uses "), "uses"), F.lit(""))).alias("text"))


def called(processes: DataFrame, budget: int = 16_000) -> DataFrame:
    """`(process, calls, body)`: bodies of called processes of the same repository, while they fit."""
    other = processes.select("repo", F.col("process").alias("calls"), F.col("body").alias("called_body"))
    pairs = processes.where("calls <> ''").join(other, ["repo", "calls"]).where("process <> calls")
    run = Window.partitionBy("repo").orderBy("process", "calls").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pairs.withColumn("spent", F.sum(F.char_length("called_body")).over(run)).where(F.col("spent") <= budget)


def route_of(literal: Column) -> Column:
    """the path of a URL or template literal: without scheme and host, placeholders as {}."""
    path = F.regexp_replace(F.regexp_replace(literal, r"^[a-z]+://[^/]*", ""), r"\$\{[^}]*\}", "{}")
    return F.regexp_extract(path, r"^([^?#]*)", 1)


def diagram_kind(body: Column) -> Column:
    """the kind of the first fenced block, empty if there is none."""
    return F.lower(F.regexp_extract(body, r"(?s)(?:^|\n)```[ \t]*([A-Za-z]+)", 1))


def edge_reason(kind: Column, value: Column, file: Column) -> Column:
    """F41."""
    return F.concat(F.lit("edge:"), kind, F.lit(" "), value, F.lit(" from "), file)


def edge_parts(reason: Column) -> Column:
    """F41, read back: (kind, value, file)."""
    p = r"^edge:(\S+) (.*) from (.*)$"
    return F.struct(F.regexp_extract(reason, p, 1).alias("kind"), F.regexp_extract(reason, p, 2).alias("value"), F.regexp_extract(reason, p, 3).alias("file"))


def day_count(text: Column) -> Column:
    """days in a tolerant spelling: digits anywhere, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d{1,4})", 1), F.lit("")), F.lit("9999")).cast("int")
