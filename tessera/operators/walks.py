"""Recursive and per-group walks: chains, library closure, process order, module clustering."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.storage import kept


def chain_roots(edges: DataFrame) -> DataFrame:
    """`(id, resumes)` -> each id with the root its chain of resumptions ends in, and its depth. A chain that is a ring has no root: its ids have no row.

    Pointer doubling: what an id points to is replaced by what that points to, so a chain of n takes log2(n) rounds.
    """
    ids = edges.select("id").distinct()
    known = edges.where("resumes IS NOT NULL").select("id", F.col("resumes").alias("at"), F.lit(1).alias("depth"))
    # what is pointed to without being an id itself ends a chain
    at = kept(ids.join(known, "id", "left").select("id", F.coalesce("at", "id").alias("at"), F.coalesce("depth", F.lit(0)).alias("depth"), F.col("at").isNull().alias("done")))
    left = None
    while True:
        next_ = at.select(F.col("id").alias("at"), F.col("at").alias("__at"), F.col("depth").alias("__depth"), F.col("done").alias("__done"))
        moved = at.where("NOT done").join(next_, "at", "left").select("id", F.coalesce("__at", "at").alias("at"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), F.coalesce("__done", F.lit(True)).alias("done"))
        at = kept(at.where("done").unionByName(moved))
        before, left = left, at.where("NOT done").count()
        if left in (0, before):  # none, or only rings
            return at.where("done").select("id", F.col("at").alias("root"), "depth")


def library_closure(uses: DataFrame, repos: DataFrame) -> DataFrame:
    """The libraries that each project reaches, through libraries only, with the least number of steps.

    Each round joins what the last one found (not what all found) and drops what is seen, until nothing is new; there is no bound of
    steps, and rings end.
    """
    libraries = repos.where("library").select(F.col("name").alias("library"))
    edges = kept(uses.select("repo", F.col("uses").alias("library")).distinct().join(libraries, "library", "left_semi"))
    own = repos.where("NOT library").select(F.col("name").alias("repo"), "project")
    front = seen = kept(edges.join(own, "repo").select("project", "library", F.lit(1).alias("depth")).distinct())
    depth = 1
    while not front.isEmpty():
        depth += 1
        found = front.select("project", F.col("library").alias("repo")).join(edges, "repo").select("project", "library").distinct()
        front = kept(found.join(seen.select("project", "library"), ["project", "library"], "left_anti").select("project", "library", F.lit(depth).alias("depth")))
        seen = kept(seen.unionByName(front))
    return seen


def cluster(files: DataFrame, least: int = 8, most: int = 150) -> DataFrame:
    """`(repo, path, unit, chunks)` -> one row per file with its module.

    Files of a declared unit are its module. The other directories fold bottom-up, deepest first (ties: names from the end): a
    directory with enough chunks, or the top, is a module, a smaller one is carried to its parent; one that grows over the
    maximum hands out what it carries first. Files are summed up by directory before, and joined back after; only the
    directories of a repository, with two numbers each, are folded in Python.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        levels: dict[int, dict[str, list]] = {}  # by depth: directory -> its chunks, itself if it has files, what it carries

        def at(d: str) -> list:
            return levels.setdefault(0 if d == "." else d.count("/") + 1, {}).setdefault(d, [0, [], []])

        for d, n in zip(pdf.folder, pdf.chunks):
            at(d)[:2] = int(n), [d]
        out: list[tuple[str, int, list[str]]] = []
        for depth in range(max(levels, default=0), -1, -1):
            for d in sorted(levels.get(depth, {}), reverse=True):
                n, own, carried = levels[depth][d]
                size = n + sum(c for c, _, _ in carried)
                if size > most and carried:
                    out += [(name, c, ds) for c, name, ds in carried]
                    carried, size = [], n
                every = own + [x for _, _, ds in carried for x in ds]
                if every and (size >= least or d == "."):
                    out.append((d, size, every))
                elif every:
                    at(d.rpartition("/")[0] or ".")[2].append((size, d, every))
        rows = [(pdf.repo.iat[0], d, name, n) for name, n, ds in out for d in ds]
        return pd.DataFrame(rows, columns=["repo", "folder", "module", "chunks"])

    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    placed = files.select("repo", "path", "unit", "chunks", F.when(folder == "", ".").otherwise(folder).alias("folder"))
    rest = placed.where("unit IS NULL")
    sums = rest.groupBy("repo", "folder").agg(F.sum("chunks").alias("chunks"))
    folded = sums.groupBy("repo").applyInPandas(fold, "repo string, folder string, module string, chunks long")
    named = rest.select("repo", "path", "folder").join(folded, ["repo", "folder"]).select("repo", "path", "module", "chunks", F.lit(False).alias("declared"))
    units = placed.where("unit IS NOT NULL")
    named = named.union(units.join(units.groupBy("repo", "unit").agg(F.sum("chunks").alias("n")), ["repo", "unit"]).select("repo", "path", F.col("unit").alias("module"), F.col("n").cast("long"), F.lit(True)))
    files_of = named.groupBy("repo", "module", "declared").agg(F.count("*").alias("files"))
    return named.join(files_of, ["repo", "module", "declared"]).select("repo", "module", "chunks", "files", (F.col("chunks") > most).alias("oversized"), "path")


def breadth_first(nodes: list, flows: list) -> list[tuple[str, bool]]:
    """(node, reached): from the start nodes on, what is not reached last. `nodes`: (node, kind); `flows`: (source, target)."""
    after: dict[str, list[str]] = {}
    for s, t in sorted(flows):
        after.setdefault(s, []).append(t)
    queue = sorted(n for n, kind in nodes if kind == "start")
    seen = dict.fromkeys(queue)
    for n in queue:
        for t in after.get(n, []):
            if t not in seen:
                seen[t] = None
                queue.append(t)
    known = {n for n, _ in nodes}
    reached = [n for n in seen if n in known]
    return [(n, True) for n in reached] + [(n, False) for n in sorted(known - set(reached))]


def process_order(flows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of each process in breadth-first order. `flows(process, source, target)`, `nodes(process, node, kind)`; a process is one model's, so small."""
    n = nodes.groupBy("process").agg(F.collect_list(F.struct("node", "kind")).alias("nodes"))
    f = flows.groupBy("process").agg(F.collect_list(F.struct("source", "target")).alias("flows"))

    def walk(batches):
        for b in batches:
            rows = []
            for process, ns, fs in zip(*(b.column(i).to_pylist() for i in range(3))):
                walked = breadth_first([(x["node"], x["kind"]) for x in ns], [(x["source"], x["target"]) for x in fs or []])
                rows += [(process, node, i, reached) for i, (node, reached) in enumerate(walked)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["process", "node", "place", "reached"])

    return n.join(f, "process", "left").select("process", "nodes", "flows").mapInArrow(walk, "process string, node string, place long, reached boolean")
