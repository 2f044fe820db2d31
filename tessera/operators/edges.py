"""Edges between files (J04-J17, G01, G03-G07): shared tokens, symbols, includes, and what is reached over them.

Token and symbol tables hold only rows of enabled repositories (P02): restrict them before calling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators.running import running
from tessera.operators.storage import kept

SPREAD, DEFINERS, FAN_OUT = 3, 4, 24
#: Kinds that never lead from one file to another by value.
NO_EDGE = ("link", "image", "include")


def spread(tokens: DataFrame) -> DataFrame:
    """In how many repositories each (kind, value) stands."""
    return tokens.groupBy("kind", "value").agg(F.countDistinct("repo").alias("spread"))


def narrow(tokens: DataFrame, most: int = SPREAD) -> DataFrame:
    """The tokens whose value stands in few repositories: a window-free semi-join of the aggregate."""
    return tokens.join(spread(tokens).where(F.col("spread") <= most).select("kind", "value"), ["kind", "value"], "left_semi")


#: rows of one side that a task's share of a key has at most, and pairs that a task makes about
BLOCK, PAIRS = 1024, 1 << 22


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """An inner join whose keys have many rows on both sides. A key's left rows are dealt into blocks by the hash of `by`, its right rows go to each of them, so no task has a whole key; there are as many tasks as the
    pairs ask for, however little is moved. Both sides are read twice: keep them before."""
    spark = left.sparkSession
    sizes = left.groupBy(*keys).agg(F.count("*").alias("n")).join(right.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    pairs = sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))
    blocks = sizes.select(*keys, F.ceil(F.col("n") / BLOCK).alias("blocks"))
    ask = left.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64(*by), F.col("blocks"))).drop("blocks")
    have = right.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    return ask.repartition(tasks, *keys, "block").join(have.repartition(tasks, *keys, "block").hint("shuffle_merge"), [*keys, "block"]).drop("block")


def neighbours(tokens: DataFrame, most: int = SPREAD) -> DataFrame:
    """Pairs of places that share a token of small spread: other repositories, or property keys from code to a properties file of the same one.

    Places ask each repository that has the value, so only pairs that count are made, by equality and in blocks of a value's places.
    """
    few = kept(narrow(_leading(tokens), most))
    stands = few.select("kind", "value", F.col("repo").alias("far_repo")).distinct()
    other = few.join(stands, ["kind", "value"]).where("repo <> far_repo").withColumn("own", F.lit(False))
    own = few.where(_from_code()).withColumn("far_repo", F.col("repo")).withColumn("own", F.lit(True))
    pairs = _dealt(other.unionByName(own), _answering(few), _MEET, "path", "line")
    return pairs.select("kind", "value", "repo", "path", "line", "far_repo", "far_path", "far_line")


def numbered_neighbours(tokens: DataFrame, rank: Column, most: int = SPREAD) -> DataFrame:
    """`neighbours` with `nth`, their number in each repository by `rank` (of a kind), kind, value, place and far place. No window is over pairs: a pair's number is the pairs of places before its own, from running sums over places,
    and those before it of its own place, from the numbers of far places in each repository that has the value."""
    few = kept(narrow(_leading(tokens), most))
    met = Window.partitionBy(*_MEET).orderBy("far_path", "far_line")
    have = kept(_answering(few).withColumn("within", F.row_number().over(met) - 1))
    places = few.groupBy("kind", "value", "repo", "path", "line").agg(F.count("*").alias("copies")).withColumn("code", _from_code())
    # what each kind of place meets: far repositories in their order, each after as many far places as the ones before have
    sizes = have.groupBy(*_MEET).agg(F.count("*").alias("size"))
    alike = ["kind", "value", "repo", "code"]
    listed = places.select(*alike).distinct().join(sizes, ["kind", "value"]).where("(repo <> far_repo AND NOT own) OR (repo = far_repo AND own AND code)")
    upto = Window.partitionBy(*alike).orderBy("far_repo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = kept(listed.withColumn("offset", F.sum("size").over(upto) - F.col("size")))
    counted = places.join(listed.groupBy(*alike).agg(F.sum("size").alias("meets")), alike).withColumn("made", F.col("copies") * F.col("meets")).withColumn("rank", rank)
    summed = running(counted, ["repo", "rank", "kind", "value", "path", "line"], total="made").withColumn("before", F.col("total") - F.col("made"))
    starts = summed.groupBy("repo").agg(F.min("before").alias("start"))
    asking = summed.join(F.broadcast(starts), "repo").join(listed, alike).select("kind", "value", "repo", "path", "line", "far_repo", "own", "copies", "offset", (F.col("before") - F.col("start")).alias("before"))
    asking = kept(asking.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))))
    nth = F.col("before") + (F.col("offset") + F.col("within")) * F.col("copies") + F.col("copy") + 1
    return _dealt(asking, have, _MEET, "path", "line", "copy").select("kind", "value", "repo", "path", "line", "far_repo", "far_path", "far_line", nth.alias("nth"))


#: what places that ask and places that answer have in common; `own`: a properties file is asked for by its own repository
_MEET = ["kind", "value", "far_repo", "own"]


def _leading(tokens: DataFrame) -> DataFrame:
    return tokens.where(~F.col("kind").isin(*NO_EDGE)).select("kind", "value", "repo", "path", "line")


def _from_code() -> Column:
    return (F.col("kind") == "property") & ~F.endswith("path", F.lit(".properties"))


def _answering(few: DataFrame) -> DataFrame:
    far = few.select("kind", "value", *[F.col(c).alias(f"far_{c}") for c in ("repo", "path", "line")])
    return far.withColumn("own", F.explode(F.when((F.col("kind") == "property") & F.endswith("far_path", F.lit(".properties")), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))


def repo_links(tokens: DataFrame, most: int = SPREAD) -> DataFrame:
    """J04 by repository: what links each pair of them, with the number of places on either side and the first of each. Places are added up per repository before they meet, so a value gives at most `most` squared rows, however many places it has."""
    per = narrow(tokens.where(~F.col("kind").isin(*NO_EDGE)), most).groupBy("kind", "value", "repo").agg(F.count("*").alias("places"), F.min(F.struct("path", "line")).alias("first"))
    here = per.select("kind", "value", "repo", "places", F.col("first.path").alias("path"), F.col("first.line").alias("line"))
    far = here.select("kind", "value", *[F.col(c).alias(f"far_{c}") for c in ("repo", "places", "path", "line")])
    return here.join(far, ["kind", "value"]).where("repo <> far_repo")


def suffix_routes(tokens: DataFrame) -> DataFrame:
    """Routes of different repositories where the longer ends with the shorter. Suffixes at `/` are expanded, so the join is by equality, not by comparison of all pairs."""
    routes = tokens.where("kind = 'route'").select("repo", "path", "value").distinct()
    parts = F.split("value", "/")
    tails = routes.select("repo", "path", "value", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, 1000), "/")))).alias("tail"))
    tails = tails.where(F.char_length("tail") < F.char_length("value")).distinct()
    short = routes.select(F.col("repo").alias("far_repo"), F.col("path").alias("far_path"), F.col("value").alias("tail"))
    return tails.join(short, "tail").where("repo <> far_repo").select("repo", "path", "value", "far_repo", "far_path", F.col("tail").alias("far_value"))


def holders(tokens: DataFrame, value: str, most: int = SPREAD) -> DataFrame:
    """The places of a value, unless it stands in too many repositories."""
    return narrow(tokens.where(F.col("value") == value), most)


def few_definers(symbols: DataFrame, most: int = DEFINERS) -> DataFrame:
    """Names longer than two that at most `most` files define, with their number."""
    named = symbols.where(F.char_length("name") > 2)
    return named.groupBy("name").agg(F.countDistinct("file_id").alias("files")).where(F.col("files") <= most)


def definers(symbols: DataFrame, names: DataFrame, home: str, most: int = DEFINERS) -> DataFrame:
    """Files that define a name; where the home repository does, only its own."""
    found = symbols.join(names, "name").join(few_definers(symbols, most), "name")
    at_home = found.where(F.col("repo") == home).select("name").distinct().withColumn("has_home", F.lit(True))
    return found.join(at_home, "name", "left").where((F.col("repo") == home) | F.col("has_home").isNull()).select("name", "repo", "path", "file_id", "line")


def symbol_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk whose lines hold each symbol: by file, then by range."""
    c = chunks.select("file_id", "chunk_id", "ordinal", "start_line", "end_line")
    return symbols.join(c, "file_id").where("line BETWEEN start_line AND end_line").select("file_id", "name", "line", "chunk_id", "ordinal")


def chunk_at(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first chunk by ordinal that holds each (file_id, line)."""
    held = places.join(chunks.select("file_id", "chunk_id", "ordinal", "start_line", "end_line"), "file_id").where("line BETWEEN start_line AND end_line")
    return held.groupBy("file_id", "line").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id"))


def lines_between(chunks: DataFrame, file_id: int, first: int, last: int) -> DataFrame:
    """Lines of a file from overlapping chunks, each from the first chunk that has it."""
    over = chunks.where((F.col("file_id") == file_id) & (F.col("start_line") <= last) & (F.col("end_line") >= first))
    rows = over.select("file_id", "ordinal", "start_line", F.posexplode(F.split("raw_text", "\n")).alias("pos", "text")).withColumn("line", F.col("start_line") + F.col("pos"))
    return rows.where(F.col("line").between(first, last)).groupBy("file_id", "line").agg(F.min_by("text", "ordinal").alias("text"))


def mentions(chunks: DataFrame) -> DataFrame:
    """(file_id, repo, path, name) of every identifier that a chunk holds, once per chunk; restrict the names before making them distinct."""
    return chunks.select("file_id", "repo", "path", F.explode(text.identifiers(F.col("raw_text"))).alias("name"))


def inland(seen: DataFrame, defined: DataFrame, said: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """G01, one hop inside a repository: files that define a name which a file mentions, or mention one that it defines; the first by path.

    `seen(file_id, repo)` is where to start; new files come with the file they were reached from. `defined` and `said` (repo, name,
    file_id, path) hold only names that few files define.
    """
    start = seen.select("repo", F.col("file_id").alias("from_id"))
    out_ = said.withColumnRenamed("file_id", "from_id").drop("path").join(start, ["repo", "from_id"]).join(defined, ["repo", "name"])
    in_ = defined.withColumnRenamed("file_id", "from_id").drop("path").join(start, ["repo", "from_id"]).join(said, ["repo", "name"])
    reached = out_.select("from_id", "repo", "file_id", "path").union(in_.select("from_id", "repo", "file_id", "path")).where("from_id <> file_id").distinct()
    nth = F.row_number().over(Window.partitionBy("from_id").orderBy("path", "file_id"))
    return reached.withColumn("nth", nth).where(F.col("nth") <= fan_out).drop("nth")


def reach(start: DataFrame, symbols: DataFrame, mentioned: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop inland, over shared tokens (`edges(from_id, file_id, repo, path)`), one hop inland again; the first discovery counts. Three joins, each against what is seen; symbols and mentions are read once, and what is seen is kept after each hop."""
    few = kept(few_definers(symbols).select("name"))
    symbols = kept(symbols.join(few, "name", "left_semi").select("repo", "name", "file_id", "path").distinct())
    mentioned = kept(mentioned.join(few, "name", "left_semi").select("repo", "name", "file_id", "path").distinct())
    seen = start.select("file_id", "repo", F.lit(0).alias("hop"), F.lit(None).cast("long").alias("from_id"))
    for hop, step in ((1, lambda s: inland(s, symbols, mentioned)), (2, lambda s: edges.join(s.select(F.col("file_id").alias("from_id")), "from_id").select("from_id", "repo", "file_id", "path")), (3, lambda s: inland(s, symbols, mentioned))):
        new = step(seen).join(seen.select("file_id"), "file_id", "left_anti").groupBy("file_id").agg(F.min_by("repo", "from_id").alias("repo"), F.min("from_id").alias("from_id"))
        seen = seen.unionByName(new.select("file_id", "repo", F.lit(hop).alias("hop"), "from_id"))
        seen = kept(seen) if hop < 3 else seen
    return seen


def includes(sites: DataFrame, files: DataFrame, chunks: DataFrame, libraries: DataFrame, languages: tuple[str, ...] = ("de", "fr", "it", "en")) -> DataFrame:
    """`sites(file_id, repo, value, line)` -> the head chunks they include.

    `{lang}` in a value stands for each language in turn. A file of the same repository beats one of a library; a site with the
    placeholder keeps its first language only; a file lands once. Files that share a stem are as many pairs as their square, so which stem a site
    means, and whether at home, is settled from sums by (stem, repository) before sites and files meet; pairs are made last and are not moved.
    """
    first = sites.groupBy("file_id", "repo", "value").agg(F.min("line").alias("line"))
    ranks = F.when(F.contains("value", F.lit("{lang}")), F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(x).alias("lang")) for i, x in enumerate(languages)])).otherwise(F.array(F.struct(F.lit(0).alias("rank"), F.lit("").alias("lang"))))
    stems = first.select("file_id", "repo", "value", "line", F.explode(ranks).alias("r")).select("file_id", "repo", "value", "line", "r.rank", F.replace("value", F.lit("{lang}"), F.col("r.lang")).alias("stem"))
    heads = files.join(chunks.where("start_line <= 1 AND end_line >= 1").groupBy("file_id").agg(F.min_by("chunk_id", "ordinal").alias("chunk_id")), "file_id").dropDuplicates(["file_id", "repo", "stem"]).join(libraries, "repo", "left")
    far = kept(heads.select("stem", F.col("file_id").alias("far_id"), F.col("repo").alias("far_repo"), F.col("path").alias("far_path"), "chunk_id", F.coalesce("library", F.lit(False)).alias("library")))
    own = far.groupBy("stem", F.col("far_repo").alias("repo")).agg(F.min("far_id").alias("least"), F.max("far_id").alias("most"))
    shared = far.where("library").groupBy("stem").agg(F.min("far_repo").alias("from"), F.max("far_repo").alias("to"))
    away = F.when((F.col("least") != F.col("file_id")) | (F.col("most") != F.col("file_id")), 0).when((F.col("from") != F.col("repo")) | (F.col("to") != F.col("repo")), 1)
    found = stems.join(own, ["stem", "repo"], "left").join(shared, "stem", "left").select("file_id", "repo", "value", "line", "rank", "stem", away.alias("away")).where("away IS NOT NULL")
    near = found.groupBy("file_id", "repo", "value", "line").agg(F.min(F.struct("away", "rank", "stem")).alias("n"))
    place = lambda away, repo: F.when(away == 0, F.col(repo)).otherwise("")
    # sites of a file that mean one stem reach the same files: the first of them has them all
    once = near.groupBy("file_id", "repo", F.col("n.stem").alias("stem"), F.col("n.away").alias("away")).agg(F.min(F.struct("line", "value", F.col("n.rank").alias("rank"))).alias("s"))
    once = kept(once.select("file_id", "repo", "stem", "away", place(F.col("away"), "repo").alias("place"), "s.*"))
    met = far.withColumn("away", F.explode(F.when(F.col("library"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("place", place(F.col("away"), "far_repo")).drop("library")
    pairs = _dealt(once, met, ["stem", "away", "place"], "file_id").where("far_id <> file_id AND (away = 0 OR far_repo <> repo)")
    return pairs.select("file_id", "value", "line", "rank", "far_id", "far_repo", "far_path", "chunk_id")


def longest_prefix(paths: DataFrame, units: DataFrame) -> DataFrame:
    """The unit whose key is the longest directory prefix of each path; keys are looked up among a path's directories, so the join is by equality. Key "." claims nothing."""
    parts = F.split("path", "/")
    dirs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    found = paths.select("repo", "path", F.explode(dirs).alias("key")).join(units.where("key <> '.'"), ["repo", "key"]).groupBy("repo", "path").agg(F.max_by("key", F.char_length("key")).alias("unit"))
    return paths.join(found, ["repo", "path"], "left")


def prefix_dependencies(publishes: DataFrame, requires: DataFrame) -> DataFrame:
    """Repositories that require a coordinate another publishes, itself or below it (`coordinate/`)."""
    parts = F.split("coordinate", "/")
    ways = requires.select("repo", "coordinate", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    pub = publishes.select(F.col("repo").alias("publisher"), F.col("coordinate").alias("prefix"))
    return ways.join(pub, "prefix").where("repo <> publisher").select("repo", "publisher", "coordinate").distinct()


def alias_imports(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Imports that are an alias or lie below it."""
    parts = F.split("literal", "/")
    ways = imports.select("repo", "path", "literal", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("alias"))
    return ways.join(aliases, ["repo", "alias"]).select("repo", "path", "literal", "alias", "unit").distinct()
