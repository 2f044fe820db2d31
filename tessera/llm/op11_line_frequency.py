"""Quality rules: cross-document line frequency, and the base measures of a text. DataFrame functions only.

Lines (pieces between line feeds that hold a word) are normalised - lower case, runs of ASCII characters that are no letter or digit as
one blank - and hashed. Per host (`source` in our tables) the distinct documents with each line are counted; equal texts of a
host are one document, so exact copies, which are the business of deduplication, make no line frequent. A line is over the limit
if more than `LEAST_DOCS` documents and more than `SHARE` of the host's documents have it. Such lines are removed, and a
document whose removed lines hold more than `DEPLETED` of the characters of its lines is rejected.

Only (host, digest of the text, hash of the line, its length) is shuffled, summed in each task first. Lines are counted by
(host, line), after a first count by (host, text, line), so a line or a host with a third of all rows burdens no task; frequent lines are joined
by equality, which adaptive execution may split or broadcast by their size. Measures are computed per row, in linear
memory but for texts with a repeated window of three words, whose windows are sorted.

Nulls and edge cases: a null or wordless text has no words and fails the base rules; a null host is a host of its own; rows that
repeat a doc_id, and null doc_ids, are judged each by their text; very long texts are read whole (their words are held as one array);
lines whose hashes collide are counted together (64 bits); lines of marks alone are compared as they stand; an empty table gives
an empty result; extra columns are ignored by `judge` and pass through `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

LEAST_DOCS, SHARE, DEPLETED = 5, 0.02, 0.7
FEWEST_WORDS, MOST_REPEATED = 50, 50
BLANKS, WORD, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", "#*$%&|<>"
#: words that a window of repeats has
RUN = 3


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once a row, so that functions over its elements do not compute it for each of them."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def repeated(w: Column) -> Column:
    """How many of the words `w` stand in windows of RUN words that are found twice or more."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - RUN), lambda i: F.xxhash64(*(w[i + k] for k in range(RUN))))

    def covered(at: Column) -> Column:
        """Words in the windows that begin at the sorted places `at`: up to the next one's begin, RUN at most."""
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0), lambda sum_, j: sum_ + F.least(F.lit(RUN), F.coalesce(F.get(at, j + 1) - at[j], F.lit(RUN))))

    def again(s: Column) -> Column:
        """Places of the windows that are not alone among the sorted (hash, place)."""
        equal = lambda j, k: F.coalesce(F.get(s, k)["h"] == s[j]["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: equal(j, j - 1) | equal(j, j + 1)), lambda j: s[j]["i"]))

    def sorted_(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(sorted_(h), again), covered))
    return F.when(n < RUN, 0).otherwise(let(hashes, some))


def measures(text: Column) -> dict[str, Column]:
    """The base measures of a text that is not null, by name."""
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated(w).cast("long").alias("n_repeat_words")))
    dup = let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return {"w": of_words, "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"), "n_dup_lines": dup}


def normal(line: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(line), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(plain == "", F.trim(F.regexp_replace(line, BLANKS, " "))).otherwise(plain)


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """`docs` with __host (null is one of its own), __key (digest of the text) and __text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"__text": text, "__host": F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")), "__key": F.unhex(F.md5(text.cast("binary")))})


def line_table(docs: DataFrame, host: str = "source") -> DataFrame:
    """(__host, __key, h, chars) of each line of each distinct text of a host, stored; chars: of all its copies together."""
    each = _keyed(docs, host).select("__host", "__key", F.explode(lines(F.col("__text"))).alias("line"))
    hashed = each.select("__host", "__key", F.xxhash64(normal(F.col("line"))).alias("h"), F.length("line").cast("long").alias("chars"))
    return stored(hashed.groupBy("__host", "__key", "h").agg(F.sum("chars").alias("chars")), "lines")


def frequent(table: DataFrame, least: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """(__host, h, docs) of the lines over the limits."""
    per_host = table.groupBy("__host", "__key").agg(F.lit(1).alias("one")).groupBy("__host").agg(F.count("*").alias("host_docs"))
    counted = table.groupBy("__host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > least)
    return stored(counted.join(per_host, "__host").where(F.col("docs") > F.col("host_docs") * share).select("__host", "h", "docs"), "frequent")


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of `docs(doc_id, <host>, text)`: doc_id, the base measures, base_failed, removed_share (of the characters of its lines that stand in
    lines over the limits), depleted, kept."""
    table = line_table(docs, host)
    over = frequent(table).select("__host", "h", F.lit(True).alias("over"))
    marked = table.join(over, ["__host", "h"], "left")
    removed = marked.groupBy("__host", "__key").agg(F.sum(F.when(F.col("over"), F.col("chars")).otherwise(0)).alias("gone"), F.sum("chars").alias("every")).where("gone > 0")
    own = _keyed(docs, host).select(F.col("doc_id").cast("long").alias("doc_id"), "__host", "__key", *(c.alias(n) for n, c in measures(F.col("__text")).items())).select("*", "w.*").drop("w")
    joined = own.join(removed, ["__host", "__key"], "left")
    share = F.coalesce(F.col("gone") / F.col("every"), F.lit(0.0))  # copies multiply both alike
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), share.alias("removed_share"))
    return out.withColumn("depleted", F.col("removed_share") > DEPLETED).withColumn("kept", ~(F.col("base_failed") | F.col("depleted")))


def clean(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of `docs` that are kept, all columns, with the lines over the limits removed from `text` (and `n_chars`, if it is there, set anew)."""
    over = frequent(line_table(docs, host))
    keyed = _keyed(docs, host)
    # the places of such lines, by distinct text; only places are shuffled
    each = keyed.select("__host", "__key", F.posexplode(F.split("__text", "\n")).alias("at", "line")).where(F.col("line").rlike(WORD))
    placed = each.select("__host", "__key", "at", F.xxhash64(normal(F.col("line"))).alias("h")).join(over.select("__host", "h"), ["__host", "h"])
    hit = placed.groupBy("__host", "__key").agg(F.collect_set("at").alias("__gone"))
    joined = keyed.join(hit, ["__host", "__key"], "left")
    split = F.split("__text", "\n")
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "__gone"), lambda i: split[i]), "\n")
    size = lambda text: let(lines(text), lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + F.length(y)))
    made = joined.withColumn("__new", F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(left)).withColumns({"__w": measures(F.col("__text"))["w"], "__size": size(F.col("__text")), "__left": size(F.col("__new"))})
    kept = made.where((F.col("__w.n_words") >= FEWEST_WORDS) & (100 * F.col("__w.n_repeat_words") <= MOST_REPEATED * F.col("__w.n_words")) & ((F.col("__size") - F.col("__left")) / F.col("__size") <= DEPLETED))
    columns = [F.col("__new").alias("text") if c == "text" else F.char_length("__new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT r, unnest(w) AS a, unnest(generate_series(1, len(w))) AS i FROM d),
wins AS (SELECT r, i, a, lead(a, 1) OVER s AS b, lead(a, 2) OVER s AS c FROM placed WINDOW s AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM wins WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
l AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
o AS (SELECT r, source, t, line, length(line) AS chars,
    trim(regexp_replace(lower(line), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS plain, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS bare
    FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
n AS (SELECT *, CASE WHEN plain = '' THEN bare ELSE plain END AS h FROM o),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM n GROUP BY r),
hosts AS (SELECT source, count(DISTINCT t) AS docs FROM n GROUP BY source),
freq AS (SELECT n.source, h, count(DISTINCT t) AS docs FROM n GROUP BY n.source, h),
over_ AS (SELECT freq.source, h FROM freq JOIN hosts ON freq.source IS NOT DISTINCT FROM hosts.source WHERE freq.docs > {LEAST_DOCS} AND freq.docs > hosts.docs * {SHARE}),
every AS (SELECT r, sum(chars) AS n FROM n GROUP BY r),
gone AS (SELECT r, sum(chars) AS n FROM n JOIN over_ ON n.source IS NOT DISTINCT FROM over_.source AND n.h = over_.h GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n::DOUBLE / every.n, 0.0) AS removed_share
    FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN every USING (r) LEFT JOIN gone USING (r)),
f AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, removed_share > {DEPLETED}::DOUBLE AS depleted FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_share, depleted, NOT (base_failed OR depleted) AS kept FROM f
"""
