"""Text functions as column expressions (F01-F45). Everything here stays in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that carry no topic.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "nor", "so", "yet", "if", "then", "than", "as", "that", "this", "these", "those", "there", "here", "it", "its", "we", "you", "they", "them", "their",
    "how", "what", "who", "where", "when", "why", "which", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "has", "have", "had", "can", "could", "should", "would", "will", "shall", "may", "might", "must",
    "about", "after", "against", "among", "around", "at", "before", "between", "by", "during", "for", "from", "in", "inside", "into", "of", "off", "on", "onto", "out", "over", "through", "to", "under", "until", "up", "upon", "with", "within", "without",
)
TERMS_MOST, PREFIX_LEAST = 32, 5
SUBSTRING_LEAST, SUBSTRING_MOST, SUBSTRING_CODE_MOST = 8, 12, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = re.compile(r"[\W_]+")


def tokens(text: Column) -> Column:
    """lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def camel_words(text: Column) -> Column:
    """words split at lower-to-upper humps, longer than one character."""
    spaced = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", " ")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda t: F.char_length(t) > 1)


def identifiers(text: Column) -> Column:
    """distinct runs of letters, digits and underscores longer than two bytes, in order of appearance."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda t: F.octet_length(t) > 2))


def folded(text: Column) -> Column:
    """letters and digits only, lower-cased."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def content_words(text: Column) -> Column:
    """tokens without stopwords."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokens(text), lambda t: ~F.array_contains(stop, t))


def ascii_lower(text: Column) -> Column:
    """lower case of A-Z alone; texts that hold nothing else take the faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Latin letters with marks and what they are without, by Unicode decomposition; the marks themselves stand last and have no counterpart, so they go.
_MARKED = [chr(c) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c)) and not unicodedata.decomposition(chr(c)).startswith("<")]
_MARKED_FROM = "".join(_MARKED) + "".join(map(chr, range(0x300, 0x370)))
_MARKED_TO = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def unaccented(text: Column) -> Column:
    """Letters without their diacritics, as keyword search sees them; plain ASCII has none."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, _MARKED_FROM, _MARKED_TO))


def plain(word: str) -> str:
    """`unaccented` on the driver."""
    return word.translate(_PLAIN)


_PLAIN = str.maketrans(_MARKED_FROM[: len(_MARKED_TO)], _MARKED_TO, _MARKED_FROM[len(_MARKED_TO) :])


def contains_term(text: Column, term: Column) -> Column:
    """a term of ASCII is found whatever the case of A-Z; another one in two spellings, as it is and with its first letter raised."""
    ascii_only = ~F.regexp_like(term, F.lit(r"[^\x00-\x7F]"))
    raised = F.concat(F.upper(F.left(term, F.lit(1))), F.right(term, F.char_length(term) - 1))
    return F.when(ascii_only, F.contains(ascii_lower(text), ascii_lower(term))).otherwise(F.contains(text, term) | F.contains(text, raised))


def holds(text: Column, folded: Column, term: str) -> Column:
    """F08 for a term known beforehand; `folded` is `ascii_lower(text)`, computed once for many terms."""
    if term.isascii():
        return F.contains(folded, F.lit(term.lower()))
    return F.contains(text, F.lit(term)) | F.contains(text, F.lit(term[:1].upper() + term[1:]))


def token_estimate(text: Column) -> Column:
    """a quarter of the characters, rounded up."""
    return F.floor((F.char_length(text) + 3) / 4).cast("long")


def excerpt(text: Column, most: int) -> Column:
    """trimmed and cut at `most` characters, back to a newline in the second half, with an ellipsis if cut."""
    whole = F.trim(text)
    head = F.left(whole, F.lit(most))
    back = F.lit(most) - F.instr(F.reverse(head), "\n") + 1  # place of the last newline; past the end if there is none
    cut = F.when((F.instr(head, "\n") > 0) & (back > most / 2), F.left(head, (back - 1).cast("int"))).otherwise(head)
    return F.when(F.char_length(whole) <= most, whole).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def content_hash(*fields: Column) -> Column:
    """SHA-256 over fields joined by the group separator."""
    return F.sha2(F.concat_ws("\u001d", *fields), 256)


def enriched(repo: Column, path: Column, chain: Column, raw: Column) -> Column:
    """what is embedded: address, symbols, text."""
    return F.concat_ws("\n", F.concat_ws("/", repo, path), F.nullif(chain, F.lit("")), raw)


def repo_fold(name: Column) -> Column:
    """a repository name as people say it: lower case, no owner, no possessive, no plural s."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^.*/", ""), r"['’]s$", "")
    return F.regexp_replace(bare, r"s$", "")


def within_one_edit(a: Column, b: Column) -> Column:
    """at most one edit apart, both at least four characters."""
    return (F.char_length(a) >= 4) & (F.char_length(b) >= 4) & F.levenshtein(a, b, 1).between(0, 1)


def one_edit_keys(a: Column) -> Column:
    """F14 for a join by equality: the text and all that one deleted character leaves of it. Texts within one edit share a key."""
    return F.array_distinct(F.concat(F.array(a), F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(a), F.lit(1))), lambda i: F.concat(F.left(a, i - 1), F.substr(a, i + 1)))))


def name_segments(name: Column) -> Column:
    """parts of a repository name."""
    return F.filter(F.split(F.lower(name), r"[-_./ ]+"), lambda t: t != "")


def whole_word(text: Column, name: str, hyphen: bool = False) -> Column:
    """F16: the name between boundaries; with `hyphen`, a hyphen is part of words."""
    inner = r"\p{L}\p{N}_" + ("-" if hyphen else "")
    return F.regexp_like(F.lower(text), F.lit(f"(?<![{inner}]){_java_quoted(name.lower())}(?![{inner}])"))


def _java_quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def glued(name: str, part: str) -> list[str]:
    """name and part in either order, joined as people join them."""
    return [a + s + b for a, b in ((name, part), (part, name)) for s in ("-", "_", " ", "")]


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def title_placeholder(question: Column, most: int = 48) -> Column:
    """white space collapsed, at most 48 characters with an ellipsis."""
    one = collapse(question)
    return F.when(F.char_length(one) <= most, one).otherwise(F.concat(F.rtrim(F.left(one, F.lit(most))), F.lit("…")))


def typed_terms(typed: str) -> list[str]:
    """what was typed, by white space; each term is a phrase of words that must stand, its last word as a prefix."""
    return [" ".join(w for w in _SPLIT.split(plain(t.lower())) if w) for t in typed.split()]


def matches_typed(body: Column, typed: str) -> Column:
    """whether every typed term stands, marks and diacritics left out; a term of marks alone matches nothing that is asked for."""
    said = F.concat(F.lit(" "), F.regexp_replace(unaccented(F.lower(body)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    out = F.lit(True)
    for term in typed_terms(typed):
        out = out & F.contains(said, F.lit(f" {term}")) if term else out
    return out & body.isNotNull()


def snippet(body: Column, typed: str, around: int = 40) -> Column:
    """F32: the passage around the first typed term that stands, the term marked; empty if none does."""
    alternatives = "|".join(r"[^\p{L}\p{N}]+".join(map(_java_quoted, t.split(" "))) for t in typed_terms(typed) if t)
    if not alternatives:
        return F.lit("")
    hit = rf"(?s)(?i)^(?:.*?)(.{{0,{around}}})(?<![\p{{L}}\p{{N}}])({alternatives})([\p{{L}}\p{{N}}]*)(.{{0,{around}}}).*$"
    whole = collapse(body)
    return F.when(F.regexp_like(whole, F.lit(hit)), F.regexp_replace(whole, hit, "$1[$2$3]$4")).otherwise("")


def memory_text(text: Column, most: int = 200) -> Column:
    """no backticks or hashes, white space collapsed, at most 200 characters."""
    return F.left(collapse(F.translate(text, "`#", "")), F.lit(most))


def stripped_comments(text: Column, prefixes: tuple[str, ...]) -> Column:
    """the lines that do not open a comment."""
    opens = "|".join(_java_quoted(p) for p in prefixes)
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.regexp_like(line, F.lit(rf"^\s*(?:{opens})"))), "\n")


def split_long(text: Column, most: int = 3200) -> Column:
    """pieces of at most `most` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{most}}})"), F.lit(1))


def image_name(ref: Column) -> Column:
    """the image without its version."""
    return F.regexp_extract(ref, r"^(.*?)(?:@[^@]*|:[^:/@]*)?$", 1)


def image_version(ref: Column) -> Column:
    """digest or tag, empty if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(ref, r"@([^@]*)$", 1), F.lit("")), F.regexp_extract(ref, r":([^:/@]*)$", 1))


def short_sha(sha: Column, n: int = 7) -> Column:
    """F25."""
    return F.left(sha, F.lit(n))


def usd(nano: Column) -> Column:
    """nano-dollars in dollars."""
    return nano / F.lit(1e9)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def followups(reply: Column, most: int = 3, longest: int = 200) -> Column:
    """lines without list markers, not blank and not too long, the first three."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: (x != "") & (F.char_length(x) <= longest))), 1, most)


def version_key(name: Column) -> Column:
    """Sorts names with digit runs as numbers: runs without leading zeros, preceded by their length."""
    bare = F.regexp_replace(name, r"0+(?=\d)", "")
    parts = F.regexp_extract_all(bare, F.lit(r"(\d+|\D+)"), F.lit(1))
    keyed = F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(r"^\d")), F.concat(F.lit("0"), F.lpad(F.char_length(p).cast("string"), 4, "0"), p)).otherwise(F.concat(F.lit("1"), p)))
    return F.array_join(keyed, "\u0001")


# --- what is built from a question, on the driver -----------------------------------------------------------------


def words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text.lower()) if w]


def tiers(text: str) -> list[tuple[str, list[str], bool, bool]]:
    """(tier, terms, all must match, as prefixes), from strict to any; duplicates dropped."""
    all_terms = words(text)[:TERMS_MOST]
    if not all_terms:
        return []
    content = [w for w in all_terms if w not in STOPWORDS]
    out = [("strict", all_terms, True, False)]
    if not content:
        return out
    if content != all_terms:
        out.append(("content", content, True, False))
    if any(len(w) >= PREFIX_LEAST for w in content):
        out.append(("prefix", content, True, True))
    if len(content) > 1:
        out.append(("any", content, False, True))
    return out


def substring_terms(text: str, code_terms: tuple[str, ...] = ()) -> list[str]:
    """code terms first, then pairs of content words glued (neighbours, then one apart), single words, snake pairs."""
    out: list[str] = []

    def add(term: str, most: int) -> None:
        if len(term) >= SUBSTRING_LEAST and term not in out and len(out) < most:
            out.append(term)

    for raw in code_terms:
        fold = "".join(c for c in raw.lower() if c.isalnum())
        if raw.lower() != fold:
            add(raw.lower(), SUBSTRING_CODE_MOST)
        add(fold, SUBSTRING_CODE_MOST)
    content = [w for w in words(text) if w not in STOPWORDS]
    pairs = [(content[i], content[i + gap]) for gap in (1, 2) for i in range(len(content) - gap)]
    for term in [a + b for a, b in pairs] + content + [f"{a}_{b}" for a, b in pairs]:
        add(term, SUBSTRING_MOST)
    return out


def search_texts(question: str, prior: str = "", terms: str = "", code: str = "") -> list[str]:
    """the texts to search for: blank and repeated ones are left out."""
    return list(dict.fromkeys(t for t in (x.strip() for x in (question, prior, terms, code)) if t))
