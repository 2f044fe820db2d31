"""Text to rows, line by line (E01-E07, E09, F35, F36): small helpers that run inside Spark tasks.

Each helper takes one text; `over` maps it over a column with Arrow batches, one row in, rows out.
"""

from __future__ import annotations

import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions.redaction import opening
from tessera.operators.budget import line_windows

TARGET, MOST, OVERLAP, PIECE = 600, 800, 75, 3200


def over(rows: DataFrame, key: str, columns: tuple[str, ...], schema: str, fn: Callable[..., Iterator[tuple]]) -> DataFrame:
    """`fn(*values)` -> tuples, for each row of `rows`; out come the key and the tuple."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")][1:]

    def run(batches):
        for b in batches:
            made = [(k, *t) for k, *values in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))) for t in fn(*values)]
            columns = zip(*made) if made else [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.select(key, *columns).mapInArrow(run, schema)


# --- chunks -------------------------------------------------------------------------------------------------------


def cost(line: str) -> int:
    return -(-len(line) // 4) + 1


def chunks(text: str | None, anchors: list[int] | None = None, comment: tuple[str, ...] = ("//", "#", "--")) -> Iterator[tuple[int, int, int, str]]:
    """(ordinal, first line, last line, text): regions between anchors, a leading comment drawn in, windows, overlong pieces."""
    return (c[:4] for c in _chunked(text, anchors, comment))


def chunk_words(text: str | None) -> Iterator[tuple[int, str]]:
    """(ordinal, what is searched of the chunk): its text, but a word that is cut between pieces is whole in the piece that it begins in."""
    return ((c[0], c[4]) for c in _chunked(text))


def _chunked(text: str | None, anchors: list[int] | None = None, comment: tuple[str, ...] = ()) -> Iterator[tuple[int, int, int, str, str]]:
    lines = (text or "").split("\n")
    starts = sorted(set(a for a in anchors or [] if 1 <= a <= len(lines)))
    if anchors and starts != list(anchors):
        starts = []
    begins, before = [], 0
    for a in starts:
        first = a
        while first - 1 > before and lines[first - 2].lstrip().startswith(comment):
            first -= 1
        begins.append(first)
        before = a
    if not begins or begins[0] > 1:
        begins.insert(0, 1)
    ordinal = 0
    for i, begin in enumerate(begins):
        end = begins[i + 1] - 1 if i + 1 < len(begins) else len(lines)
        for a, b in line_windows([cost(x) for x in lines[begin - 1 : end]], TARGET, OVERLAP):
            body = "\n".join(lines[begin + a - 2 : begin + b - 1])
            pieces = [(body, body)] if -(-len(body) // 4) <= MOST else _pieces(body)
            for piece, said in pieces:
                if piece.strip():
                    yield ordinal, begin + a - 1, begin + b - 1, piece, said
                    ordinal += 1


def _pieces(body: str) -> Iterator[tuple[str, str]]:
    """Pieces of PIECE characters, each with the text of the words that begin in it."""
    inner = lambda c: unicodedata.category(c)[0] in "LNM"
    begin = 0
    for k in range(0, len(body), PIECE):
        cut = min(k + PIECE, len(body))
        end = max(begin, cut)
        if begin <= cut < len(body) and inner(body[cut - 1]):
            while end < len(body) and inner(body[end]):
                end += 1
        yield body[k:cut], body[begin:end]
        begin = end


# --- integration tokens -------------------------------------------------------------------------------------------

ROUTE = re.compile(r"""@(?:Request|Get|Post|Put|Delete|Patch)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?["']([^"']*)["']""")
CLASS_ROUTE = re.compile(r"^\s*(?:public\s+|abstract\s+|final\s+)*(?:class|interface)\s")
CALL = re.compile(r"""["'`](/[A-Za-z0-9_\-{}$/.:]{2,})["'`]""")
DESTINATION = re.compile(r"""(?:destination|queue|topic|channel)s?\s*[=(:]\s*["']([A-Za-z][\w.\-/]*[./\-][\w.\-/]*)["']""", re.I)
PROPERTY_USE = re.compile(r"\$\{([A-Za-z][\w.\-]*)(?::[^}]*)?\}")
IMAGE = re.compile(r"""^\s*(?:-\s+)?image:\s*["']?([^\s"'#]+)""")
LINK = re.compile(r"""(?:href|routerLink|to)=["'](/[^"']*)["']""")
INCLUDE = re.compile(r"^\s*#?\s*include\s+[\"<']?([\w./{}\-]+)", re.I)


def tokens(path: str, text: str | None) -> Iterator[tuple[str, str, int]]:
    """(kind, value, line), the first line of each kind and value, by type of file."""
    ext = path.rpartition(".")[2].lower()
    seen: dict[tuple[str, str], int] = {}
    prefix, pending = "", None
    new_name = ""
    for n, line in enumerate((text or "").split("\n"), 1):
        found: list[tuple[str, str]] = []
        if ext == "properties":
            key = opening(line, False, False) if not line.lstrip().startswith(("#", "!")) else None
            found += [("property", key[0])] if key and key[0][0].isalpha() else []
        elif ext in ("yaml", "yml"):
            if m := IMAGE.match(line):
                found.append(("image", m[1]))
            if m := re.match(r"^\s*(?:-\s+)?newName:\s*[\"']?([^\s\"'#]+)", line):
                new_name = m[1]
            if (m := re.match(r"^\s*newTag:\s*[\"']?([^\s\"'#]+)", line)) and new_name:
                found.append(("image", f"{new_name}:{m[1]}"))
        elif ext in ("html", "tsx", "jsx"):
            found += [("link", m[1]) for m in LINK.finditer(line)]
        elif ext in ("mtxt", "mtxm", "inc"):
            found += [("include", m[1].lower()) for m in INCLUDE.finditer(line)]
        else:
            routes = [m[1] for m in ROUTE.finditer(line)]
            if routes:
                pending = routes
            if CLASS_ROUTE.match(line):
                # a mapping right above a class is the prefix of all in it
                prefix, pending = (pending[0] if pending else ""), None
            elif pending and not line.lstrip().startswith("@"):
                found += [("route", join(prefix, r)) for r in pending]
                pending = None
            found += [("route", m[1]) for m in CALL.finditer(line) if not ROUTE.search(line) and route_like(m[1])]
            found += [("destination", m[1]) for m in DESTINATION.finditer(line)]
            found += [("property", m[1]) for m in PROPERTY_USE.finditer(line)]
        for t in found:
            seen.setdefault(t, n)
    for r in pending or []:
        seen.setdefault(("route", join(prefix, r)), n)
    yield from ((k, v, n) for (k, v), n in seen.items())


def join(prefix: str, route: str) -> str:
    """A class's prefix and a method's route."""
    return "/" + "/".join(p for p in (prefix.strip("/"), route.strip("/")) if p)


def route_like(value: str) -> bool:
    """No asset, no relative path, more than a slash."""
    return not re.search(r"\.(?:png|jpe?g|gif|svg|css|js|ico|woff2?|html?)$", value) and ".." not in value and value.strip("/") != ""


# --- symbols ------------------------------------------------------------------------------------------------------

SYMBOLS = {
    "go": re.compile(r"^(?:func\s+(?:\([^)]*\)\s*)?(?P<func>\w+)|type\s+(?P<type>\w+))"),
    "py": re.compile(r"^\s*(?:class\s+(?P<class>\w+)|(?:async\s+)?def\s+(?P<func>\w+))"),
    "java": re.compile(r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*(?:(?:class|interface|enum|record)\s+(?P<class>\w+)|[\w<>\[\], ]+\s+(?P<method>\w+)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{)"),
    "ts": re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class\s+(?P<class>\w+)|interface\s+(?P<interface>\w+)|(?:async\s+)?function\s+(?P<func>\w+)|(?:const|let)\s+(?P<const>\w+)\s*=\s*(?:async\s*)?\()"),
}
SYMBOLS["js"] = SYMBOLS["tsx"] = SYMBOLS["ts"]


def symbols(lang: str, text: str | None) -> Iterator[tuple[str, str, int]]:
    """(name, kind, line) of definitions, by language."""
    pattern = SYMBOLS.get(lang)
    for n, line in enumerate((text or "").split("\n"), 1) if pattern else ():
        if m := pattern.match(line):
            kind, name = next((k, v) for k, v in m.groupdict().items() if v)
            yield name, kind, n


def schema_symbols(text: str | None) -> Iterator[tuple[str, str, int]]:
    """Top-level definitions of an XSD or WSDL; an unclosed element is an error."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError as e:
        raise ValueError(f"not well formed: {e}") from None
    lines = (text or "").split("\n")
    for child in root:
        kind, name = child.tag.rpartition("}")[2], child.get("name")
        if name:
            line = next((n for n, x in enumerate(lines, 1) if f'name="{name}"' in x and kind in x), 1)
            yield name, kind, line


def process_model(text: str | None) -> Iterator[tuple[str, str, str, str, str]]:
    """(process, element kind, id, name or source, target) of a BPMN model."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return
    for process in (e for e in root.iter() if e.tag.rpartition("}")[2] == "process"):
        for e in process:
            kind = e.tag.rpartition("}")[2]
            if kind == "sequenceFlow":
                yield process.get("id", ""), "flow", e.get("id", ""), e.get("sourceRef", ""), e.get("targetRef", "")
            elif e.get("id"):
                yield process.get("id", ""), kind, e.get("id"), e.get("name", ""), e.get("calledElement", "") or e.get("attachedToRef", "")


# --- citations ----------------------------------------------------------------------------------------------------

CITE = re.compile(r"\[(\d+(?:\s*,\s*\d+)*)\]")
FENCE = re.compile(r"^\s*(?:```|~~~)")


class Renumberer:
    """Citations numbered by first use; fences stay as they are, numbers of nobody too. Fed in pieces or whole, the result is the same."""

    def __init__(self, known: int):
        self.known, self.order, self.fenced, self.held = known, {}, False, ""

    def feed(self, piece: str, last: bool = False) -> str:
        self.held += piece
        ready, nl, rest = self.held.rpartition("\n")
        if last:
            ready, nl, rest = self.held, "", ""
        if not nl and not last:
            return ""
        self.held = rest
        return "\n".join(self._line(x) for x in ready.split("\n")) + nl

    def _line(self, line: str) -> str:
        if FENCE.match(line):
            self.fenced = not self.fenced
            return line
        return line if self.fenced else CITE.sub(self._cite, line)

    def _cite(self, m: re.Match) -> str:
        numbers = [int(x) for x in m[1].split(",")]
        if any(not 1 <= n <= self.known for n in numbers):
            return m[0]
        return "[" + ", ".join(str(self.order.setdefault(n, len(self.order) + 1)) for n in numbers) + "]"


def renumber(text: str | None, known: int) -> tuple[str | None, list[int]]:
    """The whole text at once, and the original numbers in their new order."""
    if text is None:
        return None, []
    r = Renumberer(known)
    return r.feed(text, last=True), list(r.order)


def strip_markers(text: str | None) -> str | None:
    """without citations outside fences."""
    if text is None:
        return None
    out, fenced = [], False
    for line in text.split("\n"):
        fenced ^= bool(FENCE.match(line))
        out.append(line if fenced else re.sub(r"[ \t]?\[\d+(?:\s*,\s*\d+)*\]", "", line))
    return "\n".join(out)


def swiss(text: str | None) -> str | None:
    """no sharp s outside of code spans, fences and identifiers."""
    if text is None:
        return None
    out, fenced = [], False
    for line in text.split("\n"):
        if FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            line = "".join(p if p.startswith("`") else re.sub(r"\S+", lambda m: m[0] if re.search(r"[_/\\(){}=]|[a-zß][A-Z]", m[0]) else m[0].replace("ß", "ss"), p) for p in re.split(r"(`[^`]*`)", line))
        out.append(line)
    return "\n".join(out)
