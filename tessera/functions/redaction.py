"""configuration files with their credential values replaced, read by position.

`places` gives the places in a line where a value lies, each with its key and its role: the value of the key that a line opens with
(`key = value`, `key: value`, in properties also `key value`), values of keys anywhere (minified JSON, YAML flow maps, XML attributes and elements),
the first value of a JSON line, and stretches that look like credentials. `CREDENTIAL` says of each role when it is one. Only the place is replaced, so keys, quotes, commas and
line ends stay. What goes over lines - a block below a key, a name whose value follows - is the state of a `Reader`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

MARKER = "<redacted>"

# File types, words in keys and shapes of values that count as credentials.
CONFIG_EXTENSIONS = ("properties", "yaml", "yml", "conf", "env", "toml", "ini", "json", "tfvars", "cfg", "xml", "config")
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "credential", "apikey", "accesskey", "authkey", "signingkey", "encryptionkey", "private", "consumerkey", "masterkey", "jaas", "passphrase", "passwort", "kennwort", "sessionid")
SECRET_PARTS, SECRET_LAST_PARTS = ("pass", "pw"), ("key",)
INSIDE_WORDS = ("password", "passwd", "passphrase", "passwort", "secret", "token", "apikey", "credential", "accesskey")
VERSION_PARTS = ("tag", "newtag", "sha", "commit", "rev", "revision", "version", "digest", "checksum", "hash", "image", "id")
VALUE_SHAPES = (
    r"ENC\(.*\)\Z",
    r"eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\Z",
    r"[A-Za-z0-9+/]{40,}={0,2}\Z",
    r"[0-9a-fA-F]{32,}\Z",
    r".*(?:password|secret)\s*=",
    r"(?:basic|bearer)\s+\S+\Z",
    r".*://[^/\s@:]+:[^/\s@]+@",
    r"(?:AKIA|ASIA)[0-9A-Z]{16}\Z",
    r"(?:gh[pousr]_|github_pat_|glpat-|xox[baprs]-|sk-|npm_)\S+\Z",
)
INSIDE_SHAPES = (
    r"\bENC\([^)]*\)",
    r"\beyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*",
    r"\b(?i:basic)\s+[A-Za-z0-9+/]{12,}={0,2}",
    r"\b(?i:bearer)\s+[A-Za-z0-9._~+/-]{20,}",
    r"\b(?:gh[pousr]_|github_pat_|glpat-|xox[baprs]-|sk-|npm_)[A-Za-z0-9_-]{16,}",
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
)
URL_LOGIN = r"""://[^/\s@:'"]+:[^/\s@'"]+@"""
# End of the fixed values.

_VALUE = re.compile("|".join(VALUE_SHAPES), re.I | re.S)
_INSIDE = re.compile("|".join(INSIDE_SHAPES))
_LOGIN = re.compile(URL_LOGIN)
_WORD = re.compile(r"[\w-]+")
_QUOTED = re.compile(r"""(["'])(?:\\.|(?!\1).)*\1""")
_POINTER = re.compile(r"\$\{[^}\s]*\}")
_BLOCK = re.compile(r"[|>][+-]?\d*")
QUOTES, SPACES, KEY_MARKS, STOPS = "\"'", " \t", "_.-[]", "\"',;} \t\r"


def is_config(path: str) -> bool:
    """Whether lines of a file of that name are redacted at all."""
    base = path.rpartition("/")[2].lower()
    return base.rpartition(".")[2] in CONFIG_EXTENSIONS and "." in base or base.startswith(".env.") or base == ".npmrc"


def parts_of(key: str) -> list[str]:
    """A key's parts between marks and camel-case humps, lower-cased."""
    humps = "".join(f" {c}" if c.isupper() and i and (key[i - 1].islower() or key[i - 1].isdigit()) else " " if c in KEY_MARKS else c for i, c in enumerate(key))
    return humps.lower().split()


def secret_key(key: str) -> bool:
    """Whether a key names a credential."""
    flat = key.lower().replace("-", "").replace("_", "")
    parts = parts_of(key)
    return any(w in flat for w in SECRET_WORDS) or len(parts) > 1 and (parts[-1] in SECRET_LAST_PARTS or not set(parts).isdisjoint(SECRET_PARTS))


def secret_value(value: str) -> bool:
    return _VALUE.match(value) is not None


def _past(s: str, at: int, chars: str) -> int:
    while at < len(s) and s[at] in chars:
        at += 1
    return at


def opening(line: str, spaced: bool, registry: bool) -> tuple[str, int] | None:
    """(key, where its value begins) of a line that opens with a key; `spaced`: blanks may separate; `registry`: a key may follow `//host/:`."""
    at = _past(line, 0, SPACES)
    if registry and line.startswith("//", at):
        at = line.rfind(":", 0, line.find("=") + 1) + 1
        if not at:
            return None
    if line[at : at + 1] == "-" and line[at + 1 : at + 2] in (" ", "\t"):
        at = _past(line, at + 1, SPACES)
    if line.startswith(("export ", "export\t"), at):
        at = _past(line, at + 6, SPACES)
    quote = line[at] if line[at : at + 1] and line[at] in QUOTES else ""
    start = end = at + len(quote)
    while end < len(line) and (line[end].isalnum() or line[end] in KEY_MARKS):
        end += 1
    if start == end or not line.startswith(quote, end):
        return None
    mark = _past(line, end + len(quote), SPACES)
    if line[mark : mark + 1] in ("=", ":"):
        return line[start:end], _past(line, mark + 1, SPACES)
    return (line[start:end], mark) if spaced and end < mark < len(line) else None


def bare(line: str, at: int) -> tuple[int, int]:
    """Where the value from `at` to the end of the line lies without blanks, one comma and a pair of quotes around it."""
    end = len(line.rstrip(SPACES))
    if end > at and line[end - 1] == ",":
        end = max(at, len(line[: end - 1].rstrip(SPACES)))
    quoted = end - at >= 2 and line[at] in QUOTES and line[end - 1] == line[at]
    return (at + 1, end - 1) if quoted else (at, max(at, end))


def _value_after(s: str, start: int, end: int) -> tuple[int, int] | None:
    """Where the value of the key s[start:end] inside a line lies: of an element, of the attribute after a name, or after a separator."""
    if s[start - 1 : start] == "<" and s[end : end + 1] == ">":
        close = s.find("<", end)
        return (end + 1, close) if close > end + 1 and s.startswith("</", close) else None
    at = end
    if s[at : at + 1] and s[at] in QUOTES:
        at += 1
        named = s[: start - 1].lower().endswith(("name=", "key="))
        value = _past(s, at, SPACES)
        if named and value > at and s[value : value + 6].lower() == "value=" and s[value + 6 : value + 7] in ('"', "'"):
            close = s.find(s[value + 6], value + 7)
            return (value + 7, close) if close >= 0 else None
    at = _past(s, at, SPACES)
    if s[at : at + 1] not in ("=", ":"):
        return None
    at = _past(s, at + 1, SPACES)
    if m := _QUOTED.match(s, at):  # to its closing quote, whatever stands in it
        return (at + 1, m.end() - 1) if m.end() > at + 2 and s[at + 1] not in "{$" else None
    at += s[at : at + 1] in (*QUOTES,)
    stop = at
    while stop < len(s) and s[stop] not in STOPS:
        stop += 1
    return (at, stop) if stop > at and s[at] not in "{$" else None


@dataclass(frozen=True)
class Place:
    """Where a value lies in a line, under which key, and how it was found."""

    role: str
    key: str
    start: int
    end: int
    value: str


def keyed(line: str, start: int = 0) -> Iterator[Place]:
    """The values of keys that name credentials, wherever they stand from `start` on."""
    done = start
    for m in _WORD.finditer(line, start):
        flat = m[0].lower().replace("-", "").replace("_", "")
        if m.start() >= done and any(w in flat for w in INSIDE_WORDS) and (span := _value_after(line, m.start(), m.end())):
            done = span[1]
            yield Place("keyed", m[0], *span, line[span[0] : span[1]])


def places(line: str, style: Style) -> tuple[Place | None, list[Place]]:
    """(the value of the key that the line opens with, if it does; the others)."""
    mark = line.lstrip(SPACES)
    comment = mark.startswith(("#", "!", "//"))
    shapes = [Place("shape", "", *m.span(), m[0]) for m in _INSIDE.finditer(line)]
    found = opening(line, style.spaced, style.registry) if not comment or style.registry and mark.startswith("//") else None
    if found is None:
        inner = [] if comment else list(keyed(line))
        return None, inner + [s for s in shapes if all(s.end <= p.start or p.end <= s.start for p in inner)]
    key, at = found
    start, end = bare(line, at)
    more = []
    if line[start:end].startswith(("{", "[")) or style.json and "," in line[at:end]:  # more keys within the value
        more = list(keyed(line, at))
        if style.json and line[at : at + 1] == '"' and (close := line.find('"', at + 1)) > at + 1:
            more.append(Place("first", key, at + 1, close, line[at + 1 : close]))
    return Place("opening", key, start, end, line[start:end]), more


#: when a place of each role is a credential
CREDENTIAL: dict[str, Callable[[Place], bool]] = {
    "keyed": lambda p: True,
    "shape": lambda p: True,
    "first": lambda p: secret_value(p.value),
    "opening": lambda p: secret_value(p.value) and (parts_of(p.key) or [""])[-1] not in VERSION_PARTS,
}


@dataclass(frozen=True)
class Style:
    """What a file's name says of how its lines are read."""

    yaml: bool
    json: bool
    spaced: bool
    registry: bool

    @classmethod
    def of(cls, path: str) -> Style:
        base = path.rpartition("/")[2].lower()
        kind = base.rpartition(".")[2]
        return cls(kind in ("yaml", "yml"), kind == "json", kind == "properties", base == ".npmrc")


def _width(line: str) -> int:
    blank = line[: _past(line, 0, SPACES)]
    return sum(8 if c == "\t" else 1 for c in blank)


@dataclass
class Reader:
    """Lines of a file one after the other. `below`: the indent of a key whose block is left out; `named`: that of a `name:` which names a credential and whose `value:` may follow."""

    style: Style
    below: int | None = None
    named: int | None = None

    def line(self, line: str) -> str | None:
        """The line with its credentials replaced; None if it is part of a block that is left out."""
        if self.below is not None:
            if not line.strip() or _width(line) > self.below:
                return None
            self.below = None
        line = _LOGIN.sub(f"://{MARKER}@", line)
        first, others = places(line, self.style)
        cut = [p for p in others if CREDENTIAL[p.role](p)]
        if first is not None:
            meant = self._meant(first, _width(line))
            if meant and self.below is not None:
                cut = [first]
            elif not first.value or _POINTER.fullmatch(first.value):
                cut = []
            elif meant or not cut and CREDENTIAL["opening"](first):
                cut = [first]
        out, done = [], 0
        for p in sorted(cut, key=lambda p: p.start):
            if p.start >= done:
                out += [line[done : p.start], MARKER]
                done = p.end
        return "".join([*out, line[done:]])

    def _meant(self, p: Place, width: int) -> bool:
        """Whether the key says that its value is a credential; remembers what that means for the lines to come."""
        if self.named is not None and (width < self.named or width == self.named and p.key != "value" or p.key == "name"):
            self.named = None
        meant = secret_key(p.key) or self.named is not None and p.key == "value"
        if self.style.yaml and p.key == "name" and secret_key(p.value):
            self.named = width
        if self.style.yaml and meant and _BLOCK.fullmatch(p.value):
            self.below = width
        return meant


def redact(path: str, text: str | None) -> str | None:
    """A configuration file with its credential values replaced; other files as they are."""
    if text is None or not is_config(path):
        return text
    reader, out = Reader(Style.of(path)), []
    for full in text.split("\n"):
        line = full.removesuffix("\r")
        if (read := reader.line(line)) is not None:
            out.append(read + full[len(line) :])
    return "\n".join(out)
