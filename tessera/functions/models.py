"""Symbols of process models (E08) and of document templates (E10), a file at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from xml.parsers import expat

# --- process models -----------------------------------------------------------------------------------------------

#: Elements that are nodes of a process, those among them that hold others, and those that count only with a name.
NODES = (
    "task", "serviceTask", "userTask", "sendTask", "receiveTask", "scriptTask", "businessRuleTask", "manualTask", "callActivity", "subProcess", "adHocSubProcess", "transaction",
    "exclusiveGateway", "parallelGateway", "inclusiveGateway", "eventBasedGateway", "complexGateway", "startEvent", "endEvent", "intermediateCatchEvent", "intermediateThrowEvent", "boundaryEvent",
)
HOLDERS = ("subProcess", "adHocSubProcess", "transaction")
EVENTS = ("startEvent", "endEvent", "intermediateCatchEvent", "intermediateThrowEvent", "boundaryEvent")
LEAST_FLOWS = 3


@dataclass
class Element:
    tag: str
    id: str
    name: str
    first: int
    last: int = 0
    inside: list[Element] = field(default_factory=list)


def elements(body: str) -> Element:
    """The elements of a document below a root of none, with their lines, read as a stream of events; prefixes are dropped. Raises ValueError if it is no XML or ends early."""
    reader, open_ = expat.ParserCreate(), [Element("", "", "", 1)]

    def start(tag: str, attributes: dict[str, str]) -> None:
        own = {k.rpartition(":")[2]: v for k, v in attributes.items()}
        new = Element(tag.rpartition(":")[2], own.get("id", ""), own.get("name", ""), reader.CurrentLineNumber)
        open_[-1].inside.append(new)
        open_.append(new)

    def end(_: str) -> None:
        open_.pop().last = reader.CurrentLineNumber

    reader.StartElementHandler, reader.EndElementHandler = start, end
    try:
        reader.Parse(body, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    return open_[0]


def process_symbols(body: str | None) -> Iterator[tuple[str, str, str, int, int]]:
    """(name, kind, scope, first line, last line) in order of lines: nodes (events only if they have a name), runs of LEAST_FLOWS sequence flows or more that follow each other
    among their siblings, and the diagram block. A blank body has none, one that does not parse is a ValueError."""

    def walk(parent: Element, scope: str) -> Iterator[tuple[str, str, str, int, int]]:
        for flows, run in groupby(parent.inside, lambda e: e.tag == "sequenceFlow"):
            siblings = list(run)
            if flows:
                if len(siblings) >= LEAST_FLOWS:
                    yield "sequence flows", "sequenceFlows", scope, siblings[0].first, siblings[-1].last
                continue
            for e in siblings:
                if e.tag == "BPMNDiagram":
                    yield "diagram", "diagram", "", e.first, e.last
                    continue
                shown = (e.name or ("" if e.tag in EVENTS else e.id)) if e.tag in NODES else ""
                if shown:
                    yield shown, e.tag, scope, e.first, e.last
                yield from walk(e, e.id or scope if e.tag == "process" else shown if shown and e.tag in HOLDERS else scope)

    if body and body.strip():
        yield from sorted(walk(elements(body), ""), key=lambda s: s[3])


def process_rows(body: str | None) -> Iterator[tuple[str, str, str, int, int, str]]:
    """`process_symbols` with what is wrong with the body as a last column: then one row that has nothing else."""
    try:
        yield from ((*s, "") for s in list(process_symbols(body)))
    except ValueError as e:
        yield "", "", "", 0, 0, str(e).partition(":")[0]


# --- document templates -------------------------------------------------------------------------------------------

#: Blocks that END closes, blocks that their own name and END close, and beginnings of description lines that are about the file.
CONTROL = ("IF", "WHILE", "FOREACH", "SWITCH", "WITH")
LAYOUT = ("TABLE", "TEXTFRAME")
ABOUT_FILE = ("ERSTELLT", "PROJEKT", "PFAD", "GUI", "EXPLAINMODE", "DPY", "TEXT BEGIN", "TEXT END", "TEXT HINT")
NAME_MOST, TITLE_MOST = 80, 120
DIRECTIVE = re.compile(r"\.([A-Za-z_]+)(.*)", re.S)
LABEL = re.compile(r"(?i)%label[^;]*;")


@dataclass
class Block:
    kind: str
    name: str
    first: int
    last: int = 0


class Blocks:
    """The outermost blocks of a template, from its directives one after the other; `sound` once all are closed."""

    def __init__(self, lines: int):
        self.lines, self.found, self.nested, self.broken, self.ended, self.preview = lines, [], [], False, False, None

    def feed(self, n: int, name: str, rest: str) -> None:
        words = rest.upper().split()
        if name == "DSC":
            self._described(n, words)
        elif name in CONTROL or (name in LAYOUT and words[:1] != ["END"]):
            if not self.nested:
                self.found.append(Block(name.lower(), rest[:NAME_MOST].strip() or name.lower(), n))
            self.nested.append(name)
        elif name in LAYOUT:
            self._close(n, self.nested[-1:] == [name] and len(self.nested) - 1)
        elif name == "END":
            depth = max((i for i, k in enumerate(self.nested) if k in CONTROL), default=None)
            self.broken |= depth is None
            self._close(n, False if depth is None else depth)
        elif name == "EOJ" and not self.nested:
            self.ended = True

    def _close(self, n: int, depth: int | bool) -> None:
        """Back to that many open blocks; False: nothing closes."""
        if depth is False:
            return
        del self.nested[depth:]
        if not self.nested:
            self.found[-1].last = n

    def _described(self, n: int, words: list[str]) -> None:
        if self.nested or not self.ended or words[:1] != ["TEXT"]:
            return
        if words[1:2] == ["BEGIN"] and self.preview is None:
            self.preview = Block("preview", "", n, self.lines)
            self.found.append(self.preview)
        elif words[1:2] == ["END"] and self.preview is not None:
            self.preview.last, self.preview = n, None

    @property
    def sound(self) -> bool:
        return not self.broken and not self.nested


def directive(line: str) -> tuple[str, str] | None:
    m = DIRECTIVE.match(line)
    return (m[1].upper(), m[2].strip()) if m else None


def title_of(described: Iterator[str]) -> str:
    """The first line of a description that is prose about the document."""
    for rest in described:
        said = LABEL.sub("", rest, count=1).strip() if LABEL.match(rest) else rest
        if re.search(r"[0-9A-Za-z\u0080-\U0010FFFF]", said) and said[0] not in ".#*$%" and not said.upper().startswith(ABOUT_FILE):
            return said[:TITLE_MOST].strip()
    return ""


def template_symbols(path: str, body: str | None) -> Iterator[tuple[str, str, str, int, int]]:
    """(name, kind, scope, first line, last line): the head, named by the file's stem with its title as scope, then the outermost blocks and previews. Where blocks do not
    close, only the head, over the whole file; a blank body has none."""
    text = (body or "").removeprefix("﻿")
    if not text.strip():
        return
    lines = [x.replace("\r", "").strip() for x in text.removesuffix("\n").split("\n")]
    base = re.split(r"[/\\]", path)[-1]
    head = "template" if base.lower().endswith(".mtxt") else "textblock"
    stem = re.sub(r"(?i)\.mtx[mt]$", "", base).removeprefix("#")
    blocks, read = Blocks(len(lines)), [directive(x) for x in lines]
    for n, d in enumerate(read, 1):
        if d and not blocks.broken:
            blocks.feed(n, *d)
    found = blocks.found
    if found and found[0].kind != "preview" and not any(lines[: found[0].first - 1]):
        found = found[1:]  # the head would be empty: it takes the block in
    until = found[0].first - 1 if found else len(lines)
    title = title_of(d[1] for d in read[:until] if d and d[0] == "DSC")
    yield stem, head, title, 1, until if blocks.sound else len(lines)
    if blocks.sound:
        scope = f"{stem}: {title}" if title else stem
        yield from ((stem if b.kind == "preview" else b.name, b.kind, scope, b.first, b.last) for b in found)
