"""Chat formatting: a sandboxed template language, compiled to Python closures.

A template is parsed into a syntax tree, constants are folded (literal text joined, operators and filters on literals
evaluated, branches on literals chosen), and the tree becomes closures that write pieces of text; nothing is evaluated by
Python itself. The language:

    {{ expr }}                        text; expressions are names, message.role, 'literals', numbers, true/false/none,
                                      (), ~ and + (joining), ==, !=, and, or, not, and filters: expr | trim
    {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% set name = expr %}
    {% for message in messages %} ... {% endfor %}          once, not nested
    {% generation %} ... {% endgeneration %}                marks what a model is to learn

Names are the two of a message, `loop.first`, and what `set` binds; no attribute, call or import reaches Python. The filters
are `escape`, `trim`, `upper`, `lower`, `default('..')`. `set` holds for the turn (or the text around the loop) it stands in,
so turns can be rendered apart: what stands before the loop goes to the first turn's piece, what stands after it is
`Template.epilogue`.

`escape` makes control strings in texts harmless and can be undone: a backslash is doubled, and one is put behind the first
character of every control string, so none is left in the text. `unescape` drops a backslash before any character.

Rendering is per turn and needs no shuffle (but for `loop.first`, which is a minimum per conversation joined back, only in
templates that use it). `conversations` then walks each conversation's pieces in order with constant memory: a digest over a
conversation is sequential by nature, so only that hashing of ready pieces happens where the conversation's rows meet, in a
stream over sorted rows.

Nulls and edge cases: null texts and roles are empty; rows of a conversation are ordered by turn (nulls first), then role,
then text; repeated rows are turns like others; a null conv_id is a conversation of its own; very long texts and
conversations stream; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>")
#: Marks turns: `<|turn|>role<|text|>text</s>`; assistant texts are under the loss mask.
TEMPLATE = """{% for message in messages %}{{ '<|' ~ 'turn' ~ '|>' }}{{ message.role | escape }}<|text|>\
{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}\
{% elif message.role == 'user' %}[INST] {{ message.content | escape }} [/INST]\
{% elif message.role == 'system' %}<<SYS>>{{ message.content | escape }}<</SYS>>\
{% else %}{{ message.content | escape }}{% endif %}</s>{% endfor %}"""


class TemplateError(ValueError):
    pass


def escaper(controls: tuple[str, ...]):
    cut = re.compile(r"\\|" + "|".join(f"(?={re.escape(c)}){re.escape(c[0])}" for c in sorted(controls)))
    return lambda text: cut.sub(lambda m: m[0] + "\\", text) if text else ""


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: "\\" if m[1] == "\\" else m[1], text) if "\\" in text else text


# --- syntax tree -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Name:
    path: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Out:
    expr: object


@dataclass(frozen=True)
class Bind:
    name: str
    expr: object


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class Learn:
    body: tuple


@dataclass(frozen=True)
class Loop:
    body: tuple


LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_][\w.]*)|(?P<op>==|!=|[()~+|,=]))")
TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
NAMES = {"message.role", "message.content", "loop.first"}
WORDS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t"}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


class Expression:
    """Recursive descent: or, and, not, comparison, joining, filters, atoms."""

    def __init__(self, text: str, names: set[str], filters: dict):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = LEX.match(text, at)
            if not m or m.end() == at:
                raise TemplateError(f"unreadable: {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.names, self.filters = 0, names, filters

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        self.at += (found := self.peek(*values))
        return found

    def whole(self):
        found = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while self.peek("==", "!="):
            kind = self.tokens[self.at][1]
            self.at += 1
            left = Op(kind, (left, self.joined()))
        return left

    def joined(self):
        left = self.filtered()
        while self.take("~", "+"):
            left = Op("~", (left, self.filtered()))
        return left

    def filtered(self):
        left = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            args = [left]
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    self.take(",")
            left = Filter(name, tuple(args))
        return left

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Lit(re.sub(r"(?s)\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1]))
        if kind == "num":
            return Lit(int(value))
        if kind == "name" and value in WORDS:
            return Lit(WORDS[value])
        if kind == "name" and value in self.names:
            return Name(value)
        if value == "(":
            found = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
            return found
        raise TemplateError(f"{value!r} may not be used here")


class Parser:
    def __init__(self, text: str, filters: dict):
        self.parts, self.filters, self.names, self.in_loop = TAG.split(text), filters, set(), False
        self.at = 0

    def expression(self, text: str):
        return Expression(text, self.names | (NAMES if self.in_loop else set()), self.filters).whole()

    def body(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to a tag whose first word is one of `ends`, and that tag."""
        out = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{") and part.endswith("}}"):
                out.append(Out(self.expression(part[2:-2])))
            elif part.startswith("{%") and part.endswith("%}"):
                tag = part[2:-2].strip()
                word, _, rest = tag.partition(" ")
                if word in ends:
                    return tuple(out), tag
                out.append(self.statement(word, rest.strip()))
            elif part:
                out.append(Out(Lit(part)))
        if ends:
            raise TemplateError(f"expected {' or '.join(ends)}")
        return tuple(out), ""

    def statement(self, word: str, rest: str):
        if word == "set":
            name, eq, expr = rest.partition("=")
            if not eq or not re.fullmatch(r"[A-Za-z_]\w*", name := name.strip()) or name in WORDS:
                raise TemplateError(f"cannot set {rest!r}")
            bound = Bind(name, self.expression(expr))
            self.names.add(name)
            return bound
        if word == "if":
            arms, condition = [], self.expression(rest)
            while True:
                body, tag = self.body("elif", "else", "endif")
                arms.append((condition, body))
                kind, _, text = tag.partition(" ")
                if kind == "endif":
                    return If(tuple(arms))
                if kind == "else":
                    body, _ = self.body("endif")
                    return If((*arms, (Lit(True), body)))
                condition = self.expression(text)
        if word == "generation":
            return Learn(self.body("endgeneration")[0])
        if word == "for":
            if self.in_loop or not re.fullmatch(r"message\s+in\s+messages", rest):
                raise TemplateError("the one loop is: for message in messages")
            self.in_loop = True
            body, _ = self.body("endfor")
            self.in_loop = False
            return Loop(body)
        raise TemplateError(f"no statement {word!r}")


# --- folding and compiling ---------------------------------------------------------------------------------------

OPERATORS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a, "~": lambda a, b: _text(a) + _text(b)}


def fold(node, filters: dict):
    """The node with constants evaluated and texts joined; bodies become tuples without dead branches."""
    if isinstance(node, (Op, Filter)):
        args = tuple(fold(a, filters) for a in node.args)
        if all(isinstance(a, Lit) for a in args):
            run = OPERATORS[node.kind] if isinstance(node, Op) else filters[node.name]
            return Lit(run(*(a.value for a in args)))
        return Op(node.kind, args) if isinstance(node, Op) else Filter(node.name, args)
    if isinstance(node, Out):
        return Out(fold(node.expr, filters))
    if isinstance(node, Bind):
        return Bind(node.name, fold(node.expr, filters))
    if isinstance(node, (Learn, Loop)):
        return type(node)(fold_body(node.body, filters))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            condition = fold(condition, filters)
            if isinstance(condition, Lit) and not condition.value:
                continue
            arms.append((condition, fold_body(body, filters)))
            if isinstance(condition, Lit):
                break
        return If(tuple(arms))
    return node


def fold_body(body: tuple, filters: dict) -> tuple:
    out: list = []
    for node in body:
        node = fold(node, filters)
        if isinstance(node, If) and (not node.arms or isinstance(node.arms[0][0], Lit)):
            out += node.arms[0][1] if node.arms else ()
        else:
            out.append(node)
    joined: list = []
    for node in out:
        if isinstance(node, Out) and isinstance(node.expr, Lit):
            if joined and isinstance(joined[-1], Out) and isinstance(joined[-1].expr, Lit):
                node = Out(Lit(_text(joined.pop().expr.value) + _text(node.expr.value)))
            elif not _text(node.expr.value):
                continue
        joined.append(node)
    return tuple(joined)


@dataclass
class Sink:
    """Pieces written so far, and the spans under the loss mask, in code points."""

    parts: list[str] = field(default_factory=list)
    at: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)


def value_of(node, filters: dict):
    if isinstance(node, Lit):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        path = node.path
        return lambda scope: scope.get(path)
    if isinstance(node, Op) and node.kind in ("and", "or"):
        a, b = (value_of(x, filters) for x in node.args)
        return (lambda scope: a(scope) and b(scope)) if node.kind == "and" else (lambda scope: a(scope) or b(scope))
    run = OPERATORS[node.kind] if isinstance(node, Op) else filters[node.name]
    args = [value_of(x, filters) for x in node.args]
    if len(args) == 1:
        one = args[0]
        return lambda scope: run(one(scope))
    if len(args) == 2:
        a, b = args
        return lambda scope: run(a(scope), b(scope))
    return lambda scope: run(*(x(scope) for x in args))


def writer_of(body: tuple, filters: dict):
    steps = [_step(node, filters) for node in body]

    def run(scope, sink):
        for step in steps:
            step(scope, sink)

    return steps[0] if len(steps) == 1 else run


def _step(node, filters: dict):
    if isinstance(node, Out):
        if isinstance(node.expr, Lit):
            text = _text(node.expr.value)
            return lambda scope, sink: sink.write(text)
        value = value_of(node.expr, filters)
        return lambda scope, sink: sink.write(_text(value(scope)))
    if isinstance(node, Bind):
        name, value = node.name, value_of(node.expr, filters)
        return lambda scope, sink: scope.__setitem__(name, value(scope))
    if isinstance(node, Learn):
        body = writer_of(node.body, filters)

        def learn(scope, sink):
            start = sink.at
            body(scope, sink)
            sink.spans.append((start, sink.at))

        return learn
    arms = [(value_of(c, filters), writer_of(b, filters)) for c, b in node.arms]

    def choose(scope, sink):
        for condition, body in arms:
            if condition(scope):
                return body(scope, sink)

    return choose


class Template:
    """A compiled template: `turn(role, content, first)` gives one turn's text and loss spans; `epilogue` follows the last."""

    def __init__(self, text: str, controls: tuple[str, ...] = CONTROLS):
        filters = {"escape": lambda v: escape(_text(v)), "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "default": lambda v, d: d if v in (None, "") else v}
        escape = escaper(controls)
        self.tree = fold_body(Parser(text, filters).body()[0], filters)
        loops = [i for i, n in enumerate(self.tree) if isinstance(n, Loop)]
        if len(loops) != 1 or "Loop(" in repr([n for n in self.tree if not isinstance(n, Loop)]):
            raise TemplateError("a template has one loop over messages, outside of any block")
        around = lambda nodes: self._render(writer_of(nodes, filters), {})[0]
        self.prologue, self.epilogue = around(self.tree[: loops[0]]), around(self.tree[loops[0] + 1 :])
        self._turn = writer_of(self.tree[loops[0]].body, filters)
        self.needs_first = bool(self.prologue) or "loop.first" in repr(self.tree)

    @staticmethod
    def _render(body, scope: dict) -> tuple[str, list[tuple[int, int]]]:
        body(scope, sink := Sink())
        return "".join(sink.parts), sink.spans

    def turn(self, role: str, content: str, first: bool = False) -> tuple[str, list[tuple[int, int]]]:
        text, spans = self._render(self._turn, {"message.role": role, "message.content": content, "loop.first": first})
        if first and self.prologue:
            n = len(self.prologue)
            return self.prologue + text, [(a + n, b + n) for a, b in spans]
        return text, spans


# --- on Spark ----------------------------------------------------------------------------------------------------

PIECE = "conv_id long, turn long, role string, text string, formatted string, loss array<struct<start:int,end:int>>"


def render(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """`rows(conv_id, turn, role, text)` -> one piece per turn: its formatted text and the spans under the loss mask."""
    needs_first = Template(template).needs_first
    keep = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if needs_first:
        lead = keep.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("lead"))
        same = keep.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
        marked = same.join(lead.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("leads", F.struct("turn", "role", "text").eqNullSafe(F.col("lead")))
        keep = marked.select("conv_id", "turn", "role", "text", F.posexplode(F.array_repeat("leads", F.col("n").cast("int"))).alias("copy", "leads")).select("conv_id", "turn", "role", "text", (F.col("leads") & (F.col("copy") == 0)).alias("first"))
    else:
        keep = keep.withColumn("first", F.lit(False))

    def run(batches):
        made = Template(template)
        for b in batches:
            pieces = [made.turn(r, t, f) for r, t, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
            spans = [[{"start": s, "end": e} for s, e in p[1]] for p in pieces]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([p[0] for p in pieces], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["conv_id", "turn", "role", "text", "formatted", "loss"])

    return keep.mapInArrow(run, PIECE)


TURN = re.compile(r"(?s)<\|turn\|>(.*?)<\|text\|>(.*?)</s>")
FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>")}


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a text that `TEMPLATE` formatted."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        role, body, at = unescape(m[1]), m[2], m.end()
        before, after = FRAMES.get(role, ("", ""))
        if not (body.startswith(before) and body.endswith(after)):
            raise ValueError(f"a turn of {role!r} is not framed")
        out.append((role, unescape(body[len(before) : len(body) - len(after)])))
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


READ = "conv_id long, turn long, role string, text string, n long, turns string, loss_text string, chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """Turns and learned text of each piece, from its formatted text and spans alone. To be shuffled once only, they are null where they say what role and text do."""

    def run(batches):
        for b in batches:
            n, turns, learned, chars = [], [], [], []
            for role, body, text, spans in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                found = read_turns(text)
                n.append(len(found))
                turns.append(None if found == [(role, body)] else "".join(f"{r}\n{t}\n" for r, t in found))
                said = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                learned.append(None if said == body else said)
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(learned, pa.string()), pa.array(chars, pa.int64())], names=["conv_id", "turn", "role", "text", "n", "turns", "loss_text", "chars"])

    return pieces.mapInArrow(run, READ)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, system_turns long"


def conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation over `read_back` rows: a stream over sorted rows that holds one digest at a time."""

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("system_turns", pa.int64())])
        done: list[tuple] = []
        here = state = None

        def close():
            if state:
                done.append((here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [()] * 7, schema)], schema=schema)
            done.clear()
            return out

        for b in batches:
            for conv, role, body, n, text, learned, chars in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7))):
                text, learned = f"{role}\n{body}\n" if text is None else text, body if learned is None else learned
                if state is None or conv != here:
                    close()
                    here, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[0] += n
                state[1].update(text.encode("utf-8", "surrogatepass"))
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += chars
                state[5] += role == "system"
            yield flush()
        close()
        yield flush()

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, DIGEST)


CHECK_ROWS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def _sql() -> str:
    """The same digests; formatted lengths from the lengths of escaped texts and what the template adds."""
    added = r"(length({0}) - length(replace({0}, chr(92), '')))"  # doubled backslashes
    hits = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', '{c[1:]}')))" for c in CONTROLS)
    extra = lambda col: f"length({col}) + {added.format(col)} + {hits.format(col)}"
    fixed = {"user": len("[INST]  [/INST]"), "system": len("<<SYS>><</SYS>>")}
    frame = " ".join(f"WHEN role = '{r}' THEN {n}" for r, n in fixed.items())
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {extra("text")} + {extra("role")} + {len("<|turn|><|text|></s>")} + CASE {frame} ELSE 0 END AS chars FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (WHERE role = 'system') AS BIGINT) AS system_turns
FROM e GROUP BY conv_id
"""


SQL = _sql()
