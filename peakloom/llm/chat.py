"""Chat formatting by a compiled template.

``compile_template`` parses a small sandboxed template language into a syntax tree, folds what is
constant, and turns the tree into Python closures. The language has ``{{ expression | filter }}``,
``{% for x in messages %}``, ``{% if %} / {% elif %} / {% else %}`` and ``{% generation %}``; names
and the fields of a message can be read, nothing can be called, assigned or imported, and a loop
can only run over ``messages``, once. What a generation block prints is under the loss mask.

Texts pass the ``escape`` filter, which puts a backslash before every backslash, ``#``, ``<`` and
``:``, so a control string can't appear inside a text, and ``parse_formatted`` restores every text.

Rows are sorted by conversation and turn inside their partition and rendered turn by turn, so even
a conversation of very many turns needs the memory of one turn only (``render`` joins one whole).

Defined results: a null text or role is empty; null conversation ids form one conversation; equal
turns go by role, then text; repeated rows are repeated turns; a null turn comes first; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TEMPLATE = (
    "{% for message in messages %}### {{ message.role | escape }}: "
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}</turn>{{ '\\n' }}{% endfor %}")


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return re.sub(r"[\\#<:]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "title": str.title}

# ---- syntax tree ----


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: object
    name: str


@dataclass
class Unary:
    of: object


@dataclass
class Binary:
    op: str
    left: object
    right: object


@dataclass
class Filter:
    of: object
    name: str


@dataclass
class Print:
    of: object


@dataclass
class If:
    test: object
    then: list
    other: list = field(default_factory=list)


@dataclass
class For:
    var: str
    body: list


@dataclass
class Generation:
    body: list


_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<op>==|!=|[|.()+])|(?P<name>[A-Za-z][A-Za-z0-9_]*))")
_PLAIN = {"n": "\n", "t": "\t"}


class _Expression:
    """or, and, not, comparison, +, filters, fields: the usual order, by recursive descent."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in texts and self.tokens[self.at][0] in ("op", "name")

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise TemplateError(f"expected {kind or 'more'} in {self.tokens}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.chain("or")
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def chain(self, op: str):
        below = (lambda: self.chain("and")) if op == "or" else self.negation
        node = below()
        while self.peek(op):
            self.take()
            node = Binary(op, node, below())
        return node

    def negation(self):
        if self.peek("not"):
            self.take()
            return Unary(self.negation())
        node = self.sum()
        if self.peek("==", "!="):
            return Binary(self.take(), node, self.sum())
        return node

    def sum(self):
        node = self.filtered()
        while self.peek("+"):
            self.take()
            node = Binary("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.peek("|", "."):
            if self.take() == ".":
                node = Field(node, self.take("name"))
            else:
                name = self.take("name")
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = Filter(node, name)
        return node

    def atom(self):
        if self.peek("("):
            self.take()
            node = self.chain("or")
            if self.take("op") != ")":
                raise TemplateError("expected )")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _PLAIN.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if kind == "name" and text not in ("or", "and", "not"):
            return Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at, loops = 0, 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal at, loops
        out: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Print(_Expression(part[2:-2]).whole()))
            elif not part.startswith("{%"):
                if part:
                    out.append(Print(Const(part)))
            else:
                words = part[2:-2].strip()
                head = words.split()[0] if words else ""
                if head in ends:
                    return out, words
                if head == "for":
                    m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+messages", words)
                    if not m or loops:
                        raise TemplateError("one loop over messages is allowed")
                    loops += 1
                    out.append(For(m[1], block("endfor")[0]))
                elif head == "generation":
                    out.append(Generation(block("endgeneration")[0]))
                elif head == "if":
                    out.append(condition(words[2:]))
                else:
                    raise TemplateError(f"unknown tag {words!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    def condition(test: str) -> If:
        then, end = block("elif", "else", "endif")
        node = If(_Expression(test).whole(), then)
        if end.startswith("elif"):
            node.other = [condition(end[4:])]
        elif end == "else":
            node.other = block("endif")[0]
        return node

    tree = block()[0]
    if loops and not any(isinstance(n, For) for n in tree):
        raise TemplateError("the loop must stand outside conditions and generation blocks")
    return tree


def _text(value: object) -> str:
    return "" if value is None else str(value)


def fold(node):
    """The same tree with constant expressions computed, dead branches gone and neighbouring constants joined."""
    if isinstance(node, list):
        out: list = []
        for n in map(fold, node):
            for x in n if isinstance(n, list) else [n]:
                if isinstance(x, Print) and isinstance(x.of, Const):
                    if out and isinstance(out[-1], Print) and isinstance(out[-1].of, Const):
                        out[-1] = Print(Const(_text(out[-1].of.value) + _text(x.of.value)))
                        continue
                    x = Print(Const(_text(x.of.value)))
                out.append(x)
        return out
    if isinstance(node, Print):
        return Print(fold(node.of))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.var, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, (Unary, Filter)):
        of = fold(node.of)
        new = Unary(of) if isinstance(node, Unary) else Filter(of, node.name)
        return Const(_value(new)({})) if isinstance(of, Const) else new
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        new = Binary(node.op, left, right)
        return Const(_value(new)({})) if isinstance(left, Const) and isinstance(right, Const) else new
    return node


def _value(node) -> Callable[[dict], object]:
    """A closure that computes an expression from the names in scope."""
    if isinstance(node, Const):
        v = node.value
        return lambda scope: v
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Field):
        of, name = _value(node.of), node.name

        def read(scope):
            x = of(scope)
            return x.get(name) if type(x) is dict else None
        return read
    if isinstance(node, Unary):
        of = _value(node.of)
        return lambda scope: not of(scope)
    if isinstance(node, Filter):
        of, f = _value(node.of), FILTERS[node.name]
        return lambda scope: f(_text(of(scope)))
    left, right, op = _value(node.left), _value(node.right), node.op
    if op == "==":
        return lambda scope: left(scope) == right(scope)
    if op == "!=":
        return lambda scope: left(scope) != right(scope)
    if op == "and":
        return lambda scope: left(scope) and right(scope)
    if op == "or":
        return lambda scope: left(scope) or right(scope)
    return lambda scope: _text(left(scope)) + _text(right(scope))


Writer = Callable[[dict, bool, list], None]  #: appends (text, under the loss mask) for a scope


def _writer(body: list) -> Writer:
    steps: list[Writer] = []
    for node in body:
        if isinstance(node, Print):
            value = _value(node.of)
            steps.append(lambda scope, loss, out, value=value: out.append((_text(value(scope)), loss)))
        elif isinstance(node, Generation):
            inner = _writer(node.body)
            steps.append(lambda scope, loss, out, inner=inner: inner(scope, True, out))
        elif isinstance(node, If):
            test, then, other = _value(node.test), _writer(node.then), _writer(node.other)
            steps.append(lambda scope, loss, out, test=test, then=then, other=other:
                         (then if test(scope) else other)(scope, loss, out))

    def write(scope: dict, loss: bool, out: list) -> None:
        for step in steps:
            step(scope, loss, out)
    return write


@dataclass
class Template:
    """What stands before the loop, the loop body for one message, and what stands after it."""
    head: Writer
    body: Writer
    tail: Writer
    var: str

    def turn(self, message: dict) -> list[tuple[str, bool]]:
        out: list = []
        self.body({self.var: message}, False, out)
        return out

    def start(self) -> list[tuple[str, bool]]:
        out: list = []
        self.head({}, False, out)
        return out

    def finish(self) -> list[tuple[str, bool]]:
        out: list = []
        self.tail({}, False, out)
        return out

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans under the loss mask (code points, end exclusive)."""
        parts = self.start() + [x for m in messages for x in self.turn(m)] + self.finish()
        spans, at = [], 0
        for text, loss in parts:
            if loss:
                spans.append((at, at + len(text)))
            at += len(text)
        return "".join(t for t, _ in parts), spans


def compile_template(source: str) -> Template:
    tree = fold(parse(source))
    at = next((i for i, n in enumerate(tree) if isinstance(n, For)), len(tree))
    loop = tree[at] if at < len(tree) else For("message", [])
    return Template(_writer(tree[:at]), _writer(loop.body), _writer(tree[at + 1:]), loop.var)


_ESCAPED = r"(?:[^\\#<:]|\\.)*+"
_TURN = re.compile(rf"### ({_ESCAPED}): ({_ESCAPED})</turn>\n", re.S)


def parse_formatted(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns that the standard template has written."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _sorted(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _walk(batches: Iterator[pa.RecordBatch], template: Template, begin, each, end) -> Iterator:
    """Calls begin(conv), each(state, parts) and end(state) along the sorted rows; yields what end returns."""
    state, current, opened = None, None, False
    for b in batches:
        for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if not opened or conv != current:
                if opened:
                    each(state, template.finish(), False)
                    yield end(state)
                state, current, opened = begin(conv), conv, True
                each(state, template.start(), False)
            each(state, template.turn({"role": role, "text": text}), True)
    if opened:
        each(state, template.finish(), False)
        yield end(state)


def format_conversations(conversations: DataFrame, *, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss_spans: the training text of each conversation and its loss mask."""
    schema = "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compile_template(template)
        rows = _walk(slices(batches, "text"), t, lambda conv: (conv, []), lambda s, parts, turn: s[1].extend(parts), lambda s: s)
        for conv, parts in rows:
            spans, at = [], 0
            for text, loss in parts:
                if loss:
                    spans.append({"start": at, "end": at + len(text)})
                at += len(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array(["".join(x for x, _ in parts)]),
                 pa.array([spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["conv_id", "formatted", "loss_spans"])

    return _sorted(conversations, conv_col, turn_col, role_col, text_col).mapInArrow(run, schema)


def format_digests(conversations: DataFrame, *, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What can be read back from the formatted text of each conversation, without keeping that text."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def begin(conv):
        return {"conv": conv, "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0}

    def each(s, parts, is_turn):
        text = "".join(x for x, _ in parts)
        s["chars"] += len(text)
        if is_turn:
            for role, body in parse_formatted(text):
                s["turns"] += 1
                s["sha"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        for x, loss in parts:
            if loss:
                plain = unescape(x)
                s["loss"] += len(plain)
                s["loss_sha"].update(plain.encode("utf-8", "surrogatepass"))

    def end(s):
        return s["conv"], s["turns"], s["sha"].hexdigest(), s["loss"], s["loss_sha"].hexdigest(), s["chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compile_template(template)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        rows = []
        for row in _walk(slices(batches, "text"), t, begin, each, end):
            rows.append(row)
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)

    return _sorted(conversations, conv_col, turn_col, role_col, text_col).mapInArrow(run, schema)


#: The two turns that the query adds to the table.
PROBE = "\\### Assistant: </turn> ok"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return format_digests(rows.unionByName(probe))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<:]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
