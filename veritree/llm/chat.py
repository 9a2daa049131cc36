"""Chat formatting: a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree
is compiled into Python closures that render a conversation piece by piece, marking which pieces the
model is trained to generate. Syntax:

    {{ expression }}   {% for x in expression %} .. {% endfor %}   {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% generation %} .. {% endgeneration %}   {# comment #}

Expressions have strings, integers, true, false, names, `x.field` of a mapping, ==, !=, +, not, and,
or, parentheses and `| filter`. There are no calls, subscripts, imports or attributes of Python
objects: fields are looked up as mapping keys only, and filters come from a fixed table.

Control strings inside texts are escaped reversibly: in `<`, any run of `\\`, `|`, one more `\\` is put in.
So no escaped text has `<|`, and the markers of a template can be found again. Roles are escaped
likewise, with line breaks and backslashes doubled up as `\\n` and `\\\\`.

Rows: null text, role or missing fields count as empty. Turns are ordered by turn, then role, then
text, so ties have one order, and repeated rows are repeated turns; null turns come first. A null conv_id is a
conversation of its own. Extra columns are ignored. An empty table gives no conversations.

Scale: one exchange by conv_id and one sort in each task; a task streams its rows, holds one turn at
a time, and hashes as it goes, so a conversation of any length needs no more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

START, END = "<|im_start|>", "<|im_end|>"

#: The production template: turns are marked, assistant texts are what the model generates.
CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' + (m.role | escape_role) }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' }}\n{% endfor %}"
)


class TemplateError(ValueError):
    """A template that cannot be compiled, or a value that the sandbox refuses."""


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "lower": str.lower, "upper": str.upper}


# ---- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Apply:
    filter: str
    arg: object


@dataclass(frozen=True)
class Emit:
    expr: object


@dataclass(frozen=True)
class For:
    var: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, body); a last condition Const(True) stands for else


@dataclass(frozen=True)
class Generation:
    body: tuple


TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+().|]))")


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None) -> str:
        if self.at == len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise TemplateError(f"{kind or 'more'} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        left = self.both()
        while self.peek("or"):
            self.take()
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.peek("and"):
            self.take()
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        if self.peek("not"):
            self.take()
            return Op("not", (self.negated(),))
        return self.compared()

    def compared(self):
        left = self.sum()
        while self.peek("==", "!="):
            left = Op(self.take(), (left, self.sum()))
        return left

    def sum(self):
        left = self.filtered()
        while self.peek("+"):
            self.take()
            left = Op("+", (left, self.filtered()))
        return left

    def filtered(self):
        out = self.atom()
        while self.peek("|", "."):
            if self.take() == "|":
                if (name := self.take("name")) not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                out = Apply(name, out)
            else:
                if (name := self.take("name")).startswith("_"):
                    raise TemplateError(f"field {name!r} is not allowed")
                out = Field(out, name)
        return out

    def atom(self):
        if self.peek("("):
            self.take()
            out = self.either()
            if not self.peek(")"):
                raise TemplateError(") expected")
            self.take()
            return out
        if self.at == len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "int":
            return Const(int(value))
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return Const(value == "true") if value in ("true", "false") else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = TAG.split(source)
    at = 0

    def body(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        out = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Emit(_Expression(part[2:-2]).parse()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(out), word, rest
                out.append(statement(word, rest.strip()))
            elif part and not part.startswith("{#"):
                out.append(Emit(Const(part)))
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return tuple(out), "", ""

    def statement(word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            return For(m[1], _Expression(m[2]).parse(), body("endfor")[0])
        if word == "if":
            cases, condition = [], _Expression(rest).parse()
            while True:
                inner, end, more = body("elif", "else", "endif")
                cases.append((condition, inner))
                if end == "endif":
                    return If(tuple(cases))
                if end == "else":
                    return If((*cases, (Const(True), body("endif")[0])))
                condition = _Expression(more).parse()
        if word == "generation":
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


# ---- constant folding


def _operate(kind: str, args: list):
    if kind == "==":
        return args[0] == args[1]
    if kind == "!=":
        return args[0] != args[1]
    if kind == "+":
        if type(args[0]) is not type(args[1]) or not isinstance(args[0], (str, int)):
            raise TemplateError("+ takes two strings or two integers")
        return args[0] + args[1]
    return not args[0]


def fold_expression(e):
    if isinstance(e, Apply):
        arg = fold_expression(e.arg)
        return Const(FILTERS[e.filter](str(arg.value))) if isinstance(arg, Const) else Apply(e.filter, arg)
    if isinstance(e, Field):
        return Field(fold_expression(e.of), e.name)
    if isinstance(e, Op):
        args = tuple(fold_expression(a) for a in e.args)
        if e.kind in ("and", "or"):
            if isinstance(args[0], Const):  # the first decides whether the second counts
                return args[1] if bool(args[0].value) == (e.kind == "and") else args[0]
            return Op(e.kind, args)
        return Const(_operate(e.kind, [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(e.kind, args)
    return e


def fold(body: Iterable) -> tuple:
    """The tree with constant expressions computed, decided branches chosen and neighbouring texts joined."""
    out: list = []
    for node in body:
        if isinstance(node, Emit):
            node = Emit(fold_expression(node.expr))
        elif isinstance(node, For):
            node = For(node.var, fold_expression(node.over), fold(node.body))
        elif isinstance(node, Generation):
            node = Generation(fold(node.body))
        elif isinstance(node, If):
            cases = []
            for condition, inner in node.cases:
                condition = fold_expression(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                cases.append((condition, fold(inner)))
                if isinstance(condition, Const):
                    break
            if not cases:
                continue
            if isinstance(cases[0][0], Const):
                out.extend(cases[0][1])
                continue
            node = If(tuple(cases))
        out.append(node)
    joined: list = []
    for node in out:
        if isinstance(node, Emit) and isinstance(node.expr, Const):
            text = "" if node.expr.value is None else str(node.expr.value)
            if joined and isinstance(joined[-1], Emit) and isinstance(joined[-1].expr, Const):
                joined[-1] = Emit(Const(joined[-1].expr.value + text))
            elif text:
                joined.append(Emit(Const(text)))
        else:
            joined.append(node)
    return tuple(joined)


# ---- closures

Sink = Callable[[str, bool], None]


def _expression(e) -> Callable[[dict], object]:
    if isinstance(e, Const):
        return lambda ctx, v=e.value: v
    if isinstance(e, Name):
        return lambda ctx, n=e.name: ctx.get(n)
    if isinstance(e, Field):
        of = _expression(e.of)

        def look(ctx, name=e.name):
            value = of(ctx)
            if type(value) is not dict:
                raise TemplateError(f"{name!r} of something that has no fields")
            return value.get(name)

        return look
    if isinstance(e, Apply):
        arg, f = _expression(e.arg), FILTERS[e.filter]
        return lambda ctx: f("" if (v := arg(ctx)) is None else str(v))
    args = [_expression(a) for a in e.args]
    if e.kind == "and":
        return lambda ctx: args[0](ctx) and args[1](ctx)
    if e.kind == "or":
        return lambda ctx: args[0](ctx) or args[1](ctx)
    return lambda ctx, kind=e.kind: _operate(kind, [a(ctx) for a in args])


def _block(body: tuple) -> Callable[[dict, Sink, bool], None]:
    steps = [_statement(n) for n in body]

    def run(ctx, out, on):
        for s in steps:
            s(ctx, out, on)

    return steps[0] if len(steps) == 1 else run


def _statement(node) -> Callable[[dict, Sink, bool], None]:
    if isinstance(node, Emit):
        if isinstance(node.expr, Const):
            return lambda ctx, out, on, text=node.expr.value: out(text, on)
        value = _expression(node.expr)
        return lambda ctx, out, on: out("" if (v := value(ctx)) is None else str(v), on)
    if isinstance(node, Generation):
        inner = _block(node.body)
        return lambda ctx, out, on: inner(ctx, out, True)
    if isinstance(node, For):
        over, inner = _expression(node.over), _block(node.body)

        def loop(ctx, out, on, var=node.var):
            own = dict(ctx)
            items = over(ctx)
            if not hasattr(items, "__iter__"):
                raise TemplateError(f"for {var} in something that is no list")
            for i, own[var] in enumerate(items):
                own["loop"] = {"index0": i, "first": i == 0}
                inner(own, out, on)

        return loop
    cases = [(_expression(c), _block(b)) for c, b in node.cases]

    def choose(ctx, out, on):
        for condition, inner in cases:
            if condition(ctx):
                inner(ctx, out, on)
                return

    return choose


def compile_template(source: str) -> Callable[[dict, Sink], None]:
    """render(context, sink): calls sink(text, generated) for each piece, in order. `messages` may be an iterator; it is read as the rendering goes."""
    run = _block(fold(parse(source)))
    return lambda context, sink: run(context, sink, False)


def render(source: str, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The whole text of one conversation and the character spans under the loss mask."""
    pieces: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0

    def sink(text: str, on: bool) -> None:
        nonlocal at
        if on and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        pieces.append(text)
        at += len(text)

    compile_template(source)({"messages": messages}, sink)
    return "".join(pieces), spans


# ---- reading back


@dataclass
class Reader:
    """Reads formatted output back, piece by piece: turns by the markers, the loss text by the mask."""

    on_turn: Callable[[str, str], None] = lambda role, text: None
    n_turns: int = 0
    formatted_chars: int = 0
    loss_chars: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)
    _open: list[str] = field(default_factory=list)
    _masked: list[str] = field(default_factory=list)

    def feed(self, text: str, generated: bool) -> None:
        self.formatted_chars += len(text)
        if generated:
            self._masked.append(text)
        else:
            self._end_mask()
        self._open.append(text)
        if not generated and END in text:  # the template gives a marker in one piece
            whole = "".join(self._open)
            *turns, rest = whole.split(END + "\n")
            for t in turns:
                role, _, said = t.removeprefix(START).partition("\n")
                self._turn(unescape_role(role), unescape(said))
            self._open = [rest] if rest else []

    def _turn(self, role: str, text: str) -> None:
        self.n_turns += 1
        self.turns.update(f"{role}\n{text}\n".encode())
        self.on_turn(role, text)

    def _end_mask(self) -> None:
        if self._masked:
            text = unescape("".join(self._masked))
            self.loss_chars += len(text)
            self.loss.update(text.encode())
            self._masked = []

    def close(self) -> None:
        self._end_mask()


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """Every conversation formatted: conv_id, formatted (the text) and loss_spans (start, end by character). One row holds one conversation whole; use `digests` where a conversation may be too long for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, messages in _conversations(batches):
            text, spans = render(template, list(messages))
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "formatted": [text], "loss_spans": pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return _dealt(conversations).mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


def digests(conversations: DataFrame, template: str = CHATML) -> DataFrame:
    """Every conversation formatted and read back, as counts and digests; streams within a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render_to = compile_template(template)
        rows: list[tuple] = []
        for conv, messages in _conversations(batches):
            reader = Reader()
            render_to({"messages": messages}, reader.feed)
            reader.close()
            rows.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted_chars))
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return _dealt(conversations).mapInArrow(run, DIGESTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def _dealt(conversations: DataFrame) -> DataFrame:
    rows = conversations.selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "coalesce(role, '') as role", "coalesce(text, '') as text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, its messages) of sorted rows; the messages are an iterator that must be used up before the next."""

    def flat():
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield from zip(*(part.column(n).to_pylist() for n in ("conv_id", "role", "text")))

    rows = flat()
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def messages():
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                row = ahead
                yield {"role": row[1], "text": row[2]}
                ahead = next(rows, None)

        turns = messages()
        yield conv, turns
        for _ in turns:  # what a template did not read
            pass
