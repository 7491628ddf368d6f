"""Chat formatting by a template compiler.

A sandboxed template language is parsed into a syntax tree, constants are
folded, and the tree becomes Python closures that render a conversation as
pieces of text, each with a flag: under the loss mask or not.

    {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}
    {% for x in e %} {% endfor %}   {% generation %} {% endgeneration %}

Expressions: names, x.key and x['key'] (keys of mappings only), strings,
integers, true/false/none, + ~ == != < <= > >= and or not, `a if c else b`,
filters `guard`, `trim`, `upper`, `lower`; `loop.first`, `loop.last`,
`loop.index`. There are no calls, no Python attributes, no assignments, so a
template can reach nothing but the conversation.

``guard`` escapes the template's control strings inside texts, reversibly: a
backslash is doubled, and where a control string begins a backslash is put
after its first character, as after a text whose end could run into one.

A conversation is rendered and read back turn by turn and written in parts, so
a very long one is never held whole.

Edge cases: a null text or role is empty; turns go by number, those without
one first, ties by role and text; repeated rows are turns of their own; rows
without conv_id are one conversation; an empty table gives none; further columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TURN]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text | guard }}[/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text | guard }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role | guard }}[TURN]{{ m.text | guard }}[/ROLE]{% endif %}"
    "{% endfor %}"
)
SCHEMA = "conv_id long, part int, formatted string, spans array<struct<start: long, stop: long>>"
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
MAX_TEMPLATE, MAX_DEPTH, MAX_CHAIN, PART_CHARS = 100_000, 40, 150, 1_000_000


class TemplateError(ValueError):
    """The template is not in the language."""


# Syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Show:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# Parser

#: Expressions and tags; strings in them may hold closing braces.
_STRING = r"'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\""
_PIECE = re.compile(rf"\{{\{{((?:{_STRING}|[^'\"])*?)\}}\}}|\{{%((?:{_STRING}|[^'\"])*?)%\}}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~.\[\]()|]))", re.S)
_WORDS = {"and", "or", "not", "if", "else", "in"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(text: str) -> list[tuple[str, object]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"unexpected {text[at:][:20]!r}")
        at = m.end()
        number, single, double, name, sign = m.groups()
        if number is not None:
            out.append(("const", int(number)))
        elif single is not None or double is not None:
            raw = single if single is not None else double
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), raw, flags=re.S)))
        elif name in ("true", "false", "none"):
            out.append(("const", {"true": True, "false": False, "none": None}[name]))
        else:
            out.append(("sign" if sign or name in _WORDS else "name", sign or name))
    return out


class _Expression:
    """Precedence climbing over one expression's tokens."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("+", "~"))

    def __init__(self, text: str) -> None:
        self.tokens, self.at, self.depth, self.chained = _tokens(text), 0, 0, 0

    def chain(self) -> None:
        """Each operator makes the tree one deeper at most; what walks the tree later does so by recursion."""
        self.chained += 1
        if self.chained > MAX_CHAIN:
            raise TemplateError("too many operators in one expression")

    def peek(self) -> object:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)
        return value if kind == "sign" else None

    def take(self, kind: str, value: object = None) -> object:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or value is not None and self.tokens[self.at][1] != value:
            raise TemplateError(f"expected {value or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> object:
        out = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> object:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        out = self.level(0)
        if self.peek() == "if":
            self.take("sign", "if")
            test = self.level(0)
            self.take("sign", "else")
            out = Op("choose", (test, out, self.choice()))
        self.depth -= 1
        return out

    def level(self, n: int) -> object:
        if n == len(self.LEVELS):
            return self.filtered()
        if n == 2 and self.peek() == "not":
            self.take("sign", "not")
            self.chain()
            return Op("not", (self.level(2),))
        out = self.level(n + 1)
        while self.peek() in self.LEVELS[n]:
            self.chain()
            out = Op(self.take("sign"), (out, self.level(n + 1)))
        return out

    def filtered(self) -> object:
        out = self.primary()
        while self.peek() in ("|", ".", "["):
            sign = self.take("sign")
            self.chain()
            if sign == "|":
                name = self.take("name")
                if name not in ("guard", "trim", "upper", "lower"):
                    raise TemplateError(f"no filter {name}")
                out = Op(name, (out,))
            elif sign == ".":
                out = Item(out, Const(self.take("name")))
            else:
                out = Item(out, self.choice())
                self.take("sign", "]")
        return out

    def primary(self) -> object:
        if self.peek() == "(":
            self.take("sign", "(")
            out = self.choice()
            self.take("sign", ")")
            return out
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            return Const(self.take("const"))
        return Name(self.take("name"))


def parse(template: str) -> tuple:
    """The template's syntax tree: a tuple of nodes."""
    if len(template) > MAX_TEMPLATE:
        raise TemplateError("template too long")
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PIECE.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at : m.start()]))
        parts.append(("show", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))
    for kind, value in parts:
        if kind == "text" and ("{{" in value or "{%" in value):
            raise TemplateError(f"not closed: {value[:20]!r}")
    place = 0

    def block(ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        nonlocal place
        if depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        nodes: list[object] = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                nodes.append(Show(Const(value)))
            elif kind == "show":
                nodes.append(Show(_Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(nodes), value
                if word == "if":
                    nodes.append(condition(rest, depth))
                elif word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad loop {rest!r}")
                    body, _ = block(("endfor",), depth + 1)
                    nodes.append(For(m[1], _Expression(m[2]).whole(), body))
                elif word == "generation":
                    body, _ = block(("endgeneration",), depth + 1)
                    nodes.append(Generation(body))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(nodes), ""

    def condition(test: str, depth: int) -> If:
        then, end = block(("elif", "else", "endif"), depth + 1)
        word, _, rest = end.partition(" ")
        if word == "elif":
            other: tuple = (condition(rest, depth + 1),)
        elif word == "else":
            other, _ = block(("endif",), depth + 1)
        else:
            other = ()
        return If(_Expression(test).whole(), then, other)

    return block((), 0)[0]


# Folding and closures


def _text(value: object) -> str:
    return "" if value is None else str(value)


class Guard:
    """Escapes control strings inside texts, and undoes it."""

    def __init__(self, control: tuple[str, ...]) -> None:
        strings = [c for c in control if c]
        begins = {c[:i] for c in strings for i in range(1, len(c))}
        self._begin = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in strings)) if strings else None
        self._tail = re.compile("(?:" + "|".join(map(re.escape, sorted(begins, key=len, reverse=True))) + r")\Z") if begins else None
        self._undo = re.compile(r"\\(\\?)")

    def __call__(self, value: object) -> str:
        text = _text(value).replace("\\", "\\\\")
        if self._begin:
            text = self._begin.sub(r"\\", text)
        return text + "\\" if self._tail and self._tail.search(text) else text

    def undo(self, text: str) -> str:
        return self._undo.sub(r"\1", text)


_PURE: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a, "choose": lambda c, a, b: a if c else b,
    "trim": lambda a: _text(a).strip(), "upper": lambda a: _text(a).upper(), "lower": lambda a: _text(a).lower(),
}


def fold(node: object, guard: Guard) -> object:
    """The tree with constant parts evaluated, dead branches cut and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list[object] = []
        for x in node:
            x = fold(x, guard)
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Show) and isinstance(y.value, Const):
                    if out and isinstance(out[-1], Show) and isinstance(out[-1].value, Const):
                        y = Show(Const(_text(out.pop().value.value) + _text(y.value.value)))
                    elif _text(y.value.value) == "":
                        continue
                out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a, guard) for a in node.args)
        if node.op == "choose" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        if all(isinstance(a, Const) for a in args):
            try:
                return Const((guard if node.op == "guard" else _PURE[node.op])(*(a.value for a in args)))
            except TypeError as e:
                raise TemplateError(str(e)) from None
        return Op(node.op, args)
    if isinstance(node, Item):
        return Item(fold(node.of, guard), fold(node.key, guard))
    if isinstance(node, Show):
        return Show(fold(node.value, guard))
    if isinstance(node, If):
        test = fold(node.test, guard)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, guard)
        return If(test, fold(node.then, guard), fold(node.other, guard))
    if isinstance(node, For):
        return For(node.name, fold(node.over, guard), fold(node.body, guard))
    if isinstance(node, Generation):
        return Generation(fold(node.body, guard))
    return node


Env = dict[str, object]
Pieces = Iterator[tuple[str, bool]]


def _value(node: object, guard: Guard) -> Callable[[Env], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, guard), _value(node.key, guard)

        def item(env: Env) -> object:
            x = of(env)
            return x.get(key(env)) if isinstance(x, dict) else None

        return item
    args = [_value(a, guard) for a in node.args]
    if node.op in ("and", "or", "choose"):  # those that needn't evaluate all
        if node.op == "choose":
            return lambda env: args[1](env) if args[0](env) else args[2](env)
        return (lambda env: args[0](env) and args[1](env)) if node.op == "and" else (lambda env: args[0](env) or args[1](env))
    f = guard if node.op == "guard" else _PURE[node.op]
    if len(args) == 1:
        one = args[0]
        return lambda env: f(one(env))
    a, b = args
    return lambda env: f(a(env), b(env))


def _render(node: object, guard: Guard) -> Callable[[Env, bool], Pieces]:
    """A closure that yields the node's pieces."""
    if isinstance(node, tuple):
        parts = [_render(x, guard) for x in node]

        def block(env: Env, masked: bool) -> Pieces:
            for part in parts:
                yield from part(env, masked)

        return parts[0] if len(parts) == 1 else block
    if isinstance(node, Show):
        value = _value(node.value, guard)
        return lambda env, masked: iter(((_text(value(env)), masked),))
    if isinstance(node, If):
        test, then, other = _value(node.test, guard), _render(node.then, guard), _render(node.other, guard)
        return lambda env, masked: then(env, masked) if test(env) else other(env, masked)
    if isinstance(node, Generation):
        body = _render(node.body, guard)

        def generation(env: Env, masked: bool) -> Pieces:
            yield "", False  # so that two spans in a row stay two
            yield from body(env, True)

        return generation
    name, over, body = node.name, _value(node.over, guard), _render(node.body, guard)

    def loop(env: Env, masked: bool) -> Pieces:
        rows = over(env)
        if not isinstance(rows, list | Iterator):
            raise TemplateError("a loop needs a list")
        rows, end = iter(rows), object()
        now, i = next(rows, end), 0
        while now is not end:
            after = next(rows, end)
            yield from body(env | {name: now, "loop": {"index": i + 1, "first": i == 0, "last": after is end}}, masked)
            now, i = after, i + 1

    return loop


def _mentions(node: object, looped: bool = False) -> list[bool]:
    """For each mention of ``messages``: whether it is the list of a loop that stands in no other."""
    if isinstance(node, For):
        over = [not looped] if node.over == Name("messages") else _mentions(node.over, True)
        return over + _mentions(node.body, True)
    if isinstance(node, Name):
        return [False] * (node.name == "messages")
    parts = node if isinstance(node, tuple) else vars(node).values() if hasattr(node, "__dataclass_fields__") else ()
    return [m for x in parts for m in _mentions(x, looped)]


class Template:
    """A compiled template."""

    def __init__(self, source: str = TEMPLATE, control: tuple[str, ...] = CONTROL) -> None:
        self.guard = Guard(control)
        self.tree = fold(parse(source), self.guard)
        self.streams = _mentions(self.tree) == [True]  # the turns can come one by one
        self._run = _render(self.tree, self.guard)

    def parts(self, messages: Iterable[dict[str, str]], chars: int = PART_CHARS) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """The formatted conversation in parts of about so many code points, each with its spans under the loss mask.

        Parts end outside spans. Turns are taken one by one where the template
        goes through them once, so no more than a part and a turn is held.
        """
        texts: list[str] = []
        spans: list[tuple[int, int]] = []
        at, open_ = 0, False
        for text, masked in self._run({"messages": iter(messages) if self.streams else list(messages)}, False):
            if at >= chars and not masked:
                yield "".join(texts), spans
                texts, spans, at = [], [], 0
            if masked and open_:
                spans[-1] = (spans[-1][0], at + len(text))
            elif masked:
                spans.append((at, at + len(text)))
            open_ = masked
            texts.append(text)
            at += len(text)
        yield "".join(texts), spans

    def render(self, messages: list[dict[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The whole formatted conversation and its spans."""
        (out,) = self.parts(messages, 1 << 62)
        return out


_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|\[ROLE\](?P<role>.*?)\[TURN\](?P<text>.*?)\[/ROLE\]", re.S)


def read_turns(formatted: str, guard: Guard, more: bool = False) -> Iterator[tuple[str, str, int]]:
    """(role, text, where it ends) of each turn, read back from what the default template made; with ``more`` the last may be cut."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            if more:
                return
            raise ValueError(f"no turn at {at}")
        at, kind = m.end(), m.lastgroup
        yield (guard.undo(m["role"]), guard.undo(m["text"]), at) if kind == "text" else (kind, guard.undo(m[kind]), at)


# On tables


def format_conversations(rows: DataFrame, template: str = TEMPLATE, control: tuple[str, ...] = CONTROL, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, formatted, spans): each conversation in parts, nearly always one; spans are under the loss mask.

    A conversation's parts are consecutive rows of one partition, in order.
    """
    compiled = (template, control)
    Template(*compiled)  # errors show before the job

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Template(*compiled)
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []
        size = 0
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def out() -> pa.RecordBatch:
            ids, parts, texts, spans = zip(*held, strict=True)
            return pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "part": pa.array(parts, pa.int32()), "formatted": pa.array(texts, pa.string()), "spans": pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], kind)})

        for conv, turns in groupby(stream, key=itemgetter(0)):
            said = ({"role": role or "", "text": text or ""} for _, _, role, text in turns)
            for k, (text, marked) in enumerate(made.parts(said, part_chars)):
                held.append((conv, k, text, marked))
                size += len(text)
                if size > 4 * PART_CHARS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


class _Reader:
    """Reads a conversation back, part by part."""

    def __init__(self, guard: Guard) -> None:
        self.guard, self.rest = guard, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.size = 0

    def add(self, text: str, spans: list[dict]) -> None:
        for span in spans:
            said = self.guard.undo(text[span["start"] : span["stop"]])
            self.loss.update(said.encode())
            self.chars += len(said)
        self.size += len(text)
        self.rest += text
        at = 0
        for role, said, at in read_turns(self.rest, self.guard, more=True):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n += 1
        self.rest = self.rest[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("the last turn does not end")
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold: counts and digests of turns and of the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guard = Guard(CONTROL)
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        out = lambda: pa.RecordBatch.from_pydict({n: pa.array(v, pa.string() if n.endswith("256") else pa.int64()) for n, v in zip(names, zip(*held, strict=True), strict=True)})
        for conv, parts in groupby(stream, key=itemgetter(0)):
            reader = _Reader(guard)
            for _, _, text, spans in parts:
                reader.add(text, spans)
            held.append((conv, *reader.row()))
            if len(held) >= 10_000:
                yield out()
                held = []
        if held:
            yield out()

    return formatted.select("conv_id", "part", "formatted", "spans").mapInArrow(run, READ_SCHEMA)


def read_back_sql(table: str) -> str:
    """What read_back gives for the default template, in DuckDB SQL. ``table``: a query for conv_id, turn, role, text."""

    def guarded(x: str) -> str:
        out = f"replace({x}, '\\', '\\\\')"
        for c in CONTROL:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        begins = sorted({c[:i] for c in CONTROL for i in range(1, len(c))})
        return f"length({out}) + (CASE WHEN {' OR '.join(f"ends_with({x}, '{b}')" for b in begins)} THEN 1 ELSE 0 END)"

    size = f"CASE WHEN role = 'user' THEN 13 + {guarded('text')} WHEN role = 'assistant' THEN 7 + {guarded('text')} ELSE 19 + {guarded('role')} + {guarded('text')} END"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({table}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum({size}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
