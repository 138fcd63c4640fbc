"""Chat templates: a small sandboxed language, compiled to closures, run over conversations.

The language has text, ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in y %} {% endfor %}`` and ``{% generation %} {% endgeneration %}``; a dash inside a tag
(``{%-``, ``-%}``) eats the white space beside it. Expressions have strings, whole numbers, true,
false, none, names, ``a.b`` (a key of a mapping, or ``loop.first``, ``loop.last``,
``loop.index0``), ``+``, ``==``, ``!=``, ``and``, ``or``, ``not``, parentheses and filters ``x | f``
from a fixed list. There are no calls, no imports and no attributes, so a template reaches nothing
but its arguments, and it always ends: loops run over the given lists only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of the production format.
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<<END>>",
)
TEMPLATE = (
    "<s>{% for turn in turns %}"
    "{% if turn.role == 'user' %}[INST]{{ turn.text | escape }}[/INST]"
    "{% elif turn.role == 'assistant' %}"
    "{% generation %}{{ turn.text | escape }}{% endgeneration %}</s>"
    "{% elif turn.role == 'system' %}<<SYS>>{{ turn.text | escape }}<</SYS>>"
    "{% else %}<<ROLE>>{{ turn.role | escape }}<</ROLE>>{{ turn.text | escape }}<<END>>"
    "{% endif %}{% endfor %}"
)

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


def escape(text: str) -> str:
    """Double backslashes and put one behind the first character of each control string.

    No control string is left, and ``unescape`` gives the text back.
    """
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": escape,
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "string": str,
}


class TemplateError(ValueError):
    pass


# Syntax tree. Expressions: Const, Name, Member, Filter, Binary, Not. Statements: Text, Output,
# If, For, Generation, Block.
@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: Any
    key: str


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    of: Any


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Block:
    parts: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: Block
    other: Block


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: Block


@dataclass(frozen=True)
class Generation:
    body: Block


_TAG = re.compile(r"(\{\{-?|\{%-?)(.*?)(-?\}\}|-?%\})", re.S)
_LEX = re.compile(
    r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>[0-9]+)"
    r"|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<op>==|!=|[+|.()]))"
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
MAX_DEPTH = 64


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over one tag: or < and < not < comparison < + < filters < members."""

    def __init__(self, source: str):
        self.tokens, self.at, self.depth = _lex(source), 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return value

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def chain(self, ops: tuple[str, ...], below: Callable):
        node = below()
        while op := self.take(*ops):
            node = Binary(op, node, below())
        return node

    def either(self):
        return self.chain(("or",), lambda: self.chain(("and",), self.negated))

    def negated(self):
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self):
        return self.chain(("==", "!="), lambda: self.chain(("+",), self.filtered))

    def filtered(self):
        node = self.single()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Filter(node, name)
        return node

    def single(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            node = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "int":
            node = Const(int(value))
        elif kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            node = Const(fixed[value]) if value in fixed else Name(value)
        elif value == "(":
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise TemplateError("too deeply nested")
            node = self.either()
            self.depth -= 1
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.take("."):
            node = Member(node, self.name())
        return node


def parse(source: str) -> Block:
    """Syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, eat = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if eat else text
        text = text.rstrip() if m[1].endswith("-") else text
        if (m[1][:2] == "{{") != (m[3][-2:] == "}}"):
            raise TemplateError(f"tag {m[0]!r} is not closed as it was opened")
        pieces += [("text", text), ("output" if m[1][:2] == "{{" else "tag", m[2].strip())]
        at, eat = m.end(), m[3].startswith("-")
    rest = source[at:].lstrip() if eat else source[at:]
    pieces.append(("text", rest))
    for kind, text in pieces:
        if kind == "text" and re.search(r"\{\{|\{%|%\}|\}\}", text):
            raise TemplateError(f"a tag is not closed in {text[:40]!r}")
    place = iter(pieces)
    block, ended = _block(place, (), 0, False)
    return block


def _block(place: Iterator, ends: tuple[str, ...], depth: int, inside: bool) -> tuple[Block, str]:
    """Statements up to one of the closing words ``ends``; that tag's text comes along."""
    if depth > MAX_DEPTH:
        raise TemplateError("too deeply nested")
    parts: list[Any] = []
    for kind, body in place:
        if kind == "text":
            if body:
                parts.append(Output(Const(body)))
            continue
        if kind == "output":
            parts.append(Output(_Expression(body).whole()))
            continue
        word, _, rest = body.partition(" ")
        if word in ends:
            return Block(tuple(parts)), body
        if word == "if":
            parts.append(_conditional(place, rest, depth, inside))
        elif word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not m:
                raise TemplateError(f"for without in: {rest!r}")
            over = _Expression(m[2]).whole()
            inner, _ = _block(place, ("endfor",), depth + 1, inside)
            parts.append(For(m[1], over, inner))
        elif word == "generation":
            if inside:
                raise TemplateError("generation inside generation")
            inner, _ = _block(place, ("endgeneration",), depth + 1, True)
            parts.append(Generation(inner))
        else:
            raise TemplateError(f"unexpected tag {body!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return Block(tuple(parts)), ""


def _conditional(place: Iterator, test: str, depth: int, inside: bool) -> If:
    condition = _Expression(test).whole()
    then, ended = _block(place, ("elif", "else", "endif"), depth + 1, inside)
    word, _, rest = ended.partition(" ")
    if word == "elif":
        return If(condition, then, Block((_conditional(place, rest, depth + 1, inside),)))
    other = _block(place, ("endif",), depth + 1, inside)[0] if word == "else" else Block(())
    return If(condition, then, other)


def fold(node: Any) -> Any:
    """The tree with constant parts worked out, dead branches gone and texts joined."""
    if isinstance(node, Member):
        return Member(fold(node.of), node.key)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Not):
        of = fold(node.of)
        return Const(not of.value) if isinstance(of, Const) else Not(of)
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        if isinstance(left, Const) and node.op in ("and", "or"):
            return right if bool(left.value) == (node.op == "and") else left
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(_BINARY[node.op](left.value, right.value))
        return Binary(node.op, left, right)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Block):
        parts: list[Any] = []
        for part in map(fold, node.parts):
            for each in part.parts if isinstance(part, Block) else (part,):
                if isinstance(each, Output) and isinstance(each.value, Const):
                    text = _shown(each.value.value)
                    if not text:
                        continue
                    if parts and isinstance(parts[-1], Output) and isinstance(parts[-1].value, Const):
                        parts[-1] = Output(Const(parts[-1].value.value + text))
                        continue
                    each = Output(Const(text))
                parts.append(each)
        return Block(tuple(parts))
    return node


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _shown(a) + _shown(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


class _Out:
    """Pieces written so far, their length, and the spans under generation."""

    __slots__ = ("pieces", "size", "spans")

    def __init__(self):
        self.pieces, self.size, self.spans = [], 0, []

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Member):
        of, key = _value(node.of), node.key

        def member(scope):
            found = of(scope)
            return found.get(key) if isinstance(found, dict) else None

        return member
    if isinstance(node, Filter):
        of, use = _value(node.of), FILTERS[node.name]

        def filtered(scope):
            found = of(scope)
            return use("" if found is None else found)

        return filtered
    if isinstance(node, Not):
        of = _value(node.of)
        return lambda scope: not of(scope)
    left, right = _value(node.left), _value(node.right)
    if node.op == "and":
        return lambda scope: left(scope) and right(scope)
    if node.op == "or":
        return lambda scope: left(scope) or right(scope)
    use = _BINARY[node.op]
    return lambda scope: use(left(scope), right(scope))


def _statement(node: Any) -> Callable[[dict, _Out], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = _shown(node.value.value)
            return lambda scope, out: out.add(text)
        value = _value(node.value)
        return lambda scope, out: out.add(_shown(value(scope)))
    if isinstance(node, If):
        test, then, other = _value(node.test), _statement(node.then), _statement(node.other)
        return lambda scope, out: then(scope, out) if test(scope) else other(scope, out)
    if isinstance(node, Generation):
        body = _statement(node.body)

        def generation(scope, out):
            begin = out.size
            body(scope, out)
            out.spans.append((begin, out.size))

        return generation
    if isinstance(node, For):
        name, over, body = node.name, _value(node.over), _statement(node.body)

        def each(scope, out):
            items = over(scope)
            items = items if isinstance(items, (list, tuple)) else []
            inner = dict(scope)
            for i, item in enumerate(items):
                inner[name] = item
                inner["loop"] = {"index0": i, "first": i == 0, "last": i == len(items) - 1}
                body(inner, out)

        return each
    parts = [_statement(p) for p in node.parts]

    def block(scope, out):
        for part in parts:
            part(scope, out)

    return block


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function from named arguments to (text, spans of code points under generation)."""
    run = _statement(fold(parse(source)))

    def render(**arguments: Any) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(arguments, out)
        return "".join(out.pieces), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text in the production format."""
    turns, at = [], len("<s>")
    if not formatted.startswith("<s>"):
        raise ValueError("the text does not begin with <s>")
    # An escaped text holds no control string, so the next one closes it.
    shapes = {"[INST]": ("user", "[/INST]"), "<<SYS>>": ("system", "<</SYS>>")}
    while at < len(formatted):
        m = _CONTROL.match(formatted, at)
        opened = m[0] if m else None
        if opened in shapes:
            role, close = shapes[opened]
            begin = m.end()
        elif opened == "<<ROLE>>":
            mid = formatted.index("<</ROLE>>", m.end())
            role, close = unescape(formatted[m.end() : mid]), "<<END>>"
            begin = mid + len("<</ROLE>>")
        else:
            role, close, begin = "assistant", "</s>", at
        end = formatted.index(close, begin)
        turns.append((role, unescape(formatted[begin:end])))
        at = end + len(close)
    return turns


def format_conversations(
    df: DataFrame,
    template: str = TEMPLATE,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(key, formatted, spans) per conversation; spans are (begin, end) under generation.

    Rows of a conversation go by turn, null turns first; rows with one turn number go by role,
    then text; repeated rows are all kept. Null roles and texts count as empty; rows with a null
    key form one conversation. A conversation is one value of the result, so it is gathered in
    one task; the number of conversations is not bounded. An empty table gives an empty result.
    """
    kind = df.schema[key].dataType.simpleString()
    turns = df.groupBy(F.col(key).alias("conv")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col(turn).cast("long").alias("at"),
                    F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )

    def formatted(batches):
        render = compile_template(template)
        for batch in batches:
            out = [render(turns=list(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([o[0] for o in out], pa.string()),
                    pa.array(
                        [[{"begin": a, "end": b} for a, b in o[1]] for o in out],
                        pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
                    ),
                ],
                ["conv", "formatted", "spans"],
            )

    out = turns.mapInArrow(
        formatted,
        f"conv {kind}, formatted string, spans array<struct<begin:bigint,end:bigint>>",
    )
    return out.withColumnRenamed("conv", key)


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted texts say when read back: turns, and the text under the loss mask."""
    kind = formatted.schema[key].dataType.simpleString()

    def read(batches):
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(body)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(body[s["begin"] : s["end"]]) for s in spans)
                rows.append(
                    (
                        len(turns),
                        hashlib.sha256(said.encode()).hexdigest(),
                        len(loss),
                        hashlib.sha256(loss.encode()).hexdigest(),
                        len(body),
                    )
                )
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    out = formatted.select(key, "formatted", "spans").mapInArrow(
        read,
        f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long",
    )
    return out.withColumnRenamed("conv", key)
