"""Chat formatting with a small sandboxed template language, compiled to Python closures.

A template is text with ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %}`` / ``{% elif %}`` / ``{% else %}``,
``{% set x = expression %}``, ``{% generation %}`` around what the model has to produce, and ``{# remarks #}``.
Expressions know literals, variables, fields of maps, ``loop.index0 / index / first / last``, ``+``, ``==``, ``!=``,
``in``, ``and``, ``or``, ``not`` and the filters below; there are no calls, and no attribute of a Python object can be
reached. The source becomes a syntax tree, constants are folded (joined texts, decided branches), and every node becomes
a closure that yields (text, whether it is to be generated). Loops read their messages one by one, so a conversation of
any length is rendered in bounded memory.

Control strings inside texts are escaped reversibly: every ``<|`` gets a backslash after ``<``, and one more if there
are some already. The only ``<|`` in the output are the template's own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from spanmill.llm.tasks import Batches, in_arrow

TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|im_start|>' + message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ '<|im_end|>' }}\n"
    "{% endfor %}"
)
#: Characters after which a formatted conversation goes on in another row, at the end of a piece of the template.
SEGMENT = 1 << 20


class TemplateError(ValueError):
    """The template does not follow the language."""


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_line(text: str) -> str:
    """``escape`` for texts that must stay on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower,
}


# Syntax tree -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: object


@dataclass(frozen=True)
class Filtered:
    of: object
    name: str


@dataclass(frozen=True)
class Binary:
    sign: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    items: object
    body: tuple


@dataclass(frozen=True)
class Choice:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# Parser ----------------------------------------------------------------------------------------------------------

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+|.\[\]()]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = ("text", "number", "word", "sign")[found.lastindex - 1]
            self.tokens.append((kind, found[found.lastindex]))
            at = found.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> bool:
        if self.peek()[0] in ("word", "sign") and self.peek()[1] in values:
            self.at += 1
            return True
        return False

    def word(self) -> str:
        kind, value = self.peek()
        if kind != "word":
            raise TemplateError(f"expected a name, not {value!r}")
        self.at += 1
        return value

    def whole(self):
        node = self.any_of()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def any_of(self):
        node = self.all_of()
        while self.take("or"):
            node = Binary("or", node, self.all_of())
        return node

    def all_of(self):
        node = self.negation()
        while self.take("and"):
            node = Binary("and", node, self.negation())
        return node

    def negation(self):
        return Not(self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        node = self.total()
        for sign in ("==", "!=", "in"):
            if self.take(sign):
                return Binary(sign, node, self.total())
        return node

    def total(self):
        node = self.filtered()
        while self.take("+"):
            node = Binary("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.path()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Filtered(node, name)
        return node

    def path(self):
        node = self.atom()
        while True:
            if self.take("."):
                node = Field(node, Const(self.word()))
            elif self.take("["):
                node = Field(node, self.any_of())
                if not self.take("]"):
                    raise TemplateError("missing ]")
            else:
                return node

    def atom(self):
        kind, value = self.peek()
        if self.take("("):
            node = self.any_of()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if kind == "word" and value not in ("and", "or", "not", "in"):
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The statements of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for found in _PARTS.finditer(source):
        if found.start() > at:
            parts.append(("text", source[at : found.start()]))
        if found[1] is not None:
            parts.append(("output", found[1]))
        elif found[2] is not None:
            parts.append(("tag", found[2].strip()))
        at = found.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    position = 0

    def block(*stops: str) -> tuple[tuple, str]:
        nonlocal position
        body = []
        while position < len(parts):
            kind, value = parts[position]
            position += 1
            if kind == "text":
                body.append(Output(Const(value)))
            elif kind == "output":
                body.append(Output(_Expression(value).whole()))
            else:
                word = value.split(None, 1)[0] if value else ""
                if word in stops:
                    return tuple(body), value
                body.append(statement(word, value[len(word) :]))
        if stops:
            raise TemplateError(f"missing {' or '.join(stops)}")
        return tuple(body), ""

    def statement(word: str, rest: str):
        if word == "for":
            head = _Expression(rest)
            name = head.word()
            if not head.take("in"):
                raise TemplateError("for needs in")
            return Loop(name, head.whole(), block("endfor")[0])
        if word == "if":
            branches, condition = [], _Expression(rest).whole()
            while True:
                body, stop = block("elif", "else", "endif")
                branches.append((condition, body))
                if stop == "endif":
                    return Choice(tuple(branches))
                condition = Const(True) if stop == "else" else _Expression(stop[4:]).whole()
        if word == "set":
            name, _, value = rest.partition("=")
            return Assign(name.strip(), _Expression(value).whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    return block()[0]


# Folding ---------------------------------------------------------------------------------------------------------


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _apply(sign: str, left: object, right: object) -> object:
    if sign == "+":
        return left + right if isinstance(left, int) and isinstance(right, int) else _text(left) + _text(right)
    if sign == "==":
        return left == right
    if sign == "!=":
        return left != right
    return left in right if isinstance(right, (str, dict, list, tuple)) else False


def fold_expression(node):
    """The expression with every part that is constant computed."""
    match node:
        case Binary(sign, left, right):
            left, right = fold_expression(left), fold_expression(right)
            if isinstance(left, Const):
                if sign in ("and", "or"):
                    return right if bool(left.value) == (sign == "and") else left
                if isinstance(right, Const):
                    return Const(_apply(sign, left.value, right.value))
            return Binary(sign, left, right)
        case Not(of):
            of = fold_expression(of)
            return Const(not of.value) if isinstance(of, Const) else Not(of)
        case Filtered(of, name):
            of = fold_expression(of)
            return Const(FILTERS[name](_text(of.value))) if isinstance(of, Const) else Filtered(of, name)
        case Field(of, key):
            return Field(fold_expression(of), fold_expression(key))
    return node


def fold(body: tuple) -> tuple:
    """The statements with constant parts computed, neighbouring texts joined and decided branches chosen."""
    done: list = []
    for node in body:
        match node:
            case Output(value):
                value = fold_expression(value)
                if isinstance(value, Const):
                    value = Const(_text(value.value))
                    if not value.value:
                        continue
                    if done and isinstance(done[-1], Output) and isinstance(done[-1].value, Const):
                        done[-1] = Output(Const(done[-1].value.value + value.value))
                        continue
                done.append(Output(value))
            case Loop(name, items, inner):
                done.append(Loop(name, fold_expression(items), fold(inner)))
            case Generation(inner):
                done.append(Generation(fold(inner)))
            case Assign(name, value):
                done.append(Assign(name, fold_expression(value)))
            case Choice(branches):
                left = []
                for condition, inner in branches:
                    condition = fold_expression(condition)
                    if isinstance(condition, Const) and not condition.value:
                        continue
                    left.append((condition, fold(inner)))
                    if isinstance(condition, Const):
                        break
                if left and isinstance(left[0][0], Const):
                    done.extend(left[0][1])
                elif left:
                    done.append(Choice(tuple(left)))
    if any(isinstance(a, Output) and isinstance(b, Output) and isinstance(a.value, Const) and isinstance(b.value, Const) for a, b in zip(done, done[1:], strict=False)):
        return fold(tuple(done))
    return tuple(done)


# Code generation -------------------------------------------------------------------------------------------------

Piece = tuple[str, bool]


def _value_of(node) -> Callable[[dict], object]:
    match node:
        case Const(value):
            return lambda scope: value
        case Name(name):
            return lambda scope: scope.get(name)
        case Field(of, key):
            get_of, get_key = _value_of(of), _value_of(key)

            def field(scope: dict) -> object:
                owner, name = get_of(scope), get_key(scope)
                if isinstance(owner, dict):
                    return owner.get(name)
                if isinstance(owner, (list, tuple, str)) and isinstance(name, int):
                    return owner[name] if -len(owner) <= name < len(owner) else None
                return None

            return field
        case Filtered(of, name):
            get, use = _value_of(of), FILTERS[name]
            return lambda scope: use(_text(get(scope)))
        case Not(of):
            get = _value_of(of)
            return lambda scope: not get(scope)
        case Binary(sign, left, right):
            one, two = _value_of(left), _value_of(right)
            if sign == "and":
                return lambda scope: one(scope) and two(scope)
            if sign == "or":
                return lambda scope: one(scope) or two(scope)
            return lambda scope: _apply(sign, one(scope), two(scope))
    raise TemplateError(f"no expression {node!r}")


def _body_of(body: tuple, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step_of(node, generated) for node in body]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _step_of(node, generated: bool) -> Callable[[dict], Iterable[Piece]]:
    match node:
        case Output(Const(value)):
            fixed = ((value, generated),)
            return lambda scope: fixed
        case Output(value):
            get = _value_of(value)
            return lambda scope: ((_text(get(scope)), generated),)
        case Generation(inner):
            return _body_of(inner, True)
        case Assign(name, value):
            get_value = _value_of(value)

            def assign(scope: dict) -> Iterable[Piece]:
                scope[name] = get_value(scope)
                return ()

            return assign
        case Choice(branches):
            compiled = [(_value_of(condition), _body_of(inner, generated)) for condition, inner in branches]

            def choose(scope: dict) -> Iterator[Piece]:
                for condition, inner in compiled:
                    if condition(scope):
                        yield from inner(scope)
                        return

            return choose
        case Loop(name, items, inner):
            get_items, run = _value_of(items), _body_of(inner, generated)

            def loop(scope: dict) -> Iterator[Piece]:
                rest = iter(get_items(scope) or ())
                ahead = next(rest, rest)
                index = 0
                while ahead is not rest:
                    item, ahead = ahead, next(rest, rest)
                    yield from run(scope | {name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": ahead is rest}})
                    index += 1

            return loop
    raise TemplateError(f"no statement {node!r}")


def compile_template(source: str = TEMPLATE) -> Callable[[dict], Iterator[Piece]]:
    """A function from variables to pieces of text, each with whether it is inside a generation marker."""
    return _body_of(fold(parse(source)), False)


# Conversations ---------------------------------------------------------------------------------------------------


def _conversations(batches: Batches) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversation ids with an iterator over their messages; rows come sorted by conversation."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    ahead = [next(rows, None)]

    def messages(conv_id) -> Iterator[dict]:
        while ahead[0] is not None and ahead[0][0] == conv_id:
            _, role, text = ahead[0]
            ahead[0] = next(rows, None)
            yield {"role": role or "", "text": text or ""}

    while ahead[0] is not None:
        conv_id = ahead[0][0]
        own = messages(conv_id)
        yield conv_id, own
        for _ in own:  # whatever the template left unread
            pass


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, segment, formatted, loss_spans) of ``conversations`` (conv_id, turn, role, text).

    The segments of a conversation, joined in order, are its formatted text; loss_spans are the [start, end) ranges of
    code points of a segment that the model has to produce. A conversation is one row unless it is very long.

    Edge cases: a null text or role is empty; rows of one turn follow each other by role and text, rows without a turn
    come first; repeated rows are turns of their own; rows without conv_id are one conversation; an empty table gives
    an empty result. Other columns are ignored.
    """
    compile_template(template)
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Batches) -> Batches:
        render = compile_template(template)
        out: list[tuple] = []
        held = 0
        for conv_id, messages in _conversations(batches):
            pieces, spans, size, segment = [], [], 0, 0
            for text, generated in render({"messages": messages}):
                if size and size + len(text) > SEGMENT:
                    out.append((conv_id, segment, "".join(pieces), spans))
                    held += size
                    pieces, spans, size, segment = [], [], 0, segment + 1
                    if held > SEGMENT:
                        yield _batch(out, schema)
                        out, held = [], 0
                if generated:
                    spans.append({"start": size, "end": size + len(text)})
                pieces.append(text)
                size += len(text)
            out.append((conv_id, segment, "".join(pieces), spans))
            held += size
            if held > SEGMENT or len(out) >= 2000:
                yield _batch(out, schema)
                out, held = [], 0
        if out:
            yield _batch(out, schema)

    rows = conversations.select("conv_id", "turn", "role", "text")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return in_arrow(dealt, run, "conv_id bigint, segment bigint, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(formatted: str) -> tuple[list[tuple[str, str]], str]:
    """The (role, text) of every turn that is complete in ``formatted``, and what is left after them."""
    turns, end = [], 0
    for found in _TURN.finditer(formatted):
        turns.append((unescape_line(found[1]), unescape(found[2])))
        end = found.end()
    return turns, formatted[end:]


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read from ``format_conversations``."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Batches) -> Batches:
        current = None  # [conv_id, turns, digest of turns, loss characters, digest of loss, characters, unread]
        for batch in batches:
            done = []
            for conv_id, segment, text, spans in zip(*(batch.column(c).to_pylist() for c in schema_in), strict=True):
                if segment == 0:
                    if current:
                        done.append(_closed(current))
                    current = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, ""]
                turns, current[6] = read_turns(current[6] + text)
                for role, body in turns:
                    current[1] += 1
                    current[2].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    loss = unescape(text[span["start"] : span["end"]])
                    current[3] += len(loss)
                    current[4].update(loss.encode())
                current[5] += len(text)
            if done:
                yield _batch(done, schema)
        if current:
            yield _batch([_closed(current)], schema)

    schema_in = ("conv_id", "segment", "formatted", "loss_spans")
    return in_arrow(formatted.select(*schema_in), run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _closed(current: list) -> tuple:
    conv_id, turns, digest, loss, loss_digest, size, unread = current
    if unread:
        raise ValueError(f"conversation {conv_id} cannot be read back from {unread[:80]!r}")
    return conv_id, turns, digest.hexdigest(), loss, loss_digest.hexdigest(), size
