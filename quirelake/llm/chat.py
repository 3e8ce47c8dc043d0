"""Chat formatting by a template compiler.

A template in a small sandboxed language is parsed into a syntax tree, constants in it are
folded, and what remains becomes nested Python closures. Expressions see only the values
passed in: names, keys of maps, items of lists, operators and the filters listed here; no
attribute of a Python object is ever read and nothing is called by name.

``{% generation %}`` blocks mark what a model is to learn: the renderer gives the code
point spans they cover. The ``escape`` filter breaks every control string in a text with
a backslash after its first character (and doubles backslashes), which ``unescape``
undoes, so a rendered conversation can be read back whatever its texts hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import python_batches, valid_utf8

#: Strings that no text may hold unescaped.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TEMPLATE = (
    "{% for m in messages %}" + TURN + "{{ m.role | escape }}" + TEXT + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}" + END + "{% endfor %}"
)
_STARTS = re.compile(r"\\|(?=(?:" + "|".join(re.escape(c) for c in CONTROLS) + r"))(.)", re.DOTALL)
_BROKEN = re.compile(r"\\(.)", re.DOTALL)


class TemplateError(ValueError):
    """The template can't be parsed or refers to what the sandbox doesn't have."""


def escape(text: str) -> str:
    return _STARTS.sub(lambda m: "\\\\" if m[1] is None else m[1] + "\\", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(r"\1", text) if "\\" in text else text


def _text(v: object) -> str:
    return "" if v is None else "true" if v is True else "false" if v is False else str(v)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "trim": lambda v: _text(v).strip(),
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
    "string": _text,
    "default": lambda v, other="": other if v is None else v,
    "join": lambda v, sep="": _text(sep).join(map(_text, v or [])),
    "first": lambda v: v[0] if v else None,
    "last": lambda v: v[-1] if v else None,
}


def _same(op: Callable) -> Callable:
    def checked(a: object, b: object) -> object:
        try:
            return op(a, b)
        except TypeError as e:
            raise TemplateError(str(e)) from None

    return checked


BINARY: dict[str, Callable] = {
    "+": _same(lambda a, b: a + b), "-": _same(lambda a, b: a - b), "%": _same(lambda a, b: a % b if not isinstance(a, str) and b else 0), "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _same(lambda a, b: a < b), ">": _same(lambda a, b: a > b), "<=": _same(lambda a, b: a <= b), ">=": _same(lambda a, b: a >= b),
    "in": _same(lambda a, b: a in (b or ())),
}
LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("~",), ("+", "-"), ("%",))


@dataclass(frozen=True)
class Node:
    """A syntax-tree node; ``kind`` tells what ``parts`` hold."""

    kind: str
    parts: tuple = ()


# --- parsing ---------------------------------------------------------------------------

_LEX = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~%<>|.()\[\],=])|(?P<bad>\S))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#(.*?)#\}", re.DOTALL)


class _Expression:
    """Recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.source, self.at, self.items = source, 0, []
        for m in _LEX.finditer(source):
            if m.lastgroup == "bad":
                raise TemplateError(f"unexpected {m['bad']!r} in {source!r}")
            if m.lastgroup:
                self.items.append((m.lastgroup, m[m.lastgroup]))

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind != "str" and value in values:
            self.at += 1
            return value
        return None

    def need(self, *values: str) -> str:
        got = self.take(*values)
        if got is None:
            raise TemplateError(f"expected {' or '.join(values)} in {self.source!r}")
        return got

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name in {self.source!r}")
        self.at += 1
        return value

    def whole(self) -> Node:
        node = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r} in {self.source!r}")
        return node

    def choice(self) -> Node:
        node = self.level(0)
        if self.take("if"):
            test = self.level(0)
            other = self.choice() if self.take("else") else Node("const", (None,))
            return Node("choice", (test, node, other))
        return node

    def level(self, k: int) -> Node:
        if k == len(LEVELS):
            return self.unary()
        if k == 2 and self.take("not"):
            return Node("not", (self.level(2),))
        node = self.level(k + 1)
        while True:
            if k == 2 and self.peek() == ("name", "not") and self.items[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                node = Node("not", (Node("binary", ("in", node, self.level(k + 1))),))
            elif op := self.take(*LEVELS[k]):
                node = Node("logic" if op in ("and", "or") else "binary", (op, node, self.level(k + 1)))
            else:
                return node

    def unary(self) -> Node:
        if self.take("-"):
            return Node("binary", ("-", Node("const", (0,)), self.unary()))
        node = self.atom()
        while True:
            if self.take("."):
                node = Node("item", (node, Node("const", (self.name(),))))
            elif self.take("["):
                node = Node("item", (node, self.choice()))
                self.need("]")
            elif self.take("|"):
                name, args = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.choice())
                        if not self.take(","):
                            self.need(")")
                            break
                node = Node("filter", (name, node, *args))
            else:
                return node

    def atom(self) -> Node:
        kind, value = self.peek()
        self.at += 1
        if kind == "num":
            return Node("const", (int(value),))
        if kind == "str":
            return Node("const", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL),))
        if kind == "name":
            constants = {"true": True, "false": False, "none": None}
            return Node("const", (constants[value.lower()],)) if value.lower() in constants else Node("name", (value,))
        if (kind, value) == ("op", "("):
            node = self.choice()
            self.need(")")
            return node
        raise TemplateError(f"unexpected {value or 'end'!r} in {self.source!r}")


def parse(template: str) -> Node:
    """The syntax tree of a template: a ``block`` of text, output, for, if, set and generation nodes."""
    items: list[tuple[str, str]] = []
    at = 0
    strip = False
    for m in [*_TAG.finditer(template), None]:
        text = template[at : m.start()] if m else template[at:]
        text = text.lstrip() if strip else text
        if m and re.match(r"\{[{%]-", m[0]):
            text = text.rstrip()
        if text:
            items.append(("text", text))
        if not m:
            break
        at, strip = m.end(), bool(re.search(r"-[%}]\}$", m[0]))
        if m[1] is not None:
            items.append(("output", m[1]))
        elif m[2] is not None:
            items.append(("tag", m[2].strip()))
    if re.search(r"\{\{|\{%", "".join(t for k, t in items if k == "text")):
        raise TemplateError("a tag is not closed")
    place = [0]

    def block(*ends: str) -> tuple[Node, str]:
        out = []
        while place[0] < len(items):
            kind, value = items[place[0]]
            place[0] += 1
            if kind == "text":
                out.append(Node("text", (value,)))
            elif kind == "output":
                out.append(Node("output", (_Expression(value).whole(),)))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return Node("block", tuple(out)), value
                out.append(tag(word, rest.strip()))
        if ends:
            raise TemplateError(f"expected {' or '.join(ends)}")
        return Node("block", tuple(out)), ""

    def tag(word: str, rest: str) -> Node:
        if word == "for":
            head = _Expression(rest)
            name = head.name()
            head.need("in")
            body, _ = block("endfor")
            return Node("for", (name, head.whole(), body))
        if word == "if":
            arms = []
            test: Node | None = _Expression(rest).whole()
            while test is not None:
                body, end = block("elif", "else", "endif")
                arms.append((test, body))
                test = _Expression(end[4:]).whole() if end.startswith("elif") else None
            other = block("endif")[0] if end == "else" else Node("block")
            return Node("if", (tuple(arms), other))
        if word == "set":
            head = _Expression(rest)
            name = head.name()
            head.need("=")
            return Node("set", (name, head.whole()))
        if word == "generation":
            return Node("generation", (block("endgeneration")[0],))
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


# --- folding ---------------------------------------------------------------------------


def fold(node: Node) -> Node:
    """The same tree with constant expressions computed, dead branches dropped and neighbouring texts joined."""
    kind, parts = node.kind, node.parts
    const = lambda n: n.kind == "const"
    if kind in ("const", "name", "text"):
        return node
    if kind == "binary":
        op, a, b = parts[0], fold(parts[1]), fold(parts[2])
        return Node("const", (BINARY[op](a.parts[0], b.parts[0]),)) if const(a) and const(b) else Node(kind, (op, a, b))
    if kind == "logic":
        op, a, b = parts[0], fold(parts[1]), fold(parts[2])
        return (b if bool(a.parts[0]) == (op == "and") else a) if const(a) else Node(kind, (op, a, b))
    if kind == "not":
        a = fold(parts[0])
        return Node("const", (not a.parts[0],)) if const(a) else Node(kind, (a,))
    if kind == "choice":
        test, a, b = map(fold, parts)
        return (a if test.parts[0] else b) if const(test) else Node(kind, (test, a, b))
    if kind == "item":
        return Node(kind, (fold(parts[0]), fold(parts[1])))
    if kind == "filter":
        args = tuple(map(fold, parts[1:]))
        return Node("const", (FILTERS[parts[0]](*[a.parts[0] for a in args]),)) if all(map(const, args)) else Node(kind, (parts[0], *args))
    if kind == "output":
        a = fold(parts[0])
        return Node("text", (_text(a.parts[0]),)) if const(a) else Node(kind, (a,))
    if kind == "block":
        out: list[Node] = []
        for p in map(fold, parts):
            for q in p.parts if p.kind == "block" else (p,):
                if q.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", (out[-1].parts[0] + q.parts[0],))
                elif q != Node("text", ("",)):
                    out.append(q)
        return Node("block", tuple(out))
    if kind == "if":
        arms, other = [], fold(parts[1])
        for test, body in parts[0]:
            test, body = fold(test), fold(body)
            if const(test) and test.parts[0]:
                other = body
                break
            if not const(test):
                arms.append((test, body))
        return Node(kind, (tuple(arms), other)) if arms else other
    if kind == "for":
        return Node(kind, (parts[0], fold(parts[1]), fold(parts[2])))
    if kind == "set":
        return Node(kind, (parts[0], fold(parts[1])))
    return Node(kind, (fold(parts[0]),))  # generation


# --- closures --------------------------------------------------------------------------


class _Out:
    """Rendered pieces, their code points so far, and the spans of generation blocks."""

    __slots__ = ("pieces", "length", "spans")

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _item(value: object, key: object) -> object:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, str)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def _evaluator(node: Node) -> Callable[[dict], object]:
    kind, parts = node.kind, node.parts
    if kind == "const":
        value = parts[0]
        return lambda env: value
    if kind == "name":
        name = parts[0]
        return lambda env: env.get(name)
    if kind == "item":
        base, key = _evaluator(parts[0]), _evaluator(parts[1])
        return lambda env: _item(base(env), key(env))
    if kind == "not":
        inner = _evaluator(parts[0])
        return lambda env: not inner(env)
    if kind == "choice":
        test, a, b = map(_evaluator, parts)
        return lambda env: a(env) if test(env) else b(env)
    if kind == "filter":
        f, args = FILTERS[parts[0]], [_evaluator(p) for p in parts[1:]]
        if len(args) == 1:
            only = args[0]
            return lambda env: f(only(env))
        return lambda env: f(*[a(env) for a in args])
    a, b = _evaluator(parts[1]), _evaluator(parts[2])
    if kind == "logic":
        return (lambda env: a(env) and b(env)) if parts[0] == "and" else (lambda env: a(env) or b(env))
    op = BINARY[parts[0]]
    return lambda env: op(a(env), b(env))


def _writer(node: Node) -> Callable[[dict, _Out], None]:
    kind, parts = node.kind, node.parts
    if kind == "text":
        text = parts[0]
        return lambda env, out: out.put(text)
    if kind == "output":
        value = _evaluator(parts[0])
        return lambda env, out: out.put(_text(value(env)))
    if kind == "set":
        name, value = parts[0], _evaluator(parts[1])

        def assign(env: dict, out: _Out) -> None:
            env[name] = value(env)

        return assign
    if kind == "if":
        arms, other = [(_evaluator(t), _writer(b)) for t, b in parts[0]], _writer(parts[1])

        def branch(env: dict, out: _Out) -> None:
            for test, body in arms:
                if test(env):
                    return body(env, out)
            return other(env, out)

        return branch
    if kind == "for":
        name, values, body = parts[0], _evaluator(parts[1]), _writer(parts[2])

        def loop(env: dict, out: _Out) -> None:
            found = values(env)
            found = found if isinstance(found, list) else []
            inner = dict(env)
            for i, v in enumerate(found):
                inner[name] = v
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(found), "length": len(found)}
                body(inner, out)

        return loop
    if kind == "generation":
        body = _writer(parts[0])

        def mark(env: dict, out: _Out) -> None:
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return mark
    writers = [_writer(p) for p in parts]

    def every(env: dict, out: _Out) -> None:
        for w in writers:
            w(env, out)

    return every


@lru_cache(maxsize=16)
def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from values to (text, generation spans in code points)."""
    write = _writer(fold(parse(template)))

    def render(values: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        write(dict(values), out)
        return "".join(out.pieces), out.spans

    return render


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from what TEMPLATE rendered."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(TEXT)
        turns.append((unescape(role), unescape(rest.removesuffix(END))))
    return turns


def read_loss(formatted: str, spans: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped, in order."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


# --- conversations ---------------------------------------------------------------------


def format_conversations(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, formatted, spans``: one row for each conversation, its rows in the order of turn, role and text.

    Null roles and texts count as empty; a null conversation id is a conversation of its
    own; null turns come first; repeated rows are repeated turns. Rows are shuffled by
    conversation and streamed in order, so a task holds one conversation at a time. Ids and
    turns keep their type. Texts are taken whole, however long, and invalid UTF-8 as its
    replacement characters. Other columns are ignored whatever their names. An empty table
    gives an empty result.
    """
    python_batches(turns.sparkSession)
    said = lambda c: F.coalesce(valid_utf8(F.col(c)), F.lit("")).alias
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), said(role_col)("role"), said(text_col)("text"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        done: list[tuple] = []
        held: list[dict] = []
        current = kind = None
        begun, size = False, 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], spans)], names=["conv_id", "formatted", "spans"])

        for batch in batches:
            kind = batch.column(0).type
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if begun and conv != current:
                    done.append((current, *render({"messages": held})))
                    size += len(done[-1][1])
                    held = []
                    if size > 1 << 22:
                        yield batch_of(done)
                        done, size = [], 0
                current, begun = conv, True
                held.append({"role": role, "text": text})
        if begun:
            done.append((current, *render({"messages": held})))
            yield batch_of(done)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(step, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, formatted string, spans array<struct<start:long,end:long>>")
