"""A sandboxed template language, compiled to Python closures.

A template is text with ``{{ expression }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for name in list %} {% endfor %}`` and
``{% generation %} {% endgeneration %}``, which marks what a model is to learn. Expressions have strings, numbers, names, ``a.field``, ``+``, ``== !=``,
``and or not``, parentheses and ``value | filter``. There are no calls, no item access by expression and no names besides those given and the loop's, so a
template reaches nothing but its data. In a loop, ``loop.first``, ``loop.last``, ``loop.index`` and ``loop.index0`` are known.

The syntax tree is made of tuples; constants are folded in it; each node becomes a closure that yields (text, learned) pieces and, at the end of each
turn of an outermost loop, ``TURN``. Loops take their rows from an iterator, one ahead, so that a long conversation is never held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

TURN = ("", None)

_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+|.()]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template breaks the language's rules."""


class _Parser:
    def __init__(self, source: str):
        self.parts = [p for p in _TAG.split(source) if p]
        self.at = 0

    # Statements.

    def block(self, *ends: str) -> tuple[list, list[str]]:
        """Nodes up to a tag that is one of ``ends``, and that tag's words."""
        nodes: list = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{"):
                nodes.append(("put", self.expression(part[2:-2])))
            elif part.startswith("{%"):
                words = part[2:-2].split()
                word = words[0] if words else ""
                if word in ends:
                    return nodes, words
                nodes.append(self.statement(word, words, part[2:-2]))
            else:
                nodes.append(("text", part))
        if ends:
            raise TemplateError(f"expected one of {', '.join(ends)}")
        return nodes, []

    def statement(self, word: str, words: list[str], inner: str) -> tuple:
        if word == "for":
            if len(words) != 4 or words[2] != "in":
                raise TemplateError(f"bad loop: {inner.strip()}")
            return ("for", words[1], words[3], self.block("endfor")[0])
        if word == "generation":
            return ("generation", self.block("endgeneration")[0])
        if word == "if":
            branches, condition = [], self.expression(inner.strip()[2:])
            while True:
                body, end = self.block("elif", "else", "endif")
                branches.append((condition, body))
                if end[0] == "endif":
                    return ("if", branches)
                condition = ("const", True) if end[0] == "else" else self.expression(" ".join(end[1:]) if "'" not in (raw := self.parts[self.at - 1]) and '"' not in raw else raw[2:-2].strip()[4:])
        raise TemplateError(f"unknown tag: {inner.strip()}")

    # Expressions.

    def expression(self, source: str) -> tuple:
        self.tokens, at = [], 0
        while source[at:].strip():
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"bad expression: {source.strip()}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        out = self.either()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"bad expression: {source.strip()}")
        return out

    def take(self, *values: str) -> str | None:
        return self.tokens.pop(0)[1] if self.tokens[0][1] in values and self.tokens[0][0] in ("op", "name") else None

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.summed()
        if op := self.take("==", "!="):
            return (op, left, self.summed())
        return left

    def summed(self) -> tuple:
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.atom()
        while self.take("|"):
            kind, name = self.tokens.pop(0)
            if kind != "name":
                raise TemplateError("a filter's name is missing")
            left = ("filter", name, left)
        return left

    def atom(self) -> tuple:
        kind, value = self.tokens.pop(0)
        if value == "(" and kind == "op":
            inner = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is not closed")
            return inner
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(value))
        if kind == "name":
            node = ("const", value == "true") if value in ("true", "false") else ("name", value)
            while self.take("."):
                kind, field = self.tokens.pop(0)
                if kind != "name" or field.startswith("_"):
                    raise TemplateError(f"no such field: {field}")
                node = ("field", node, field)
            return node
        raise TemplateError(f"unexpected {value or 'end'}")


def parse(source: str) -> list:
    """The template's syntax tree."""
    return _Parser(source).block()[0]


def fold(nodes: list, filters: dict[str, Callable[[str], str]]) -> list:
    """The same tree with constant expressions computed, constant branches chosen and neighbouring texts joined."""
    out: list = []
    for node in nodes:
        kind = node[0]
        if kind == "put":
            value = _fold_value(node[1], filters)
            made = [("text", _text(value[1]))] if value[0] == "const" else [("put", value)]
        elif kind == "if":
            branches = []
            for condition, body in node[1]:
                condition = _fold_value(condition, filters)
                if condition[0] != "const" or condition[1]:
                    branches.append((condition, fold(body, filters)))
                if condition[0] == "const" and condition[1]:
                    break
            made = branches[0][1] if branches and branches[0][0][0] == "const" else [("if", branches)] if branches else []
        elif kind in ("for", "generation"):
            made = [(*node[:-1], fold(node[-1], filters))]
        else:
            made = [node]
        for x in made:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def _fold_value(node: tuple, filters: dict) -> tuple:
    if node[0] in ("const", "name"):
        return node
    node = tuple(_fold_value(x, filters) if isinstance(x, tuple) else x for x in node)
    inner = [x for x in node[1:] if isinstance(x, tuple)]
    if node[0] != "field" and all(x[0] == "const" for x in inner):
        return ("const", _closure(node, filters)({}))
    return node


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _closure(node: tuple, filters: dict) -> Callable[[dict], object]:
    """A function from the names' values to the expression's."""
    kind = node[0]
    if kind == "const":
        return lambda _, v=node[1]: v
    if kind == "name":
        return lambda names, n=node[1]: names.get(n)
    if kind == "field":
        inner, field = _closure(node[1], filters), node[2]
        return lambda names: held.get(field) if isinstance(held := inner(names), dict) else None
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter: {node[1]}")
        inner, call = _closure(node[2], filters), filters[node[1]]
        return lambda names: call(_text(inner(names)))
    if kind == "not":
        inner = _closure(node[1], filters)
        return lambda names: not inner(names)
    a, b = _closure(node[1], filters), _closure(node[2], filters)
    return {
        "and": lambda names: a(names) and b(names),
        "or": lambda names: a(names) or b(names),
        "==": lambda names: a(names) == b(names),
        "!=": lambda names: a(names) != b(names),
        "+": lambda names: _text(a(names)) + _text(b(names)),
    }[kind]


def _body(nodes: list, filters: dict, learned: bool, depth: int) -> Callable[[dict], Iterator[tuple]]:
    steps = [_step(n, filters, learned, depth) for n in nodes]

    def run(names: dict) -> Iterator[tuple]:
        for step in steps:
            yield from step(names)

    return run


def _step(node: tuple, filters: dict, learned: bool, depth: int) -> Callable[[dict], Iterable[tuple]]:
    kind = node[0]
    if kind == "text":
        pieces = ((node[1], learned),)
        return lambda _: pieces
    if kind == "put":
        value = _closure(node[1], filters)
        return lambda names: ((_text(value(names)), learned),)
    if kind == "generation":
        return _body(node[1], filters, True, depth)
    if kind == "if":
        branches = [(_closure(c, filters), _body(b, filters, learned, depth)) for c, b in node[1]]
        return lambda names: next((body(names) for condition, body in branches if condition(names)), ())
    _, name, rows, inner = node
    body = _body(inner, filters, learned, depth + 1)

    def loop(names: dict) -> Iterator[tuple]:
        source, k = iter(names.get(rows) or ()), 0
        row = next(source, None)
        while row is not None:
            following = next(source, None)
            yield from body({**names, name: row, "loop": {"first": k == 0, "last": following is None, "index": k + 1, "index0": k}})
            if not depth:
                yield TURN
            row, k = following, k + 1

    return loop


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], Iterator[tuple]]:
    """A function from names' values to the pieces of the rendered template."""
    return _body(fold(parse(source), filters), filters, False, 0)
