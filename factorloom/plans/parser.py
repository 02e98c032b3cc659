"""Parser of the factor expression language.

Grammar, loosest first: ``c ? a : b`` (right), ``||``/``|``, ``&&``/``&``, comparisons,
``+ -``, ``* /``, sign, calls, ``$field``, numbers, constants, parentheses.  The whole
text must parse; unbalanced parentheses and unknown characters are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Const:
    value: bool | None


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\$?[A-Za-z_]\w*)|(&&|\|\||>=|<=|==|!=|[-+*/()<>,?:&|]))")
_CONST = {"true": True, "false": False, "nan": None, "null": None}
#: Binary operators by binding power, with the function each stands for.
_BINARY = {
    "||": (1, "OR"), "|": (1, "OR"), "&&": (2, "AND"), "&": (2, "AND"),
    ">": (3, "GT"), "<": (3, "LT"), ">=": (3, "GE"), "<=": (3, "LE"), "==": (3, "EQ"), "!=": (3, "NE"),
    "+": (4, "ADD"), "-": (4, "SUBTRACT"), "*": (5, "MULTIPLY"), "/": (5, "DIVIDE"),
}
COMMUTATIVE = frozenset({"ADD", "MULTIPLY", "EQ", "NE", "AND", "OR"})


def _tokens(text: str) -> list[str]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:10]!r} at {at}")
        out.append(m.group(1) or m.group(2) or m.group(3))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if t is None or want not in (None, t):
            raise ExpressionError(f"expected {want or 'an operand'}, found {t or 'the end'}")
        self.at += 1
        return t

    def ternary(self):
        cond = self.binary(1)
        if self.peek() != "?":
            return cond
        self.take("?")
        yes = self.ternary()
        self.take(":")
        return Call("WHERE", (cond, yes, self.ternary()))

    def binary(self, power: int):
        left = self.unary()
        while (op := _BINARY.get(self.peek())) and op[0] >= power:
            self.take()
            left = Call(op[1], (left, self.binary(op[0] + 1)))
        return left

    def unary(self):
        if self.peek() in ("-", "+"):
            sign = self.take()
            inner = self.unary()
            if sign == "+":
                return inner
            return Num(-inner.value) if isinstance(inner, Num) else Call("NEG", (inner,))
        return self.primary()

    def primary(self):
        t = self.take()
        if t == "(":
            inner = self.ternary()
            self.take(")")
            return inner
        if t[0].isdigit() or t[0] == ".":
            return Num(float(t))
        if t[0] == "$":
            return Field(t[1:])
        if t[0].isalpha() or t[0] == "_":
            if self.peek() != "(":
                return Const(_CONST[t.lower()]) if t.lower() in _CONST else Field(t)
            self.take("(")
            args = []
            while self.peek() != ")":
                args.append(self.ternary())
                if self.peek() != ")":
                    self.take(",")
            self.take(")")
            return Call(t.upper(), tuple(args))
        raise ExpressionError(f"unexpected {t!r}")


def parse(text: str):
    p = _Parser(text)
    node = p.ternary()
    if p.peek() is not None:
        raise ExpressionError(f"trailing {p.peek()!r}")
    return node


def walk(node):
    yield node
    for a in getattr(node, "args", ()):
        yield from walk(a)


def canonical(node) -> str:
    """Text of a tree in which the operands of commutative operators are sorted."""
    if isinstance(node, Call):
        parts = [canonical(a) for a in node.args]
        return f"{node.name}({','.join(sorted(parts) if node.name in COMMUTATIVE else parts)})"
    return f"${node.name}" if isinstance(node, Field) else repr(node.value)


def size(node) -> int:
    return sum(1 for _ in walk(node))


def common_subtree(a, b) -> tuple[int, str | None]:
    """Size and text of the largest subtree two trees share, up to commutativity."""
    seen = {canonical(n) for n in walk(a)}
    best = (0, None)
    for n in walk(b):
        if size(n) > best[0] and (c := canonical(n)) in seen:
            best = (size(n), c)
    return best
