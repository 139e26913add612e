"""Equality of mathematical expressions by their values: a reader of plain and LaTeX notation, and identity tests.

An expression is read into a tree and evaluated as complex numbers. Two expressions with names are the same if they
agree, within rounding, at all of several fixed points where both have values (an identity test: expressions of usual
size that agree at that many points in general position are equal). Nothing is evaluated as code, nothing depends on
time limits; a text that can't be read has no tree and equals only its own spelling.
"""

from __future__ import annotations

import cmath
import hashlib
import math
import re
from collections.abc import Iterator

#: Points of an identity test; relative difference that passes as rounding.
POINTS, ROUNDING = 6, 1e-8

# Functions of one argument, constants, and Greek letters that are names.
FUNCTIONS = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x), "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan,
    "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "ln": cmath.log, "log": cmath.log, "exp": cmath.exp, "sqrt": cmath.sqrt, "abs": abs,
}
CONSTANTS = {"pi": math.pi, "e": math.e, "i": 1j, "inf": math.inf, "infty": math.inf}
GREEK = "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Sigma Phi Psi Omega".split()

_LEAF = re.compile(r"\d+(?:\.\d+)?|\.\d+|\\[a-zA-Z]+|\\.|[a-zA-Z](?:_(?:\{[^{}]*\}|[a-zA-Z0-9]))?|\*\*|[-+*/^(){}\[\]|!,=<>_']")
_WORDS = re.compile("|".join(sorted([*FUNCTIONS, "pi", "inf"], key=len, reverse=True)))


class Unreadable(ValueError):
    """The text isn't an expression."""


class Reader:
    """Recursive descent: sum, product, power, atom. Trees are tuples (operation, parts...)."""

    def __init__(self, text: str):
        text = re.sub(r"\\[,;!: ]|\\(?:left|right|displaystyle|limits)(?![a-zA-Z])", " ", text)
        # words of functions without their stroke become commands, so that the letters stay names
        text = re.sub(r"(?<![\\a-zA-Z])(?:" + _WORDS.pattern + r")(?![a-zA-Z])", lambda m: "\\" + m.group() + " ", text)
        self.parts = _LEAF.findall(text)
        if not self.parts or "".join(self.parts) != re.sub(r"\s+", "", text) or re.search(r"(?<![\\a-zA-Z])[a-zA-Z]{4}", text):
            raise Unreadable(text)  # four letters in a row are a word
        self.at = 0

    def peek(self) -> str:
        return self.parts[self.at] if self.at < len(self.parts) else ""

    def take(self, wanted: str = "") -> str:
        x = self.peek()
        if not x or wanted and x != wanted:
            raise Unreadable(x)
        self.at += 1
        return x

    def whole(self) -> tuple:
        tree = self.sum()
        if self.peek():
            raise Unreadable(self.peek())
        return tree

    def sum(self) -> tuple:
        tree = self.product()
        while self.peek() in ("+", "-"):
            tree = ("+" if self.take() == "+" else "-", tree, self.product())
        return tree

    def product(self) -> tuple:
        tree = self.signed()
        while x := self.peek():
            if x in ("*", "\\cdot", "\\times"):
                self.take()
                tree = ("*", tree, self.signed())
            elif x in ("/", "\\div"):
                self.take()
                tree = ("/", tree, self.signed())
            elif self.starts(x):
                tree = ("*", tree, self.power())
            else:
                break
        return tree

    def starts(self, x: str) -> bool:
        """Whether a part can follow a factor without a sign between."""
        return x[0].isalnum() or x in ("(", "{", "[") or x[0] == "." or x[0] == "\\" and x not in ("\\cdot", "\\times", "\\div", "\\}", "\\le", "\\ge")

    def signed(self) -> tuple:
        if self.peek() in ("-", "+"):
            return ("-", ("n", 0.0), self.signed()) if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> tuple:
        tree = self.atom()
        while self.peek() == "!":
            self.take()
            tree = ("!", tree)
        if self.peek() in ("^", "**"):
            self.take()
            tree = ("^", tree, self.argument() if self.peek() == "{" else self.signed())
        return tree

    def argument(self) -> tuple:
        """What a command takes: a braced expression, or the next sign alone."""
        if self.peek() == "{":
            return self.inside("{", "}")
        x = self.peek()
        if x and x[0].isdigit() and len(x) > 1 and "." not in x:  # \frac12
            self.parts[self.at : self.at + 1] = [x[0], x[1:]]
        return self.atom()

    def inside(self, left: str, right: str) -> tuple:
        self.take(left)
        tree = self.sum()
        self.take(right)
        return tree

    def atom(self) -> tuple:
        x = self.take()
        if x[0].isdigit() or x[0] == ".":
            return ("n", float(x))
        if x in ("(", "{", "["):
            self.at -= 1
            return self.inside(x, {"(": ")", "{": "}", "[": "]"}[x])
        if x == "|":
            tree = self.sum()
            self.take("|")
            return ("f", "abs", tree)
        name = x.lstrip("\\")
        if x[0] != "\\":
            return ("n", complex(CONSTANTS[x])) if x in ("e", "i") else ("v", x.replace("{", "").replace("}", ""))
        if name in ("frac", "dfrac", "tfrac"):
            top = self.argument()
            return ("/", top, self.argument())
        if name == "sqrt" and self.peek() == "[":
            degree = self.inside("[", "]")
            return ("^", self.argument(), ("/", ("n", 1.0), degree))
        if name == "log" and self.peek() == "_":
            self.take()
            base = self.argument()
            return ("/", ("f", "log", self.argument_of_function()), ("f", "log", base))
        if name in FUNCTIONS:
            if self.peek() in ("^", "**") and name != "sqrt":  # sin^2 x
                self.take()
                n = self.argument()
                return ("^", ("f", name, self.argument_of_function()), n)
            return ("f", name, self.argument() if name == "sqrt" else self.argument_of_function())
        if name in CONSTANTS:
            return ("n", complex(CONSTANTS[name]))
        if name in GREEK:
            return ("v", name)
        raise Unreadable(x)

    def argument_of_function(self) -> tuple:
        """A bracket, or the factors up to the next sign: sin 2x."""
        if self.peek() in ("(", "{", "["):
            return self.power()
        tree = self.power()
        while (x := self.peek()) and x not in FUNCTIONS and self.starts(x) and x.lstrip("\\") not in FUNCTIONS:
            tree = ("*", tree, self.power())
        return tree


def read(text: str) -> tuple | None:
    """The tree of an expression, or None."""
    try:
        return Reader(text).whole()
    except (Unreadable, RecursionError):
        return None


def names(tree: tuple) -> set[str]:
    if tree[0] == "v":
        return {tree[1]}
    return set().union(*(names(x) for x in tree[1:] if isinstance(x, tuple)))


def value(tree: tuple, at: dict[str, complex]) -> complex | None:
    """The value at a point, or None where there is none (a pole, an overflow)."""
    try:
        x = _value(tree, at)
    except (ZeroDivisionError, OverflowError, ValueError, TypeError, KeyError):
        return None
    return None if cmath.isnan(x) else x


def _value(t: tuple, at: dict[str, complex]) -> complex:
    op = t[0]
    if op == "n":
        return t[1]
    if op == "v":
        return at[t[1]]
    if op == "f":
        return FUNCTIONS[t[1]](_value(t[2], at))
    a = _value(t[1], at)
    if op == "!":
        return math.gamma(a.real + 1)
    b = _value(t[2], at)
    if op == "^":
        return a**b
    return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b


def points(variables: set[str]) -> Iterator[dict[str, complex]]:
    """Fixed points in general position: each name's coordinates come from a hash of the name."""
    for k in range(POINTS):
        yield {v: 0.3 + int(hashlib.sha256(f"{v}|{k}".encode()).hexdigest()[:8], 16) / 2**32 * 2.4 for v in variables}


def close(x: complex, y: complex) -> bool:
    return x == y or abs(x - y) <= ROUNDING * max(abs(x), abs(y), 1.0)


def equal(a: str, b: str) -> bool:
    """Whether two expressions are the same function of their names."""
    p, q = read(a), read(b)
    if p is None or q is None:
        return False
    both = [(x, y) for at in points(names(p) | names(q)) if (x := value(p, at)) is not None and (y := value(q, at)) is not None]
    return len(both) > POINTS // 2 and all(close(x, y) for x, y in both)


def same_equation(a: str, b: str) -> bool:
    """Whether two equations say the same: the differences of their sides are multiples of each other."""
    if a.count("=") != 1 or b.count("=") != 1:
        return False
    sides = [[read(x) for x in t.split("=")] for t in (a, b)]
    if any(x is None for s in sides for x in s):
        return False
    variables = set().union(*(names(x) for s in sides for x in s))
    ratios = []
    for at in points(variables):
        v = [[value(x, at) for x in s] for s in sides]
        if any(x is None for s in v for x in s):
            continue
        p, q = (s[0] - s[1] for s in v)
        if abs(p) < 1e-12 or abs(q) < 1e-12:
            if abs(p) > 1e-9 or abs(q) > 1e-9:
                return False
            continue
        ratios.append(p / q)
    return len(ratios) > POINTS // 2 and bool(variables) and all(close(r, ratios[0]) for r in ratios)


def members(text: str) -> list[str]:
    """The parts of a list, cut at commas outside brackets."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(text[last:k])
            last = k + 1
    return [*out, text[last:]]


def matrix(text: str) -> list[list[str]] | None:
    """The rows of a matrix environment, or None."""
    m = re.fullmatch(r"\\begin\{([pbvBV]?matrix|array)\}(?:\{[^{}]*\})?(.*)\\end\{\1\}", text, re.S)
    if not m:
        return None
    return [[c.strip() for c in row.split("&")] for row in re.split(r"\\\\|(?<!\\)\\(?=[-\d])", m[2].strip()) if row.strip()]


def matching(left: list, right: list, same) -> bool:
    """Whether the members can be paired one to one; equality within a tolerance isn't transitive, so pairs are re-made where needed."""
    if len(left) != len(right):
        return False
    edges = [[j for j, y in enumerate(right) if same(x, y)] for x in left]
    owner: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j in edges[i]:
            if j not in tried:
                tried.add(j)
                if j not in owner or place(owner[j], tried):
                    owner[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(left)))
