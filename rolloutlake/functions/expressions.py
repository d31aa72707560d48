"""Exact equality of mathematical expressions: rational functions over symbols with square roots, without evaluation of text.

An expression is read into a quotient of two sums of terms. A term has a rational coefficient, a square-free radicand
and powers of symbols; pi is a symbol. Two expressions are equal if the cross products of their quotients are. What the
grammar does not know (functions, inequalities, text), and what grows beyond the limits below, has no value (None).
"""

from __future__ import annotations

import re
from fractions import Fraction

#: Limits: terms of a sum, exponents, radicands and characters.
TERMS, EXPONENT, RADICAND, CHARACTERS = 400, 40, 10**12, 400

_TOKEN = re.compile(r"\\[A-Za-z]+|\d+(?:\.\d+)?|\.\d+|[A-Za-z]|[-+*/^(){}\[\]]|π|·|×")
_SPACE = re.compile(r"\\(?:left|right|displaystyle|,|;|!|:| )|[\s$]|\{,\}|(?<=\d),(?=\d{3}(?!\d))")

Sum = dict[tuple[int, tuple[tuple[str, int], ...]], Fraction]


class _Unknown(Exception):
    pass


def _square_part(n: int) -> tuple[int, int]:
    """(s, r) with n = s s r and r square-free."""
    if not 0 <= n <= RADICAND:
        raise _Unknown
    s, d = 1, 2
    while d * d <= n:
        while n % (d * d) == 0:
            n //= d * d
            s *= d
        d += 1
        if d > 100_000:
            raise _Unknown
    return s, n


def _add(a: Sum, b: Sum, sign: int = 1) -> Sum:
    out = dict(a)
    for key, c in b.items():
        c = out.get(key, Fraction(0)) + sign * c
        if c:
            out[key] = c
        else:
            out.pop(key, None)
    if len(out) > TERMS:
        raise _Unknown
    return out


def _mul(a: Sum, b: Sum) -> Sum:
    out: Sum = {}
    for (r, x), c in a.items():
        for (q, y), d in b.items():
            s, root = _square_part(r * q)
            powers = dict(x)
            for name, k in y:
                powers[name] = powers.get(name, 0) + k
                if abs(powers[name]) > EXPONENT:
                    raise _Unknown
            key = (root, tuple(sorted((n, k) for n, k in powers.items() if k)))
            out = _add(out, {key: c * d * s})
    return out


def _constant(x: Fraction | int) -> Sum:
    return {(1, ()): Fraction(x)} if x else {}


class _Reader:
    """Recursive descent: sums of products of powers of atoms, with products that need no sign."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise _Unknown
            self.tokens.append(m.group())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or (wanted is not None and token != wanted):
            raise _Unknown
        self.at += 1
        return token

    def sum(self) -> tuple[Sum, Sum]:
        sign = 1
        while self.peek() in ("+", "-"):
            sign = -sign if self.take() == "-" else sign
        n, d = self.product()
        total = ({k: sign * c for k, c in n.items()}, d)
        while self.peek() in ("+", "-"):
            sign = -1 if self.take() == "-" else 1
            n, d = self.product()
            total = (_add(_mul(total[0], d), _mul(n, total[1]), sign), _mul(total[1], d))
        return total

    def product(self) -> tuple[Sum, Sum]:
        n, d = self.power()
        while True:
            token = self.peek()
            if token in ("*", "\\cdot", "\\times", "·", "×"):
                self.take()
                a, b = self.power()
            elif token in ("/", "\\div"):
                self.take()
                b, a = self.power()
            elif token and (token[0].isalnum() or token in ("(", "{", "π", "\\frac", "\\sqrt", "\\pi")):
                a, b = self.power()
            else:
                return n, d
            n, d = _mul(n, a), _mul(d, b)

    def power(self) -> tuple[Sum, Sum]:
        n, d = self.atom()
        while self.peek() == "^":
            self.take()
            sign = -1 if self.peek() == "-" and self.take() else 1
            e, one = self.atom()
            if set(e) - {(1, ())} or one != _constant(1):
                raise _Unknown
            e = sign * e.get((1, ()), Fraction(0))
            if e == Fraction(1, 2):
                n, d = self.root(n, d)
                continue
            if e.denominator != 1 or abs(e) > EXPONENT:
                raise _Unknown
            a, b = (n, d) if e >= 0 else (d, n)
            n, d = _constant(1), _constant(1)
            for _ in range(abs(int(e))):
                n, d = _mul(n, a), _mul(d, b)
        return n, d

    def root(self, n: Sum, d: Sum) -> tuple[Sum, Sum]:
        """Square root of a rational number: sqrt(p / q) = sqrt(p q) / q."""
        if set(n) - {(1, ())} or set(d) - {(1, ())}:
            raise _Unknown
        value = n.get((1, ()), Fraction(0)) / d[(1, ())]
        s, r = _square_part(value.numerator * value.denominator)
        return ({(r, ()): Fraction(s)} if value else {}), _constant(value.denominator)

    def atom(self) -> tuple[Sum, Sum]:
        token = self.take()
        if token[0].isdigit() or token[0] == ".":
            return _constant(Fraction(token)), _constant(1)
        if token in ("(", "{"):
            inside = self.sum()
            self.take(")" if token == "(" else "}")
            return inside
        if token in ("\\frac", "\\dfrac", "\\tfrac"):
            (a, b), (c, d) = self.argument(), self.argument()
            return _mul(a, d), _mul(b, c)
        if token == "\\sqrt":
            if self.peek() == "[":
                raise _Unknown
            return self.root(*self.argument())
        if token in ("\\pi", "π"):
            return {(1, (("π", 1),)): Fraction(1)}, _constant(1)
        if len(token) == 1 and token.isalpha():
            return {(1, ((token, 1),)): Fraction(1)}, _constant(1)
        raise _Unknown

    def argument(self) -> tuple[Sum, Sum]:
        """A braced argument, or one character: ``\\frac12`` is one half."""
        token = self.peek()
        if token[:1].isdigit() and len(token) > 1:
            self.tokens[self.at] = token[1:]
            return _constant(int(token[0])), _constant(1)
        return self.atom()


def value_of(text: str | None) -> tuple[Sum, Sum] | None:
    """Quotient of two sums, or None."""
    if text is None or len(text) > CHARACTERS:
        return None
    try:
        reader = _Reader(_SPACE.sub("", text))
        n, d = reader.sum()
        return None if reader.peek() or not d else (n, d)
    except (_Unknown, RecursionError, ZeroDivisionError):
        return None


def equal(a: str | None, b: str | None) -> bool | None:
    """Whether two expressions are equal; None where one of them has no value."""
    x, y = value_of(a), value_of(b)
    if x is None or y is None:
        return None
    try:
        return _mul(x[0], y[1]) == _mul(y[0], x[1])
    except _Unknown:
        return None


def number_of(text: str | None, pi: float = 3.141592653589793) -> float | None:
    """Floating value of an expression without symbols but pi; None for all else."""
    value = value_of(text)
    if value is None:
        return None
    total = []
    for part in value:
        x = 0.0
        for (root, powers), c in part.items():
            if any(name != "π" for name, _ in powers):
                return None
            x += float(c) * root**0.5 * pi ** sum(k for _, k in powers)
        total.append(x)
    return total[0] / total[1] if total[1] else None
