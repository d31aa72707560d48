"""Mathematical answers: balanced boxes, LaTeX normalisation, equality, and sequence metrics, as Arrow-batched UDFs.

These need a scan with a depth or a dynamic program, which column expressions cannot say. Nulls give nulls (or 0 for
scores); the functions themselves are plain Python and are tested directly.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloutlake.functions import expressions


def last_boxed(text: str | None, markers: tuple[str, ...] = ("\\boxed", "\\fbox")) -> str | None:
    """From the last box marker to its matching brace; the ``\\boxed x$`` form runs to the dollar sign."""
    if text is None:
        return None
    space = text.rfind("\\boxed ")
    if space >= 0 and space >= text.rfind("\\boxed{") and "\\boxed" in markers:
        return "\\boxed " + text[space + 7 :].split("$")[0]
    for marker in markers:
        start = text.rfind(marker)
        if start < 0:
            continue
        depth = 0
        for at in range(start, len(text)):
            depth += (text[at] == "{") - (text[at] == "}")
            if text[at] == "}" and depth == 0:
                return text[start : at + 1]
        return None
    return None


def unboxed(box: str | None) -> str | None:
    """Content of a box; null when the string is none."""
    if box is None:
        return None
    if box.startswith("\\boxed "):
        return box[7:]
    for head in ("\\boxed{", "\\fbox{"):
        if box.startswith(head) and box.endswith("}"):
            return box[len(head) : -1]
    return None


#: What is dropped from an answer before anything else, in this order.
_DROPPED = ("\n", "\\!")
_DROPPED_LATER = ("\\left", "\\right", "^{\\circ}", "^\\circ", "\\$")


def _short_fractions(text: str) -> str:
    """``\\frac12`` as ``\\frac{1}{2}``; a fraction whose first argument has braces stays, a cut one leaves the text as it was."""
    head, *rest = text.split("\\frac")
    out = [head]
    for part in rest:
        if part.startswith("{"):
            out.append(part)
        elif len(part) < 2:
            return text
        else:
            out.append(f"{{{part[0]}}}" + (part[1] if part[1] == "{" else f"{{{part[1]}}}") + part[2:])
    return "\\frac".join(out)


def _short_roots(text: str) -> str:
    return re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", text)


def normal_math(text: str | None) -> str | None:
    """Normal form of a LaTeX answer: spacing, units, degree and percent signs, fractions, roots, leading zeros.

    A text with more than one unit (``\\text{ ``) has no normal form and comes back as it is.
    """
    if text is None:
        return None
    x = text
    for dropped in _DROPPED:
        x = x.replace(dropped, "")
    x = x.replace("\\\\", "\\").replace("tfrac", "frac").replace("dfrac", "frac")
    for dropped in _DROPPED_LATER:
        x = x.replace(dropped, "")
    x, *units = x.split("\\text{ ")
    if len(units) > 1:
        return text
    x = x.replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    if x.startswith("."):
        x = "0" + x
    left, *right = x.split("=")
    if len(right) == 1 and len(left) <= 2:
        x = right[0]
    x = _short_fractions(_short_roots(x).replace(" ", ""))
    if x == "0.5":
        x = "\\frac{1}{2}"
    m = re.fullmatch(r"(0|-?[1-9]\d*)/(0|-?[1-9]\d*)", x)
    return f"\\frac{{{m[1]}}}{{{m[2]}}}" if m else x


def math_equal_text(a: str | None, b: str | None) -> bool:
    """Equal normal forms; two nulls are equal."""
    if a is None or b is None:
        return a is None and b is None
    return normal_math(a) == normal_math(b)


def rational(text: str | None) -> Fraction | None:
    """Value of an integer, decimal, percentage, a/b or \\frac{a}{b}; null for all else. Nothing is evaluated."""
    if text is None:
        return None
    x = text.strip().strip("$").replace(",", "").replace(" ", "").replace("\\!", "").replace("dfrac", "frac").replace("tfrac", "frac")
    m = re.fullmatch(r"(-?)\\frac\{(-?\d+)\}\{(-?\d+)\}", x) or re.fullmatch(r"(-?)(\d+)/(\d+)", x)
    try:
        if m:
            value = Fraction(int(m[2]), int(m[3]))
            return -value if m[1] else value
        if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", x):
            return Fraction(x)
    except ZeroDivisionError:
        return None
    return None


_MATRIX = re.compile(r"\\begin\{([pbv]?matrix|array)\}(?:\{[^}]*\})?(.*)\\end\{\1\}", re.S)


def split_elements(text: str) -> tuple[str, list[str]]:
    """(brackets, elements) of an interval, tuple, set or matrix; a plain answer is its own element without brackets."""
    x = re.sub(r"\\(?:left|right)\s*", "", text.strip().strip("$").strip())
    m = _MATRIX.fullmatch(x)
    if m:
        rows = [r for r in m[2].split("\\\\") if r.strip()]
        return f"matrix {len(rows)}", [e.strip() for r in rows for e in r.split("&")]
    for opening, closing in (("\\{", "\\}"), ("{", "}"), ("(", ")"), ("[", "]"), ("(", "]"), ("[", ")")):
        if len(x) > len(opening) + len(closing) and x.startswith(opening) and x.endswith(closing):
            inside, depth, parts = x[len(opening) : -len(closing)], 0, [""]
            for c in inside:
                depth += (c in "([{") - (c in ")]}")
                if depth < 0:
                    return "", [x]
                if c == "," and depth == 0:
                    parts.append("")
                else:
                    parts[-1] += c
            if len(parts) > 1:
                return ("set" if opening[-1] == "{" else opening + closing), [e.strip() for e in parts]
    return "", [x]


def _is_fraction(text: str) -> bool:
    return re.fullmatch(r"-?(?:\\frac\{-?\d+\}\{-?\d+\}|\d+/\d+)", text.replace(" ", "").replace("dfrac", "frac").replace("tfrac", "frac")) is not None


def _element_equal(x: str, y: str, tolerance: float) -> bool:
    if math_equal_text(x, y):
        return True
    if _is_fraction(x) and _is_fraction(y):
        return False
    p, q = rational(x), rational(y)
    if p is not None and q is not None:
        return p == q or bool(tolerance) and math.isclose(p, q, rel_tol=tolerance)
    same = expressions.equal(x, y)
    if same or same is None or not tolerance:
        return bool(same)
    a, b = expressions.number_of(x), expressions.number_of(y)
    return a is not None and b is not None and math.isclose(a, b, rel_tol=tolerance)


def grade(given: str | None, truth: str | None, tolerance: float = 0.0) -> bool:
    """Normal-form equality, else element by element: numbers, then exact expressions (sums, products, powers, roots, pi).

    Intervals, tuples and matrices need the same brackets and order; sets need the same elements. Fractions against
    fractions must be written alike.
    """
    if given is None or truth is None:
        return False
    if math_equal_text(given, truth):
        return True
    (kind, a), (other, b) = split_elements(given), split_elements(truth)
    if kind != other or len(a) != len(b):
        return False
    if kind == "set":
        left = list(b)
        for x in a:
            at = next((k for k, y in enumerate(left) if _element_equal(x, y, tolerance)), None)
            if at is None:
                return False
            del left[at]
        return True
    return all(_element_equal(x, y, tolerance) for x, y in zip(a, b))


#: A reply whose repetition is above this is not graded.
REPETITIVE = 0.2


def guarded_grade(given: str | None, truth: str | None) -> bool:
    """grade, but false for a long answer that repeats itself."""
    return grade(given, truth) and not (len(given) > 128 and repetition(given) > REPETITIVE)


# ---- answers inside prose (fixed values: the markers, in the order in which they are tried) ----

_BEFORE_ANSWER = ("answer:", "answer is", "answers are")
_AFTER_ANSWER = ("is answer", "is the answer", "are answers", "are the answers")
_LINKS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")


def located_answer(text: str | None) -> tuple[bool, str | None]:
    """(found, answer): the answer behind the last markers of a reply; without a digit it does not count as found."""
    if text is None:
        return False, None
    found, rest = False, text

    def last(markers: tuple[str, ...], behind: bool) -> None:
        nonlocal found, rest
        for marker in markers:
            before, hit, _ = rest.lower().rpartition(marker)
            if hit:
                found, rest = True, (rest[len(before) + len(marker) :] if behind else rest[: len(before)]).strip()

    last(_BEFORE_ANSWER, True)
    last(_AFTER_ANSWER, False)
    box = unboxed(last_boxed(rest))
    if box is not None and box.strip():
        found, rest = True, box.strip()
    if ". " in rest:
        rest = rest[: rest.rindex(". ")].strip()
    last(_LINKS, True)
    return found and any(c.isdigit() for c in rest), rest


def plain_number(text: str | None, pi: float = math.pi) -> str | None:
    """Dollar and percent signs off numbers, a number's base dropped, products with pi worked out; other texts as they are."""
    if text is None:
        return None
    if re.match(r"\$\d+(\.\d+)?", text):
        return text[1:]
    if re.fullmatch(r"\d+(\.\d+)?\\?%", text):
        return text.rstrip("%").rstrip("\\")
    if "_" in text:
        digits = text.split("_")[0]
        return str(int(float(digits))) if re.fullmatch(r"\s*[-+]?\d+(\.\d*)?\s*", digits) else None
    if "\\pi" in text:
        value = expressions.number_of(text, pi)
        return text if value is None else repr(value)
    return text


def math_score(solution: str | None, truth: str | None) -> float:
    answer = unboxed(last_boxed(solution))
    return float(answer is not None and grade(answer, truth))


def repetition(text: str) -> float:
    """Twice the sum of longest common prefixes of neighbouring suffixes over n (n + 1).

    Suffixes are ordered by prefix doubling, so the time grows with n log n sorts of numbers, not with whole suffixes.
    """
    n = len(text)
    if n < 2:
        return 0.0
    rank = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        behind = np.full(n, -1, np.int64)
        behind[: max(0, n - step)] = rank[step:]
        key = rank * (n + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = first
        if first[-1] == n - 1 or step >= n:
            break
        step *= 2
    order, place = order.tolist(), rank.tolist()
    total = h = 0
    for i in range(n):
        if place[i]:
            j = order[place[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            total += h
            h = max(0, h - 1)
        else:
            h = 0
    return 2 * total / (n * (n + 1))


_WORD = re.compile(r"\w+")


def rouge_l(reference: str | None, candidate: str | None) -> float:
    """F1 of the longest common subsequence of words."""
    r, c = _WORD.findall((reference or "").lower()), _WORD.findall((candidate or "").lower())
    if not r or not c:
        return 0.0
    row = [0] * (len(c) + 1)
    for w in r:
        left = 0
        for j, v in enumerate(c, 1):
            up = row[j]
            row[j] = left + 1 if w == v else max(up, row[j - 1])
            left = up
    lcs = row[-1]
    return 2 * lcs / (len(r) + len(c)) if lcs else 0.0


def sentence_bleu(reference: str | None, candidate: str | None, order: int = 4) -> float:
    """Sentence BLEU with effective order: n-gram orders without any candidate n-gram are left out."""
    r, c = (reference or "").split(), (candidate or "").split()
    if not r or not c:
        return 0.0
    logs = []
    for n in range(1, order + 1):
        grams = [tuple(c[i : i + n]) for i in range(len(c) - n + 1)]
        if not grams:
            break
        have: dict = {}
        for i in range(len(r) - n + 1):
            have[tuple(r[i : i + n])] = have.get(tuple(r[i : i + n]), 0) + 1
        hit = 0
        for g in grams:
            if have.get(g, 0) > 0:
                have[g] -= 1
                hit += 1
        if not hit:
            return 0.0
        logs.append(math.log(hit / len(grams)))
    return math.exp(sum(logs) / len(logs)) * (1.0 if len(c) >= len(r) else math.exp(1 - len(r) / len(c)))


_SEGMENT = re.compile(r"<(code|interpreter|answer)>(.*?)</\1>", re.S)


def transcript_messages(text: str | None) -> list[tuple[str, str]]:
    """(role, content) of a tagged transcript: code and answers are the assistant's, interpreter output the tool's."""
    out, at = [], 0
    for m in _SEGMENT.finditer(text or ""):
        before = text[at : m.start()].strip()
        if before:
            out.append(("assistant", before))
        out.append(("tool" if m[1] == "interpreter" else "assistant", m[2].strip()))
        at = m.end()
    rest = (text or "")[at:].strip()
    return [*out, ("assistant", rest)] if rest else out


@F.pandas_udf(T.StringType())
def boxed_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unboxed(last_boxed(t)))


@F.pandas_udf(T.StringType())
def normal_math_udf(text: pd.Series) -> pd.Series:
    return text.map(normal_math)


@F.pandas_udf(T.DoubleType())
def math_score_udf(solution: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([math_score(s, t) for s, t in zip(solution, truth)])


@F.pandas_udf(T.DoubleType())
def rouge_l_udf(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(r, c) for r, c in zip(reference, candidate)])


@F.pandas_udf(T.DoubleType())
def bleu_udf(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([sentence_bleu(r, c) for r, c in zip(reference, candidate)])


@F.pandas_udf(T.DoubleType())
def repetition_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: repetition(t) if t else 0.0)


@F.pandas_udf(T.BooleanType())
def grade_udf(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([guarded_grade(g, t) for g, t in zip(given, truth)])


@F.pandas_udf(T.StructType([T.StructField("found", T.BooleanType()), T.StructField("answer", T.StringType())]))
def located_answer_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([located_answer(t) for t in text], columns=["found", "answer"])


@F.pandas_udf(T.StringType())
def plain_number_udf(text: pd.Series) -> pd.Series:
    return text.map(plain_number)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])))
def transcript_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"role": r, "content": c} for r, c in transcript_messages(t)])
