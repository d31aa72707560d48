"""Answer extraction and normalisation as column expressions (JVM side; unigram scores count in Arrow batches)."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that do not count as content words.
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "with", "this", "that", "from", "have", "has", "was", "were", "they", "them", "their", "his",
    "her", "hers", "its", "into", "than", "then", "there", "what", "when", "where", "which", "who", "why", "how", "all", "any", "can", "could",
    "would", "should", "will", "shall", "may", "might", "must", "did", "does", "done", "doing", "been", "being", "very", "too",
)

#: Fixed values of the final-answer normaliser: replacements, then removals, in this order.
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm",
    "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}",
    "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]

#: White space of every kind, the wide and thin blanks of Unicode included.
SPACES = r"[\s\p{Z}\x1c-\x1f\x85]+"

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _last(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(1))


def hash_answer(text: Column) -> Column:
    """Last ``#### number`` without commas and dollar signs; null when absent."""
    return F.translate(_last(text, r"#### (\-?[0-9\.,]+)"), ",$", "")


def flexible_answer(text: Column) -> Column:
    """Last number-like token that is neither empty nor a lone full stop."""
    tokens = F.filter(F.regexp_extract_all(text, F.lit(r"(\-?[0-9\.,]+)"), F.lit(1)), lambda t: ~t.isin("", "."))
    return F.try_element_at(tokens, F.lit(-1))


def first_hash_answer(text: Column) -> Column:
    return F.translate(_first(text, r"#### (\-?[0-9.,]+)"), ",", "")


def match_score(answer: Column, truth: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    """``score`` when equal, ``format_score`` when an answer was found, else 0."""
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(format_score)


def flat_boxed(text: Column) -> Column:
    """Content of the last \\boxed{...} without inner braces."""
    return _last(text, r"\\boxed\{([^{}]*)\}")


def remove_boxed(boxed: Column) -> Column:
    """The content of a string that is exactly \\boxed{...}; null otherwise."""
    ok = boxed.startswith("\\boxed{") & boxed.endswith("}")
    return F.when(ok, boxed.substr(F.lit(8), F.length(boxed) - 8))


def slash_fraction(text: Column) -> Column:
    """a/b of two integers as \\frac{a}{b}."""
    return F.regexp_replace(text, r"^(-?\d+)/(-?\d+)$", r"\\frac{$1}{$2}")


def braced_sqrt(text: Column) -> Column:
    return F.regexp_replace(text, r"\\sqrt([^{])", r"\\sqrt{$1}")


def without_units(text: Column) -> Column:
    """Text before ``\\text{ ``."""
    return F.split_part(text, F.lit("\\text{ "), F.lit(1))


def normal_final_answer(text: Column) -> Column:
    """Final-answer normaliser: last side of an equation, replacements and removals, unwrapping, shorthand TeX, digit commas."""
    x = F.element_at(F.split(text, "="), -1)
    for old, new in SUBSTITUTIONS:
        x = F.replace(x, F.lit(old), F.lit(new))
    for old in REMOVED:
        x = F.replace(x, F.lit(old), F.lit(""))
    x = F.regexp_replace(x, r"(.*?)\$(.*?)\$(.*)", r"\$$2\$")
    for name in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, rf"\\{name}\{{(.*?)\}}", "$1")
    x = F.regexp_replace(x, r"\\boxed\{(.*)\}", "$1")
    x = F.regexp_replace(x, r"frac([^{])(.)", r"frac{$1}{$2}")
    x = F.regexp_replace(x, r"sqrt([^{])", r"sqrt{$1}")
    x = F.replace(x, F.lit("$"), F.lit(""))
    plain = F.replace(x, F.lit(","), F.lit(""))
    return F.trim(F.when(plain.rlike(r"^\d+$"), plain).otherwise(x))


def answer_line(text: Column) -> Column:
    """Last ``Answer: x`` line, case-insensitive; [INVALID] when absent."""
    return F.coalesce(_last(text, r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]"))


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def choice_letter(text: Column) -> Column:
    """Upper-case letter of the first \\boxed{A-D}."""
    return F.upper(_first(text, r"\\boxed\{\s*([A-Da-d])\s*\}"))


def choice_line(text: Column) -> Column:
    """Letter of the first ``Answer: X``, case-insensitive."""
    return F.upper(_first(text, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?"))


def choice_grade(answer: Column, truth: Column) -> Column:
    return F.coalesce(F.upper(F.trim(answer)) == F.upper(F.trim(truth)), F.lit(False))


def open_answer(text: Column) -> Column:
    """Boxed content if there is any, else the text; trimmed."""
    return strip(F.coalesce(flat_boxed(text), text))


def split_tuple(text: Column) -> Column:
    """Elements of (a, b) or [a, b]; other texts are one element."""
    inner = F.regexp_replace(text, r"^[\(\[](.*)[\)\]]$", "$1")
    return F.when(text.rlike(r"^[\(\[].*[\)\]]$"), F.transform(F.split(inner, ","), lambda x: F.trim(x))).otherwise(F.array(text))


def is_int(text: Column) -> Column:
    value = F.replace(text, F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(F.abs(value - F.round(value)) <= 1e-7, F.lit(False))


def is_fraction(text: Column) -> Column:
    return text.rlike(r"^-?[0-9]+.?/0*[1-9][0-9]*.?$")


def value_equal(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) | (a.try_cast("double") == b.try_cast("double")), F.lit(False))


def numeric_close(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    return F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b))


def interval_brackets(text: Column) -> Column:
    """Interval(a, b) and its open forms as brackets."""
    out = text
    for name, left, right in ((r"Interval\.open", "(", ")"), (r"Interval\.Lopen", "(", "]"), (r"Interval\.Ropen", "[", ")"), ("Interval", "[", "]")):
        out = F.regexp_replace(out, rf"^{name}\((.*)\)$", f"{left}$1{right}")
    return out


def qa_normal(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks, in this order."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), SPACES, " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    return F.array_contains(F.transform(golds, qa_normal), qa_normal(prediction))


def contains_match(prediction: Column, golds: Column) -> Column:
    p = qa_normal(prediction)
    return F.exists(golds, lambda g: p.contains(qa_normal(g)))


def answer_tag(text: Column) -> Column:
    """Content of the last answer tag, over lines, trimmed."""
    return strip(_last(text, r"(?s)<answer>(.*?)</answer>"))


def tag_count(text: Column, tag: str) -> Column:
    return F.regexp_count(text, F.lit(f"<{tag}>"))


def qa_score(prediction: Column, golds: Column, text: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    """Exact-match score; a quarter of it when the text holds more than ten answer tags."""
    hit = F.when(tag_count(text, "answer") > 10, score / 4).otherwise(score)
    return F.when(prediction.isNull(), 0.0).when(exact_match(prediction, golds), hit).otherwise(format_score)


def think_format(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def judge_score(text: Column, neutral: float = 0.5) -> list[Column]:
    """First one- or two-digit number over ten, at most 1, and whether there was one."""
    raw = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(\d{1,2})\b", 1), F.lit("")).cast("int")
    return [F.when(raw.isNotNull(), F.least(raw, F.lit(10)) / 10.0).otherwise(F.lit(neutral)).alias("judge"), raw.isNotNull().alias("parsed")]


def judge_digit(text: Column) -> Column:
    """First 0 to 10 over ten; null when absent."""
    return F.regexp_extract(text, r"\b(10|[0-9])\b", 1).try_cast("int") / 10.0


def verdict(text: Column) -> Column:
    """Score of the first [[A>>B]]-style verdict; null when absent."""
    v = F.regexp_extract(text, r"\[\[(A>>B|A>B|A=B|B>A|B>>A)\]\]", 1)
    return F.when(v == "A>>B", 1.0).when(v == "A>B", 0.5).when(v == "A=B", 0.0).when(v == "B>A", -0.5).when(v == "B>>A", -1.0)


#: Option lines of a question: a letter A to D, a mark, the text.
OPTION = r"(?m)^[ \t]*\(?([A-D])[.):][ \t]*(.+?)[ \t]*$"


def option_texts(question: Column) -> Column:
    """Letter to option text."""
    return F.map_from_arrays(F.array_distinct(F.regexp_extract_all(question, F.lit(OPTION), F.lit(1))), F.slice(F.regexp_extract_all(question, F.lit(OPTION), F.lit(2)), F.lit(1), F.size(F.array_distinct(F.regexp_extract_all(question, F.lit(OPTION), F.lit(1))))))


def question_stem(question: Column) -> Column:
    """Text before the first option line."""
    return strip(F.regexp_extract(question, r"(?s)^(.*?)(?:\n[ \t]*\(?[A-D][.):][ \t]|$)", 1))


def format_options(options: Column, most: int = 4) -> Column:
    """Lines "A. text" of up to four options."""
    return F.array_join(F.transform(F.slice(options, 1, most), lambda o, i: F.concat(F.substring(F.lit("ABCD"), i + 1, F.lit(1)), F.lit(". "), o)), "\n")


def caption_clean(text: Column) -> Column:
    """" [title]" to a full stop, bracketed text dropped, double blanks halved once."""
    x = F.replace(strip(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(x, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def squeeze(text: Column) -> Column:
    """Trimmed, lower case, single blanks; white space of every kind counts."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nd}_]+"), F.lit(0))


def content_words(tokens: Column, least: int = 3) -> Column:
    return F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.isin(list(STOP_WORDS)))


def keyword_hit(reference: Column, candidate: Column) -> Column:
    """1 when every content word of the reference stands in the candidate."""
    return (F.size(F.array_except(content_words(word_tokens(reference)), word_tokens(candidate))) == 0).cast("double")


def bleu1(reference: Column, candidate: Column) -> Column:
    """Clipped unigram precision times the brevity penalty; 0 for empty sides."""

    @F.pandas_udf(T.DoubleType())
    def run(references: pd.Series, candidates: pd.Series) -> pd.Series:
        return pd.Series([_unigrams(r, c) for r, c in zip(references, candidates)])

    return run(word_tokens(reference), word_tokens(candidate))


def _unigrams(r, c) -> float:
    if not len(r) or not len(c):
        return 0.0
    have = Counter(r)
    clipped = sum(min(n, have[w]) for w, n in Counter(c).items())
    return clipped / len(c) * (1.0 if len(c) >= len(r) else math.exp(1 - len(r) / len(c)))


def code_block(text: Column) -> Column:
    """Last python block, else the first fenced block without its language line; null when there is none."""
    python = F.split_part(F.element_at(F.split(text, "```python"), -1), F.lit("```"), F.lit(1))
    parts = F.split(text, "```")
    fenced = F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"^[ \t]*[A-Za-z]+[ \t]*\n", "")
    return F.when(text.contains("```python"), python).when(text.contains("```"), fenced)


def tool_calls(text: Column) -> Column:
    """JSON bodies of tool-call tags that parse as objects with a name."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    return F.filter(bodies, lambda b: F.get_json_object(b, "$.name").isNotNull())


def truncate_reply(text: Column, n: int, side: str = "left") -> Column:
    """Tool replies above n characters: the head (left), the tail (right), or both halves."""
    if side == "left":
        cut = F.concat(F.left(text, F.lit(n)), F.lit("...(truncated)"))
    elif side == "right":
        cut = F.concat(F.lit("(truncated)..."), F.right(text, F.lit(n)))
    else:
        cut = F.concat(F.left(text, F.lit(n // 2)), F.lit("...(truncated)..."), F.right(text, F.lit(n // 2)))
    return F.when(F.length(text) > n, cut).otherwise(text)


def label_text(labels: Column) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(1)), F.lit(""))


def text_key(text: Column) -> Column:
    return F.sha1(text)


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    """min(-(length - (longest - buffer)) / buffer x factor, 0)."""
    return F.least(-(length - (longest - buffer)) / buffer * factor, F.lit(0.0))


def tool_turn_score(correct: Column, turns: Column) -> Column:
    """1 when right; when wrong, -1 plus a twentieth per turn beyond two, at most 0."""
    return F.when(correct, 1.0).otherwise(F.least(F.lit(0.0), F.lit(-1.0) + (turns - 2) / 2 * 0.1))


def lookup_score(scores: Column, text: Column) -> Column:
    """Score of a text in a map, by exact then by stripped key; 0 when absent."""
    bare = F.transform_keys(scores, lambda k, _: strip(k))
    return F.coalesce(scores[text], bare[strip(text)], F.lit(0.0))


def lines_equal(output: Column, truth: Column) -> Column:
    """Outputs that are equal as a whole, or line by line, after trimming."""
    per_line = lambda t: F.array_join(F.transform(F.split(strip(t), "\n"), strip), "\n")
    return (strip(output) == strip(truth)) | (per_line(output) == per_line(truth))


def index_of(extra: Column, index: Column) -> Column:
    return F.coalesce(extra, index, F.lit(0))


def passages(titles_texts: Column) -> Column:
    """Numbered passages "Doc i (Title: t)" with the first line as title."""
    line = lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), F.split_part(d, F.lit("\n"), F.lit(1)), F.lit(")\n"), F.regexp_replace(d, r"(?s)^[^\n]*\n?", ""))
    return F.array_join(F.transform(titles_texts, line), "\n")
