"""Problem 10: personal information in free text, listed and replaced by placeholders of its kind.

Every document is a skip-chain conditional random field. Its nodes are, for e-mail addresses, phone numbers, identity
numbers and street addresses, all stretches of text that have the form of their kind (wide patterns; e-mail addresses also
written out: ``user [at] host dot org``), with the labels other and entity, and for names of people the name-like words
near a known name part, a cue or a repeat of a likely name, with the labels other, given and family. Form, checks of the
number and cues around it are a node's own potential; neighbouring words of names share chain potentials; equal and
similar nodes of a document share skip potentials wherever they stand. Loopy message passing spreads the evidence, so that
what is seen clearly once is recognised elsewhere. A skip potential between numbers needs evidence at one of its ends, so
that repeated run numbers do not vouch for each other. One name part alone is no name; parts inside e-mail addresses are
masked first.

Cues are learned, not listed: the words next to pairs of known name parts, and in front of phone numbers whose form is
certain, are counted over all documents, and a cue's weight is the log odds that such a pair or number stands at it,
smoothed. Words that the documents write nearly always in lower case are no name words.

Null, empty and blank texts have no findings and stay as they are. Whole texts are searched; equal findings of one
document are listed once, and all their places are replaced. Repeated rows are handled alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlake.llm import common

KINDS = ("email", "phone", "identity", "address", "name")

# ---- patterns (fixed values) ----

_S = r"\s{1,8}"
_AT = re.compile(r"@|＠|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+", re.I)
_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*$|[A-Za-z0-9]$")
_DOT = r"(?:\.|\s{1,4}\.\s{1,4}|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)"
_DOMAIN = re.compile(rf"([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)((?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)", re.I)
_DOT_SPLIT = re.compile(_DOT, re.I)
_TLD = frozenset("com org net edu gov io ai co info biz eu de fr es it uk us ru cn nl ch at be se no fi dk pl cz example invalid test localdomain".split())

_PHONE_CUE = re.compile(r"(?:phone|tel|telephone|call|text|fax|mobile|cell|whatsapp|sms|left|says|number|dial|ring|reach|contact|card|llame|llamar|teléfono|móvil|telefon|handy|anrufen|rufen|téléphone|tél|appelez|appeler|тел|телефон|звоните|позвоните|电话|致电|手机)(?:\b|(?<=[话电机]))[^\n]{0,90}$", re.I)
_D = rf"(?:{_S}|[.-])"
#: Forms of phone numbers with the potential of being one; the doubtful ones need a cue close by or a certain repeat.
SURE, DOUBTFUL = 2.0, -1.5
_PHONE_FORMS = (
    (SURE, rf"\+\d{{1,3}}{_D}?(?:\(\d{{1,4}}\){_D}?)?\d{{1,4}}(?:{_D}?\d{{2,8}}){{1,5}}"),
    (SURE, rf"00\d{{2}}{_S}\d{{1,4}}(?:{_S}\d{{2,4}}){{1,5}}"),
    (SURE, rf"0\d{{4}}{_S}\d{{6}}"),
    (SURE, rf"\(\d{{3}}\){_S}?\d{{3}}[-.]\d{{4}}"),
    (SURE, r"\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}"),
    (SURE, rf"\d{{3}}/\d{{3}}{_S}\d{{4}}"),
    (DOUBTFUL, rf"[2-9]\d{{2}}{_S}[2-9]\d{{2}}{_S}\d{{4}}"),
    (DOUBTFUL, r"0\d{1,4}(?:[ \u00a0./-]\d{2,8}){1,5}"),
    (DOUBTFUL, r"\d{10}"),
)
_PHONE = re.compile(r"(?<![\w+.,:/-])(?:" + "|".join(f"({form})" for _, form in _PHONE_FORMS) + r")(?![\d:]|[.,-]\d)")
#: Where a phone number can begin; trying there alone is far cheaper than trying everywhere.
_PHONE_START = re.compile(r"[+(]|\d+")


def _phones(text: str) -> Iterator[re.Match]:
    """The matches of _PHONE in order, without overlaps."""
    done = 0
    for start in _PHONE_START.finditer(text):
        if start.start() >= done and (m := _PHONE.match(text, start.start())):
            done = m.end()
            yield m


_IDENTITY = re.compile(
    rf"(?:\bssn\b|\bsocial{_S}security\b|\btax{_S}id\b|\bpassport\b|\btravel{_S}document\b|\binsurance\b|\btax{_S}number\b|\bidentity\b|\bnational{_S}id\b|\bni{_S}no\b|\bnino\b|\bnational{_S}insurance\b)"
    rf"(?:{_S}(?:no\.?|number|nr\.?|num\.?|card|id|is|code))*\.?\s*[:=#]?\s*(?:no\.?\s*)?[\"']?"
    rf"(\d{{3}}[- \t]\s?\d{{2}}[- \t]\s?\d{{4}}|\d{{9}}|[A-Z]{{2}}\s{{0,4}}\d{{2}}\s{{0,4}}\d{{2}}\s{{0,4}}\d{{2}}\s{{0,4}}[A-D]|[A-Z]{{1,2}}\s?\d{{6,9}})(?!\w)",
    re.I,
)
#: Without a cue: the form of a social security number, with the groups that are never given out left out.
_BARE_SSN = re.compile(r"(?<![\w-])(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")

_TYPES = r"(?:road|rd|street|str|st|avenue|ave|av|lane|ln|way|boulevard|blvd|drive|dr|court|ct|place|pl|terrace|ter|square|sq|close|crescent|cres|row|parkway|pkwy|highway|hwy|circle|cir|alley|walk|hill|grove|gardens|mews|quay|loop|trail)"
_NAME = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_N = r"\d{1,5}[A-Za-z]?"
_ADDRESS = (
    ("english", re.compile(rf"(?<![\w.-])(?:no\.?{_S})?({_N})\s{{0,4}},?{_S}((?:{_NAME}{_S}){{1,3}}?{_TYPES})\b(?![-'’]\w)", re.I)),
    ("german", re.compile(rf"(?<![\w-])([^\W\d_]+(?:-[^\W\d_]+)*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig))\s{{1,8}}({_N})\b", re.I)),
    ("spanish", re.compile(rf"(?<![\w-])((?:calle|avenida|avda\.?|paseo|plaza|camino|carrera|ronda|travesía|via|viale|rua){_S}(?:(?:de|del|la|las|los|el){_S})*{_NAME}(?:{_S}{_NAME})?)\s?,?{_S}(?:(?:no|nº|n)\.?{_S})?({_N})\b", re.I)),
    ("french", re.compile(rf"(?<![\w.-])({_N})\s?,?{_S}((?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|cours|passage){_S}(?:(?:de|du|des|la|le|les|l|d)(?:{_S}|['’]))*{_NAME})", re.I)),
)
#: Words of which one must stand in a text for the pattern to match; plain searches are far cheaper than patterns.
_GATES = {
    "german": ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "ring", "damm", "ufer", "steig"),
    "spanish": ("calle", "avenida", "avda", "paseo", "plaza", "camino", "carrera", "ronda", "travesía", "via", "rua"),
    "french": ("rue", "avenue", "boulevard", "place", "chemin", "allée", "quai", "impasse", "cours", "passage"),
    "identity": ("ssn", "security", "tax", "passport", "document", "insurance", "identity", "national", "nino"),
}
_NI = re.compile(r"\bni\s")


def _may_match(kind: str, low: str) -> bool:
    if kind != "german":
        return any(w in low for w in _GATES[kind]) or (kind == "identity" and _NI.search(low) is not None)
    for w in _GATES[kind]:
        at = low.find(w)
        while at >= 0:
            if low[at + len(w) : at + len(w) + 9].lstrip()[:1].isdigit():
                return True
            at = low.find(w, at + 1)
    return False


_ADDRESS_CUE = re.compile(r"(?:\blive[sd]?\s+(?:at|in)|\breturned\s+to|\bhome\s*[=:]|\baddress\s*(?:is|[:=])|\bcontact\b[^\n]{0,60}|\b(?:ship|send|deliver|mail|post)(?:ed)?\b[^\n]{0,30}\s+to|\bis\s+at|\bfilmed\s+(?:at|in)|\bliegt|\bwohnt|\bvive\s+en|\bhabite)[\s\"']*$", re.I)
_WORDS = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")


def _words(text: str) -> str:
    return " ".join(_WORDS.findall(text.lower()))


def find_emails(text: str) -> list[tuple[int, int, str, str]]:
    out, done = [], 0
    for m in _AT.finditer(text):
        sign = m.group().strip().lower()
        if m.start() < done:
            continue
        lo = max(0, m.start() - 80)
        local = _LOCAL.search(text[lo : m.start()])
        domain = _DOMAIN.match(text, m.end())
        if local is None or domain is None:
            continue
        plain_sign = sign in ("@", "＠")
        if plain_sign and m.start() != lo + local.end():
            continue
        labels = [x for x in _DOT_SPLIT.split(domain.group()) if x]
        # A stop at the end of a sentence is no dot of the domain: drop what follows the last known ending.
        end = domain.end()
        ends = list(_DOT_SPLIT.finditer(domain.group()))
        while len(labels) > 2 and labels[-1].lower() not in _TLD and any(x.lower() in _TLD for x in labels[1:-1]):
            end = domain.start() + ends[len(labels) - 2].start()
            labels.pop()
        if len(labels) < 2 or not labels[-1].isalpha() or len(labels[-1]) < 2:
            continue
        name = local.group()
        written_dot = _DOT_SPLIT.search(domain.group()).group().strip().lower() != "."
        if sign == "at":
            if not (written_dot or any(not c.isalpha() for c in name)) and not (text[domain.start() : domain.end()].find(" . ") > 0):
                continue
            if labels[-1].lower() not in _TLD:
                continue
        start = lo + local.start()
        out.append((start, end, "email", f"{name}@{'.'.join(labels)}".lower()))
        done = end
    return out


Candidate = tuple[int, int, str, str, float]


def phone_candidates(text: str, cues: dict[str, float]) -> list[Candidate]:
    out = []
    for m in _phones(text):
        digits = re.sub(r"\D", "", m.group())
        if not 9 <= len(digits) <= 15:
            continue
        score = _PHONE_FORMS[m.lastindex - 1][0]
        if score < 0:
            before = text[max(0, m.start() - 110) : m.start()]
            near = _PHONE_CUE.search(before) if m.group().isdigit() else _PHONE_CUE.search(before[-30:])
            score += 3.0 if near else max((w for c in _last_words(before[-40:].lower()) if (w := cues.get(c))), default=0.0)
        out.append((m.start(), m.end(), "phone", digits, score))
    return out


def identity_candidates(text: str) -> list[Candidate]:
    cued = _IDENTITY.finditer(text) if _may_match("identity", text.lower()) else ()
    out = [(m.start(1), m.end(1), "identity", re.sub(r"[^A-Za-z0-9]", "", m.group(1)).upper(), SURE) for m in cued]
    taken = {s for s, *_ in out}
    out += [(m.start(), m.end(), "identity", m.group().replace("-", ""), 0.5) for m in _BARE_SSN.finditer(text) if m.start() not in taken]
    # Forms that say little by themselves stand where a certain one is repeated.
    known = {found for *_, found, _ in out}
    for found in known:
        for m in re.finditer(rf"(?<![\w-]){r'[ -]?'.join(map(re.escape, found))}(?![\w-])", text, re.I) if len(found) >= 7 else ():
            if m.start() not in taken:
                out.append((m.start(), m.end(), "identity", found, -1.0))
    return out


def address_candidates(text: str) -> list[Candidate]:
    out = []
    low = text.lower()
    for kind, pattern in _ADDRESS:
        if kind in _GATES and not _may_match(kind, low):
            continue
        for m in pattern.finditer(text):
            cue = _ADDRESS_CUE.search(text[max(0, m.start() - 90) : m.start()])
            number, street = (m.group(1), m.group(2)) if kind in ("english", "french") else (m.group(2), m.group(1))
            names = re.findall(_NAME, street)
            proper = names[0][:1].isupper() if kind in ("english", "german") else names[-1][:1].isupper()
            shouted = text[max(0, m.start() - 30) : m.end() + 30].isupper()
            if kind == "english" and not all(x[:1].isupper() for x in names):
                proper = False
            if kind == "german" and len(names[0]) < 7:
                proper = False
            first, second = (number, street) if kind in ("english", "french") else (street, number)
            score = (3.0 if cue else 0.0) + (3.0 if proper and not shouted else 0.0) - 1.0
            out.append((m.start(), m.end(), "address", _words(f"{first} {second}"), score))
    return out


_OPENING, _CLOSING = "\"'([{<*_-–—>", ".,;:!?\")'"


def _last_words(before: str) -> list[str]:
    """The last one to three words of a text, white space as one blank, with and without quotes at their end and signs in front."""
    words = " ".join(before.split()).split(" ")
    out = []
    for k in range(1, min(3, len(words)) + 1):
        quoted = " ".join(words[-k:])
        told = quoted.rstrip("\"'")
        out += {told, quoted, told.lstrip(_OPENING), quoted.lstrip(_OPENING)} if told != quoted else {told, told.lstrip(_OPENING)}
    return [x for x in out if x]


def _first_words(after: str) -> list[str]:
    """The first one to three words of a text, signs at its beginning and behind words dropped."""
    words = " ".join(after.split()).lstrip("\" ')*_").split(" ")
    return [x for k in range(1, min(3, len(words)) + 1) if (x := " ".join(words[:k]).rstrip(_CLOSING))]


#: Skip potential of equal and similar numbers or addresses: both being the entity is likely.
_SAME = np.array([[0.0, 0.0], [0.0, 2.4]])


def _alike(kind: str, found: str) -> str:
    """Key of similar findings: a phone number by its last digits, so that it is the same with and without a country code."""
    return found[-8:] if kind == "phone" else found


def decided(candidates: list[Candidate]) -> list[tuple[int, int, str, str]]:
    """The candidates whose most likely label is the entity."""
    if not candidates:
        return []
    first: dict[tuple[str, str], int] = {}
    for k, (_, _, kind, found, score) in enumerate(candidates):
        if score > 0:
            first.setdefault((kind, _alike(kind, found)), k)
    edges = [(at, k, _SAME) for k, (_, _, kind, found, _) in enumerate(candidates) if (at := first.get((kind, _alike(kind, found)), k)) != k]
    if not edges:
        return [c[:4] for c in candidates if c[4] > 0]
    labels = _marginals(np.array([[0.0, c[4]] for c in candidates]), edges).argmax(axis=1)
    return [c[:4] for c, label in zip(candidates, labels) if label]


# ---- names: skip-chain conditional random field ----

#: Titles of persons, which are cues by themselves.
TITLES = frozenset("prof professor dr mr mrs ms miss sir herr frau señor señora monsieur madame".split())

#: Cues that are kept of those learned, least number of known pairs at one, and least weight of one that is searched for.
MOST_CUES, LEAST_PAIRS, ANCHOR_WEIGHT = 400, 4, 0.8

_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d+|[^\w\s]|_")
#: Function words of English and its neighbours; other words that are no names are learned.
_COMMON = frozenset(
    "the a an and or but of to in on at by for from with is are was were be been this that these those it its he she they we you i my your his her their our not no yes "
    "as if then than so all one two has have had will can could would should may more less very when where who what which how why because while after before about into over under out up down off both again cc "
    "der die das und ein eine el la los las un una le les des du de en et que y".split()
)
_O, _G, _F = 0, 1, 2


class NameModel:
    """Potentials of the field: known name parts, weights of cues on the left, on the right and before numbers, words that are no names."""

    def __init__(self, given: set[str], family: set[str], left: dict[str, float], right: dict[str, float] | None = None, numbers: dict[str, float] | None = None, plain: set[str] | None = None):
        self.given, self.family, self.left, self.right, self.numbers, self.plain = given, family, left, right or {}, numbers or {}, plain or set()
        strong = {c for side in (self.left, self.right) for c, w in side.items() if len(c) > 1 and w >= ANCHOR_WEIGHT}
        self.anchors = _automaton(given | family | strong)

    def spans(self, lower: str, also: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """Stretches of text around anchors and around the places (last character, length) of ``also``, merged."""
        out: list[list[int]] = []
        n = len(lower)
        anchors = self.anchors.iter(lower) if len(self.anchors) else ()
        for end, size in sorted([*anchors, *also]) if also else anchors:
            start = end - size + 1
            if (start and lower[start - 1].isalnum()) or (end + 1 < n and lower[end + 1].isalnum() and lower[end].isalnum()):
                continue
            a, b = max(0, start - 70), min(n, end + 70)
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def cue_at(self, lower: str, start: int, end: int) -> tuple[float, float]:
        """Weights of the left cue that ends before ``start`` and of the right cue that begins after ``end``."""
        left = max((self.left.get(c, 0.0) for c in _last_words(lower[max(0, start - 40) : start])), default=0.0)
        right = max((self.right.get(c, 0.0) for c in _first_words(lower[end : end + 40])), default=0.0)
        return left, right


def _node_scores(model: NameModel, word: str, low: str, left: float, right: float, shouted: bool) -> np.ndarray:
    g, f = low in model.given, low in model.family
    # A capital says nothing where the words around are in capitals too.
    shape = 0.5 if word[:1].isupper() and not shouted else -0.8
    known_g = 4.0 if g else (-3.0 if f else -2.2 + shape)
    known_f = 4.0 if f else (-3.0 if g else -2.2 + shape)
    return np.array([0.0, known_g + left + 0.5 * right, known_f + right + 0.5 * left])


_CHAIN = np.array([[0.0, 0.0, -1.5], [-1.5, -1.0, 2.6], [-0.5, -1.5, -1.5]])
_COMMA = np.array([[0.0, 0.0, -0.5], [-0.5, -1.0, -2.5], [-0.5, 2.8, -2.0]])
_SKIP = np.array([[0.3, -0.6, -0.6], [-0.6, 1.0, -0.6], [-0.6, -0.6, 1.0]])


def _marginals(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]], rounds: int = 5) -> np.ndarray:
    """Loopy sum-product in the log domain."""
    messages = [np.zeros((2, unary.shape[1])) for _ in edges]
    incoming = unary.copy()
    for _ in range(rounds):
        for k, (a, b, table) in enumerate(edges):
            from_a = incoming[a] - messages[k][1]
            to_b = np.logaddexp.reduce(from_a[:, None] + table, axis=0)
            to_b -= to_b.max()
            incoming[b] += to_b - messages[k][0]
            messages[k][0] = to_b
            from_b = incoming[b] - messages[k][0]
            to_a = np.logaddexp.reduce(from_b[None, :] + table, axis=1)
            to_a -= to_a.max()
            incoming[a] += to_a - messages[k][1]
            messages[k][1] = to_a
    return incoming


def find_names(text: str, model: NameModel) -> list[tuple[int, int, str, str]]:
    """Names in ``text``, in which e-mail addresses are blanked already."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans, likely = model.spans(lower), set()
    while True:
        out, words = _names_in(text, lower, spans, model)
        # Repeats of likely names are nodes too, wherever they stand; the words only grow, so this ends.
        if words <= likely:
            return out
        likely |= words
        wider = model.spans(lower, [(at + len(w) - 1, len(w)) for w in likely for at in _places(lower, w)])
        if wider == spans:
            return out
        spans = wider


def _folded(word: str) -> str:
    """Key of similar words: without accents and without a possessive ending."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)) if not word.isascii() else word
    return plain.removesuffix("'s").removesuffix("’s")


def _places(lower: str, word: str) -> Iterator[int]:
    at = lower.find(word)
    while at >= 0:
        yield at
        at = lower.find(word, at + len(word))


def _names_in(text: str, lower: str, spans: list[tuple[int, int]], model: NameModel) -> tuple[list[tuple[int, int, str, str]], set[str]]:
    """Names with their nodes in ``spans``, and the words that are labelled as parts of a name."""
    nodes, unary, edges = [], [], []
    where = defaultdict(list)
    for a, b in spans:
        while a > 0 and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum():
            b += 1
        before, gap = None, ""
        for m in _TOKEN.finditer(text, a, b):
            w = m.group()
            low = lower[m.start() : m.end()]
            if not w[0].isalpha():
                gap = gap + w if len(gap) < 4 else gap
                continue
            if len(w) == 1 or low in TITLES:
                if low in TITLES or not w.isupper():
                    before = None
                gap = gap if before is not None and w.isupper() else gap + "w"
                if before is not None and w.isupper():
                    gap += "i"
                continue
            if low in _COMMON or (low in model.plain and low not in model.given and low not in model.family):
                before, gap = None, ""
                continue
            left, right = model.cue_at(lower, m.start(), m.end())
            k = len(nodes)
            nodes.append((m.start(), m.end(), w, low))
            around = text[max(0, m.start() - 30) : m.start()] + text[m.end() : m.end() + 30]
            unary.append(_node_scores(model, w, low, left, right, around.isupper()))
            if before is not None:
                if gap in ("", "i", "i."):
                    edges.append((before, k, _CHAIN))
                elif gap == ",":
                    edges.append((before, k, _COMMA))
            where[_folded(low)].append(k)
            before, gap = k, ""
    if len(nodes) < 2 or not edges:
        return [], set()
    if not any(low in model.given or low in model.family for *_, low in nodes) and not any(u[1:].max() > 0 for u in unary):
        return [], set()
    # Equal and similar words: each is linked to the one before it and to the first of them.
    for same in where.values():
        for i in range(1, len(same)):
            edges.append((same[i - 1], same[i], _SKIP))
            if i > 1:
                edges.append((same[0], same[i], _SKIP))
    labels = _marginals(np.array(unary), edges).argmax(axis=1)
    places, sure = [], set()
    for a, b, table in edges:
        if table is not _SKIP:
            g, f = (a, b) if table is _CHAIN else (b, a)
            pair = nodes[g][3], nodes[f][3]
            places.append((a, b, g, f, pair))
            if labels[g] == _G and labels[f] == _F:
                sure.add(pair)
    # All places of a finding come out, those included that are not clear by themselves.
    out = [(nodes[a][0], nodes[b][1], "name", _words(f"{nodes[g][2]} {nodes[f][2]}")) for a, b, g, f, pair in places if pair in sure]
    return out, {nodes[k][3] for k in range(len(nodes)) if labels[k] != _O}


def findings(text: str | None, model: NameModel) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, found) of a text, in order of place, without overlaps; earlier kinds win."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def add(found):
        for x in sorted(found):
            if all(x[1] <= a or x[0] >= b for a, b in taken):
                out.append(x)
                taken.append((x[0], x[1]))

    numbers = _DIGIT.search(text) is not None
    candidates = [(*x, SURE) for x in find_emails(text)]
    if numbers:
        candidates += identity_candidates(text) + address_candidates(text) + phone_candidates(text, model.numbers)
    sure = decided(candidates)
    for kind in ("email", "identity", "address", "phone"):
        add(x for x in sure if x[2] == kind)
    masked = text
    for a, b in sorted(taken, reverse=True):
        masked = masked[:a] + "0" * (b - a) + masked[b:]
    add(find_names(masked, model))
    return sorted(out)


def replaced(text: str | None, found: list[tuple[int, int, str, str]]) -> str | None:
    for a, b, kind, _ in reversed(found):
        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
    return text


def _pairs(text: str, given: set[str], family: set[str]) -> Iterator[tuple[int, int]]:
    """Where pairs of known parts begin and end: given before family, or family, comma, given; an initial may stand between."""
    before: tuple[int, int, str] | None = None
    for m in _TOKEN.finditer(text):
        low = m.group().lower()
        if before is not None and (before[2] in given and low in family or before[2] in family and low in given):
            between = text[before[1] : m.start()].strip()
            if (before[2] in given and re.fullmatch(r"(?:[A-Za-z]\.?)?", between)) or between == ",":
                yield before[0], m.end()
        if len(low) > 1 and low[0].isalpha():
            before = (m.start(), m.end(), low)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


#: Signs that end a cue although the next word follows at once.
_ATTACHED = re.compile(r"([\"(=:<\[])(?=\w)")
_WORD = re.compile(_NAME)


def _automaton(words: set[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, len(w))
    if len(out):
        out.make_automaton()
    return out


def _may_pair(low: str, parts: ahocorasick.Automaton) -> bool:
    """Whether two known parts may stand beside each other: never false where they do, and far cheaper than looking at every word."""
    before: list[int] = []
    for end, size in parts.iter(low) if len(parts) else ():
        start = end - size + 1
        at = next((x for x in reversed(before) if x <= start), None)
        if at is not None and len(low[at:start].strip()) <= 2:
            return True
        before.append(end + 1)
    return False


def _hit_counts(texts: list[str], given: set[str], family: set[str]) -> dict[tuple[str, str], list[int]]:
    """(side, words) to (at a known pair or a certain number, 0), and ("word", word) to (written in lower case, with a capital)."""
    out: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    parts, spelled = _automaton(given | family), Counter()
    for text in texts:
        spelled.update(_WORD.findall(text))
        low = _lower(text)
        if _may_pair(low, parts):
            for a, b in _pairs(low, given, family):
                for side, words in (("left", _last_words(low[max(0, a - 40) : a])), ("right", _first_words(low[b : b + 40]))):
                    for w in words:
                        out[side, w][0] += 1
        for m in _phones(text):
            if _PHONE_FORMS[m.lastindex - 1][0] > 0:
                for w in _last_words(low[max(0, m.start() - 40) : m.start()]):
                    out["number", w][0] += 1
    for w, n in spelled.items():
        if len(w) > 1 and w[0].isalpha():
            out["word", w.lower()][0 if w[0].islower() else 1] += n
    return out


class _Marks(dict):
    """Word to 1 if an asked cue may end with it, plus 2 if one may begin with it; as many words as the memory holds."""

    def __init__(self, tails: set[str], heads: set[str]):
        self.tails, self.heads = tails, heads

    def __missing__(self, w: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        tail, head = w.rstrip("\"'"), w.lstrip("\"')*_")
        self[w] = mark = int(not self.tails.isdisjoint((tail, tail.lstrip(_OPENING), w, w.lstrip(_OPENING)))) + 2 * int(not self.heads.isdisjoint((head, head.rstrip(_CLOSING))))
        return mark


def _place_counts(texts: list[str], asked: dict[str, dict[str, int]]) -> dict[tuple[str, str], list[int]]:
    """(side, asked cue) to (0, places where it stands), over every word of the texts."""
    out: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    marks = _Marks({c.rsplit(" ", 1)[-1] for side in ("left", "number") for c in asked[side]}, {c.split(" ", 1)[0] for c in asked["right"]})
    ending, beginning = Counter(), Counter()
    for text in texts:
        words = _ATTACHED.sub(r"\1 ", _lower(text)).split()
        marked = list(map(marks.__getitem__, words))
        padded = ["", "", *words, "", ""]
        ending.update([(padded[i], padded[i + 1], w) for i, (w, mark) in enumerate(zip(words, marked)) if mark & 1])
        beginning.update([(w, padded[i + 3], padded[i + 4]) for i, (w, mark) in enumerate(zip(words, marked)) if mark & 2])
    for sides, counts, told in ((("left", "number"), ending, _last_words), (("right",), beginning, _first_words)):
        for words, n in counts.items():
            for cue in told(" ".join(words).strip(" ")):
                for side in sides:
                    if cue in asked[side]:
                        out[side, cue][1] += n
    return out


def fitted_model(docs: DataFrame, names: DataFrame, text_col: str = "text") -> NameModel:
    """Potentials fitted on all documents.

    What comes to the driver are the MOST_CUES most frequent cues of each side with LEAST_PAIRS known pairs or more, and the words
    that stand ten times or more, nearly always in lower case.
    """
    parts = names.select("name_part", "kind").collect()
    given = {r.name_part.lower() for r in parts if r.kind == "given" and r.name_part}
    family = {r.name_part.lower() for r in parts if r.kind == "family" and r.name_part}
    spark = docs.sparkSession
    texts = docs.where(F.col(text_col).isNotNull()).select(text_col)

    def counted(counts: Callable[..., dict[tuple[str, str], list[int]]], *told) -> DataFrame:
        sent = spark.sparkContext.broadcast(told)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(side, w, a, b) for (side, w), (a, b) in counts(batch.column(0).to_pylist(), *sent.value).items()]
                cols = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["side", "cue", "hit", "n"])

        return texts.mapInArrow(run, "side string, cue string, hit long, n long").groupBy("side", "cue").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))

    word = F.col("side") == "word"
    first = common.written(counted(_hit_counts, given, family).where(~word & (F.col("hit") >= LEAST_PAIRS) | word & (F.col("hit") >= 10) & (F.col("hit") >= 19 * F.col("n"))), "cues")
    plain = {r.cue for r in first.where(word).select("cue").collect()}
    hits = {side: {r.cue: r.hit for r in first.where(F.col("side") == side).orderBy(F.desc("hit"), "cue").limit(MOST_CUES).collect()} for side in ("left", "right", "number")}
    weights: dict[str, dict[str, float]] = {side: {} for side in hits}
    if any(hits.values()):
        for r in counted(_place_counts, hits).collect():
            hit = min(hits[r.side][r.cue], r.n)
            # The shift makes a cue that is right one time in ten worthless.
            weight = max(0.0, min(3.5, math.log((hit + 0.5) / (r.n - hit + 0.5)) + 2.2))
            if weight > 0.2:
                weights[r.side][r.cue] = weight
    for t in TITLES:
        for form in (t, f"{t}."):
            weights["left"].setdefault(form, 2.0)
    return NameModel(given, family, weights["left"], weights["right"], weights["number"], plain - given - family)


def scan(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text", replace: bool = False) -> DataFrame:
    """(id, kind, found) once per document and finding, or with ``replace`` (id, text) with placeholders."""
    spark = docs.sparkSession
    model = fitted_model(docs, names, text_col)
    sent = spark.sparkContext.broadcast((model.given, model.family, model.left, model.right, model.numbers, model.plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NameModel(*sent.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if replace:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([replaced(t, findings(t, own)) for t in texts], pa.string())], names=[id_col, "text"])
                continue
            rows = [(i, k, f) for i, t in zip(ids, texts) for k, f in dict.fromkeys((k, f) for _, _, k, f in findings(t, own))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.column(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[id_col, "kind", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, text string" if replace else f"{id_col} {kind}, kind string, found string")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "name_parts"))


def p10_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "name_parts"), replace=True)
