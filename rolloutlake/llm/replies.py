"""Problem 1: unusable replies and their kind of defect.

Kinds, in the order in which they are tried: ``empty`` (null, blank, no letter or digit, or a stand-in for a missing
answer), ``refusal`` (refusal dictionaries of six languages, anchored at the start of the reply), ``copied`` (the
reply, compressed with its prompt as zstandard dictionary, shrinks to a small part of its size, and so does the prompt
with the reply as dictionary), ``language`` (function-word dictionaries and scripts), ``truncated`` (terminal-context
models). A record gets the first kind that applies.

Two terminal-context models are fitted on all replies. Worked solutions: for every place, a context (whether a boxed
result stands before it, and the sign it ends with; at most 16 of them) is counted as an end of a reply or as gone on
from; a solution that ends in a context where replies practically never end is truncated. Other replies: contexts are
the last word, the last two and three words and the shapes of the last four; the contexts in which some reply without
closing sign ends are counted exactly, over all replies, in a table that is joined to these replies. Such a reply is
truncated if the longest of its contexts with enough support practically never ends a sentence, if its last word stands
nowhere else but begins a word that does, if a delimiter is left open, or if it trails off.

Null prompts make ``copied`` and ``language`` impossible, nothing else. Whole texts are used. Repeated rows each get
their label; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloutlake.llm import common

# ---- dictionaries (fixed values) ----

#: Stand-ins for a missing answer, after brackets and outer signs are dropped.
STAND_INS = frozenset(["n/a", "na", "n.a", "null", "nil", "nan", "tbd", "todo", "no answer", "none given", "not given", "empty", "blank", "undefined", "missing", "no response", "not available", "unanswered"])

FUNCTION_WORDS = {
    "en": "the of and to is it that was with as at from for by an are this which what how when where why who does did while then before after between there into near be been has have had not its we you they them these those than more only once until because so or if but both each were will would could about over under",
    "de": "der die das und ist ein eine einen einem einer dem den des nicht mit auf bei von zu im als wird hat es war sich für wie wo zwischen neben während jemand etwas nur wir aus daraus folgt dass vor nach oft mal hinter dann zuerst sie zusammen man hört zweimal zum zur am um und durch oder ergibt erhalten beim",
    "es": "el la los las un una de que y en es se del al con por para como su lo más entre mientras alguien cerca dos veces cada después resultado qué cuántas cuál dónde sobre unos algo hay fue ha era donde tanto obtenemos primero tras desde hasta o",
    "fr": "le la les un une des du de et est que qui dans en sur au aux ce pas plus pour par avec on nous il elle où combien fois entre pendant enfin obtenons quel quelle quelques chose quelqu près côté dure son sa ses moment vers puis donc d l qu c a été",
}
_WORD_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY_FUNCTION = frozenset().union(*_WORD_SETS.values())

#: Words that cannot close a reply: articles, conjunctions, most prepositions and possessives.
NEVER_LAST = frozenset(
    "the a an and or but of to its with by because which that is was were are be been than about for from as at into while before after between until "
    "der die das ein eine einen einem einer den dem des und oder mit von zu zum zur auf bei im als dass weil während neben zwischen wie für durch um "
    "el la los las un una de del que y en con por para como su al lo mientras entre porque cuando "
    "le les une des du et ou qui dans sur au aux ce pour par avec où pendant entre car donc mais sa ses "
    "и в на с по для что как но или из от до".split()
)

_OPENERS = {
    "en": r"(?:(?:i'm|i am|we're|we are) (?:very |really |so |terribly )?sorry|sorry|unfortunately|regrettably|(?:i|we) apologi[sz]e|my apologies|as an? (?:ai|assistant|language model|ai assistant|ai language model)|i'm afraid|i am afraid)",
    "fr": r"(?:je suis (?:vraiment )?désolée?|désolée?|malheureusement|je regrette|je m'excuse|excusez-moi|navrée?)",
    "de": r"(?:(?:es )?tut mir (?:sehr )?leid|leider|entschuldigung|bedauerlicherweise|verzeihung|ich bedau?e?re)",
    "es": r"(?:lo (?:siento|lamento)(?: mucho)?|lamentablemente|desafortunadamente|por desgracia|disculpe?|perdón|perdona)",
    "ru": r"(?:извините|к сожалению|простите|мне (?:очень )?жаль|прошу прощения|сожалею)",
    "zh": r"(?:很抱歉|非常抱歉|抱歉|对不起|很遗憾|遗憾的是|不好意思)",
}
_CORES = {
    "en": r"(?:(?:i|we) (?:can't|cannot|can not|could not|couldn't|am unable|are unable|am not able|'m unable|'m not able|must decline|have to decline|must refuse|refuse|would rather not|'d rather not|won't|will not|do not have the ability|don't have the ability|do not have access|don't have access|am not allowed|am not permitted|do not feel comfortable|don't feel comfortable)\b|(?:i'm|we're) (?:unable|not able|not allowed|not permitted)\b|(?:this|that|it) is (?:something|not something) (?:that )?i\b|(?:this|that|it) falls outside\b|(?:no|an?) (?:reply|answer|response) (?:can|cannot|can't) be (?:given|provided)\b|(?:audio|video|image|sound) (?:input|files?|content) (?:is|are) not supported\b|my (?:guidelines|policy|policies|instructions|rules) (?:keep|prevent|do not|don't|forbid|stop)\b|you should (?:consult|ask|contact)\b.*\binstead\b)",
    "fr": r"(?:je ne (?:peux|pourrai|suis|dois|souhaite)\b|je dois (?:refuser|décliner)|je refuse|il m'est impossible|il ne m'est pas possible|cela m'est impossible|mes (?:règles|consignes))",
    "de": r"(?:(?:dabei |das |diese frage |darauf )?(?:kann|darf|möchte|muss|werde) ich\b|ich (?:kann|darf|möchte|muss|werde|bin nicht)\b|(?:es )?ist (?:es )?mir (?:leider )?nicht|das ist mir nicht|meine (?:richtlinien|vorgaben))",
    "es": r"(?:no (?:puedo|podré|me es posible|estoy|soy capaz|debo|tengo permitido)\b|me es imposible|debo (?:rechazar|declinar)|prefiero no|mis (?:normas|directrices))",
    "ru": r"(?:я )?(?:не (?:могу|имею|смогу|буду|в состоянии|способен)|вынужден|должен отказ|мои правила)",
    "zh": r"(?:但)?(?:我|这个我)?(?:无法|不能|没有办法|没办法|不便|不可以|拒绝)",
}
_LINK = r"[\s,.;:，。！!—-]*(?:but|however|yet|mais|cependant|aber|jedoch|doch|pero|sin embargo|но|但是?|不过)?[\s,，:]*"
_REFUSAL = re.compile("|".join(rf"(?:{_OPENERS[k]}{_LINK})?{_CORES[k]}" for k in _CORES if k not in ("de", "ru", "zh", "es")) + "|" + "|".join(rf"(?:{_OPENERS[k]}{_LINK}){_CORES[k]}" for k in ("de", "ru", "zh", "es")) + "|" + r"(?:ich (?:kann|darf) (?:dabei |das |diese frage |darauf |hier |leider )+nicht|no puedo (?:ayudar|responder|contestar)|я не могу (?:ответить|помочь)|我?(?:无法|不能)(?:回答|提供|帮助|处理))", re.I)

_LATEX = re.compile(r"\$[^$]*\$|\\\[.*?\\\]|\\[A-Za-z]+|[{}]", re.S)
_TOKEN = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*|\d+|[^\w\s]|_", re.U)
_HAN = re.compile(r"[一-鿿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_STOP = frozenset(".!?。！？")
_CLOSERS = "\"'”’)]}»」』*`"


def language_of(text: str) -> tuple[str | None, int]:
    """Language of a text by script or function words, with the number of hits it rests on; None if undecided."""
    plain = _LATEX.sub(" ", text)
    words = _LETTERS.findall(plain.lower())
    letters = sum(map(len, words))
    if not letters:
        return None, 0
    han, cyr = len(_HAN.findall(plain)), len(_CYRILLIC.findall(plain))
    if han >= 2 and han * 2 > letters:
        return "zh", han
    if cyr >= 3 and cyr * 2 > letters:
        return "ru", cyr
    hits = Counter()
    for w in words:
        for lang, known in _WORD_SETS.items():
            if w in known:
                hits[lang] += 1
    if not hits:
        return None, 0
    (best, n), *rest = hits.most_common(2)
    if n < 2 or (rest and rest[0][1] >= n) or n * 8 < len(words):
        return None, n
    return best, n


def is_empty(reply: str | None) -> bool:
    if reply is None or not _LETTERS.search(reply) and not any(c.isdigit() for c in reply):
        return True
    core = reply.strip().strip("[](){}<>*_-.…:;,'\"“”` ").lower()
    return core in STAND_INS


_NORMAL = re.compile(r"[^\W_]+")

#: A reply and its prompt are copies if each, with the other as dictionary, shrinks below this share of its size alone.
#: Fitted on labelled rows: copies reach 0.37 at most, other replies 0.84 at least.
COPY_RATIO = 0.6

_ZSTD = zstandard.ZstdCompressionParameters.from_level(3, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)


def _ratio(text: bytes, dictionary: bytes) -> float:
    """Size of ``text`` compressed with a dictionary over its size without; dictionaries of under eight bytes say nothing."""
    if len(dictionary) < 8:
        return 1.0
    given = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    alone = len(zstandard.ZstdCompressor(compression_params=_ZSTD).compress(text))
    return len(zstandard.ZstdCompressor(compression_params=_ZSTD, dict_data=given).compress(text)) / alone


def copies_prompt(prompt: str, reply: str) -> bool:
    """Whether the reply only repeats the prompt, wholly (letter case and signs aside) or nearly."""
    given, told = (" ".join(_NORMAL.findall(x.lower())).encode("utf-8", "surrogatepass") for x in (prompt, reply))
    if not given or not told:
        return False
    return given == told or (_ratio(told, given) < COPY_RATIO and _ratio(given, told) < COPY_RATIO)


# ---- terminal-context model ----

_BOS = "<s>"


def tokens(text: str) -> list[str]:
    out = []
    for t in _TOKEN.findall(text.lower()):
        if _HAN.match(t):
            out.extend(t)
        elif t.isdigit():
            out.append(f"<{min(len(t), 4)}>")
        else:
            out.append(t)
    return out


def _shape(t: str) -> str:
    if t in _ANY_FUNCTION or not t[0].isalpha() or _HAN.match(t):
        return t
    for end in ("ing", "ed", "ly", "s"):
        if t.endswith(end) and len(t) > len(end) + 2:
            return "*" + end
    return "*"


def _code(kind: str, *words: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {' '.join(words)}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _contexts(line: list[str], shapes: list[str], k: int) -> tuple[int, int, int, int]:
    """Codes of the contexts that end with token k: three words, four shapes, two words, one word."""
    at = lambda seq, j: seq[j] if j >= 0 else _BOS
    return (
        _code("3", at(line, k - 2), at(line, k - 1), line[k]),
        _code("4", at(shapes, k - 3), at(shapes, k - 2), at(shapes, k - 1), shapes[k]),
        _code("2", at(line, k - 1), line[k]),
        _code("1", line[k]),
    )


#: Replies shorter than this are phrases: a last word that stands nowhere else tells nothing there.
PHRASE = 4
SUPPORT = 12
RARE_END = 0.02


def last_contexts(text: str) -> list[int]:
    """Codes of a reply's last contexts, longest first, and of its last word as the beginning of another (0 where that is not asked)."""
    line = _core(text)
    k = len(line) - 1
    begun = _code("p", line[k]) if len(line) >= PHRASE and line[k][0].isalpha() and not _HAN.match(line[k]) else 0
    return [*_contexts(line, [_shape(t) for t in line], k), begun]


def _core(text: str) -> list[str]:
    line = tokens(text)
    while line and line[-1] in _CLOSERS:
        line.pop()
    return line


def count_contexts(texts: list[str | None], asked: frozenset[int] | None = None) -> dict[int, list[int]]:
    """Context code to (gone on from, ended at) over all replies; of the ``asked`` contexts only, if these are given."""
    out: dict[int, list[int]] = {}
    words: Counter = Counter()

    def add(codes, side: int) -> None:
        for c in codes:
            if asked is None or c in asked:
                cell = out.get(c)
                if cell is None:
                    cell = out[c] = [0, 0]
                cell[side] += 1

    for text in texts:
        if not text:
            continue
        line = tokens(text)
        shapes = [_shape(t) for t in line]
        for k in range(len(line) - 1):
            if line[k] not in _STOP:
                add(_contexts(line, shapes, k), int(line[k + 1] in _STOP))
                words[line[k]] += 1
        if line and line[-1] not in _STOP and line[-1] not in NEVER_LAST:
            add(_contexts(line, shapes, len(line) - 1)[:3], 1)  # a word cut in half stays unknown
    for w, n in words.items():
        if w[0].isalpha():
            for end in range(1, len(w)):
                code = _code("p", w[:end])
                if asked is None or code in asked:
                    out.setdefault(code, [0, 0])[0] += n
    return out


def ends_broken(counts: list[tuple[int, int]]) -> bool:
    """Whether a reply breaks off, from (gone on, ended) of its last contexts in the order of ``last_contexts``."""
    if sum(counts[3]) == 0 and sum(counts[4]) > 0:
        return True
    for on, end in counts[:4]:
        if on + end >= SUPPORT:
            return end < RARE_END * (on + end)
    return False


_BOXED = re.compile(r"\\boxed\s*\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}")
_DANGLING = re.compile(r"(?:\.\.\.|…|[,;:(\[{“«=+*/\\&]|\s[-–—])$")


#: A worked solution's place is a context; fewer than this share of replies that come to it end there: broken off.
WORKED_END = 0.1


def _sign_class(sign: str) -> str:
    return "stop" if sign in _STOP else "word" if sign.isalpha() else "digit" if sign.isdigit() else "sign"


def worked_context(text: str) -> str:
    """Context of a worked solution's end: whether a boxed result stands in it, and its last sign's kind."""
    text = text.rstrip()
    return f"{'boxed' if _BOXED.search(text) else 'open'} {_sign_class(text[-1])}"


def count_worked(texts: list[str | None]) -> Counter:
    """(context, ended) to number, over all places of all worked solutions."""
    out: Counter = Counter()
    for text in texts:
        text = (text or "").rstrip()
        if not text:
            continue
        boxed = _BOXED.search(text)
        done = boxed.end() if boxed else len(text) + 1
        for m in _TOKEN.finditer(text, 0, len(text)):
            if m.end() < len(text):
                out[f"{'boxed' if m.end() >= done else 'open'} {_sign_class(m.group()[-1])}", False] += 1
        out[worked_context(text), True] += 1
    return out


def rare_ends(counts: dict[tuple[str, bool], int]) -> frozenset[str]:
    """Contexts where worked solutions practically never end."""
    contexts = {c for c, _ in counts}
    return frozenset(c for c in contexts if counts.get((c, True), 0) < WORKED_END * (counts.get((c, True), 0) + counts.get((c, False), 0)))


def defect(prompt: str | None, reply: str | None, worked: bool, rare: frozenset[str]) -> str | None:
    """Kind of defect; ``?`` where the contexts of the reply's end have to be looked up; None for a sound reply."""
    if is_empty(reply):
        return "empty"
    head = reply.strip().lstrip(_CLOSERS + "“‘>*-").strip().replace("’", "'")
    if _REFUSAL.match(head):
        return "refusal"
    solved = worked and _BOXED.search(reply) is not None
    if prompt and not solved and copies_prompt(prompt, reply):
        return "copied"
    if prompt:
        told, _ = language_of(reply)
        if told:
            asked, _ = language_of(prompt)
            if asked and asked != told:
                return "language"
    text = reply.rstrip()
    if worked:
        return "truncated" if worked_context(text) in rare else None
    if _DANGLING.search(text):
        return "truncated"
    bare = text.rstrip(_CLOSERS)
    if bare and bare[-1] in _STOP:
        return None
    if text.count("(") > text.count(")") or text.count("[") > text.count("]") or text.count("“") > text.count("”") or text.count("$") % 2:
        return "truncated"
    line = _core(text)
    return None if not line else "truncated" if line[-1] in NEVER_LAST else "?"


#: Up to this number the asked contexts are sent to the tasks that count (16 MB), so that only these are shuffled.
SENT = 1_000_000


def label_replies(rows: DataFrame) -> DataFrame:
    """(row_id, defect) of the broken rows; ``rows`` has row_id, prompt, reply and worked (a worked solution)."""
    rows = rows.select("row_id", "prompt", "reply", "worked")
    spark = rows.sparkSession

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            total.update(count_worked(b["reply"].tolist()))
        yield pd.DataFrame([(c, e, n) for (c, e), n in total.items()], columns=["context", "ended", "n"])

    worked = rows.where("worked").select("reply").mapInPandas(places, "context string, ended boolean, n long")
    rare = rare_ends({(r.context, r.ended): r.n for r in worked.groupBy("context", "ended").agg(F.sum("n").alias("n")).collect()})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, prompts, told, is_worked = (c.to_pylist() for c in b.columns)
            kinds = [defect(p, r, w, rare) for p, r, w in zip(prompts, told, is_worked)]
            hit = [k for k, kind in enumerate(kinds) if kind]
            contexts = [last_contexts(told[k]) if kinds[k] == "?" else None for k in hit]
            columns = [pa.array([ids[k] for k in hit], pa.int64()), pa.array([kinds[k] for k in hit], pa.string()), pa.array(contexts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "defect", "contexts"])

    firsts = common.written(rows.mapInArrow(first, "row_id long, defect string, contexts array<long>"), "firsts")
    # A row id may come more than once: open ends are looked up by their contexts, not by row.
    open_ends = firsts.where("defect = '?'").select("contexts").distinct()
    asked = common.written(open_ends.select(F.explode("contexts").alias("context")).distinct(), "asked")
    few = frozenset(r.context for r in asked.collect()) if asked.count() <= SENT else None
    sent = spark.sparkContext.broadcast(few)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = count_contexts(b["reply"].tolist(), sent.value)
            yield pd.DataFrame({"context": list(cells), "went_on": [x for x, _ in cells.values()], "ended": [y for _, y in cells.values()]}, dtype="int64")

    counted = rows.where("NOT worked").select("reply").mapInPandas(count, "context long, went_on long, ended long")
    if few is None:
        counted = counted.join(asked, "context", "left_semi")
    counts = counted.groupBy("context").agg(F.sum("went_on").alias("went_on"), F.sum("ended").alias("ended"))
    looked = open_ends.select("contexts", F.posexplode("contexts").alias("k", "context")).join(counts, "context", "left")
    cell = F.struct("k", F.coalesce("went_on", F.lit(0)).alias("went_on"), F.coalesce("ended", F.lit(0)).alias("ended"))
    cells = looked.groupBy("contexts").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    n = lambda i: F.col("cells")[i]["went_on"] + F.col("cells")[i]["ended"]
    broken = F.when((n(3) == 0) & (n(4) > 0), True)
    for i in range(4):
        broken = broken.when(n(i) >= SUPPORT, F.col("cells")[i]["ended"] < F.lit(RARE_END) * n(i))
    cut = firsts.where("defect = '?'").join(cells.where(broken.otherwise(False)).select("contexts"), "contexts", "left_semi").select("row_id", F.lit("truncated").alias("defect"))
    return firsts.where("defect <> '?'").select("row_id", "defect").unionByName(cut)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "sanity").select("row_id", "prompt", F.col("answer").alias("reply"), F.lit(False).alias("worked")).unionByName(
        common.table(spark, sf_dir, "math_l1_ttt").select("row_id", "prompt", F.col("solution").alias("reply"), F.lit(True).alias("worked"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_replies(replies(spark, sf_dir))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per kind of reply and defect; sound rows have defect null."""
    rows = replies(spark, sf_dir)
    found = label_replies(rows)
    return rows.select("row_id", "worked").join(found, "row_id", "left").groupBy("worked", "defect").agg(F.count("*").alias("n_rows"))
