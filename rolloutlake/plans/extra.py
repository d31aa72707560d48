"""Queries of batch checks, collation, equivalence votes, grading, search results and guarded scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloutlake.functions import math_answers as ma
from rolloutlake.functions import search as se
from rolloutlake.operators import batches as ba
from rolloutlake.operators import builders as bd
from rolloutlake.operators import frame, guarded
from rolloutlake.operators import losses as ls
from rolloutlake.operators import messages as ms
from rolloutlake.operators import scoring as sc
from rolloutlake.operators import votes as vt
from rolloutlake.plans.tokens_plan import TOK, token_rows
from rolloutlake.sources import readers as rd
from rolloutlake.sources import sinks as sk
from rolloutlake.sources.shared import shared_path

C = F.col


def t(name):
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet")


train, sanity, math1, events, amc = t("train_sanity"), t("sanity"), t("math_l1_ttt"), t("events"), t("amc_ttt")


def _case(column, *values):
    """values[column % n], as strings."""
    k = column % len(values)
    out = F.when(k == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        out = out.when(k == i, F.lit(v))
    return out.cast("string")


def _sql_case(column: str, *values) -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


#: (given, truth, equal): graded pairs, told by hand.
GRADED = (
    ("\\frac{1}{2}", "0.5", True), ("1/2", "2/4", False), ("50\\%", "50", True), ("50%", "50", False), ("ab = 5", "5", False), ("x=5", "5", True),
    ("2x+1", "1 + 2x", True), ("\\sqrt{8}", "2\\sqrt{2}", True), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt2}{2}", True), ("(1, 2)", "(1,2.0)", True), ("(1,2]", "(1,2)", False),
    ("\\{1,2\\}", "\\{2,1\\}", True), ("2\\pi", "\\pi \\cdot 2", True), ("(x+1)^2", "x^2+2x+1", True), ("\\sin x", "x", False), ("1,000", "1000", True), (None, "1", False),
    ("\\begin{pmatrix} 1 & 2 \\\\ 3 & 4 \\end{pmatrix}", "\\begin{pmatrix}1&2.0\\\\3&4\\end{pmatrix}", True), ("7", "8", False),
)

#: (text, found, answer): replies with an answer in prose, told by hand.
PROSE = (
    ("First we add. So the answer is: 42", True, "42"), ("Then $x = 7$ is the answer", True, "7$"), ("we get \\boxed{12}", True, "12"), ("No number stands here, the answer is blue", False, "blue"),
    ("There are 3. The total is 15 apples", True, "3"), ("Adding, the sum must be 9", True, "9"), (None, False, None),
)

#: (text, plain): signs, bases and pi, told by hand.
PLAIN = (("$5.5", "5.5"), ("12%", "12"), ("12\\%", "12"), ("101_2", "101"), ("1.0_7", "1"), ("ab_2", None), ("2\\pi", "6.283185307179586"), ("x\\pi", "x\\pi"), ("7", "7"), (None, None))

#: (text, normal form), told by hand.
NORMAL = (
    ("\\dfrac12\\text{ cm}", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), ("03/4", "03/4"), (".5", "\\frac{1}{2}"), ("k = \\sqrt3", "\\sqrt{3}"), ("ab = 5", "ab=5"), ("50%", "50%"), ("50\\%", "50"),
    ("\\frac{72}1", "\\frac{72}1"), ("\\frac1{72}", "\\frac{1}{72}"), ("90^\\circ", "90"), ("\\$12", "12"), ("2\\text{ a}\\text{ b}", "2\\text{ a}\\text{ b}"), ("", ""), (None, None),
)


def _golden(source, key, udf, pairs, fields=("x",)):
    """A function over every row of a table whose value is one of the given texts."""

    def run(s, d):
        rows = source(s, d).select(key, *[_case(C(key), *[p[k] for p in pairs]).alias(f"i{k}") for k in range(len(pairs[0]) - len(fields))])
        out = udf(*[C(f"i{k}") for k in range(len(pairs[0]) - len(fields))])
        return rows.select(key, out.alias("x")) if fields == ("x",) else rows.select(key, out.alias("o")).select(key, *[C("o")[f].alias(f) for f in fields])

    return run


def _golden_sql(table, key, pairs, kinds):
    """The values that belong to these texts."""
    shown = [[None if p[k] is None else str(p[k]).lower() if isinstance(p[k], bool) else p[k] for p in pairs] for k in range(len(pairs[0]))]
    tail = shown[-len(kinds) :]
    return f"SELECT {key}, " + ", ".join(f"CAST({_sql_case(key, *values)} AS {kind}) AS {name}" for values, (name, kind) in zip(tail, kinds.items())) + f" FROM {table}"


def _same_number(a: str, b: str) -> bool:
    return ma.rational(a) == ma.rational(b)


def _equivalence(s, d):
    rows = events(s, d).select("user_id", "event_id", F.concat(_case(C("event_id"), "", "0", "", "0"), (C("event_id") % 3).cast("string"), _case(C("event_id"), "", ".0", ".00", "/1", "")).alias("answer"))
    found = vt.equivalence_votes(rows, "user_id", "event_id", "answer", _same_number)
    return found.select("user_id", "representative", "votes")


EQUIVALENCE = f"""WITH a AS (SELECT user_id, event_id, event_id % 3 AS v, concat({_sql_case('event_id', '', '0', '', '0')}, CAST(event_id % 3 AS VARCHAR), {_sql_case('event_id', '', '.0', '.00', '/1', '')}) AS answer FROM events)
  SELECT user_id, arg_min(answer, event_id) AS representative, count(*) AS votes FROM a GROUP BY user_id, v"""


def _inconsistent(s, d):
    rows = frame.with_row_index(events(s, d).select("event_id"), "event_id").select("row_idx", F.array("event_id", "event_id").alias("a"), F.when(C("event_id") % 7 == 0, F.array("event_id")).otherwise(F.array("event_id", "event_id")).alias("b"))
    return ba.inconsistencies(rows, ["a", "b"])


def _chunks(s, d):
    rows, _ = ba.padded_chunks(frame.with_row_index(events(s, d).select("event_id"), "event_id"), 7)
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


CHUNKS = """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events),
  p AS (SELECT event_id, i, n FROM e UNION ALL SELECT event_id, i + n, n FROM e WHERE i < (7 - n % 7) % 7)
  SELECT CAST(i // ((n + (7 - n % 7) % 7) // 7) AS INT) AS chunk, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM p GROUP BY 1"""


def _collated(s, d):
    out = ba.collate(events(s, d), "user_id", "event_id", "event_type", "value")
    return out.select("user_id", "n_items", F.array_join("event_type", ",").alias("types"), F.round(C("value")[0], 4).alias("first"))


def _masks(s, d):
    mask = ba.random_mask(C("event_id"), 50, 0.8, 0.5, 0.1)
    rows = events(s, d).select("event_id", F.array_join(F.transform(mask, lambda x: x.cast("string")), "").alias("m"))
    return rows.select("event_id", F.length("m").alias("n"), C("m").rlike("^0{0,25}1{5,40}0*$").alias("ok"))


def _pieces(s, d):
    whole = F.array(*[C("event_id") + i for i in range(4)])
    pieces = F.array(F.array("event_id", C("event_id") + 1), F.array(C("event_id") + 2, C("event_id") + F.when(C("event_id") % 3 == 0, 4).otherwise(3)))
    return events(s, d).select("event_id", *ba.piecewise_tokens(whole, pieces)).select("event_id", "same", C("tokens")[3].alias("last"))


def _search(s, d):
    part = F.concat(F.lit("{'query': 'q"), C("event_id").cast("string"), F.lit("', 'results': [{'title': 'a'}, {'title': 'b'}]}"))
    return events(s, d).select("event_id", se.tool_result(F.array(part, F.lit("no result"))).alias("r")).select("event_id", "r.text", F.array_join("r.queries", ",").alias("queries"), "r.query_count", "r.total_results", "r.status")


SEARCH = """SELECT event_id, '[{"title": "a"}, {"title": "b"}]' AS text, 'q' || event_id || ',' AS queries, 2 AS query_count, 2 AS total_results, 'success' AS status FROM events"""


def _status(s, d):
    k = C("event_id") % 4
    docs = F.array(F.concat(F.lit("T"), C("event_id").cast("string"), F.lit("\nline one\nline two")), F.lit("only a title"))
    none = F.lit(None).cast("array<array<string>>")
    got = F.when(k == 0, F.array(docs, F.slice(docs, 2, 1))).when(k == 1, F.array().cast("array<array<string>>")).otherwise(none)
    return events(s, d).select("event_id", se.search_status(F.when(k == 2, F.lit("refused")), got).alias("r")).select("event_id", "r.*")


STATUS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'no_results' WHEN 2 THEN 'api_error' ELSE 'unknown_api_state' END AS status, CASE event_id % 4 WHEN 0 THEN 3 ELSE 0 END AS total_results,
  CASE event_id % 4 WHEN 0 THEN 'Doc 1 (Title: T' || event_id || ')' || chr(10) || 'line one' || chr(10) || 'line two' || chr(10) || chr(10) || 'Doc 2 (Title: only a title)' || chr(10) || '---' || chr(10) || 'Doc 1 (Title: only a title)' END AS formatted FROM events"""


def _half(value: float, k: int) -> float:
    if k % 5 == 0:
        raise ValueError("no score")
    return (value / 2, "and a note") if k % 5 == 1 else value / 2


def _judge(text: str) -> str | None:
    if text == "click":
        raise ConnectionError("gone")
    return f"[[{len(text)}]]"


def _managed(s, d):
    rows = math1(s, d).select("row_id", F.concat(F.lit("x \\boxed{"), F.coalesce("answer", F.lit("")), F.lit("}")).alias("sol"), F.coalesce("answer", F.lit("")).alias("truth"), (C("row_id") % 4 + 1).cast("int").alias("len"))
    out = guarded.load_manager("naive", "character_count")(rows, "sol", "truth", "len", 4)
    return out.select("row_id", F.array_join(F.transform("rewards", lambda x: x.cast("int").cast("string")), "").alias("x"))


def _scored(name, solutions, truth):
    """A registered scorer over every event; the solutions are told by the event's number."""

    def run(s, d):
        rows = events(s, d).select("event_id", _case(C("event_id"), *solutions).alias("sol"), F.lit(truth).alias("truth"))
        return rows.select("event_id", F.round(sc.SCORERS.get(name)(C("sol"), C("truth")), 6).alias("x"))

    return run


def _scores_sql(*values: float) -> str:
    return "SELECT event_id, CAST(CASE event_id % " + str(len(values)) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END AS DOUBLE) AS x FROM events"


def _broken(s, d):
    """Two objects a fragment, fragments one after the other without commas, some of them cut: the first object of each counts."""
    path = shared_path(s, "broken")
    k = C("event_id").cast("string")
    whole = F.concat(F.lit('[{"id": '), k, F.lit(', "v": "a"}, {"id": -1}]'))
    events(s, d).select(F.when(C("event_id") % 5 == 0, F.concat(F.lit('[{"id": '), k, F.lit(', "v"]'))).otherwise(whole)).write.text(path)
    return rd.broken_json(s, path, "id BIGINT, v STRING")


def _splits_written(s, d):
    path = shared_path(s, "splits")
    sk.parquet_splits(events(s, d).select("event_id", "value", C("event_type").alias("split")), path)
    return s.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _report(s, d):
    path = shared_path(s, "report")
    sk.report_csv(events(s, d).groupBy("event_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n")), path, 3)
    return s.read.option("header", "true").csv(path).select("event_type", C("mean").cast("double").alias("mean"), C("n").cast("long").alias("n"))


def _summary(s, d):
    told = sk.summary_json(events(s, d).groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")
    return told.select(F.from_json("json", "n BIGINT, mean DOUBLE, by_key MAP<STRING, BIGINT>").alias("j")).select(C("j.n").alias("kinds"), F.round("j.mean", 4).alias("mean"), F.explode("j.by_key").alias("event_type", "n"))


def _changes(s, d):
    paths = events(s, d).select(F.concat(F.lit("/x/"), C("event_id").cast("string")).alias("path"), "event_id")
    return rd.listing_changes(paths.where("event_id % 3 <> 0").select("path"), paths.where("event_id % 5 <> 0").select("path"))


def _total(c):
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)


def _conversations(s, d):
    rows = events(s, d).select("user_id", "event_id", F.when(C("event_type") == "view", "assistant").otherwise("user").alias("role"), F.sequence(F.lit(1).cast("long"), C("event_id") % 4 + 1).alias("tok"))
    out = ms.padded_conversations(rows, "user_id", "event_id", "role", "tok", 100)
    return out.select("user_id", "n_tokens", F.size("input_ids").alias("width"), _total("input_ids").alias("ids"), _total("attention_mask").alias("seen"), _total("loss_mask").alias("on_tokens"))


CONVERSATIONS = """WITH t AS (SELECT user_id, event_id, event_type, unnest(range(1, event_id % 4 + 2)) AS id FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id, id) AS k FROM t)
  SELECT user_id, CAST(count(*) AS INT) AS n_tokens, 100 AS width, CAST(sum(id) FILTER (k <= 100) AS BIGINT) AS ids, count(*) FILTER (k <= 100) AS seen, count(*) FILTER (k <= 100 AND event_type = 'view') AS on_tokens FROM n GROUP BY 1"""


def _preference(s, d):
    make = lambda n: F.sequence(F.lit(1).cast("long"), n)
    packed = ms.preference_pack(F.array(C("event_id")), make(C("event_id") % 3 + 1), make(C("event_id") % 5 + 1), -1)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return events(s, d).select("event_id", *packed).select("event_id", text("chosen_ids").alias("chosen"), text("rejected_ids").alias("rejected"), text("chosen_mask").alias("mask"))


PREFERENCE = """WITH n AS (SELECT event_id, event_id % 3 + 2 AS a, event_id % 5 + 2 AS b FROM events), w AS (SELECT *, greatest(a, b) AS w FROM n)
  SELECT event_id, event_id || ',' || array_to_string(list_transform(range(1, w), lambda i: CASE WHEN i < a THEN i ELSE -1 END), ',') AS chosen, event_id || ',' || array_to_string(list_transform(range(1, w), lambda i: CASE WHEN i < b THEN i ELSE -1 END), ',') AS rejected,
    array_to_string(list_transform(range(0, w), lambda i: CASE WHEN i < a THEN 1 ELSE 0 END), ',') AS mask FROM w"""

_LONG = "y" * 400

CATALOG = {
    "frame_inconsistencies": (
        _inconsistent,
        "SELECT 'b' AS column, CAST(min(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 END) AS BIGINT) AS least, CAST(2 AS BIGINT) AS most, count(*) AS rows, CAST(0 AS BIGINT) AS missing FROM events HAVING min(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 END) < 2",
    ),
    "frame_padded_chunks": (_chunks, CHUNKS),
    "frame_collate": (_collated, "SELECT user_id, count(*) AS n_items, string_agg(event_type, ',' ORDER BY event_id) AS types, round(arg_min(value, event_id), 4) AS first FROM events GROUP BY 1"),
    "frame_random_masks": (_masks, "SELECT event_id, 50 AS n, true AS ok FROM events"),
    "tok_piecewise": (_pieces, "SELECT event_id, event_id % 3 <> 0 AS same, event_id + CASE WHEN event_id % 3 = 0 THEN 4 ELSE 3 END AS last FROM events"),
    "vote_equivalence": (_equivalence, EQUIVALENCE),
    "math_grade": (_golden(events, "event_id", ma.grade_udf, GRADED), _golden_sql("events", "event_id", GRADED, {"x": "BOOLEAN"})),
    "math_located_answer": (_golden(events, "event_id", ma.located_answer_udf, PROSE, ("found", "answer")), _golden_sql("events", "event_id", PROSE, {"found": "BOOLEAN", "answer": "VARCHAR"})),
    "math_plain_number": (_golden(events, "event_id", ma.plain_number_udf, PLAIN), _golden_sql("events", "event_id", PLAIN, {"x": "VARCHAR"})),
    "math_normal_forms": (_golden(events, "event_id", ma.normal_math_udf, NORMAL), _golden_sql("events", "event_id", NORMAL, {"x": "VARCHAR"})),
    "loss_clip_cov": (
        lambda s, d: ls.clip_cov_tokens(token_rows(s, d).withColumn("key", F.concat_ws("-", "seq", "pos")), "key", "new", "adv", "m", 0.001, 0.01, 0.02).select("seq", "pos"),
        f"""WITH u AS (SELECT * FROM {TOK} WHERE m = 1), c AS (SELECT seq, pos, round((adv - (SELECT avg(adv) FROM u)) * (new - (SELECT avg(new) FROM u)), 9) AS cov FROM u)
            SELECT seq, CAST(pos AS INT) AS pos FROM c WHERE cov > 0.001 AND cov < 0.01 QUALIFY row_number() OVER (ORDER BY CAST('0x' || substr(md5('0:' || seq || '-' || pos), 1, 13) AS BIGINT), seq || '-' || pos) <= greatest(1, floor((SELECT count(*) FROM u) * 0.02))""",
    ),
    "search_tool_result": (_search, SEARCH),
    "search_status": (_status, STATUS),
    "score_guarded": (
        lambda s, d: guarded.guarded_scores(events(s, d), "event_id", ["value", "event_id"], _half).select("event_id", "score", C("error").isNotNull().alias("failed")),
        "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value / 2 END AS score, event_id % 5 = 0 AS failed FROM events",
    ),
    "judge_pool": (
        lambda s, d: guarded.judged(events(s, d), "event_id", ["event_type"], _judge, retries=1, wait=0.0),
        "SELECT event_id, CASE WHEN event_type <> 'click' THEN '[[' || length(event_type) || ']]' END AS reply, CASE WHEN event_type = 'click' THEN 'ConnectionError: gone' END AS error FROM events",
    ),
    "reward_managed": (_managed, "SELECT row_id, repeat('0', CAST(row_id % 4 AS INT)) || '1' || repeat('0', CAST(3 - row_id % 4 AS INT)) AS x FROM math_l1_ttt"),
    "score_final_answer": (_scored("final_answer", ["So Answer: 12", "Answer: 13", "no line", "Answer: 12" + _LONG, "Answer: $12$\nAnswer: 12 "], "12"), _scores_sql(1, -1, -1, -1, 1)),
    "score_strict_box": (_scored("strict_box", ["it is \\boxed{12}", "\\boxed{12} " + _LONG, "\\boxed{1} or \\boxed{12}", "12"], "12"), _scores_sql(1, -1, 1, -1)),
    "score_geometry": (_scored("geometry", ["<think> a </think> \\boxed{12}", "\\boxed{12}", "<think> a </think> \\boxed{13}", "12"], "12"), _scores_sql(1.0, 0.9, 0.1, 0.0)),
    "score_characters": (_scored("character_count", ["\\boxed{3}", "\\boxed{4}", "3", "\\boxed{\\text{3}}"], "3"), _scores_sql(1, 0, 0, 0)),
    "msg_padded_conversations": (_conversations, CONVERSATIONS),
    "tok_preference_pack": (_preference, PREFERENCE),
    "read_broken_json": (_broken, "SELECT event_id AS id, 'a' AS v FROM events WHERE event_id % 5 <> 0"),
    "read_listing_changes": (_changes, "SELECT '/x/' || event_id AS path, CASE WHEN event_id % 3 = 0 THEN 'added' ELSE 'removed' END AS change FROM events WHERE (event_id % 3 = 0) <> (event_id % 5 = 0)"),
    "sink_parquet_splits": (_splits_written, "SELECT event_type AS split, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1"),
    "sink_report_csv": (_report, "SELECT event_type, round(avg(value), 3) AS mean, count(*) AS n FROM events GROUP BY 1"),
    "sink_summary_json": (_summary, "WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT (SELECT count(*) FROM g) AS kinds, (SELECT round(avg(n), 4) FROM g) AS mean, event_type, n FROM g"),
    "build_tagged_transcripts": (
        lambda s, d: events(s, d).select("event_id", ma.transcript_udf(F.concat(F.lit("Let me see <code>print("), C("event_id").cast("string"), F.lit(")</code><interpreter>"), C("event_id").cast("string"), F.lit("</interpreter> so <answer>done</answer>"))).alias("m")).select("event_id", F.array_join(C("m.role"), ",").alias("roles"), F.array_join(C("m.content"), "|").alias("contents")),
        "SELECT event_id, 'assistant,assistant,tool,assistant,assistant' AS roles, 'Let me see|print(' || event_id || ')|' || event_id || '|so|done' AS contents FROM events",
    ),
    "build_media_rows": (
        lambda s, d: bd.media_rows(train(s, d), "question", "answer", "Think first.", videos=["video_file"], audios=["audio_file"]).select(C("prompt")[0]["content"].alias("content"), F.array_join("videos", ",").alias("videos"), F.array_join("audios", ",").alias("audios"), C("reward_model.ground_truth").alias("truth")),
        "SELECT CASE WHEN length(trim(coalesce(video_file, ''))) > 0 THEN '<video>' ELSE '' END || CASE WHEN length(trim(coalesce(audio_file, ''))) > 0 THEN '<audio>' ELSE '' END || question || ' Think first.' AS content, CASE WHEN length(trim(coalesce(video_file, ''))) > 0 THEN video_file ELSE '' END AS videos, CASE WHEN length(trim(coalesce(audio_file, ''))) > 0 THEN audio_file ELSE '' END AS audios, answer AS truth FROM train_sanity",
    ),
    "build_tool_rows": (
        lambda s, d: bd.tool_rows(events(s, d).select("event_id", F.concat(F.lit("12 + 1 = "), C("event_id").cast("string"), F.lit("\n#### 1,"), (C("event_id") % 900 + 100).cast("string")).alias("solution"), F.lit("q").alias("question")), "question", "solution", "calc").select(C("extra_info.answer").alias("raw"), C("reward_model.ground_truth").alias("truth"), C("extra_info.need_tools_kwargs").alias("need"), C("extra_info.tools_kwargs.tool").alias("tool"), C("extra_info.tools_kwargs.create_kwargs.ground_truth").alias("given")),
        "SELECT '12 + 1 = ' || event_id || chr(10) || '#### 1,' || (event_id % 900 + 100) AS raw, '1' || (event_id % 900 + 100) AS truth, true AS need, 'calc' AS tool, '1' || (event_id % 900 + 100) AS given FROM events",
    ),
}
