"""Text function queries over the record tables and the documents, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloutlake.functions import text as tx

C = F.col


def t(name):
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet")


train, sanity, math1, docs, events, amc = t("train_sanity"), t("sanity"), t("math_l1_ttt"), t("documents"), t("events"), t("amc_ttt")


def q(table, key, **columns):
    return lambda s, d: table(s, d).select(key, *[c().alias(n) for n, c in columns.items()])


def lit_sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SOL = "concat('Step ', row_id, ' gives #### ', CAST(row_id % 9999 AS VARCHAR), ',000 then #### -', CAST(row_id % 77 AS VARCHAR))"
def solc():
    return F.concat(F.lit("Step "), C("row_id").cast("string"), F.lit(" gives #### "), (C("row_id") % 9999).cast("string"), F.lit(",000 then #### -"), (C("row_id") % 77).cast("string"))


BOX = "list_extract(regexp_extract_all(solution, '\\\\boxed\\{([^{}]*)\\}', 1), -1)"


def _minerva_sql(x: str) -> str:
    x = f"list_extract(string_split({x}, '='), -1)"
    for old, new in tx.SUBSTITUTIONS:
        x = f"replace({x}, {lit_sql(old)}, {lit_sql(new)})"
    for old in tx.REMOVED:
        x = f"replace({x}, {lit_sql(old)}, '')"
    x = f"regexp_replace({x}, '(.*?)\\$(.*?)\\$(.*)', '$\\2$', 'g')"
    for name in ("text", "textbf", "overline"):
        x = f"regexp_replace({x}, '\\\\{name}\\{{(.*?)\\}}', '\\1', 'g')"
    x = f"regexp_replace({x}, '\\\\boxed\\{{(.*)\\}}', '\\1', 'g')"
    x = f"regexp_replace({x}, 'frac([^{{])(.)', 'frac{{\\1}}{{\\2}}', 'g')"
    x = f"regexp_replace({x}, 'sqrt([^{{])', 'sqrt{{\\1}}', 'g')"
    return f"replace({x}, '$', '')"




def qa(column: str) -> str:
    return "trim(regexp_replace(regexp_replace(translate(lower(" + column + "), " + lit_sql(tx.PUNCTUATION) + ", ''), '\\b(a|an|the)\\b', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\p{Z}\\x{85}]+', ' ', 'g'))"
WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{Nd}}_]+')"
STOP = "[" + ", ".join(lit_sql(w) for w in tx.STOP_WORDS) + "]"
STRIP = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"

CATALOG = {
    "text_hash_answer": (q(math1, "row_id", x=lambda: tx.hash_answer(solc())), f"SELECT row_id, replace(replace(list_extract(regexp_extract_all({SOL}, '#### (-?[0-9.,]+)', 1), -1), ',', ''), '$', '') AS x FROM math_l1_ttt"),
    "text_flexible_answer": (q(math1, "row_id", x=lambda: tx.flexible_answer(C("solution"))), "SELECT row_id, list_extract(list_filter(regexp_extract_all(solution, '(-?[0-9.,]+)', 1), lambda x: x <> '' AND x <> '.'), -1) AS x FROM math_l1_ttt"),
    "text_first_hash_answer": (q(math1, "row_id", x=lambda: tx.first_hash_answer(solc())), f"SELECT row_id, replace(regexp_extract({SOL}, '#### (-?[0-9.,]+)', 1), ',', '') AS x FROM math_l1_ttt"),
    "score_hash_answer": (
        q(math1, "row_id", x=lambda: tx.match_score(tx.hash_answer(solc()), F.concat(F.lit("-"), (C("row_id") % 70).cast("string")), 0.1)),
        f"SELECT row_id, CASE WHEN replace(list_extract(regexp_extract_all({SOL}, '#### (-?[0-9.,]+)', 1), -1), ',', '') = '-' || (row_id % 70) THEN 1.0 ELSE 0.1 END AS x FROM math_l1_ttt",
    ),
    "text_boxed": (q(math1, "row_id", x=lambda: tx.flat_boxed(C("solution"))), f"SELECT row_id, {BOX} AS x FROM math_l1_ttt"),
    "text_remove_boxed": (
        q(math1, "row_id", x=lambda: tx.remove_boxed(F.regexp_extract("solution", r"\\boxed\{[^{}]*\}", 0))),
        "SELECT row_id, CASE WHEN regexp_matches(solution, '\\\\boxed\\{[^{}]*\\}') THEN regexp_extract(solution, '\\\\boxed\\{([^{}]*)\\}', 1) END AS x FROM math_l1_ttt",
    ),
    "score_boxed_answer": (q(math1, "row_id", x=lambda: tx.match_score(tx.flat_boxed(C("solution")), C("answer"))), f"SELECT row_id, CASE WHEN {BOX} = answer THEN 1.0 ELSE 0.0 END AS x FROM math_l1_ttt"),
    "text_slash_fraction": (q(events, "event_id", x=lambda: tx.slash_fraction(F.concat(C("user_id").cast("string"), F.lit("/"), C("event_id").cast("string")))), "SELECT event_id, '\\frac{' || user_id || '}{' || event_id || '}' AS x FROM events"),
    "text_braced_sqrt": (q(events, "event_id", x=lambda: tx.braced_sqrt(F.concat(F.lit("\\sqrt"), C("user_id").cast("string"), F.lit(" + \\sqrt{2}")))), "SELECT event_id, '\\sqrt{' || substr(CAST(user_id AS VARCHAR), 1, 1) || '}' || substr(CAST(user_id AS VARCHAR), 2) || ' + \\sqrt{2}' AS x FROM events"),
    "text_without_units": (q(events, "event_id", x=lambda: tx.without_units(F.concat(C("user_id").cast("string"), F.lit("\\text{ cm} x")))), "SELECT event_id, CAST(user_id AS VARCHAR) AS x FROM events"),
    "text_final_answer": (q(amc, "row_id", x=lambda: tx.normal_final_answer(C("prompt"))), f"WITH n AS (SELECT row_id, {_minerva_sql('prompt')} AS x FROM amc_ttt) SELECT row_id, trim(CASE WHEN regexp_matches(replace(x, ',', ''), '^\\d+$') THEN replace(x, ',', '') ELSE x END) AS x FROM n"),
    "text_answer_line": (
        q(sanity, "row_id", x=lambda: tx.answer_line(F.concat(F.lit("so\nanswer: "), C("answer")))),
        "SELECT row_id, coalesce(list_extract(regexp_extract_all('so' || chr(10) || 'answer: ' || answer, '(?i)Answer\\s*:\\s*([^\\n]+)', 1), -1), '[INVALID]') AS x FROM sanity",
    ),
    "text_tail": (q(math1, "row_id", x=lambda: tx.tail(C("solution"), 300)), "SELECT row_id, right(solution, 300) AS x FROM math_l1_ttt"),
    "text_choice_letter": (q(train, "row_id", x=lambda: tx.choice_letter(F.concat(F.lit("I pick \\boxed{"), F.lower("answer"), F.lit("} or \\boxed{D}")))), "SELECT row_id, upper(regexp_extract('I pick \\boxed{' || lower(answer) || '} or \\boxed{D}', '\\\\boxed\\{\\s*([A-Da-d])\\s*\\}', 1)) AS x FROM train_sanity"),
    "text_choice_line": (q(train, "row_id", x=lambda: tx.choice_line(F.concat(F.lit("ANSWER: "), C("answer")))), "SELECT row_id, nullif(upper(regexp_extract('ANSWER: ' || answer, '(?i)Answer[ \\t]*:[ \\t]*\\$?([A-D])\\$?', 1)), '') AS x FROM train_sanity"),
    "score_choice": (q(train, "row_id", x=lambda: tx.choice_grade(C("answer"), F.lit(" b "))), "SELECT row_id, coalesce(upper(trim(answer)) = 'B', false) AS x FROM train_sanity"),
    "text_open_answer": (q(math1, "row_id", x=lambda: tx.open_answer(C("solution"))), f"SELECT row_id, {STRIP.format(f'coalesce({BOX}, solution)')} AS x FROM math_l1_ttt"),
    "text_split_tuple": (q(events, "event_id", x=lambda: F.array_join(tx.split_tuple(F.concat(F.lit("("), C("user_id").cast("string"), F.lit(", "), C("event_type"), F.lit(")"))), "|")), "SELECT event_id, user_id || '|' || event_type AS x FROM events"),
    "text_is_int": (q(events, "event_id", x=lambda: tx.is_int(F.when(C("event_id") % 2 == 0, C("user_id").cast("string")).otherwise(C("event_type")))), "SELECT event_id, event_id % 2 = 0 AS x FROM events"),
    "text_is_fraction": (q(events, "event_id", x=lambda: tx.is_fraction(F.concat(C("user_id").cast("string"), F.lit("/"), (C("event_id") % 3).cast("string")))), "SELECT event_id, event_id % 3 > 0 AS x FROM events"),
    "score_value_equal": (q(events, "event_id", x=lambda: tx.value_equal(C("value").cast("string"), F.lit("6.550"))), "SELECT event_id, coalesce(value = 6.55, false) AS x FROM events"),
    "score_numeric_close": (q(t("lineitem"), "l_orderkey", x=lambda: tx.numeric_close(C("l_extendedprice"), C("l_extendedprice") + C("l_tax") * 100)), "SELECT l_orderkey, abs(l_tax * 100) <= 1e-4 * greatest(abs(l_extendedprice), abs(l_extendedprice + l_tax * 100)) AS x FROM lineitem"),
    "text_interval_brackets": (
        q(events, "event_id", x=lambda: tx.interval_brackets(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Interval", "Interval.open", "Interval.Lopen", "Interval.Ropen")]), (C("event_id") % 4 + 1).cast("int")), F.lit("(1, 2)")))),
        "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '(1, 2)' WHEN 2 THEN '(1, 2]' ELSE '[1, 2)' END AS x FROM events",
    ),
    "text_qa_normal": (q(amc, "row_id", x=lambda: tx.qa_normal(C("prompt"))), f"SELECT row_id, {qa('prompt')} AS x FROM amc_ttt"),
    "score_exact_match": (q(train, "row_id", x=lambda: tx.exact_match(C("answer"), F.array(F.lit("The B!"), F.lit("c.")))), f"SELECT row_id, {qa('answer')} IN ('b', 'c') AS x FROM train_sanity"),
    "score_contains": (q(amc, "row_id", x=lambda: tx.contains_match(C("prompt"), F.array(F.lit("How many"), F.lit("the remainder")))), f"SELECT row_id, contains({qa('prompt')}, 'how many') OR contains({qa('prompt')}, 'remainder') AS x FROM amc_ttt"),
    "text_answer_tag": (q(sanity, "row_id", x=lambda: tx.answer_tag(F.concat(F.lit("<answer>x</answer> <answer> "), C("answer"), F.lit("\n</answer>")))), f"SELECT row_id, {STRIP.format('answer')} AS x FROM sanity"),
    "text_tag_count": (q(sanity, "row_id", x=lambda: tx.tag_count(F.repeat(F.lit("<answer>"), (C("row_id") % 13).cast("int")), "answer")), "SELECT row_id, CAST(row_id % 13 AS INT) AS x FROM sanity"),
    "score_qa": (
        q(train, "row_id", x=lambda: tx.qa_score(C("answer"), F.array(F.lit("b")), F.repeat(F.lit("<answer>"), (C("row_id") % 13).cast("int")))),
        f"SELECT row_id, CAST(CASE WHEN answer IS NULL THEN 0 WHEN {qa('answer')} = 'b' THEN CASE WHEN row_id % 13 > 10 THEN 0.25 ELSE 1 END ELSE 0 END AS DOUBLE) AS x FROM train_sanity",
    ),
    "score_think_format": (q(math1, "row_id", x=lambda: tx.think_format(F.concat(F.lit("<think>a\nb</think>"), C("solution")))), "SELECT row_id, CASE WHEN regexp_matches(solution, '(?s)\\\\boxed\\{.*\\}') THEN 1.0 ELSE 0.0 END AS x FROM math_l1_ttt"),
    "score_judge": (
        q(sanity, "row_id", judge=lambda: tx.judge_score(C("answer"))[0], parsed=lambda: tx.judge_score(C("answer"))[1]),
        """WITH n AS (SELECT row_id, TRY_CAST(regexp_extract(coalesce(answer, ''), '\\b(\\d{1,2})\\b', 1) AS INT) AS k FROM sanity)
           SELECT row_id, CAST(CASE WHEN k IS NULL THEN 0.5 ELSE least(k, 10) / 10.0 END AS DOUBLE) AS judge, k IS NOT NULL AS parsed FROM n""",
    ),
    "score_judge_digit": (q(sanity, "row_id", x=lambda: tx.judge_digit(C("answer"))), "SELECT row_id, TRY_CAST(regexp_extract(answer, '\\b(10|[0-9])\\b', 1) AS INT) / 10.0 AS x FROM sanity"),
    "score_verdict": (q(docs, "doc_id", x=lambda: tx.verdict(C("text"))), "SELECT doc_id, CAST(CASE regexp_extract(text, '\\[\\[(A>>B|A>B|A=B|B>A|B>>A)\\]\\]', 1) WHEN 'A>>B' THEN 1.0 WHEN 'A>B' THEN 0.5 WHEN 'A=B' THEN 0.0 WHEN 'B>A' THEN -0.5 WHEN 'B>>A' THEN -1.0 END AS DOUBLE) AS x FROM documents"),
    "text_options": (
        lambda s, d: train(s, d).where("question IS NOT NULL").select("row_id", F.explode(tx.option_texts(C("question"))).alias("letter", "option")),
        """WITH o AS (SELECT row_id, regexp_extract_all(replace(question, chr(13), ''), '(?m)^[ \\t]*\\(?([A-D])[.):][ \\t]*(.+?)[ \\t]*$', 1) AS l, regexp_extract_all(replace(question, chr(13), ''), '(?m)^[ \\t]*\\(?([A-D])[.):][ \\t]*(.+?)[ \\t]*$', 2) AS o FROM train_sanity)
            SELECT row_id, unnest(l) AS letter, unnest(o) AS option FROM o""",
    ),
    "text_question_stem": (
        q(train, "row_id", x=lambda: tx.question_stem(C("question"))),
        "SELECT row_id, " + STRIP.format("regexp_extract(question, '(?s)^(.*?)(?:\\n[ \\t]*\\(?[A-D][.):][ \\t]|$)', 1)") + " AS x FROM train_sanity",
    ),
    "text_format_options": (q(events, "event_id", x=lambda: tx.format_options(F.array(C("event_type"), C("user_id").cast("string"), F.lit("x")))), "SELECT event_id, 'A. ' || event_type || chr(10) || 'B. ' || user_id || chr(10) || 'C. x' AS x FROM events"),
    "text_caption_clean": (q(docs, "doc_id", x=lambda: tx.caption_clean(C("text"))), None),
    "text_squeeze": (q(amc, "row_id", x=lambda: tx.squeeze(C("prompt"))), "SELECT row_id, trim(regexp_replace(lower(prompt), '[\\s\\x0b\\x1c-\\x1f\\p{Z}\\x{85}]+', ' ', 'g')) AS x FROM amc_ttt"),
    "text_word_tokens": (q(sanity, "row_id", x=lambda: F.array_join(tx.word_tokens(C("answer")), " ")), f"SELECT row_id, array_to_string({WORDS.format('answer')}, ' ') AS x FROM sanity"),
    "text_content_words": (q(sanity, "row_id", x=lambda: F.array_join(tx.content_words(tx.word_tokens(C("answer"))), " ")), f"SELECT row_id, array_to_string(list_filter({WORDS.format('answer')}, lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w)), ' ') AS x FROM sanity"),
    "score_keyword_hit": (q(sanity, "row_id", x=lambda: tx.keyword_hit(C("answer"), C("prompt"))), f"SELECT row_id, CAST(len(list_filter(list_filter({WORDS.format('answer')}, lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w)), lambda w: NOT list_contains({WORDS.format('prompt')}, w))) = 0 AS DOUBLE) AS x FROM sanity"),
    "score_bleu1": (
        q(sanity, "row_id", x=lambda: F.round(tx.bleu1(C("prompt"), C("answer")), 6)),
        f"""WITH w AS (SELECT row_id, {WORDS.format('prompt')} AS r, {WORDS.format('answer')} AS c FROM sanity)
            SELECT row_id, CASE WHEN len(r) = 0 OR len(c) = 0 THEN 0.0 ELSE round(list_sum(list_transform(list_distinct(c), lambda t: least(len(list_filter(c, lambda x: x = t)), len(list_filter(r, lambda x: x = t))))) / len(c)
            * CASE WHEN len(c) >= len(r) THEN 1.0 ELSE exp(1 - len(r) / len(c)) END, 6) END AS x FROM w""",
    ),
    "text_code_block": (
        q(docs, "doc_id", x=lambda: F.md5(tx.code_block(C("text")))),
        """SELECT doc_id, md5(CASE WHEN contains(text, '```python') THEN string_split(list_extract(string_split(text, '```python'), -1), '```')[1]
           WHEN contains(text, '```') THEN regexp_replace(string_split(text, '```')[2], '^[ \\t]*[A-Za-z]+[ \\t]*\\n', '') END) AS x FROM documents""",
    ),
    "text_tool_calls": (
        q(events, "event_id", x=lambda: F.size(tx.tool_calls(F.concat(F.lit("<tool_call>{\"name\": \"f\"}</tool_call><tool_call>{bad</tool_call>"), F.when(C("event_id") % 2 == 0, "<tool_call>{\"name\": \"g\"}</tool_call>").otherwise(""))))),
        "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS x FROM events",
    ),
    "text_truncate_reply_left": (q(math1, "row_id", x=lambda: tx.truncate_reply(C("solution"), 60)), "SELECT row_id, CASE WHEN length(solution) > 60 THEN left(solution, 60) || '...(truncated)' ELSE solution END AS x FROM math_l1_ttt"),
    "text_truncate_reply_middle": (q(math1, "row_id", x=lambda: tx.truncate_reply(C("solution"), 60, "middle")), "SELECT row_id, CASE WHEN length(solution) > 60 THEN left(solution, 30) || '...(truncated)...' || right(solution, 30) ELSE solution END AS x FROM math_l1_ttt"),
    "text_label": (q(train, "row_id", x=lambda: tx.label_text(F.array("answer"))), "SELECT row_id, coalesce(answer, '') AS x FROM train_sanity"),
    "text_key": (q(train, "row_id", x=lambda: tx.text_key(C("question"))), "SELECT row_id, sha1(question) AS x FROM train_sanity"),
    "score_overlong_penalty": (q(docs, "doc_id", x=lambda: F.round(tx.overlong_penalty(C("n_chars"), 2000, 500, 1.0), 6)), "SELECT doc_id, CAST(round(least(-(n_chars - 1500) / 500, 0), 6) AS DOUBLE) AS x FROM documents"),
    "score_tool_turns": (q(events, "event_id", x=lambda: F.round(tx.tool_turn_score(C("event_id") % 2 == 0, C("user_id")), 6)), "SELECT event_id, CAST(round(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE least(0, -1 + (user_id - 2) / 2 * 0.1) END, 6) AS DOUBLE) AS x FROM events"),
    "score_lookup": (q(events, "event_id", x=lambda: tx.lookup_score(F.create_map(F.lit("click"), F.lit(0.5), F.lit(" view "), F.lit(0.25)), C("event_type"))), "SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 ELSE 0 END AS DOUBLE) AS x FROM events"),
    "score_lines_equal": (q(events, "event_id", x=lambda: tx.lines_equal(F.concat(C("event_type"), F.lit(" \n 7\n")), F.concat(C("event_type"), F.lit("\n"), (C("user_id") % 8).cast("string")))), "SELECT event_id, user_id % 8 = 7 AS x FROM events"),
    "text_index_of": (q(events, "event_id", x=lambda: tx.index_of(F.when(C("event_id") % 3 == 0, C("user_id")), F.when(C("event_id") % 2 == 0, C("event_id")))), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id WHEN event_id % 2 = 0 THEN event_id ELSE 0 END AS x FROM events"),
    "text_passages": (q(sanity, "row_id", x=lambda: tx.passages(F.array(F.lit("T\nbody"), F.coalesce("answer", F.lit("")).substr(1, 0)))), "SELECT row_id, 'Doc 1 (Title: T)' || chr(10) || 'body' || chr(10) || 'Doc 2 (Title: )' || chr(10) AS x FROM sanity"),
}
