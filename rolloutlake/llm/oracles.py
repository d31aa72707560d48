"""DuckDB equivalents of training-data queries that plain SQL can say."""

from __future__ import annotations

from rolloutlake.llm import radix, splits

_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{Nd}}]+'))"
_NUMBERS = "array_to_string(list_sort(regexp_extract_all({0}, '[0-9]+')), ' ')"


def _pairs(rows: str, join: str) -> str:
    """Pairs of rows with equal numbers and a similarity of 0.7 or more, by counting shared words."""
    return f"""r AS ({rows}), s AS (SELECT *, {_WORDS.format('text')} AS ws, {_NUMBERS.format('text')} AS nums FROM r WHERE text IS NOT NULL),
      w AS (SELECT row_id, nums, part, len(ws) AS n, unnest(ws) AS w FROM s),
      p AS (SELECT a.row_id AS a, b.row_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM w a JOIN w b ON a.w = b.w AND a.nums = b.nums AND {join} GROUP BY 1, 2),
      links AS (SELECT a, b FROM p WHERE k * 10 >= 7 * (n + m - k))"""


P3 = f"""WITH {_pairs(
    '''SELECT row_id, question AS text, split = 'train' AS part FROM train_sanity WHERE split IN ('train', 'validation', 'test')
       UNION ALL SELECT row_id, prompt, split = 'train' FROM amc_ttt WHERE split IN ('train', 'validation', 'test') UNION ALL SELECT row_id, prompt, split = 'train' FROM math_l1_ttt WHERE split IN ('train', 'validation', 'test')''',
    'a.part AND NOT b.part',
)} SELECT least(a, b) AS row_a, greatest(a, b) AS row_b FROM links"""

P5 = f"""WITH RECURSIVE {_pairs('SELECT row_id, question AS text, true AS part FROM train_sanity UNION ALL SELECT row_id, prompt, true FROM sanity', 'a.row_id <> b.row_id')},
  reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
  SELECT min(b) AS row_a, a AS row_b FROM reach GROUP BY a HAVING min(b) < a"""

P3_REPORT = f"""WITH {_pairs(
    '''SELECT row_id, question AS text, split = 'train' AS part, split, source FROM train_sanity WHERE split IN ('train', 'validation', 'test')
       UNION ALL SELECT row_id, prompt, split = 'train', split, source FROM amc_ttt WHERE split IN ('train', 'validation', 'test') UNION ALL SELECT row_id, prompt, split = 'train', split, 'math_l1_ttt' FROM math_l1_ttt WHERE split IN ('train', 'validation', 'test')''',
    'a.part AND NOT b.part',
)} SELECT split, source, count(DISTINCT b) AS eval_rows, count(*) AS pairs FROM links JOIN r ON r.row_id = b GROUP BY 1, 2"""

P5_GROUPS = f"""WITH RECURSIVE {_pairs('SELECT row_id, question AS text, true AS part FROM train_sanity UNION ALL SELECT row_id, prompt, true FROM sanity', 'a.row_id <> b.row_id')},
  reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
  g AS (SELECT row_id, least(row_id, coalesce(min(b), row_id)) AS root FROM s LEFT JOIN reach ON a = row_id WHERE regexp_replace(text, '[\\p{{Z}}\\p{{C}}\\s]+', '', 'g') <> '' GROUP BY 1)
  SELECT members, count(*) AS groups FROM (SELECT root, count(*) AS members FROM g GROUP BY 1) GROUP BY 1"""

_GRAMS = "unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' ')))"
_LEAKS = f"""i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM eval_items), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
  found AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, {_GRAMS} AS g FROM d) JOIN (SELECT DISTINCT item_id, {_GRAMS} AS g FROM i) USING (g))"""


def _read(column: str, pattern: str) -> str:
    return f"nullif(regexp_extract({column}, '{pattern}', 1), '')"


def _last(path: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex(trim({path}), '[/\\\\]+'), lambda p: regexp_extract(p, '^{pattern}$', 1)), lambda x: x <> '')[-1]"


_TUBE, _CLIP = f"({splits._ID}){splits._TAIL}", r"(\d{5})(?:_\d{3,4}p)?(?:\s*\(\d+\))?(?:\.[A-Za-z0-9]{2,4})?"
P2 = f"""SELECT row_id, coalesce({_read('video_id', rf'^\s*(?:.*[?&])?(?:v=)?{_TUBE}\s*$')}, {_last('video_file', _TUBE)}, {_read('id', rf'^\s*({splits._ID})-[A-Za-z]+-\d+\s*$')}, {_last("replace(audio_file, '_audio.', '.')", _TUBE)}) AS video FROM train_sanity
  UNION ALL SELECT row_id, coalesce({_last('video_file', _CLIP)}, {_last('audio_file', _CLIP)}, {_read('id', r'^\s*(\d{5})_\d+\s*$')}) FROM sanity"""

_DROP = radix._DROP.replace("'", "''")
_OPTION = radix._OPTION


def _fold(text: str) -> str:
    return f"regexp_replace(lower({text}), '{_DROP}', '', 'g')"


_COPIES = f"""t AS (SELECT 'train_sanity' AS grp, row_id, question AS text FROM train_sanity UNION ALL SELECT 'amc_ttt', row_id, prompt FROM amc_ttt),
  l AS (SELECT grp, row_id, text, string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM t WHERE regexp_replace(text, '[\\p{{Z}}\\p{{C}}\\s]+', '', 'g') <> ''),
  c AS (SELECT grp, row_id, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{_OPTION}'))) = 0 THEN {_fold('text')} ELSE
    {_fold(f"array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '{_OPTION}')), chr(10))")} || chr(1) || array_to_string(list_sort(list_transform(list_filter(ls, lambda x: regexp_matches(x, '{_OPTION}')), lambda x: {_fold(f"regexp_replace(x, '{_OPTION}', '')")})), chr(1)) END AS canon FROM l),
  g AS (SELECT row_id, min(row_id) OVER (PARTITION BY grp, canon) AS first_id, count(*) OVER (PARTITION BY grp, canon) AS copies FROM c)"""

GROWTH = """WITH rows_ AS (
    SELECT 'train_sanity' AS source_table, batch, CASE WHEN coalesce(trim(id), '') = '' THEN 'row:' || row_id ELSE trim(id) END AS unit FROM train_sanity
    UNION ALL SELECT 'math_l1_ttt', batch, CASE WHEN coalesce(trim(unique_id), '') = '' THEN 'row:' || row_id ELSE trim(unique_id) END FROM math_l1_ttt),
  k AS (SELECT source_table, unit, batch, count(*) AS k FROM rows_ GROUP BY ALL),
  n AS (SELECT source_table, unit, batch, CAST(CAST('0x' || substr(md5('7:' || source_table || ':' || unit), 1, 13) AS BIGINT) AS DOUBLE) < least(1.0, max(k) OVER (PARTITION BY source_table, unit ORDER BY batch) * 0.1) * 4503599627370496 AS now FROM k),
  b AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY source_table, unit ORDER BY batch), false) AS before FROM n)
  SELECT source_table, batch, count(*) FILTER (now AND NOT before) AS newly, count(*) FILTER (before AND NOT now) AS lost FROM b GROUP BY 1, 2"""

ORACLE = {
    "p2_found": P2,
    "p3_found": P3,
    "p4_found": f"WITH {_COPIES} SELECT first_id AS row_a, row_id AS row_b FROM g WHERE row_id <> first_id",
    "p4_copies": f"WITH {_COPIES} SELECT row_id, copies FROM g WHERE row_id = first_id",
    "p3_report": P3_REPORT,
    "p5_found": P5,
    "p5_groups": P5_GROUPS,
    "p7_growth": GROWTH,
    "p8_round_trip": "SELECT coalesce(lower(lang), 'und') AS lang, count(*) AS docs, count(*) AS exact FROM documents GROUP BY 1",
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM found",
    "p9_leaked_items": f"WITH {_LEAKS} SELECT item_id, source, split, docs FROM eval_items JOIN (SELECT item_id, count(*) AS docs FROM found GROUP BY 1) USING (item_id)",
}
