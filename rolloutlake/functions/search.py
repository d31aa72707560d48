"""Results of search tools: reading a tool's text, formatting retrieved passages, and the status record of a search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- patterns of the tool's text (fixed values) ----
_QUERY = r'query"\s*:\s*"([^"]+)"'
_TITLE = r'"title"\s*:'
_RESULTS = r'(?s)"results"\s*:\s*(\[.*?\])'


def tool_result(parts: Column) -> Column:
    """Struct (text, queries, query_count, total_results, status) of an array of text parts; single quotes count as double ones."""
    plain = F.transform(parts, lambda p: F.replace(p, F.lit("'"), F.lit('"')))
    queries = F.transform(plain, lambda p: F.regexp_extract(p, _QUERY, 1))
    titles = F.aggregate(plain, F.lit(0), lambda n, p: n + F.size(F.regexp_extract_all(p, F.lit(_TITLE), F.lit(0))))
    text = F.array_join(F.transform(plain, lambda p: F.regexp_extract(p, _RESULTS, 1)), "")
    return F.struct(text.alias("text"), queries.alias("queries"), F.size(parts).alias("query_count"), titles.alias("total_results"), F.lit("success").alias("status"))


def formatted_passages(contents: Column) -> Column:
    """Numbered passages of an array of contents: the first line is the title, the others the text."""
    lines = lambda c: F.split(c, "\n", -1)
    body = lambda c: F.array_join(F.slice(lines(c), 2, F.greatest(F.size(lines(c)) - 1, F.lit(0))), "\n")
    one = F.transform(contents, lambda c, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit(" (Title: "), lines(c)[0], F.lit(")\n"), body(c), F.lit("\n\n")))
    return F.regexp_replace(F.array_join(one, ""), r"^\s+|\s+$", "")


def search_status(error: Column, retrieved: Column) -> Column:
    """Struct (status, total_results, formatted) of a search: error text, or per query an array of contents (null: no answer)."""
    some = F.size(retrieved) > 0
    text = F.array_join(F.transform(retrieved, formatted_passages), "\n---\n")
    total = F.aggregate(retrieved, F.lit(0), lambda n, r: n + F.size(r))
    status = F.when(F.length(error) > 0, "api_error").when(retrieved.isNull(), "unknown_api_state").when(some, "success").otherwise("no_results")
    good = status == "success"
    return F.struct(status.alias("status"), F.when(good, total).otherwise(0).alias("total_results"), F.when(good, text).alias("formatted"))
