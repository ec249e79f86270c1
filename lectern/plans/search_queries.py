"""In-book search, list filters, regex find and replace."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import regexfind, search, tree
from lectern.plans.registry import query
from lectern.sources import tables as b
from lectern.sources.tables import oracle

#: A whole word, a part of words, a pattern.
TERM, PART, PATTERN = "the", "on", r"\b[tT]h\w{2,4}\b"

_TOTAL = f"(length(s) - length(replace(s, '{PART}', ''))) // {len(PART)}"
_HITS = f"hits AS (SELECT id, book_id, line_index, {_TOTAL} AS total FROM (SELECT id, book_id, line_index, regexp_replace(regexp_replace(lower(regexp_replace(content, '<[^>]*>', '', 'g')), '[\\x{{0591}}-\\x{{05C7}}]', '', 'g'), 'onon', 'on on', 'g') AS s FROM line) WHERE {_TOTAL} > 0)"


@query("content_search_counts", oracle("SELECT id, total FROM hits", _HITS))
def content_search_counts(spark, sf):
    return search.matches(b.line(spark, sf), PART).where("occurrence = 0").select("id", F.col("total").cast("long").alias("total"))


@query("content_search_matches", oracle("SELECT id, o AS occurrence, total FROM hits, unnest(range(total)) u(o)", _HITS))
def content_search_matches(spark, sf):
    return search.matches(b.line(spark, sf), "ON").select("id", F.col("occurrence").cast("long").alias("occurrence"), F.col("total").cast("long").alias("total"))


@query("content_search_total", oracle("SELECT sum(total)::BIGINT AS n, count(*) AS items FROM hits", _HITS))
def content_search_total(spark, sf):
    return search.matches(b.line(spark, sf), PART).agg(F.count("*").alias("n"), F.count_distinct("id").alias("items"))


@query("content_search_overlapping", "SELECT p_partkey AS id, len(list_filter(range(1, length(t)), lambda i: substr(t, i, 2) = 'ee')) AS total FROM (SELECT p_partkey, repeat('e', (p_partkey % 7)::INT) AS t FROM part)")
def content_search_overlapping(spark, sf):
    return b.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), search.occurrences(F.repeat(F.lit("e"), (F.col("p_partkey") % 7).cast("int")), "ee").cast("long").alias("total"))


@query("content_search_ordinals", oracle("SELECT book_id, line_index, 0 AS occurrence, sum(total) OVER (ORDER BY book_id, line_index RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - total AS ordinal FROM hits", _HITS))
def content_search_ordinals(spark, sf):
    """The first match of each line with its place among all matches of all books."""
    return _ordinals(b.line(spark, sf))


def _ordinals(lines):
    found = search.matches(lines, PART).join(lines.select("id", "book_id", "line_index"), "id")
    placed = search.ordinals(found, "book_id", "line_index").where("occurrence = 0")
    return placed.select("book_id", "line_index", F.col("occurrence").cast("int").alias("occurrence"), "ordinal")


@query("book_tree_search", oracle("SELECT k.id, p.title || ' > ' || c.title AS path, k.title FROM book k JOIN category c ON c.id = k.category_id JOIN category p ON p.id = c.parent_id WHERE contains(lower(p.title || ' > ' || c.title || ' ' || k.title), 'asia') AND contains(lower(p.title || ' > ' || c.title || ' ' || k.title), 'supplier') ORDER BY k.id LIMIT 100"))
def book_tree_search(spark, sf):
    paths = tree.paths(b.category(spark, sf)).select(F.col("id").alias("category_id"), "path")
    books = b.book(spark, sf).join(paths, "category_id")
    hits = books.where(search.all_words(F.concat_ws(" ", "path", "title"), "Asia supplier"))
    return search.first_hits(hits.select("id", "path", "title"), "id")


@query("toc_word_search", oracle("SELECT id, title FROM catalog WHERE regexp_matches(lower(replace(title, '\"', '')), '(^|[^a-z0-9_])red($|[^a-z0-9_])') ORDER BY id LIMIT 100"))
def toc_word_search(spark, sf):
    hits = b.catalog(spark, sf).where(search.whole_words(F.col("title"), '"Red"'))
    return search.first_hits(hits.select("id", "title"), "id")


@query("toc_two_words", oracle("SELECT id, title FROM catalog WHERE regexp_matches(lower(title), '(^|[^a-z0-9_])red($|[^a-z0-9_])') AND regexp_matches(lower(title), '(^|[^a-z0-9_])ring($|[^a-z0-9_])')"))
def toc_two_words(spark, sf):
    return b.catalog(spark, sf).where(search.whole_words(F.col("title"), "red ring")).select("id", "title")


@query("label_filter", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'nation') AND contains(lower(n_name), '_1')")
def label_filter(spark, sf):
    return b.read(spark, sf, "nation").where(search.all_words(F.col("n_name"), " NATION  _1")).select("n_nationkey", "n_name")


@query("label_filter_blank", "SELECT n_nationkey FROM nation")
def label_filter_blank(spark, sf):
    return b.read(spark, sf, "nation").where(search.all_words(F.col("n_name"), "  ")).select("n_nationkey")


def _books(spark, sf):
    return b.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


_FOUND = """f AS (SELECT id, i, m[i] AS match, list_sum(list_transform(range(1, i + 1), lambda k: length(g[k]))) + coalesce(list_sum(list_transform(range(1, i), lambda k: length(m[k]))), 0) AS start, text
  FROM (SELECT doc_id AS id, text, regexp_extract_all(text, 'token\\s*=\\s*"[0-9a-f]+"|password=\\S+') AS m, regexp_split_to_array(text, 'token\\s*=\\s*"[0-9a-f]+"|password=\\S+') AS g FROM documents WHERE regexp_matches(text, 'token\\s*=\\s*"[0-9a-f]+"|password=\\S+')), unnest(range(1, len(m) + 1)) u(i))"""
_SECRET = r'token\s*=\s*"[0-9a-f]+"|password=\S+'


@query("regex_find_all", oracle("SELECT id, start::INT AS start, length(match)::INT AS length, match FROM f", _FOUND))
def regex_find_all(spark, sf):
    return regexfind.find_all(_books(spark, sf), _SECRET).select("id", "start", "length", "match")


@query("regex_find_offsets", oracle("SELECT id, start::INT AS start, length(match)::INT AS length, match FROM f", _FOUND))
def regex_find_offsets(spark, sf):
    return regexfind.find_offsets(_books(spark, sf), _SECRET)


@query("regex_snippets", oracle("SELECT id, start::INT AS start, substr(text, greatest(1, start + 1 - 75)::BIGINT, least(start, 75)::BIGINT) || '<b>' || match || '</b>' || substr(text, (start + length(match) + 1)::BIGINT, 75) AS snippet FROM f", _FOUND))
def regex_snippets(spark, sf):
    return regexfind.find_all(_books(spark, sf), _SECRET).select("id", "start", "snippet")


@query("regex_scope_forward", oracle("SELECT id, start::INT AS start FROM f WHERE start >= 400", _FOUND))
def regex_scope_forward(spark, sf):
    return regexfind.scope(regexfind.find_all(_books(spark, sf), _SECRET), "forward", 400).select("id", "start")


@query("regex_scope_selection", oracle("SELECT id, start::INT AS start FROM f WHERE start >= 200 AND start + length(match) <= 900", _FOUND))
def regex_scope_selection(spark, sf):
    return regexfind.scope(regexfind.find_all(_books(spark, sf), _SECRET), "selection", 200, 900).select("id", "start")


@query("next_previous_match", "SELECT l_suppkey AS id, coalesce(min(l_orderkey) FILTER (l_orderkey > 300), min(l_orderkey)) AS next, coalesce(max(l_orderkey) FILTER (l_orderkey < 300), max(l_orderkey)) AS previous FROM lineitem GROUP BY 1")
def next_previous_match(spark, sf):
    found = b.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("start"))
    return regexfind.neighbour(found, 300)


# Word characters as (?U) has them; the oracle's engine has no Unicode word rules, nor looks around: for boundaries on
# both sides, each other character is doubled, so that neighbouring matches don't share one.
_W = r"\p{L}\p{M}\p{Nd}\p{Pc}"
_DOUBLED = f"regexp_replace(content, '([^{_W}])', '\\1\\1', 'g')"


@query("regex_count_by_line", oracle(f"SELECT id, n FROM (SELECT id, len(regexp_extract_all({_DOUBLED}, '(?:^|[^{_W}])[tT]h[{_W}]{{2,4}}(?:$|[^{_W}])')) AS n FROM line) WHERE n > 0"))
def regex_count_by_line(spark, sf):
    return count_by_line(b.line(spark, sf))


def count_by_line(lines):
    unicode = f"(?U){PATTERN}"
    return lines.where(F.col("content").rlike(unicode)).select("id", F.regexp_count("content", F.lit(unicode)).cast("long").alias("n"))


@query("regex_slop", oracle(f"""SELECT id FROM line WHERE regexp_matches(content, 'the[^{_W}]+(?:[{_W}"]+[^{_W}]+){{0,2}}and')"""))
def regex_slop(spark, sf):
    return slop(b.line(spark, sf))


def slop(lines):
    return lines.where(F.col("content").rlike(regexfind.slop_pattern("the and", 2))).select("id")


@query("regex_literal", oracle("SELECT id FROM line WHERE contains(content, '|')"))
def regex_literal(spark, sf):
    return b.line(spark, sf).where(F.col("content").rlike(regexfind.literal("|"))).select("id")


@query("regex_replace_all", "SELECT p_partkey, regexp_replace(p_name, '(\\w+) (\\w+)', '\\2 [\\1]', 'g') AS name FROM part")
def regex_replace_all(spark, sf):
    return b.read(spark, sf, "part").select("p_partkey", regexfind.replace_all(F.col("p_name"), r"(\w+) (\w+)", "$2 [$1]").alias("name"))


@query("regex_replace_first", "SELECT p_partkey, regexp_replace(p_name, '([aeiou])', '<\\1>') AS name FROM part")
def regex_replace_first(spark, sf):
    return b.read(spark, sf, "part").select("p_partkey", regexfind.replace_first(F.col("p_name"), "([aeiou])", "<$1>").alias("name"))


def _runs(spark, sf):
    """Text runs whose attributes are columns of line items."""
    flag = lambda c, v: (F.col(c) == v).cast("int")
    return b.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("start"), F.col("l_partkey").alias("part"), flag("l_returnflag", "A").alias("bold"), flag("l_returnflag", "R").alias("bold_bi"), flag("l_linestatus", "O").alias("underline"), F.col("l_discount").cast("float").alias("size"), F.col("l_tax").cast("float").alias("size_bi"), F.col("l_returnflag").alias("style")
    )


@query("format_predicate", "SELECT l_orderkey AS doc_id, l_linenumber AS start, l_partkey AS part FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus <> 'O' AND (abs(l_discount::FLOAT - 0.05) < 0.01 OR abs(l_tax::FLOAT - 0.05) < 0.01)")
def format_predicate(spark, sf):
    return _runs(spark, sf).where(regexfind.format_matches(bold=True, underline=False, size=0.05, style=None)).select("doc_id", "start", "part")


@query("format_assign", "SELECT l_orderkey AS doc_id, l_linenumber AS start, l_partkey AS part, 1 AS bold, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS underline, 'Title' AS style FROM lineitem")
def format_assign(spark, sf):
    return regexfind.assign_format(_runs(spark, sf), bold=1, underline=None, style="Title").select("doc_id", "start", "part", "bold", "underline", "style")


@query("regex_replace_first_groups", "SELECT event_id, regexp_replace(props || chr(10) || props, '(.)(k).', '\\2[\\0]') AS text FROM events")
def regex_replace_first_groups(spark, sf):
    """Groups, the whole match, and a dot that stops at line ends."""
    text = F.concat("props", F.lit("\n"), "props")
    return b.read(spark, sf, "events").select("event_id", regexfind.replace_first(text, "(.)(k).", "$2[$0]").alias("text"))
