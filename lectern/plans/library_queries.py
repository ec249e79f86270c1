"""Library lookups, trees, links and their groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import intervals, library, ordering, tree
from lectern.plans.registry import query
from lectern.sources import files
from lectern.sources import tables as b
from lectern.sources.tables import oracle

#: The book that point queries ask for.
BOOK = 3


@query("all_categories", oracle("SELECT DISTINCT * FROM category"))
def all_categories(spark, sf):
    return library.all_categories(b.category(spark, sf))


@query("all_books", oracle("SELECT * FROM book"))
def all_books(spark, sf):
    return b.book(spark, sf)


_TOC = """SELECT DISTINCT e.id, e.parent_id, e.text_id, e.level, e.line_id, e.has_children, t.text, l.line_index, 0 AS is_alt FROM toc_entry e LEFT JOIN toc_text t ON t.id = e.text_id LEFT JOIN target_line l ON l.id = e.line_id WHERE e.book_id = 1
UNION ALL SELECT DISTINCT e.id, e.parent_id, e.text_id, e.level, e.line_id, e.has_children, t.text, l.line_index, 1 FROM alt_toc_entry e JOIN alt_toc_structure s ON s.id = e.structure_id LEFT JOIN toc_text t ON t.id = e.text_id LEFT JOIN target_line l ON l.id = e.line_id WHERE s.book_id = 1"""


def _toc(spark, sf):
    return library.contents(b.toc_entry(spark, sf), b.alt_toc_entry(spark, sf), b.alt_toc_structure(spark), b.toc_text(spark, sf), b.target_line(spark, sf), 1)


@query("toc", oracle(_TOC))
def toc(spark, sf):
    return _toc(spark, sf)


@query("toc_split_counts", oracle("SELECT is_alt, count(*) AS n FROM toc GROUP BY 1", f"toc AS ({_TOC})"))
def toc_split_counts(spark, sf):
    return _toc(spark, sf).groupBy("is_alt").agg(F.count("*").alias("n"))


@query("toc_with_alt_root", oracle("SELECT id, parent_id, level, text, is_alt FROM toc UNION ALL SELECT -1, NULL, 0, 'כותרות נוספות', 1 WHERE EXISTS (SELECT 1 FROM toc WHERE is_alt = 1)", f"toc AS ({_TOC})"))
def toc_with_alt_root(spark, sf):
    return library.with_alt_root(_toc(spark, sf))


@query(
    "toc_paths",
    oracle(
        "SELECT id, depth, path FROM p",
        f"""toc AS ({_TOC}), reg AS (SELECT * FROM toc WHERE is_alt = 0),
p(id, depth, path, text, open) AS (SELECT id, 0, '', text, has_children FROM reg WHERE coalesce(parent_id, 0) = 0
  UNION ALL SELECT r.id, p.depth + 1, CASE WHEN p.path = '' THEN p.text ELSE p.path || ' > ' || p.text END, r.text, r.has_children FROM p JOIN reg r ON r.parent_id = p.id WHERE p.open)""",
    ),
)
def toc_paths(spark, sf):
    regular = _toc(spark, sf).where("is_alt = 0")
    return tree.paths(regular, label="text", include_self=False, order=None, only_parents="has_children").select("id", "depth", "path")


@query("toc_flattened", oracle("SELECT e.id, row_number() OVER (ORDER BY CASE WHEN e.level = 0 THEN e.id WHEN e.level = 1 THEN e.parent_id ELSE n.parent_id END, e.level > 0, CASE WHEN e.level = 1 THEN e.id ELSE e.parent_id END, e.level > 1, e.id) - 1 AS place FROM toc_entry e LEFT JOIN toc_entry n ON n.id = e.parent_id"))
def toc_flattened(spark, sf):
    """Depth-first order: places by the sort key of the paths."""
    keys = tree.paths(b.toc_entry(spark, sf).withColumn("title", F.lit("")), order=None, only_parents="has_children")
    return ordering.numbered(keys.select("id", "sort_path"), "sort_path").select("id", F.col("place").cast("int").alias("place"))


@query("alt_toc_by_line", oracle("SELECT line_index, id, text, level FROM toc WHERE is_alt = 1 AND line_index IS NOT NULL AND coalesce(text, '') <> ''", f"toc AS ({_TOC})"))
def alt_toc_by_line(spark, sf):
    grouped = _toc(spark, sf).where("is_alt = 1 and line_index is not null and coalesce(text, '') <> ''").groupBy("line_index").agg(F.array_sort(F.collect_list(F.struct("id", "text", "level"))).alias("entries"))
    return grouped.select("line_index", F.inline("entries"))


_LINKS = "SELECT l.target_line_id, l.target_book_id, l.connection_type_id, k.title, t.content, t.line_index FROM link l JOIN target_line t ON t.id = l.target_line_id JOIN book k ON k.id = l.target_book_id WHERE l.source_line_id = {0}"


def _links(spark, sf, kind=None, source=-1):
    return library.links(b.link(spark, sf), b.target_line(spark, sf), b.book(spark, sf), source, kind)


@query("links", oracle(_LINKS.format("(SELECT source_line_id FROM link GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")))
def links(spark, sf):
    """Cross-references of the busiest source, by title."""
    busy = b.link(spark, sf).groupBy("source_line_id").count().orderBy(F.desc("count"), "source_line_id").first()
    return _links(spark, sf, source=busy.source_line_id if busy else -1).orderBy("title", "target_line_id")


@query("links_by_type", oracle("SELECT l.target_line_id, l.target_book_id, l.connection_type_id, k.title, t.content, t.line_index FROM link l JOIN target_line t ON t.id = l.target_line_id JOIN book k ON k.id = l.target_book_id WHERE l.source_line_id = (SELECT source_line_id FROM link WHERE connection_type_id = 2 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AND l.connection_type_id = 2"))
def links_by_type(spark, sf):
    """Cross-references of one kind, of the source that has most of them."""
    busy = b.link(spark, sf).where("connection_type_id = 2").groupBy("source_line_id").count().orderBy(F.desc("count"), "source_line_id").first()
    return _links(spark, sf, 2, busy.source_line_id if busy else -1)


@query("line_links", oracle("SELECT n.book_id, n.line_index, l.target_line_id, l.connection_type_id FROM source_line n JOIN link l ON l.source_line_id = n.id"))
def line_links(spark, sf):
    """The dependent lookup (book, line) to a line's id to its links, as one join over all lines."""
    return library.links_of_lines(b.source_line(spark, sf), b.link(spark, sf))


@query("line_links_at", oracle("SELECT n.book_id, n.line_index, l.target_line_id, l.connection_type_id FROM source_line n JOIN link l ON l.source_line_id = n.id JOIN (SELECT s.book_id, s.line_index FROM source_line s JOIN link k ON k.source_line_id = s.id WHERE k.connection_type_id = 3 ORDER BY s.id LIMIT 1) f ON f.book_id = n.book_id AND f.line_index = n.line_index WHERE l.connection_type_id = 3"))
def line_links_at(spark, sf):
    """Links of one kind of the first line that has some."""
    some = b.link(spark, sf).where("connection_type_id = 3").select(F.col("source_line_id").alias("id"))
    first = b.source_line(spark, sf).join(some, "id", "left_semi").orderBy("id").first()
    return library.links_of_lines(b.source_line(spark, sf), b.link(spark, sf), first.book_id, first.line_index, 3)


@query("line_range", oracle(f"SELECT line_index, content FROM line WHERE book_id = {BOOK} AND line_index BETWEEN 1 AND 5"))
def line_range(spark, sf):
    return library.line_range(b.line(spark, sf), BOOK, 1, 5).orderBy("line_index")


@query("line_content", oracle(f"SELECT content FROM line WHERE book_id = {BOOK} AND line_index = 2"))
def line_content(spark, sf):
    return library.line_at(b.line(spark, sf), BOOK, 2).select("content")


@query("line_id", oracle(f"SELECT id FROM line WHERE book_id = {BOOK} AND line_index = 2"))
def line_id(spark, sf):
    return library.line_at(b.line(spark, sf), BOOK, 2).select("id")


@query("total_lines", oracle(f"SELECT coalesce(max(total_lines), 0) AS total_lines FROM book WHERE id = {BOOK}"))
def total_lines(spark, sf):
    return library.total_lines(b.book(spark, sf), BOOK)


@query("total_lines_unknown", oracle("SELECT coalesce(max(total_lines), 0) AS total_lines FROM book WHERE id = -5"))
def total_lines_unknown(spark, sf):
    return library.total_lines(b.book(spark, sf), -5)


@query("search_lines_like", oracle(f"SELECT line_index, content FROM line WHERE book_id = {BOOK} AND content ILIKE '%en%'"))
def search_lines_like(spark, sf):
    return library.search_like(b.line(spark, sf), BOOK, "en")


@query("line_ranges", oracle("SELECT book_id, line_index, content FROM line WHERE line_index BETWEEN 0 AND 4 OR line_index BETWEEN 3 AND 6 OR line_index BETWEEN 9 AND 12"))
def line_ranges(spark, sf):
    """Several ranges loaded at once, overlapping ones without repeats."""
    return library.line_ranges(b.line(spark, sf), [(0, 4), (3, 6), (9, 12)]).select("book_id", "line_index", "content")


@query("flattened_ranges", oracle("SELECT book_id, line_index, length(content) AS size FROM line WHERE (line_index < 3 OR line_index BETWEEN 5 AND 7) AND length(content) > 40"))
def flattened_ranges(spark, sf):
    """Arrays of two ranges, flattened, mapped and filtered, and rows again."""
    lines = b.line(spark, sf)
    part = lambda test: F.collect_list(F.when(test, F.struct("line_index", "content")))
    nested = lines.where("line_index < 8").groupBy("book_id").agg(F.array(part(F.col("line_index") < 3), part(F.col("line_index").between(5, 7))).alias("ranges"))
    sizes = F.transform(F.flatten("ranges"), lambda x: F.struct(x["line_index"].alias("line_index"), F.length(x["content"]).cast("long").alias("size")))
    return nested.select("book_id", F.inline(F.filter(sizes, lambda x: x["size"] > 40)))


@query("line_pages", oracle("SELECT book_id, line_index // 20 AS page, count(*) AS n FROM line GROUP BY ALL"))
def line_pages(spark, sf):
    """Lines by the batches that a scan loads one after the other."""
    return b.line(spark, sf).groupBy("book_id", files.page(F.col("line_index"), 20).alias("page")).agg(F.count("*").alias("n"))


@query("search_lines_literal", oracle("SELECT id FROM line WHERE contains(lower(regexp_replace(content, '<[^>]*>', '', 'g')), '%')"))
def search_lines_literal(spark, sf):
    """A term that would be a wildcard, taken as it is, in all books."""
    return library.search_literal(b.line(spark, sf), "%").select("id")


@query("line_counts", oracle("SELECT book_id, count(*) AS n_lines, max(line_index) AS last FROM line GROUP BY 1"))
def line_counts(spark, sf):
    return b.line(spark, sf).groupBy("book_id").agg(F.count("*").alias("n_lines"), F.max("line_index").alias("last"))


@query("connection_types", oracle("SELECT id, name FROM connection_type"))
def connection_types(spark, sf):
    return b.connection_type(spark).orderBy("name")


@query("connection_labels", "SELECT * FROM (VALUES ('SOURCE', 'מקור'), ('OTHER', 'אחר'), ('COMMENTARY', 'מפרשים'), ('TARGUM', 'תרגומים'), ('REFERENCE', 'קשרים')) t(name, label)")
def connection_labels(spark, sf):
    from lectern.functions.text import connection_label

    return b.connection_type(spark).select("name", connection_label(F.col("name")).alias("label"))


@query(
    "category_tree_paths",
    oracle("SELECT c.id, c.title, c.level, CASE WHEN p.id IS NULL THEN c.title ELSE p.title || ' > ' || c.title END AS path FROM category c LEFT JOIN category p ON p.id = c.parent_id"),
)
def category_tree_paths(spark, sf):
    c = b.category(spark, sf)
    return c.join(tree.paths(c), "id").select("id", "title", "level", "path")


@query("book_paths", oracle("SELECT b.id, p.title || ' > ' || c.title AS path FROM book b JOIN category c ON c.id = b.category_id JOIN category p ON p.id = c.parent_id"))
def book_paths(spark, sf):
    p = tree.paths(b.category(spark, sf)).select(F.col("id").alias("category_id"), "path")
    return b.book(spark, sf).join(p, "category_id").select("id", "path")


@query("category_orphans", oracle("SELECT id, title FROM category c WHERE coalesce(parent_id, 0) <> 0 AND NOT EXISTS (SELECT 1 FROM category p WHERE p.id = c.parent_id AND p.title <> 'ASIA' AND p.id <> 2)"))
def category_orphans(spark, sf):
    """What is left without a parent once one root is gone."""
    return tree.orphans(files.remove_all(b.category(spark, sf), (F.col("id") == 2) | (F.col("title") == "ASIA"))).select("id", "title")


@query("books_by_category", oracle("SELECT c.id AS category_id, b.id AS book_id, b.title, coalesce(row_number() OVER (PARTITION BY c.id ORDER BY b.order_index, b.id), 0) - 1 AS place, count(b.id) OVER (PARTITION BY c.id) AS n FROM category c LEFT JOIN book b ON b.category_id = c.id"))
def books_by_category(spark, sf):
    nested = tree.children(b.category(spark, sf).select("id", F.col("title").alias("category")), b.book(spark, sf), "category_id")
    flat = nested.select(F.col("id").alias("category_id"), F.size("items").cast("long").alias("n"), F.posexplode_outer("items").alias("place", "x"))
    return flat.select("category_id", F.col("x.id").alias("book_id"), F.col("x.title").alias("title"), F.coalesce("place", F.lit(0)).cast("long").alias("place"), "n")


@query(
    "commentary_groups",
    oracle(
        "SELECT coalesce(nullif(title, ''), 'אחר') AS \"group\", arg_min(target_book_id, o) AS target_book_id, arg_min(line_index, o) AS target_line_index, count(*) AS n_links FROM f GROUP BY 1",
        "f AS (SELECT l.*, CASE WHEN k.id % 5 = 0 THEN NULL ELSE k.title END AS title, t.line_index, (coalesce(CASE WHEN k.id % 5 = 0 THEN NULL ELSE k.title END, ''), l.target_line_id, l.target_book_id, l.connection_type_id) AS o FROM link l JOIN target_line t ON t.id = l.target_line_id JOIN book k ON k.id = l.target_book_id)",
    ),
)
def commentary_groups(spark, sf):
    """Groups of all links; every fifth book counts as untitled."""
    found = _all_links(spark, sf).withColumn("title", F.when(F.col("target_book_id") % 5 != 0, F.col("title")))
    return library.commentary_groups(found).drop("links")


@query("commentary_items", oracle("SELECT k.title AS \"group\", row_number() OVER (PARTITION BY k.title ORDER BY l.target_line_id, t.content) - 1 AS place, l.target_line_id, t.content FROM link l JOIN target_line t ON t.id = l.target_line_id JOIN book k ON k.id = l.target_book_id"))
def commentary_items(spark, sf):
    """Nested groups flattened again, keyed by group and place."""
    return library.commentary_groups(_all_links(spark, sf)).select("group", F.posexplode("links").alias("place", "x")).select("group", F.col("place").cast("long").alias("place"), "x.target_line_id", "x.content")


def _all_links(spark, sf):
    return library.links(b.link(spark, sf), b.target_line(spark, sf), b.book(spark, sf), F.col("source_line_id"))


@query("commentary_group_position", oracle("SELECT min(p) AS place FROM (SELECT id, row_number() OVER (ORDER BY title, id) - 1 AS p FROM book) WHERE id = 8"))
def commentary_group_position(spark, sf):
    """Place of the first group with a saved target, in title order."""
    placed = ordering.numbered(b.book(spark, sf).select("id", "title"), "title", "id", name="p")
    return placed.where("id = 8").agg(F.min("p").alias("place"))


@query("group_target_books", oracle("SELECT DISTINCT l.target_book_id AS id, k.title, k.total_lines FROM link l JOIN book k ON k.id = l.target_book_id"))
def group_target_books(spark, sf):
    targets = b.link(spark, sf).select(F.col("target_book_id").alias("id")).distinct()
    return b.book(spark, sf).join(targets, "id", "left_semi").select("id", "title", "total_lines")


_KIND = "name, n FROM book, LATERAL (VALUES ('TARGUM', has_targum), ('REFERENCE', has_reference), ('COMMENTARY', has_commentary), ('OTHER', has_other), ('SOURCE', has_source)) v(name, n)"


@query("filter_options", oracle(f"SELECT o.id, o.name, t.id AS type_id, o.name = 'COMMENTARY' AS is_default FROM (SELECT id, {_KIND} WHERE n > 0) o JOIN connection_type t ON t.name = o.name"))
def filter_options(spark, sf):
    return library.filter_options(b.book(spark, sf), b.connection_type(spark))


@query("has_connections", oracle("SELECT id, greatest(has_targum, has_reference, has_commentary, has_other, has_source) > 0 AS has_any, (has_targum > 0)::INT + (has_reference > 0)::INT + (has_commentary > 0)::INT + (has_other > 0)::INT + (has_source > 0)::INT > 1 AS shows_filter FROM book"))
def has_connections(spark, sf):
    return b.book(spark, sf).select("id", library.has_connections().alias("has_any"), library.shows_filter().alias("shows_filter"))


@query("missing_line_ranges", oracle("SELECT p AS part, min(i) AS start, max(i) AS \"end\" FROM (SELECT p, i, i - row_number() OVER (PARTITION BY p ORDER BY i) AS g FROM (SELECT DISTINCT p_size AS p FROM part), range(0, 301) t(i) WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size = p AND q.p_partkey % 301 = i)) GROUP BY p, g"))
def missing_line_ranges(spark, sf):
    """Which indices 0 to 300 each group lacks, as ranges."""
    have = b.read(spark, sf, "part").select(F.col("p_size").alias("part"), (F.col("p_partkey") % 301).alias("i"))
    return intervals.missing_ranges(have, "part", "i", 0, 300)


@query("lines_near_visible", oracle("SELECT book_id, line_index FROM line l WHERE EXISTS (SELECT 1 FROM line v WHERE v.book_id = l.book_id AND v.line_index % 20 = 7 AND abs(v.line_index - l.line_index) <= 3)"))
def lines_near_visible(spark, sf):
    lines = b.line(spark, sf).select("book_id", "line_index", (F.col("line_index") % 20 == 7).alias("visible"))
    return intervals.near(lines, "book_id", "line_index", "visible", 3).select("book_id", "line_index")


@query("clip_sections", "SELECT o_custkey AS id, greatest(o_orderkey % 500, 100) AS start, least(o_orderkey % 500 + o_custkey % 90, 300) AS \"end\" FROM orders WHERE o_orderkey % 500 < 300 AND o_orderkey % 500 + o_custkey % 90 > 100")
def clip_sections(spark, sf):
    sections = b.read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 500).alias("start"), (F.col("o_orderkey") % 500 + F.col("o_custkey") % 90).alias("end"))
    return intervals.clipped(sections, 100, 300)


@query("nearest_to_top", "SELECT p_size AS part, arg_min(p_partkey, (abs(p_retailprice - 1000), p_partkey)) AS line FROM part GROUP BY 1")
def nearest_to_top(spark, sf):
    rows = b.read(spark, sf, "part").select(F.col("p_size").alias("part"), F.col("p_partkey").alias("line"), "p_retailprice")
    return intervals.nearest(rows, "part", "line", "p_retailprice", 1000.0)


@query("visible_bounds", oracle("SELECT book_id, min(line_index) AS first, max(line_index) AS last FROM line WHERE length(content) > 20 GROUP BY 1"))
def visible_bounds(spark, sf):
    return b.line(spark, sf).where(F.length("content") > 20).groupBy("book_id").agg(F.min("line_index").alias("first"), F.max("line_index").alias("last"))


@query("paragraphs_by_style", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_size >= 10")
def paragraphs_by_style(spark, sf):
    return b.read(spark, sf, "part").where(F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33") & (F.col("p_size") >= 10)).select("p_partkey", "p_brand", "p_size")


@query("tri_state_rollup", "SELECT p_brand AS brand, CASE WHEN count(f) < count(*) THEN NULL WHEN bool_and(f) THEN true WHEN NOT bool_or(f) THEN false END AS state FROM (SELECT p_brand, CASE WHEN p_size % 50 = 0 THEN NULL ELSE p_size > 0 END AS f FROM part) GROUP BY 1")
def tri_state_rollup(spark, sf):
    flags = b.read(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 50 != 0, F.col("p_size") > 0).alias("f"))
    return tree.tri_state(flags, "brand", "f")
