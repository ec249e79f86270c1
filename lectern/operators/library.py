"""Library lookups over categories, books, lines, contents and links. All keys are literals that reach the scan as filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import censor, plain_term, searchable


def all_categories(category: DataFrame) -> DataFrame:
    return category.select("id", "parent_id", "title", "level", "order_index").distinct()


def contents(entry: DataFrame, alt_entry: DataFrame, structure: DataFrame, text: DataFrame, line: DataFrame, book_id: int) -> DataFrame:
    """Regular and alternative table of contents of a book, each made distinct and tagged, with texts and line indices."""
    columns = ["id", "parent_id", "text_id", "level", "line_id", "has_children"]
    texts, lines = text.select(F.col("id").alias("text_id"), "text"), line.select(F.col("id").alias("line_id"), "line_index")
    regular = entry.where(F.col("book_id") == book_id).select(*columns)
    other = alt_entry.join(structure.where(F.col("book_id") == book_id).select(F.col("id").alias("structure_id")), "structure_id").select(*columns)
    full = lambda e, tag: e.join(texts, "text_id", "left").join(lines, "line_id", "left").select(*columns, "text", "line_index", F.lit(tag).alias("is_alt")).distinct()
    return full(regular, 0).union(full(other, 1))


def with_alt_root(toc: DataFrame, label: str = "כותרות נוספות") -> DataFrame:
    """Adds one synthetic root (id -1, level 0) if there are alternative entries."""
    root = toc.where("is_alt = 1").limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("level"), F.lit(label).alias("text"), F.lit(1).alias("is_alt"))
    return toc.select("id", "parent_id", "level", "text", "is_alt").union(root)


def links(link: DataFrame, line: DataFrame, book: DataFrame, source: int | Column, kind: int | None = None) -> DataFrame:
    """Cross-references of a source line, with target content and book title; only of one kind if given."""
    chosen = link.where(F.col("source_line_id") == source)
    if kind is not None:
        chosen = chosen.where(F.col("connection_type_id") == kind)
    lines = line.select(F.col("id").alias("target_line_id"), "content", "line_index")
    books = book.select(F.col("id").alias("target_book_id"), "title")
    return chosen.join(lines, "target_line_id").join(books, "target_book_id").select("target_line_id", "target_book_id", "connection_type_id", "title", "content", "line_index")


def line_range(line: DataFrame, book_id: int, start: int, end: int, censored: bool = False) -> DataFrame:
    out = line.where((F.col("book_id") == book_id) & F.col("line_index").between(start, end)).select("line_index", "content")
    return out.withColumn("content", censor(F.col("content"))) if censored else out


def line_at(line: DataFrame, book_id: int, index: int) -> DataFrame:
    return line.where((F.col("book_id") == book_id) & (F.col("line_index") == index))


def total_lines(book: DataFrame, book_id: int) -> DataFrame:
    """One row, 0 for an unknown book."""
    return book.where(F.col("id") == book_id).agg(F.coalesce(F.max("total_lines"), F.lit(0)).alias("total_lines"))


def line_ranges(line: DataFrame, ranges: list[tuple[int, int]], book_id: int | None = None) -> DataFrame:
    """Lines in any of several ranges of indices, each once: the ranges are one filter of one scan."""
    inside = F.lit(False)
    for start, end in ranges:
        inside = inside | F.col("line_index").between(start, end)
    return line.where(inside if book_id is None else (F.col("book_id") == book_id) & inside)


def links_of_lines(line: DataFrame, link: DataFrame, book_id: int | None = None, index: int | None = None, kind: int | None = None) -> DataFrame:
    """(book_id, line_index, target_line_id, connection_type_id): a line's id is looked up by book and index, its links by the id; what is None isn't asked for."""
    for name, value in (("book_id", book_id), ("line_index", index)):
        line = line if value is None else line.where(F.col(name) == value)
    link = link if kind is None else link.where(F.col("connection_type_id") == kind)
    ids = line.select(F.col("id").alias("source_line_id"), "book_id", "line_index")
    return ids.join(link, "source_line_id").select("book_id", "line_index", "target_line_id", "connection_type_id")


def search_literal(line: DataFrame, term: str) -> DataFrame:
    """Lines that hold the term itself, % and _ included, in the form that in-book search compares; letters of either case."""
    return line.where(F.contains(searchable(F.col("content")), F.lit(plain_term(term))))


def search_like(line: DataFrame, book_id: int, term: str) -> DataFrame:
    """Lines of a book whose raw content holds the term, letters of either case; % and _ stay wildcards."""
    return line.where((F.col("book_id") == book_id) & F.col("content").ilike(f"%{term}%")).select("line_index", "content")


FLAGS = ["has_targum", "has_reference", "has_commentary", "has_other", "has_source"]


def has_connections() -> Column:
    out = F.col(FLAGS[0]) > 0
    for f in FLAGS[1:]:
        out = out | (F.col(f) > 0)
    return out


def filter_options(book: DataFrame, types: DataFrame) -> DataFrame:
    """A row for each kind of connection that a book has, with its id; COMMENTARY is the default one."""
    pairs = ", ".join(f"'{f[4:].upper()}', {f}" for f in FLAGS)
    kinds = book.select("id", F.expr(f"stack({len(FLAGS)}, {pairs}) AS (name, n)")).where("n > 0")
    return kinds.join(F.broadcast(types.select(F.col("id").alias("type_id"), "name")), "name").select("id", "name", "type_id", (F.col("name") == "COMMENTARY").alias("is_default"))


def shows_filter() -> Column:
    return sum(((F.col(f) > 0).cast("int") for f in FLAGS[1:]), (F.col(FLAGS[0]) > 0).cast("int")) > 1


def commentary_groups(found: DataFrame, label: str = "אחר") -> DataFrame:
    """Links by book title (a blank one gets the label): first target by title order, size, and the position of the group."""
    key = F.coalesce(F.nullif("title", F.lit("")), F.lit(label)).alias("group")
    order = F.struct(F.coalesce("title", F.lit("")), "target_line_id", "target_book_id", "connection_type_id")
    return found.groupBy(key).agg(F.min_by("target_book_id", order).alias("target_book_id"), F.min_by("line_index", order).alias("target_line_index"), F.count("*").alias("n_links"), F.array_sort(F.collect_list(F.struct("target_line_id", "content"))).alias("links"))
