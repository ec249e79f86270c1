"""Text search: in-book matches, all-words, prefix and whole-word filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import plain_term, searchable
from lectern.operators.ordering import running_total

#: Rows that list searches return at most: the feature itself.
MOST = 100


def occurrences(c: Column, term: str) -> Column:
    """How often a term occurs, overlapping ones counted."""
    return F.regexp_count(c, F.lit(f"(?=\\Q{term}\\E)")) if term else F.lit(0)


def matches(items: DataFrame, query: str, id: str = "id", content: str = "content") -> DataFrame:
    """(id, occurrence, total): a row for each match, counted from 0 within its item. A blank query matches nothing."""
    term = plain_term(query)
    if not term.strip():
        return items.select(id, F.lit(0).alias("occurrence"), F.lit(0).alias("total")).limit(0)
    counted = items.select(id, occurrences(searchable(F.col(content)), term).alias("total")).where("total > 0")
    return counted.select(id, F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("occurrence"), "total")


def ordinals(found: DataFrame, *order: str) -> DataFrame:
    """Numbers all matches from 0 by order, which tells the items apart: offsets of items come from their totals."""
    items = found.where("occurrence = 0").select(*order, "total")
    start = running_total(items, F.col("total").cast("long"), *order, name="start").drop("total")
    return found.join(start, list(order)).withColumn("ordinal", F.col("start") + F.col("occurrence")).drop("start")


def all_words(c: Column, query: str) -> Column:
    """Every white-space-separated word of the query is contained, letters of either case; a blank query fits all."""
    out = F.lit(True)
    for w in query.lower().split():
        out = out & F.contains(F.lower(c), F.lit(w))
    return out


def whole_words(c: Column, query: str) -> Column:
    """Every word of the query stands by itself (no letter, digit, underscore or Hebrew character beside it); double quotes are ignored."""
    clean = F.replace(F.lower(c), F.lit('"'), F.lit(""))
    out = F.lit(True)
    for w in query.lower().replace('"', "").split():
        out = out & clean.rlike(r"(?<![\w֐-׿])\Q" + w + r"\E(?![\w֐-׿])")
    return out


def catalog_search(catalog: DataFrame, query: str, fields: tuple[str, ...] = ("title", "author", "tags")) -> DataFrame:
    """One term of under five letters is a prefix of a field; otherwise each term is contained in some field."""
    terms = [t for t in query.strip().lower().split(" ") if t]
    out = F.lit(True)
    for t in terms:
        short = len(terms) == 1 and len(t) < 5
        hit = F.lit(False)
        for f in fields:
            low = F.lower(F.coalesce(F.col(f), F.lit("")))
            hit = hit | (F.startswith(low, F.lit(t)) if short else F.contains(low, F.lit(t)))
        out = out & hit
    return catalog.where(out)


def first_hits(rows: DataFrame, *order: str, most: int = MOST) -> DataFrame:
    """The first rows in scan order."""
    return rows.orderBy(*order).limit(most)
