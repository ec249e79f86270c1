"""Catalog search, usage ranking, capped lists and the streamed history."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.scalar import popularity
from lectern.operators import catalog as ops
from lectern.operators import search
from lectern.plans.registry import query
from lectern.session import new_folder
from lectern.sources import files
from lectern.sources import tables as b
from lectern.sources.tables import oracle
from lectern.streaming import history as stream

#: The clock of the ranking: a fixed time after the last event.
NOW = "2024-01-31 00:00:00"
_NOW = f"TIMESTAMP '{NOW}'"
_SCORE = f"""floor(access_count * 10 + CASE WHEN ago < 1 THEN 50 WHEN ago < 7 THEN 25 WHEN ago < 30 THEN 10 ELSE 0 END + CASE WHEN age > 0 THEN access_count / age * 20 ELSE 0 END + 0.5)::BIGINT"""
_SCORED = f"scored AS (SELECT *, {_SCORE} AS score FROM (SELECT *, (epoch_us({_NOW}) - epoch_us(last_accessed)) / 86400000000.0 AS ago, (epoch_us({_NOW}) - epoch_us(first_accessed)) / 86400000000.0 AS age FROM history))"


def _now():
    return F.lit(NOW).cast("timestamp")


@query("popularity_scores", oracle("SELECT id, score FROM scored", _SCORED))
def popularity_scores(spark, sf):
    return b.history(spark, sf).select("id", popularity(F.col("access_count"), F.col("last_accessed"), F.col("first_accessed"), _now()).alias("score"))


@query("popularity_ranked", oracle("SELECT c.id, c.title, c.author, s.access_count, s.score FROM catalog c JOIN scored s ON s.id = c.id ORDER BY s.score DESC, c.title, c.id LIMIT 50", _SCORED))
def popularity_ranked(spark, sf):
    return ops.ranked(b.catalog(spark, sf), b.history(spark, sf), _now())


@query("user_interactions", oracle("SELECT c.id, c.title, coalesce(h.access_count, 0) AS access_count, h.last_accessed FROM catalog c LEFT JOIN history h ON h.id = c.id"))
def user_interactions(spark, sf):
    return ops.with_usage(b.catalog(spark, sf), b.history(spark, sf)).select("id", "title", "access_count", "last_accessed")


@query("used_catalog", oracle("SELECT c.id, c.title FROM catalog c WHERE c.id IN (SELECT id FROM history)"))
def used_catalog(spark, sf):
    return b.catalog(spark, sf).join(b.history(spark, sf).select("id"), "id", "left_semi").select("id", "title")


@query("history_all", oracle("SELECT * FROM history"))
def history_all(spark, sf):
    return b.history(spark, sf)


@query("history_entry", oracle("SELECT * FROM history WHERE id = 17"))
def history_entry(spark, sf):
    return ops.history_of(b.read(spark, sf, "events").where("user_id = 17"))


@query("history_size", oracle("SELECT count(*) AS n FROM history"))
def history_size(spark, sf):
    return b.history(spark, sf).agg(F.count("*").alias("n"))


@query("history_lru", oracle("SELECT id, access_count, last_accessed FROM history ORDER BY last_accessed DESC, id LIMIT 100"))
def history_lru(spark, sf):
    return ops.newest(b.history(spark, sf)).select("id", "access_count", "last_accessed")


@query("history_evicted", oracle("SELECT id FROM history WHERE id NOT IN (SELECT id FROM history ORDER BY last_accessed DESC, id LIMIT 100)"))
def history_evicted(spark, sf):
    h = b.history(spark, sf)
    return h.join(ops.newest(h).select("id"), "id", "left_anti").select("id")


@query("history_merged", oracle("SELECT * FROM history"))
def history_merged(spark, sf):
    """Counters of two batches merged: the same as of all events."""
    e = b.read(spark, sf, "events")
    old, new = (ops.history_of(e.where(f"event_id % 3 {op} 0")) for op in ("=", "<>"))
    return ops.merge_history(old, new)


@query("recent_searches", "SELECT user_id AS value, max(ts) AS used FROM events GROUP BY 1 ORDER BY used DESC, value LIMIT 10")
def recent_searches(spark, sf):
    return ops.recent_values(b.read(spark, sf, "events").select(F.col("user_id").alias("value"), "ts"), "value", "ts")


@query("recent_without_value", "SELECT user_id AS value, max(ts) AS used FROM events WHERE user_id <> 5 GROUP BY 1 ORDER BY used DESC, value LIMIT 10")
def recent_without_value(spark, sf):
    return ops.recent_values(b.read(spark, sf, "events").select(F.col("user_id").alias("value"), "ts").where("value <> 5"), "value", "ts")


@query("recent_colours", "SELECT event_type AS colour, max(ts) AS used FROM events GROUP BY 1 ORDER BY used DESC, colour LIMIT 8")
def recent_colours(spark, sf):
    return ops.recent_values(b.read(spark, sf, "events").withColumnRenamed("event_type", "colour"), "colour", "ts", 8)


@query("whitelist_override", oracle("SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey % 8 = 0 ELSE true END AS is_visible FROM nation"))
def whitelist_override(spark, sf):
    base = b.read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit(True).alias("is_visible"))
    own = b.read(spark, sf, "nation").where("n_nationkey % 4 = 0").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 8 == 0).alias("is_visible"))
    return ops.overridden(base, own, "name", "is_visible")


@query("whitelist_all_selected", "SELECT bool_and(n_nationkey % 4 > 0) AS every_one, bool_or(n_nationkey % 4 > 0) AS some FROM nation")
def whitelist_all_selected(spark, sf):
    shown = F.col("n_nationkey") % 4 > 0
    return b.read(spark, sf, "nation").agg(F.every(shown).alias("every_one"), F.some(shown).alias("some"))


_ANY = "(contains(lower(title), '{0}') OR contains(lower(author), '{0}') OR contains(lower(tags), '{0}'))"


@query("catalog_search_prefix", oracle("SELECT id, title FROM catalog WHERE starts_with(lower(title), 'red') OR starts_with(lower(author), 'red') OR starts_with(lower(tags), 'red')"))
def catalog_search_prefix(spark, sf):
    return search.catalog_search(b.catalog(spark, sf), " Red ").select("id", "title")


@query("catalog_search_terms", oracle(f"SELECT id, title FROM catalog WHERE {_ANY.format('red')} AND {_ANY.format('brand#1')} ORDER BY title, id LIMIT 100"))
def catalog_search_terms(spark, sf):
    return search.catalog_search(b.catalog(spark, sf), "red brand#1").select("id", "title").orderBy("title", "id").limit(search.MOST)


@query("catalog_search_long", oracle(f"SELECT id FROM catalog WHERE {_ANY.format('brand')}"))
def catalog_search_long(spark, sf):
    return search.catalog_search(b.catalog(spark, sf), "brand").select("id")


@query("catalog_by_locale", oracle("SELECT id, title FROM catalog ORDER BY title, id LIMIT 50"))
def catalog_by_locale(spark, sf):
    """Titles in the order of a locale; ids break ties."""
    return b.catalog(spark, sf).select("id", "title").orderBy(ops.by_locale("title"), "id").limit(50)


@query("catalog_tags", oracle("SELECT id, tag FROM catalog, unnest(list_filter(list_transform(string_split(tags, ' '), lambda x: trim(x)), lambda x: x <> '')) u(tag)"))
def catalog_tags(spark, sf):
    from lectern.functions.text import tag_array

    return b.catalog(spark, sf).select("id", F.explode(tag_array(F.replace("tags", F.lit(" "), F.lit(" \\ ")))).alias("tag"))


@query("families_sorted", "SELECT DISTINCT p_brand AS family FROM part")
def families_sorted(spark, sf):
    return b.read(spark, sf, "part").select(F.col("p_brand").alias("family")).distinct().orderBy("family")


@query("family_suggestions", "SELECT DISTINCT p_brand AS family FROM part WHERE contains(lower(p_brand), 'd#1') ORDER BY 1 LIMIT 10")
def family_suggestions(spark, sf):
    return b.read(spark, sf, "part").select(F.col("p_brand").alias("family")).distinct().where(F.contains(F.lower("family"), F.lit("d#1"))).orderBy("family").limit(10)


@query("families_script_first", "SELECT p_brand AS family, min(p_size) <= 1 AS supported FROM part GROUP BY 1 ORDER BY NOT supported, family LIMIT 12")
def families_script_first(spark, sf):
    fonts = b.read(spark, sf, "part").groupBy(F.col("p_brand").alias("family")).agg((F.min("p_size") <= 1).alias("supported"))
    return fonts.orderBy(F.when(F.col("supported"), 0).otherwise(1), "family").limit(12)


@query("lowest_free_id", "SELECT min(x) AS free FROM range(1, 100000) t(x) WHERE x NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 13)")
def lowest_free_id(spark, sf):
    return ops.lowest_free(b.read(spark, sf, "orders").where("o_orderkey % 97 <> 13"), "o_orderkey")


@query("styles_distinct", "SELECT lower(p_brand) AS style, arg_min(p_partkey, p_partkey) AS first_id, NOT (min(p_partkey) % 2 = 0 AND starts_with(lower(p_brand), 'brand#1')) AS on_by_default FROM part GROUP BY 1")
def styles_distinct(spark, sf):
    first = ops.distinct_by_name(b.read(spark, sf, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey")
    off = (F.col("p_partkey") % 2 == 0) & F.startswith(F.lower("p_brand"), F.lit("brand#1"))
    return first.select(F.lower("p_brand").alias("style"), F.col("p_partkey").alias("first_id"), (~off).alias("on_by_default"))


@query("persisted_kinds", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def persisted_kinds(spark, sf):
    return b.read(spark, sf, "events").where(F.col("event_type").isin("view", "click", "purchase")).select("event_id", "event_type")


def _stream(spark, sf, name, **options):
    return spark.readStream.schema(b.read(spark, sf, name).schema).options(**options).parquet(f"{sf}/{name}.parquet*")


def _plain(df):
    """Timestamps without a zone, as the tables have them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@query("stream_history", oracle("SELECT * FROM history"))
def stream_history(spark, sf):
    """The streamed counters over all events: complete mode, so they equal the batch result."""
    return _plain(stream.collected(stream.counters(_stream(spark, sf, "events")), new_folder(spark, "history"), "complete"))


@query("stream_newest", oracle("SELECT * FROM history ORDER BY last_accessed DESC, id LIMIT 100"))
def stream_newest(spark, sf):
    """The streamed history after eviction: the newest keys."""
    path = new_folder(spark, "newest")
    stream.keep_history(_stream(spark, sf, "events"), f"{path}/rows", f"{path}/state").awaitTermination()
    return _plain(ops.newest(spark.read.parquet(f"{path}/rows/*")))


@query("stream_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, sf):
    """Bursts of events with gaps of under six hours, of the whole stream."""
    return _plain(stream.collected(stream.sessions(_stream(spark, sf, "events"), gap="6 hours"), new_folder(spark, "sessions"), "complete"))


@query("stream_first_events", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_first_events(spark, sf):
    """A stream that brings each event twice, without the second ones."""
    events = _stream(spark, sf, "events").select("event_id", "event_type", "ts")
    first = stream.collected(stream.first_lines(events.union(events), "ts", "event_id").drop("ts"), new_folder(spark, "first"))
    return first.groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_search", oracle("SELECT id, total FROM (SELECT id, (length(s) - length(replace(s, 'th', ''))) // 2 AS total FROM (SELECT id, lower(regexp_replace(content, '<[^>]*>', '', 'g')) AS s FROM line)) WHERE total > 0"))
def stream_search(spark, sf):
    """Lines that load in batches, each searched as it comes in: the lines with matches, and how many each has."""
    lines = _stream(spark, sf, "documents", maxFilesPerTrigger=1).select(F.col("doc_id").alias("book_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_index", "content"))
    lines = lines.select((F.col("book_id") * b.LINES + F.col("line_index")).alias("id"), "content")
    found = stream.searched(lines, "TH").where("occurrence = 0").select("id", F.col("total").cast("long").alias("total"))
    return stream.collected(found, new_folder(spark, "search"))


@query("file_cache_kept", oracle("SELECT id, last_accessed FROM history ORDER BY last_accessed DESC, id LIMIT 10"))
def file_cache_kept(spark, sf):
    """The files that a cache of ten keeps."""
    return ops.newest(b.history(spark, sf), ops.FILES).select("id", "last_accessed")


@query("store_upsert", oracle("SELECT id, CASE WHEN id % 3 = 0 THEN access_count + 100 ELSE access_count END AS access_count FROM history WHERE id % 2 = 0 OR id % 3 = 0"))
def store_upsert(spark, sf):
    """Rows put into a keyed store replace those of their key."""
    h = b.history(spark, sf).select("id", "access_count")
    return files.put(h.where("id % 2 = 0"), h.where("id % 3 = 0").withColumn("access_count", F.col("access_count") + 100), "id")


@query("store_cleared", "SELECT 0 AS n")
def store_cleared(spark, sf):
    return files.clear(b.history(spark, sf)).agg(F.count("*").alias("n"))


@query("list_without", "SELECT p_partkey FROM part WHERE NOT (p_size < 10 AND p_brand <> 'Brand#1')")
def list_without(spark, sf):
    """A list after a conditional delete."""
    return files.remove_all(b.read(spark, sf, "part"), (F.col("p_size") < 10) & (F.col("p_brand") != "Brand#1")).select("p_partkey")


@query("first_match", oracle("SELECT id, title FROM catalog WHERE starts_with(title, 'red') ORDER BY title, id LIMIT 1"))
def first_match(spark, sf):
    return files.first_match(b.catalog(spark, sf).select("id", "title"), F.startswith("title", F.lit("red")), "title", "id")


# Scores and titles, and their places by score and locale.
RANKS = {"b": (5, 3), "B": (5, 4), "a": (5, 1), "é": (5, 6), "e": (5, 5), "A": (5, 2), "z": (9, 0)}


@query("popularity_by_locale", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {p})" for t, (_, p) in RANKS.items()) + ") t(title, place)")
def popularity_by_locale(spark, sf):
    """Equal scores are in the order of a locale, not of bytes."""
    rows = spark.createDataFrame([(t, s) for t, (s, _) in RANKS.items()], "title string, score int")
    ranked = rows.orderBy(F.desc("score"), ops.by_locale("title")).agg(F.collect_list("title").alias("titles"))
    return ranked.select(F.posexplode("titles").alias("place", "title")).select("title", "place")
