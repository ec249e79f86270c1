"""Text transforms over pages, lines and literal inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as f
from lectern.plans.registry import query
from lectern.session import new_folder
from lectern.sources import files
from lectern.sources import tables as b
from lectern.sources.tables import oracle

# Inputs in Hebrew, as the documents hold none, and what must come out.
MARKED = {"שָׁלוֹם֙": "שלום", "א־ב": "אב", "abc": "abc"}
NAMES = {"יהוה": "יקוק", "אדני": "אדנ-י", "אלהים": "אלקים", "אלוהים": "אלוקים", "אלהי": "אלקי", "אלוה": "אלוק", "אלוהי": "אלוהי", "אלהים אחרים": "אלקים אחרים", "אלוהים אחרים": "אלוהים אחרים"}


def _values(pairs: dict, *names: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + str(x) + "'" for x in kv) + ")" for kv in pairs.items()) + f") t({', '.join(names)})"


@query("strip_html", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def strip_html(spark, sf):
    return b.read(spark, sf, "pages").select("page_id", f.strip_tags(F.col("html")).alias("text"))


@query("strip_html_decoded", "SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS text FROM pages")
def strip_html_decoded(spark, sf):
    return b.read(spark, sf, "pages").select("page_id", f.strip_html(F.col("html")).alias("text"))


@query("remove_marks", _values(MARKED, "text", "plain"))
def remove_marks(spark, sf):
    return spark.createDataFrame([(k,) for k in MARKED], "text string").select("text", f.remove_marks(F.col("text")).alias("plain"))


@query("is_mark", "SELECT * FROM (VALUES ('ָ', true), ('א', false), ('a', false)) t(c, mark)")
def is_mark(spark, sf):
    return spark.createDataFrame([("ָ",), ("א",), ("a",)], "c string").select("c", f.is_mark(F.col("c")).alias("mark"))


@query("display_filter", "SELECT * FROM (VALUES (0, 'בְּרֵ֖אשִׁית!'), (1, 'בְּרֵאשִׁית!'), (2, 'בראשית.')) t(state, text)")
def display_filter(spark, sf):
    one = spark.createDataFrame([("בְּרֵ֖אשִׁית!",)], "t string")
    shown = [one.select(F.lit(s).alias("state"), f.display_filter(F.col("t"), s).alias("text")) for s in range(3)]
    return shown[0].union(shown[1]).union(shown[2])


@query("display_filter_lines", oracle("SELECT id, '<a title=\"Wow! — why?\">' || replace(regexp_replace(content, '[?!]', '.', 'g'), '—', '') || '</a>' AS text FROM line"))
def display_filter_lines(spark, sf):
    """All lines, each inside of markup whose attribute must stay as it is."""
    marked = F.concat(F.lit('<a title="Wow! — why?">'), "content", F.lit("</a>"))
    return b.line(spark, sf).select("id", f.display_filter(marked, 2).alias("text"))


@query("censor", _values(NAMES, "text", "censored"))
def censor(spark, sf):
    return spark.createDataFrame([(k,) for k in NAMES], "text string").select("text", f.censor(F.col("text")).alias("censored"))


@query("highlight", "SELECT p_partkey, regexp_replace(p_name, '(?i)red', '<mark>\\0</mark>', 'g') AS html FROM part")
def highlight(spark, sf):
    return b.read(spark, sf, "part").select("p_partkey", f.highlight(F.col("p_name"), "RED").alias("html"))


@query("sanitize_filename", "SELECT page_id, coalesce(nullif(left(regexp_replace(url, '[\\x00-\\x1F\"<>|:*?\\\\/]', '', 'g'), 100), ''), 'unknown') AS name FROM pages")
def sanitize_filename(spark, sf):
    return b.read(spark, sf, "pages").select("page_id", f.sanitize_file_name(F.col("url")).alias("name"))


@query("tag_separators", "SELECT p_partkey, replace(replace(p_type, ' ', ';'), ';', ' \\ ') AS tags FROM part")
def tag_separators(spark, sf):
    return b.read(spark, sf, "part").select("p_partkey", f.tag_separator(F.replace("p_type", F.lit(" "), F.lit(";"))).alias("tags"))


@query("joined_list", "SELECT p_partkey, replace(p_type, ' ', ' \\ ') || ' ' AS tags FROM part")
def joined_list(spark, sf):
    return b.read(spark, sf, "part").select("p_partkey", f.joined_list(F.split("p_type", " ")).alias("tags"))


@query("first_words", oracle("SELECT id, string_split(content, ' ')[1] AS word FROM line"))
def first_words(spark, sf):
    return b.line(spark, sf).select("id", f.first_word(F.col("content")).alias("word"))


@query("remove_breaks", "SELECT n_nationkey, n_name || 'x' AS text FROM nation")
def remove_breaks(spark, sf):
    made = F.concat("n_name", F.lit("\u000b "), F.lit("x\t"))
    return b.read(spark, sf, "nation").select("n_nationkey", f.remove_breaks(made).alias("text"))


@query("footnote_marks", "SELECT n_nationkey, n_name || chr(160) || chr(2) || 'x' AS text FROM nation")
def footnote_marks(spark, sf):
    return b.read(spark, sf, "nation").select("n_nationkey", f.footnote_space(F.concat("n_name", F.lit("  \u0002 x"))).alias("text"))


@query("quoted_name", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'font ' || n_name END AS name FROM nation")
def quoted_name(spark, sf):
    made = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("'"), "n_name", F.lit("', serif"))).otherwise(F.concat(F.lit("font "), "n_name"))
    return b.read(spark, sf, "nation").select("n_nationkey", f.quoted_name(made).alias("name"))


@query("direction", "SELECT * FROM (VALUES ('שלום abc', 'rtl'), ('abc', 'ltr'), ('مرحبا', 'rtl'), ('--', 'none'), ('été', 'ltr')) t(text, flow)")
def direction(spark, sf):
    return spark.createDataFrame([(x,) for x in ("שלום abc", "abc", "مرحبا", "--", "été")], "text string").select("text", f.direction(F.col("text"), "none").alias("flow"))


@query("heading_levels", "SELECT n_nationkey, greatest(2, least(6, n_nationkey + 2)) AS level FROM nation")
def heading_levels(spark, sf):
    return b.read(spark, sf, "nation").select("n_nationkey", f.heading_level(F.col("n_nationkey")).alias("level"))


@query("rows_as_json", "SELECT n_nationkey, '{\"nNationkey\":' || n_nationkey || ',\"nName\":\"' || n_name || '\"}' AS json FROM nation")
def rows_as_json(spark, sf):
    rows = b.read(spark, sf, "nation").select("n_nationkey", "n_name")
    return rows.select("n_nationkey", files.as_json(rows).alias("json"))


@query("json_round_trip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_round_trip(spark, sf):
    parsed = b.read(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return parsed.select("event_id", F.from_json(F.to_json("p"), "k long")["k"].alias("k"))


@query("json_lines_written", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def json_lines_written(spark, sf):
    """A table written as JSON and read again with its types."""
    path = new_folder(spark, "json")
    files.write_json(b.read(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), path)
    return files.read_json(spark, path, "key long, name string, region long", lines=True)


@query("catalog_csv_written", "SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand || ', \"x\"' AS author, replace(p_type || ';b', ';', ' \\ ') AS tags FROM part")
def catalog_csv_written(spark, sf):
    """The catalog written as rows by position, with separators and quotes in values, and read again."""
    blank = F.lit("p")
    rows = b.read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.concat("p_brand", F.lit(', "x"')).alias("author"), blank.alias("printing_place"), blank.alias("printing_year"), blank.alias("pages"), F.concat("p_type", F.lit(";b")).alias("tags"))
    path = new_folder(spark, "csv")
    files.write_catalog_csv(rows, path)
    return files.catalog_csv(spark, path).select("id", "title", "author", "tags")


@query("typed_record", "SELECT p_partkey, p_name AS tag, p_brand AS asset, 2 AS n_assets FROM part")
def typed_record(spark, sf):
    """A fetched JSON text as a typed record with a nested list; unknown fields are ignored."""
    text = F.to_json(F.struct(F.col("p_name").alias("tag_name"), F.lit(1).alias("other"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit("z").alias("name"))).alias("assets")))
    made = b.read(spark, sf, "part").select("p_partkey", F.from_json(text, "tag_name string, assets array<struct<name: string, url: string>>").alias("r"))
    return made.select("p_partkey", F.col("r.tag_name").alias("tag"), F.get("r.assets.name", F.lit(0)).alias("asset"), F.size("r.assets").alias("n_assets"))
