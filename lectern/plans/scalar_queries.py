"""Numerals, dates, versions, colours, JSON properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import scalar as s
from lectern.plans.registry import query
from lectern.sources import tables as b
from lectern.sources.tables import oracle

# Numbers and their numerals.
NUMERALS = {1: "א", 15: "טו", 16: "טז", 115: "קטו", 272: "ערב", 744: "תדשם", 5784: "ה׳תשפד", 400: "ת", 999: "תתקצט", 304: "דש"}
READ = {"קטו": 115, "תת": -1, "ער": -1, "": 0, "יט": 19, "תשפד": 784}


@query("hebrew_numerals", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in NUMERALS.items()) + ") t(n, numeral)")
def hebrew_numerals(spark, sf):
    return spark.createDataFrame([(k,) for k in NUMERALS], "n int").select("n", s.to_numeral(F.col("n")).alias("numeral"))


@query("hebrew_numerals_read", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in READ.items()) + ") t(numeral, n)")
def hebrew_numerals_read(spark, sf):
    return spark.createDataFrame([(k,) for k in READ], "numeral string").select("numeral", s.from_numeral(F.col("numeral")).alias("n"))


@query("hebrew_numerals_round_trip", "SELECT p_partkey % 269 + 1 AS n, count(*) AS same FROM part GROUP BY 1")
def hebrew_numerals_round_trip(spark, sf):
    n = (F.col("p_partkey") % 269 + 1).alias("n")
    back = b.read(spark, sf, "part").select(n).withColumn("back", s.from_numeral(s.to_numeral(F.col("n"))))
    return back.groupBy("n").agg(F.sum((F.col("n") == F.col("back")).cast("long")).alias("same"))


# The calendar once more as SQL: days to the new year of each year, the lengths of its months, and days counted on from there.
_NUMERAL = "CASE WHEN {0} >= 400 THEN repeat('ת', ({0} // 400)::INT) || coalesce(substr('קרש', nullif(({0} % 400) // 100, 0)::INT, 1), '') ELSE coalesce(substr('קרש', nullif({0} // 100, 0)::INT, 1), '') END || CASE WHEN {0} % 100 = 15 THEN 'טו' WHEN {0} % 100 = 16 THEN 'טז' ELSE coalesce(substr('יכלמנסעפצ', nullif({0} % 100 // 10, 0)::INT, 1), '') || coalesce(substr('אבגדהוזחט', nullif({0} % 10, 0)::INT, 1), '') END"
_DATES = f"""WITH y AS (SELECT y, 29 * m + (12084 + 13753 * m) // 25920 AS d FROM (SELECT y, (235 * y - 234) // 19 AS m FROM range(5700, 5900) t(y))),
e AS (SELECT y, CASE WHEN 3 * (d + 1) % 7 < 3 THEN d + 1 ELSE d END AS d FROM y),
s AS (SELECT y, d + CASE WHEN lead(d) OVER w - d = 356 THEN 2 WHEN d - lag(d) OVER w = 382 THEN 1 ELSE 0 END AS d FROM e WINDOW w AS (ORDER BY y)),
years AS (SELECT y, d, lead(d) OVER (ORDER BY y) - d AS size, (7 * y + 1) % 19 < 7 AS leap FROM s),
months(k, name) AS (VALUES (1, 'תשרי'), (2, 'חשון'), (3, 'כסלו'), (4, 'טבת'), (5, 'שבט'), (6, 'אדר א'), (7, 'אדר ב'), (8, 'אדר'), (9, 'ניסן'), (10, 'אייר'), (11, 'סיון'), (12, 'תמוז'), (13, 'אב'), (14, 'אלול')),
lengths AS (SELECT y, d, k, name, CASE WHEN k = 2 AND size % 10 = 5 THEN 30 WHEN k = 2 THEN 29 WHEN k = 3 AND size % 10 = 3 THEN 29 WHEN k IN (1, 3, 5, 6, 9, 11, 13) THEN 30 ELSE 29 END AS n FROM years, months WHERE k NOT IN (6, 7, 8) OR leap = (k < 8)),
spans AS (SELECT *, d + sum(n) OVER (PARTITION BY y ORDER BY k) - n AS first FROM lengths),
days AS (SELECT DISTINCT o_orderdate::TIMESTAMP AS t, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719163 + 1373427 AS n FROM orders)
SELECT t, {_NUMERAL.format("(days.n - first + 1)")} || ' ' || name || ' ' || {_NUMERAL.format("(y % 1000)")} AS date, ['יום ראשון', 'יום שני', 'יום שלישי', 'יום רביעי', 'יום חמישי', 'יום שישי', 'שבת'][dayofweek(t) + 1] || ' ' || {_NUMERAL.format("(days.n - first + 1)")} || ' ' || name || ' ' || {_NUMERAL.format("(y % 1000)")} AS long_date, strftime(t, '%H:%M') AS clock
FROM days JOIN spans ON days.n >= spans.first AND days.n < spans.first + spans.n"""


@query("hebrew_dates", _DATES)
def hebrew_dates(spark, sf):
    days = b.read(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("t")).distinct()
    return days.select(F.col("t").cast("timestamp_ntz").alias("t"), s.hebrew_date_text(F.col("t")).alias("date"), s.hebrew_date_text(F.col("t"), True).alias("long_date"), F.date_format("t", "HH:mm").alias("clock"))


_PARTS = "list_transform(string_split(regexp_replace({0}, '^[vV]+', ''), '.'), lambda x: x::INT)"


@query("version_compare", f"SELECT p_partkey, CASE WHEN {_PARTS.format('v')} > {_PARTS.format(chr(39) + '4.3.2' + chr(39))} THEN 1 WHEN {_PARTS.format('v')} < {_PARTS.format(chr(39) + '4.3.2' + chr(39))} THEN -1 ELSE 0 END AS sign FROM (SELECT p_partkey, 'v' || p_size % 9 || '.' || p_partkey % 6 || '.' || p_partkey % 4 AS v FROM part)")
def version_compare(spark, sf):
    v = F.concat(F.lit("v"), F.col("p_size") % 9, F.lit("."), F.col("p_partkey") % 6, F.lit("."), F.col("p_partkey") % 4)
    return b.read(spark, sf, "part").select("p_partkey", s.compare_versions(v, F.lit("4.3.2")).alias("sign"))


_HEX = "printf('#%06X', (p_partkey * 7919 % 16777216)::INT)"


def _colours(spark, sf):
    return b.read(spark, sf, "part").select("p_partkey", F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0")).alias("colour"))


_RGB = "rgb AS (SELECT p_partkey, (x // 65536) AS r, (x // 256) % 256 AS g, x % 256 AS b FROM (SELECT p_partkey, p_partkey * 7919 % 16777216 AS x FROM part))"


@query("hex_bgr", f"WITH {_RGB} SELECT p_partkey, (b * 65536 + g * 256 + r)::INT AS bgr FROM rgb")
def hex_bgr(spark, sf):
    return _colours(spark, sf).select("p_partkey", s.hex_to_bgr(F.col("colour")).alias("bgr"))


@query("hex_bgr_round_trip", f"WITH {_RGB} SELECT p_partkey, printf('#%02X%02X%02X', r::INT, g::INT, b::INT) AS colour FROM rgb")
def hex_bgr_round_trip(spark, sf):
    return _colours(spark, sf).select("p_partkey", s.bgr_to_hex(s.hex_to_bgr(F.col("colour"))).alias("colour"))


@query("hex_valid", "SELECT page_id, regexp_matches(right(url, 6), '^[0-9A-Fa-f]{6}$') AS valid FROM pages")
def hex_valid(spark, sf):
    return b.read(spark, sf, "pages").select("page_id", s.is_hex(F.right("url", F.lit(6))).alias("valid"))


_HSL = f"""WITH {_RGB}, n AS (SELECT p_partkey, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM rgb), m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM n)
SELECT p_partkey, round(CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END / 6, 6) AS h,
  round(CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END, 6) AS s, round((hi + lo) / 2, 6) AS l FROM m"""


def _rgb(spark, sf):
    x = F.col("p_partkey") * 7919 % 16777216
    return b.read(spark, sf, "part").select("p_partkey", F.floor(x / 65536).alias("r"), (F.floor(x / 256) % 256).alias("g"), (x % 256).alias("b"))


@query("rgb_hsl", _HSL)
def rgb_hsl(spark, sf):
    made = _rgb(spark, sf).select("p_partkey", s.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b")).alias("x"))
    return made.select("p_partkey", *[F.round(f"x.{c}", 6).alias(c) for c in "hsl"])


@query("hsl_rgb_round_trip", f"WITH {_RGB} SELECT p_partkey, r::INT AS r, g::INT AS g, b::INT AS b FROM rgb")
def hsl_rgb_round_trip(spark, sf):
    x = s.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))
    made = _rgb(spark, sf).withColumn("x", x).select("p_partkey", s.hsl_to_rgb(F.col("x.h"), F.col("x.s"), F.col("x.l")).alias("y"))
    return made.select("p_partkey", "y.r", "y.g", "y.b")


@query("tint_grey", "SELECT n_nationkey, printf('#%02X%02X%02X', v, v, v) AS colour FROM (SELECT n_nationkey, floor((n_nationkey * 10 / 255.0::DOUBLE * 0.4::DOUBLE + 0.6::DOUBLE) * 255 + 0.5)::INT AS v FROM nation)")
def tint_grey(spark, sf):
    two = F.lpad(F.hex(F.col("n_nationkey") * 10), 2, "0")
    return b.read(spark, sf, "nation").select("n_nationkey", s.tint(F.concat(F.lit("#"), two, two, two), F.lit(0.4)).alias("colour"))


@query("theme_colours", "SELECT i, amount::DOUBLE AS amount, encoded, decoded FROM (VALUES (4, 0.0, -738131969, 4), (5, 0.4, -721354855, 5), (7, -0.5, -687832833, 7), (0, 0.0, -587137025, 13), (12, 0.0, NULL, NULL)) t(i, amount, encoded, decoded)")
def theme_colours(spark, sf):
    rows = spark.createDataFrame([(4, 0.0), (5, 0.4), (7, -0.5), (0, 0.0), (12, 0.0)], "i int, amount double")
    return rows.withColumn("encoded", s.theme_encode(F.col("i"), F.col("amount"))).withColumn("decoded", s.theme_decode(F.col("encoded"))["index"])


@query("contrast_colours", f"WITH {_RGB} SELECT p_partkey, CASE WHEN (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255 > 0.5 THEN '#000000' ELSE '#ffffff' END AS ink FROM rgb")
def contrast_colours(spark, sf):
    return _colours(spark, sf).select("p_partkey", s.contrast_colour(F.col("colour")).alias("ink"))


@query("json_properties", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, 'none' AS other FROM events")
def json_properties(spark, sf):
    return b.read(spark, sf, "events").select("event_id", s.json_property(F.col("props"), "K", "k", kind="int", default=-1).alias("k"), s.json_property(F.col("props"), "missing", default="none").alias("other"))


@query("elapsed_days", "SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 86400000000.0::DOUBLE AS days FROM events")
def elapsed_days(spark, sf):
    now = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return b.read(spark, sf, "events").select("event_id", ((now - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86_400_000_000.0)).alias("days"))


@query("clamped_range", "SELECT book_id, greatest(0, c - 200) AS first, least(n - 1, c + 200) AS last FROM (SELECT doc_id AS book_id, len(string_split(text, chr(10))) AS n, len(string_split(text, chr(10))) // 2 AS c FROM documents)")
def clamped_range(spark, sf):
    n = F.size(F.split("text", "\n", -1))
    counted = b.read(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), n.cast("long").alias("n"), F.floor(n / 2).alias("c"))
    return counted.select("book_id", F.greatest(F.lit(0), F.col("c") - 200).alias("first"), F.least(F.col("n") - 1, F.col("c") + 200).alias("last"))


@query("positional_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O'")
def positional_parameters(spark, sf):
    return b.statement(spark, "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = ? AND o_orderstatus = ?", [7, "O"], orders=b.read(spark, sf, "orders"))


@query("any_statement", oracle("SELECT k.title, count(*) AS n, max(t.content) AS last FROM link l JOIN book k ON k.id = l.target_book_id JOIN target_line t ON t.id = l.target_line_id WHERE l.connection_type_id = 3 GROUP BY 1 HAVING count(*) > 2"))
def any_statement(spark, sf):
    """A statement of joins and groups with parameters, over bound tables."""
    sql = "SELECT k.title, count(*) AS n, max(t.content) AS last FROM {link} l JOIN {book} k ON k.id = l.target_book_id JOIN {line} t ON t.id = l.target_line_id WHERE l.connection_type_id = ? GROUP BY 1 HAVING count(*) > ?"
    return b.statement(spark, sql, [3, 2], link=b.link(spark, sf), book=b.book(spark, sf), line=b.target_line(spark, sf))
