"""Golden cases of the functions, read off the behaviour they must show."""

import datetime

import pytest
from pyspark.sql import functions as F

from lectern.functions import scalar as s
from lectern.functions import text as t


def _apply(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"a {kind}").select(f(F.col("a"))).collect()]


def test_marks_and_display(spark):
    assert _apply(spark, t.remove_marks, ["שָׁלוֹם֙", "א־ב", None]) == ["שלום", "אב", None]
    assert _apply(spark, lambda c: t.display_filter(c, 0), ["בְּרֵ֖אשִׁית!"]) == ["בְּרֵ֖אשִׁית!"]
    assert _apply(spark, lambda c: t.display_filter(c, 1), ["בְּרֵ֖אשִׁית!"]) == ["בְּרֵאשִׁית!"]
    assert _apply(spark, lambda c: t.display_filter(c, 2), ["בְּרֵ֖אשִׁית!", '<a href="x?y">!—</a>']) == ["בראשית.", '<a href="x?y">.</a>']


def test_censor(spark):
    names = ["יהוה", "אדני", "אלהים", "אלוהים", "אלהי", "אלוה", "אלוהי", "אלהים אחרים", "אלוהים אחרים", "אֱלוֹהִים אֲחֵרִים"]
    want = ["יקוק", "אדנ-י", "אלקים", "אלוקים", "אלקי", "אלוק", "אלוהי", "אלקים אחרים", "אלוהים אחרים", "אֱלוֹקִים אֲחֵרִים"]
    assert _apply(spark, t.censor, names) == want
    assert _apply(spark, lambda c: t.censor(c, True), ["אלהים אחרים"]) == ["אלהים אחרים"]


def test_highlight_is_leftmost_and_outside_tags(spark):
    assert _apply(spark, lambda c: t.highlight(c, "aa"), ["aaaa", '<i id="aa">aa</i>']) == ["<mark>aa</mark><mark>aa</mark>", '<i id="aa"><mark>aa</mark></i>']


def test_small_text_functions(spark):
    assert _apply(spark, t.sanitize_file_name, [None, "x" * 150, "a/b:c", "***"]) == ["unknown", "x" * 100, "abc", "unknown"]
    assert _apply(spark, t.heading_level, [0, 3, 9], "int") == [2, 5, 6]
    assert _apply(spark, t.tag_separator, ["a;b"]) == ["a \\ b"]
    assert _apply(spark, t.tag_array, ["a \\ b\\\\ c"]) == [["a", "b", "c"]]


def test_numerals(spark):
    assert _apply(spark, s.to_numeral, [1, 15, 16, 115, 272, 744, 5784, 0, -3], "int") == ["א", "טו", "טז", "קטו", "ערב", "תדשם", "ה׳תשפד", "", ""]
    assert _apply(spark, s.from_numeral, ["קטו", "תת", "ער", ""]) == [115, -1, -1, 0]
    n = spark.range(1, 1000).select("id", s.from_numeral(s.to_numeral(F.col("id"))).alias("back")).where("id <> back")
    assert n.agg(F.min("id"), F.count("*")).first() == (270, 226)


@pytest.mark.parametrize(("day", "want"), [("2025-09-23", (5786, 7, 1)), ("2024-03-25", (5784, 13, 15)), ("2024-02-10", (5784, 12, 1)), ("2023-09-16", (5784, 7, 1))])
def test_calendar(day, want):
    assert s.hebrew_date(datetime.date.fromisoformat(day)) == want


def test_dates_as_text(spark):
    d = spark.createDataFrame([(datetime.datetime(2024, 3, 25),), (None,)], "t timestamp")
    assert [tuple(r) for r in d.select(s.hebrew_date_text(F.col("t")), s.hebrew_date_text(F.col("t"), True)).collect()] == [("טו אדר ב תשפד", "יום שני טו אדר ב תשפד"), (None, None)]


def test_versions_and_colours(spark):
    assert _apply(spark, lambda c: s.compare_versions(c, F.lit("1.9.9")), ["v1.10.0", "1.9.9", "1.9", "1.9.9-beta"]) == [1, 0, -1, 1]
    assert _apply(spark, s.hex_to_bgr, ["#C00010", "C00010", "xyz"]) == [1048768, 1048768, None]
    assert _apply(spark, s.bgr_to_hex, [1048768, 0], "int") == ["#C00010", "#000000"]
    row = spark.range(1).select(s.theme_encode(F.lit(4), F.lit(0.0)), s.theme_encode(F.lit(12), F.lit(0.0)), s.theme_decode(F.lit(-738131969))["index"], s.theme_decode(F.lit(5))).first()
    assert tuple(row) == (-738131969, None, 4, None)


def test_popularity(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    ago = lambda d: F.timestamp_micros(F.unix_micros(now) - F.lit(int(d * 86_400_000_000)))
    score = lambda n, last, first: spark.range(1).select(s.popularity(F.lit(n), ago(last), ago(first), now)).first()[0]
    assert score(3, 0.5, 10) == 86
    assert score(1, 40, 40) == 11
    assert [score(0, d, 0) for d in (1, 7, 30)] == [25, 10, 0]
