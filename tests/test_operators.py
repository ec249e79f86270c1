"""Operators on small tables: edges, invariants, files and streams."""

from pyspark.sql import functions as F

from lectern.operators import catalog, intervals, library, regexfind, search, tree
from lectern.sources import files
from lectern.streaming import history


def test_search_counts_overlaps_and_numbers_matches(spark):
    items = spark.createDataFrame([(7, "<b>ab</b> ab"), (8, "a<b>b</b>"), (9, None)], "id int, content string")
    assert sorted(map(tuple, search.matches(items, "AB").collect())) == [(7, 0, 2), (7, 1, 2), (8, 0, 1)]
    assert search.matches(items, "  ").count() == 0
    placed = search.ordinals(search.matches(items, "ab"), "id")
    assert sorted(r.ordinal for r in placed.collect()) == [0, 1, 2]


def test_whole_words_and_prefixes(spark):
    d = spark.createDataFrame([("red ring",), ("reddish",), ("infrared",), ('ש"ס',)], "t string")
    assert [r.t for r in d.where(search.whole_words(F.col("t"), "red")).collect()] == ["red ring"]
    assert d.where(search.whole_words(F.col("t"), "שס")).count() == 1
    c = spark.createDataFrame([("abcde f", "x", "y"), ("zabcd", "x", "y"), ("zabcde", None, "y")], "title string, author string, tags string")
    assert search.catalog_search(c, "abcd").count() == 1
    assert search.catalog_search(c, "abcde").count() == 2


def test_tree_is_independent_of_order_and_reports_orphans(spark):
    n = spark.createDataFrame([(3, 2, "C", 0), (2, 1, "B", 0), (1, None, "A", 0), (9, 77, "lost", 0)], "id int, parent_id int, title string, order_index int")
    assert {r.id: r.path for r in tree.paths(n).collect()} == {1: "A", 2: "A > B", 3: "A > B > C"}
    assert {r.id: r.path for r in tree.paths(n, include_self=False).collect()} == {1: "", 2: "A", 3: "A > B"}
    assert [r.id for r in tree.orphans(n).collect()] == [9]


def test_tri_state(spark):
    d = spark.createDataFrame([(1, True), (1, True), (2, False), (3, True), (3, False), (4, True), (4, None)], "k int, f boolean")
    assert {r.k: r.state for r in tree.tri_state(d, "k", "f").collect()} == {1: True, 2: False, 3: None, 4: None}


def test_commentary_groups(spark):
    d = spark.createDataFrame([(1, 10, 1, "A", "x", 5), (2, 11, 1, "A", "y", 6), (3, 12, 1, None, "z", 7)], "target_line_id int, target_book_id int, connection_type_id int, title string, content string, line_index int")
    got = {r.group: (r.target_book_id, r.n_links) for r in library.commentary_groups(d).collect()}
    assert got == {"A": (10, 2), "אחר": (12, 1)}


def test_missing_ranges(spark):
    d = spark.createDataFrame([(0, 2), (0, 3), (0, 6), (0, 6)], "k int, i int")
    assert sorted((r.start, r.end) for r in intervals.missing_ranges(d, "k", "i", 0, 8).collect()) == [(0, 1), (4, 5), (7, 8)]


def test_regex_find_and_navigation(spark):
    d = spark.createDataFrame([(1, "a" * 100 + "é hit " + "b" * 100 + "hit"), (2, None)], "id int, text string")
    got = sorted(regexfind.find_all(d, "hit").collect())
    assert [(r.start, r.length) for r in got] == [(102, 3), (206, 3)]
    assert got[0].snippet == "a" * 73 + "é <b>hit</b> " + "b" * 74
    assert [(r.start, r.match) for r in sorted(regexfind.find_offsets(d, "hit").collect())] == [(102, "hit"), (206, "hit")]
    starts = spark.createDataFrame([(1, 5), (1, 10), (1, 20)], "id int, start int")
    at = lambda p: tuple(regexfind.neighbour(starts, p).select("next", "previous").first())
    assert [at(10), at(20), at(5)] == [(20, 5), (5, 10), (10, 20)]


def test_slop_and_literal(spark):
    d = spark.createDataFrame([("שלום לכם רב",), ("שלום רב",), ("שלום א ב ג רב",)], "t string")
    assert [r[0] for r in d.select(F.col("t").rlike(regexfind.slop_pattern("שלום רב", 2))).collect()] == [True, True, False]
    assert spark.range(1).where(F.lit("a.b\\Ec").rlike(regexfind.literal(".b\\E"))).count() == 1


def test_formats(spark):
    runs = spark.createDataFrame([(0, -1, 12.0, 10.0, "x")], "bold int, bold_bi int, size float, size_bi float, style string")
    ok = lambda **w: runs.where(regexfind.format_matches(**w)).count() == 1
    assert not ok(bold=False) and ok(bold=True) and ok(size=10.005) and not ok(size=11.0) and ok(style=None) and ok(style="x")
    assert regexfind.assign_format(runs, bold=1, style=None).first().style == "x"


def test_replace(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(regexfind.replace_first(F.lit("ab ab"), "(a)(b)", "$2$1")) == "ba ab"
    assert one(regexfind.replace_all(F.lit("ab ab"), "(a)(b)", "$2$1")) == "ba ba"


def test_popular_view_without_history_is_empty(spark):
    c = spark.createDataFrame([(1, "t", "a", "g")], "id long, title string, author string, tags string")
    h = spark.createDataFrame([], "id long, access_count long, last_accessed timestamp, first_accessed timestamp")
    assert catalog.ranked(c, h, F.current_timestamp()).count() == 0
    assert catalog.with_usage(c, h).first().access_count == 0


def test_lowest_free(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert [catalog.lowest_free(ids(*x)).first().free for x in ((1, 2, 4), (2, 3), (), (1, 2, 3))] == [3, 1, 1, 4]


def test_csv_arity(spark, tmp_path):
    (tmp_path / "c.csv").write_text('1,t,a,p,y,9,a;b\n2,t,a,p,y,9\n3, ,a,p,y,9,x\n4,"t, u",a,p,y,9,x,more\n5,t,a,p,y,9,\n6,"t,u",a,p,y,9\n')
    got = {r.id: r.tags for r in files.catalog_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"1": "a \\ b", "4": "x", "5": ""}


def test_json_and_batches(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "some_id int, the_name string")
    assert sorted(r[0] for r in d.select(files.as_json(d)).collect()) == ['{"someId":1,"theName":"a"}', '{"someId":2,"theName":null}']
    files.write_json(d, str(tmp_path / "j"))
    assert spark.read.schema("some_id int, the_name string").json(str(tmp_path / "j")).count() == 2
    assert [len(x) for x in files.batches(spark.range(450), "id")] == [200, 200, 50]


def test_put_replaces_rows_of_a_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, files.put(a, b, "k").collect())) == [(1, "x"), (2, "z"), (3, "w")]


def test_streamed_history_keeps_the_newest(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(src))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = history.keep_history(events, str(tmp_path / "out"), str(tmp_path / "ck"), keep=1000)
    q.awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    got = {r.id: r.access_count for r in spark.read.parquet(str(tmp_path / "out" / str(last))).collect()}
    want = {r.id: r.access_count for r in catalog.history_of(spark.read.parquet(str(src))).collect()}
    assert last == 2 and got == want


def test_regex_over_lines_beyond_ascii(spark):
    import re

    from lectern.plans import search_queries as q

    texts = ["the cat and thé théâtre", "Then thëse the été and them", "über the die and", "théand the x y z and", "the über x and", "plain then that", None, "", "éthen them"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    want = {i: n for i, t in enumerate(texts) if (n := len(re.findall(q.PATTERN, t or "")))}
    assert {r.id: r.n for r in q.count_by_line(d).collect()} == want
    assert {r.id for r in q.slop(d).collect()} == {i for i, t in enumerate(texts) if re.search(r'the\b\W+(?:[\w"]+\W+){0,2}and', t or "")}


def test_replace_first_keeps_the_pattern_as_it_is(spark):
    one = lambda *x: spark.range(1).select(regexfind.replace_first(F.lit(x[0]), x[1], x[2])).first()[0]
    assert one("a\nb", "a.b", "X") == "a\nb"
    assert one("xaby ab", "(a)b", "[$0]") == "x[ab]y ab"
    assert one("xyy aa", r"(\w)\1", "Z") == "xZ aa"
    assert one("1é2", r"\p{L}", "L") == "1L2"
    assert one("foo bar foo", "(?<=bar )foo", "$0!") == "foo bar foo!"
    assert one("a\nb\nc", "^(b)$", r"\$1$1") == "a\n$1b\nc"
    assert one("😀 x x", "x", "y") == "😀 y x"
    assert one("abc", "z*", "-") == "-abc" and one("abc", "(?i)B|q", "-") == "a-c"


def test_versions_with_large_parts(spark):
    from lectern.functions.scalar import compare_versions

    one = lambda a, b: spark.range(1).select(compare_versions(F.lit(a), F.lit(b))).first()[0]
    assert [one("1.99999999999", "1.2"), one("v1.10", "1.9"), one("1.2", "v1.2"), one("1.9", "1.10"), one("a", "B")] == [1, 1, 0, -1, -1]


def test_hebrew_dates_once_a_day(spark):
    from datetime import datetime

    from lectern.functions.scalar import hebrew_date_text

    d = spark.createDataFrame([(datetime(2024, 10, 3, 5),), (datetime(2024, 10, 3, 9),), (None,), (datetime(2024, 3, 24),)], "t timestamp")
    assert [r[0] for r in d.coalesce(1).select(hebrew_date_text(F.col("t"))).collect()] == ["א תשרי תשפה", "א תשרי תשפה", None, "יד אדר ב תשפד"]


def test_places_and_running_totals(spark):
    from lectern.operators import ordering

    d = spark.createDataFrame([(k * 7 % 101, f"v{k}", 5) for k in range(101)], "k int, place string, _value int").repartition(6)
    got = {r.k: (r.at, r.place) for r in ordering.numbered(d, "k", name="at").collect()}
    assert got == {k * 7 % 101: (k * 7 % 101, f"v{k}") for k in range(101)}
    assert {r.k: r.before for r in ordering.running_total(d.drop("_value"), F.col("k").cast("long"), "k").collect()} == {k: k * (k - 1) // 2 for k in range(101)}
    assert ordering.numbered(d.limit(0), "k", name="at").count() == 0


def test_running_folds_in_blocks(spark):
    from lectern.functions.arrays import running

    step = lambda state, x: F.struct((state + x).cast("int").alias("state"), state.alias("out"))
    for n in (0, 1, 63, 64, 65, 1000):
        items = F.lit(list(range(n))) if n else F.array().cast("array<int>")
        assert spark.range(1).select(running(items, 0, step, "int")).first()[0] == [k * (k - 1) // 2 for k in range(n)]


def test_matches_of_one_long_text(spark):
    """Positions and snippets of very many matches, in time in proportion to them."""
    import time

    def took(n):
        d = spark.createDataFrame([(1, "ab hit " * n)], "id int, text string")
        began = time.time()
        got = regexfind.find_all(d, "hit").agg(F.count("*"), F.max("start"), F.max("length")).first()
        assert tuple(got) == (n, 7 * n - 4, 3)
        return time.time() - began

    took(1000)
    assert took(8000) < 8 * took(2000) + 2


def test_store_and_lists(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    assert [r.k for r in files.remove_all(d, F.col("v") == "a").collect()] == [2, 3]
    assert files.first_match(d, F.col("k") > 1, "k").first().k == 2 and files.first_match(d, F.col("k") > 5, "k").count() == 0
    assert files.clear(d).count() == 0 and files.clear(d).columns == d.columns
    (tmp_path / "one.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in files.read_json(spark, str(tmp_path / "one.json"), "a int").collect()) == [1, 2]


def test_statements_raise_what_they_cannot_run(spark):
    import pytest

    from lectern.sources.tables import statement

    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert statement(spark, "SELECT v FROM {d} WHERE k = ?", [2], d=d).first().v == "b"
    with pytest.raises(Exception, match="nothing"):
        statement(spark, "SELECT nothing FROM {d}", d=d)


def test_temporary_views_are_gone(spark):
    n = spark.createDataFrame([(1, None, "A", 0)], "id int, parent_id int, title string, order_index int")
    before = len(spark.catalog.listTables())
    assert tree.paths(n).count() == 1 and len(spark.catalog.listTables()) == before
