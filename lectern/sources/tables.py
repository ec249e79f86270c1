"""Bindings: the library's tables as views of the driver's tables, and the same bindings as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifiers of one line: book * LINES + index.
LINES = 1_000_000

#: Kinds of cross-references. Fixed values.
CONNECTIONS = {1: "SOURCE", 2: "OTHER", 3: "COMMENTARY", 4: "TARGUM", 5: "REFERENCE"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("int").alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("title"), F.lit(0).alias("level"), F.col("r_regionkey").cast("int").alias("order_index"))
    sub = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("int"), (F.col("n_regionkey") + 1).cast("int"), "n_name", F.lit(1), F.col("n_nationkey").cast("int"))
    return top.union(sub)


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c, v: F.sum((F.col(c) == v).cast("int")).cast("int")
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.count("*").cast("int").alias("total_lines"), flag("l_returnflag", "A").alias("has_targum"), flag("l_returnflag", "R").alias("has_reference"), flag("l_returnflag", "N").alias("has_commentary"), flag("l_linestatus", "O").alias("has_other"), flag("l_linestatus", "F").alias("has_source")
    )
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 100).cast("int").alias("category_id"), F.col("s_name").alias("title"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("balance "), F.floor("s_acctbal"))).alias("short_desc"), F.col("s_suppkey").cast("int").alias("order_index"))
    names = ["total_lines", "has_targum", "has_reference", "has_commentary", "has_other", "has_source"]
    return s.join(counts, "id", "left").select(*s.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_index", "content"))
    return docs.select((F.col("book_id") * LINES + F.col("line_index")).alias("id"), "book_id", "line_index", "content")


def target_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), (F.col("p_partkey") % 1000).cast("int").alias("line_index"))


def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_line_id"), F.col("l_partkey").alias("target_line_id"), F.col("l_suppkey").alias("target_book_id"), kind.alias("connection_type_id"))


def source_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that links begin at: orders, by customer."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book_id"), (F.col("o_orderkey") % 1000).cast("int").alias("line_index"))


def statement(spark: SparkSession, sql: str, parameters: list | None = None, **tables: DataFrame) -> DataFrame:
    """Any statement over the tables, named in braces; each ? takes the next parameter. What can't be run is an error."""
    return spark.sql(sql, args=parameters, **tables)


def connection_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONNECTIONS.items()), "id int, name string")


def _entries(leaf: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels: regions, nations, leaves (key, nation)."""
    c = category(spark, sf_dir)
    inner = c.select(F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id"), "level", F.lit(None).cast("long").alias("line_id"), F.lit(True).alias("has_children"))
    line_id = F.when(F.col("key") % 7 != 0, F.col("key"))
    return inner.union(leaf.select(F.col("key") + 1000, (F.col("nation") + 100).cast("long"), F.lit(2), line_id, F.lit(False)))


def toc_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation")), spark, sf_dir)
    return e.select("id", F.lit(1).alias("book_id"), "parent_id", F.col("id").alias("text_id"), "level", "line_id", "has_children")


def alt_toc_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")), spark, sf_dir)
    return e.select("id", F.lit(9).alias("structure_id"), "parent_id", F.when(F.col("level") < 2, F.col("id")).otherwise(F.col("id") + 10_000_000).alias("text_id"), "level", "line_id", "has_children")


def alt_toc_structure(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(9, 1), (10, 2)], "id int, book_id int")


def toc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = category(spark, sf_dir).select(F.col("id").cast("long").alias("id"), F.col("title").alias("text"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey") + 1000, "c_name")
    return c.union(customers).union(read(spark, sf_dir, "supplier").select(F.col("s_suppkey") + 10_001_000, "s_name"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"), F.col("p_type").alias("tags"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"), F.min("ts").alias("first_accessed"))


#: The same bindings for the oracles, as the head of a WITH statement.
SQL = f"""WITH RECURSIVE
category AS (SELECT (r_regionkey + 1)::INT AS id, NULL::INT AS parent_id, r_name AS title, 0 AS level, r_regionkey::INT AS order_index FROM region
  UNION ALL SELECT (n_nationkey + 100)::INT, (n_regionkey + 1)::INT, n_name, 1, n_nationkey::INT FROM nation),
item_counts AS (SELECT l_suppkey AS id, count(*) AS total_lines, count(*) FILTER (l_returnflag = 'A') AS has_targum, count(*) FILTER (l_returnflag = 'R') AS has_reference, count(*) FILTER (l_returnflag = 'N') AS has_commentary, count(*) FILTER (l_linestatus = 'O') AS has_other, count(*) FILTER (l_linestatus = 'F') AS has_source FROM lineitem GROUP BY 1),
book AS (SELECT s_suppkey AS id, (s_nationkey + 100)::INT AS category_id, s_name AS title, CASE WHEN s_acctbal > 0 THEN 'balance ' || floor(s_acctbal)::BIGINT END AS short_desc, s_suppkey::INT AS order_index,
  coalesce(total_lines, 0)::INT AS total_lines, coalesce(has_targum, 0)::INT AS has_targum, coalesce(has_reference, 0)::INT AS has_reference, coalesce(has_commentary, 0)::INT AS has_commentary, coalesce(has_other, 0)::INT AS has_other, coalesce(has_source, 0)::INT AS has_source
  FROM supplier LEFT JOIN item_counts ON id = s_suppkey),
line AS (SELECT doc_id * {LINES} + i AS id, doc_id AS book_id, i::INT AS line_index, parts[i + 1] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(len(parts))) AS t(i)),
target_line AS (SELECT p_partkey AS id, p_name AS content, (p_partkey % 1000)::INT AS line_index FROM part),
link AS (SELECT l_orderkey AS source_line_id, l_partkey AS target_line_id, l_suppkey AS target_book_id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS connection_type_id FROM lineitem),
source_line AS (SELECT o_orderkey AS id, o_custkey AS book_id, (o_orderkey % 1000)::INT AS line_index FROM orders),
connection_type(id, name) AS (VALUES {", ".join(f"({k}, '{v}')" for k, v in CONNECTIONS.items())}),
inner_entry AS (SELECT id::BIGINT AS id, parent_id::BIGINT AS parent_id, level, NULL::BIGINT AS line_id, true AS has_children FROM category),
toc_entry AS (SELECT id, 1 AS book_id, parent_id, id AS text_id, level, line_id, has_children FROM (SELECT * FROM inner_entry UNION ALL SELECT c_custkey + 1000, (c_nationkey + 100)::BIGINT, 2, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END, false FROM customer)),
alt_toc_entry AS (SELECT id, 9 AS structure_id, parent_id, CASE WHEN level < 2 THEN id ELSE id + 10000000 END AS text_id, level, line_id, has_children FROM (SELECT * FROM inner_entry UNION ALL SELECT s_suppkey + 1000, (s_nationkey + 100)::BIGINT, 2, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey END, false FROM supplier)),
alt_toc_structure(id, book_id) AS (VALUES (9, 1), (10, 2)),
toc_text AS (SELECT id::BIGINT AS id, title AS text FROM category UNION ALL SELECT c_custkey + 1000, c_name FROM customer UNION ALL SELECT s_suppkey + 10001000, s_name FROM supplier),
catalog AS (SELECT p_partkey AS id, p_name AS title, p_brand AS author, p_type AS tags FROM part),
history AS (SELECT user_id AS id, count(*) AS access_count, max(ts) AS last_accessed, min(ts) AS first_accessed FROM events GROUP BY 1)
"""


def oracle(select: str, more: str = "") -> str:
    """A statement over the bound tables; more are further common table expressions."""
    return SQL + (f", {more}\n" if more else "") + select
