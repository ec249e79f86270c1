"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence.

1. Each text becomes its set of distinct word shingles (64-bit hashes, sorted). Documents of equal sets collapse into
   one class by the set's size and a 128-bit sum, so a group of copies costs one row from here on. A class is named by a
   number of its own, never by a document's id, which may repeat or be null.
2. A linked pair shares at least o = ceil(s * n) shingles of either side, so the first n - o + l hashes of two linked
   sets share at least the smaller l. Only these prefixes are exploded and matched. A class of whose prefix fewer than
   l are met in another class's prefix has no link and leaves; what is left is matched once more, and of a class's met
   shingles only so many are kept, rare ones first, that a linked class must hold one of them.
3. Classes that share a kept shingle are gathered by connected components (stars around the least number of a
   shingle, so a shingle of d classes makes d - 1 edges). Every link lies within one of these gatherings.
4. A gathering is cut into bands of size, as linked sets differ in size by 1 / s at most, and a band into blocks of
   bounded size. Each pair of blocks of the same or neighbouring bands is one task: overlap counts are accumulated
   column by column (rare columns as index pairs, frequent ones as dense tiles of a matrix product), pairs outside the
   size-derived bounds are discarded, and the task emits each class's number of links and a spanning forest of the
   links, never the pairs.
5. Connected components of the forests are the result.

Nothing is capped, and no result depends on a sample; the cost of step 4 grows with the square of a band of a gathering
of different, similar texts, which counting their links needs. Shingles of very many classes are found in a sample
beforehand, and their entries are dealt out by class, so no task gets all of one. A side that is aggregated by the key of
a join is kept apart, so that adaptive execution can split a hot key. Sets are made where the texts are, for those texts
that a bitmap of fixed size may want, so texts aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import drop_durable, durable, one_of_each, partitions
from lectern.llm.graph import apart, connected_components

#: Classes, and shingles, of a block of the product.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
#: Columns with fewer rows are accumulated as index pairs; the others in dense tiles of so many columns.
DENSE, TILE = 24, 2048
#: Shingles that count as heavy at most, of one in so many classes; and bits of the filter of digests.
HEAVY, SAMPLE = 100_000, 64
FILTER = 1 << 26


def _needed(n, percent: int):
    return -(-n * percent // 100)


def _slack(n):
    """How many prefix shingles two linked sets share at least, by the size of one of them."""
    return 1 + n // 12


def _signatures(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                words, first = tokens.words(batch.column("text"))
                n, sums, prefixes = [], [], []
                for i in range(batch.num_rows):
                    s = np.unique(tokens.shingles(words[first[i] : first[i + 1]], size))
                    n.append(len(s))
                    sums.append(((s * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64), tokens.mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)))
                    k = min(len(s), len(s) - int(_needed(len(s), percent)) + int(_slack(len(s)))) if len(s) else 0
                    prefixes.append(s[:k])
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
                at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                pair = np.array(sums, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))],
                    names=["id", "digest", "n", "s1", "s2", "prefix"],
                )

    return run


def _filter(own: DataFrame):
    """A bitmap of FILTER bits in which those of the digests are set, whatever their number."""
    x = F.pmod("digest", F.lit(FILTER)) + 1
    rows = own.groupBy(F.bitmap_bucket_number(x).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()  # FILTER / 32768 rows at most
    out = np.zeros((FILTER // 32768, 4096), np.uint8)
    for r in rows:
        out[r.k - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return own.sparkSession.sparkContext.broadcast(out.ravel())


def _sets(size: int, wanted):
    """Sets of the texts whose digests may be wanted; of rows alike in id and text, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for whole in batches:
            at = np.mod(whole.column("digest").to_numpy(), FILTER)
            some = whole.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))
            fresh = [k not in seen and not seen.add(k) for k in zip(some.column("id").to_pylist(), some.column("digest").to_pylist(), strict=True)]
            for batch in tokens.slices(some.filter(pa.array(fresh, pa.bool_())), "text"):
                words, first = tokens.words(batch.column("text"))
                sets = [np.unique(tokens.shingles(words[first[i] : first[i + 1]], size)).tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(sets, pa.binary())], names=["id", "digest", "items"])

    return run


def overlaps(rows: list[np.ndarray]) -> np.ndarray:
    """How many items each two of the sets share: the product of their incidence matrix and its transpose."""
    n = len(rows)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    items = np.concatenate(rows) if n else np.zeros(0, np.uint64)
    order = np.argsort(items, kind="stable")
    items, of = items[order], of[order]
    starts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else np.zeros(0, np.int64)
    height = np.diff(np.append(starts, len(items)))
    out = np.zeros((n, n), np.float32)
    for d in np.unique(height[(height > 1) & (height < DENSE)]):
        at = starts[height == d]
        step = max(1, 500_000 // (d * d))
        for k in range(0, len(at), step):
            who = of[at[k : k + step, None] + np.arange(d)]
            out += np.bincount((who[:, :, None] * n + who[:, None, :]).ravel(), minlength=n * n).reshape(n, n)
    tall = starts[height >= DENSE], height[height >= DENSE]
    for k in range(0, len(tall[0]), TILE):
        s, h = tall[0][k : k + TILE], tall[1][k : k + TILE]
        tile = np.zeros((n, len(s)), np.float32)
        column = np.repeat(np.arange(len(s)), h)
        entry = np.repeat(s - np.concatenate([[0], np.cumsum(h)[:-1]]), h) + np.arange(h.sum())
        tile[of[entry], column] = 1
        out += tile @ tile.T
    return out


def _links(shared: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which two sets of sizes n are linked; some rows at a time, as whole numbers."""
    out = np.empty(shared.shape, bool)
    for k in range(0, len(n), 128):
        a = n[k : k + 128, None]
        both = shared[k : k + 128].astype(np.int64)
        out[k : k + 128] = (100 * np.minimum(a, n) >= percent * np.maximum(a, n)) & (100 * both >= percent * (a + n - both))
    np.fill_diagonal(out, False)
    return out


def _forest(linked: np.ndarray) -> np.ndarray:
    """Of each row, the least row that it reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = label.copy()
        for k in range(0, n, 128):
            low[k : k + 128] = np.minimum(low[k : k + 128], np.where(linked[k : k + 128], label[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _product(percent: int):
    """Rows come sorted by (gathering, left, right, cid); each run of the first three is one task of the product."""

    def task(rows: dict, left: int, right: int) -> Iterator[tuple]:
        sets = [np.frombuffer(x, np.uint64) for x in rows["items"]]
        ids, copies, side = np.array(rows["cid"], np.int64), np.array(rows["copies"], np.int64), np.array(rows["block"])
        n = np.array([len(s) for s in sets], np.int64)
        linked = _links(overlaps(sets), n, percent)
        if left != right:
            linked &= side[:, None] != side[None, :]
        label = _forest(linked)
        links = linked @ copies
        for i in np.flatnonzero(links):
            yield int(ids[i]), int(ids[label[i]]), int(links[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

        for batch in batches:
            got = batch.to_pydict()
            for i in range(batch.num_rows):
                k = (got["gathering"][i], got["left"][i], got["right"][i])
                if k != key:
                    if held and len(held["cid"]) > 1:
                        out.extend(task(held, key[1], key[2]))
                    key, held = k, {c: [] for c in ("cid", "items", "copies", "block")}
                    if len(out) > 50_000:
                        yield packed()
                        out = []
                if held["cid"] and held["cid"][-1] == got["cid"][i]:
                    continue  # another task's copy of a repeated row
                for c in held:
                    held[c].append(got[c][i])
        if held and len(held["cid"]) > 1:
            out.extend(task(held, key[1], key[2]))
        yield packed()

    return run


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, text, digest): what tells a row's text from another one's of the same id is a digest of 64 bits."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).cast("long").alias("id"), text_.alias("text"), F.xxhash64(text_).alias("digest"))


def _components(src: DataFrame, size: int, percent: int) -> DataFrame:
    """(row, id, digest, n, component, least, links, same) of each row of src; component is a number, least its smallest id."""
    signed = src.mapInArrow(_signatures(size, percent), "id long, digest long, n long, s1 long, s2 long, prefix array<long>")
    # Numbers are written with the rows, so whatever reads them sees the same ones.
    all_ = durable(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    some, key = all_.where("n > 0"), ["n", "s1", "s2"]
    classes = durable(some.groupBy(*key).agg(F.min("row").alias("cid"), F.min("id").alias("least"), F.count("*").alias("copies")), "classes")

    # One row a class: without the other rows of those that have several, which are fewer than the classes.
    copies = some.select("row", *key).join(classes.where("copies > 1").select(*key, "cid"), key).where("row <> cid").select("row")
    first = some.join(durable(copies, "copies"), "row", "left_anti")
    posts = first.select(F.col("row").alias("cid"), F.expr(_slack_sql(_needed_sql(percent))).cast("int").alias("slack"), F.explode("prefix").alias("h"))
    posts = posts.join(F.broadcast(_heavy(some, classes, key, percent)), "h", "left")
    # Windows by shingle; a heavy one is dealt out by class too, as nothing has to be counted of it.
    by, alike = Window.partitionBy("cid"), Window.partitionBy("h", F.when(F.col("heavy"), F.pmod("cid", F.lit(1 << 16))))
    often = lambda rows: rows.withColumn("c", F.when(F.col("heavy"), F.lit(1 << 62)).otherwise(F.count("*").over(alike))).where("c > 1")
    posts = durable(often(posts).withColumn("of", F.count("*").over(by)).where("of >= slack").select("cid", "slack", "h", "heavy"), "met")
    # Of a class's met shingles a linked one shares `slack`, so all but the last slack - 1 in any one order must hold one
    # of these; the order is rare ones first, so lines that very many texts share gather nothing.
    again = often(posts).withColumn("of", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy("c", "h")))
    before, posts = posts, durable(again.where("of >= slack and place <= of - slack + 1").select("cid", "h", "heavy"), "rare")
    drop_durable(before)

    stars = posts.where("heavy").groupBy("h").agg(F.min("cid").alias("hub"))  # HEAVY rows at most
    star = posts.join(F.broadcast(stars), "h", "left").select(F.col("cid").alias("a"), F.coalesce("hub", F.min("cid").over(alike)).alias("b")).where("a != b").distinct()
    where = connected_components(star).withColumnRenamed("node", "cid").withColumnRenamed("component", "gathering")
    where = where.join(classes.select("cid", "n", "copies"), "cid").withColumn("band", F.floor(F.log("n") / F.log(F.lit(_ratio(percent)))).cast("int"))
    blocks = lambda rows, n: F.greatest(F.ceil(F.sum(rows) / BLOCK_ROWS), F.ceil(F.sum(n) / BLOCK_SHINGLES)).cast("int")
    sizes = where.groupBy("gathering", "band").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), blocks(F.lit(1), "n").alias("blocks"))
    bands = sizes.groupBy("gathering").agg(F.collect_list(F.struct("band", "blocks")).alias("bands"), blocks("rows", "n").alias("blocks"))  # some tens of bands at most
    # A set goes to its own band and both neighbours; where that is no fewer blocks than there are, all are one band.
    whole = F.array(F.struct(F.lit(0).alias("band"), F.col("blocks")))
    where = where.join(apart(bands, "gathering"), "gathering").withColumn("band", F.when(F.col("blocks") > 3, F.col("band")).otherwise(0))
    where = where.withColumn("bands", F.when(F.col("blocks") > 3, F.col("bands")).otherwise(whole))
    total = lambda which: F.aggregate(F.filter("bands", which), F.lit(0), lambda a, x: a + x["blocks"])
    own_, below = (lambda d: total(lambda x: x["band"] == F.col("band") + d)), (lambda d: total(lambda x: x["band"] < F.col("band") + d))
    # Blocks are numbered through a gathering, a band after the other.
    partners = F.array_sort(F.flatten(F.array(*[F.when(own_(d) > 0, F.sequence(below(d), below(d) + own_(d) - 1)).otherwise(F.array().cast("array<int>")) for d in (-1, 0, 1)])))
    where = where.withColumn("block", (below(0) + F.pmod(F.xxhash64("cid"), own_(0))).cast("int")).withColumn("partners", partners).withColumn("blocks", total(lambda x: F.lit(True)))
    # The classes' own rows, found again by id and digest.
    own = some.select(F.col("row").alias("cid"), "id", "digest").join(where.select("cid", "gathering", "copies", "block", "blocks", "partners"), "cid")
    own = durable(own, "gatherings")
    sets = src.mapInArrow(_sets(size, _filter(own)), "id long, digest long, items binary")
    # As many of either as there are similar texts, so both are dealt out at any size.
    sides = F.transform("partners", lambda p: F.struct(F.least("block", p).alias("left"), F.greatest("block", p).alias("right")))
    tasks = sets.alias("t").join(own.hint("merge").alias("o"), F.col("t.id").eqNullSafe(F.col("o.id")) & (F.col("t.digest") == F.col("o.digest"))).select("gathering", "cid", "copies", "block", "blocks", "items", F.explode(sides).alias("p"))
    parts = partitions(src.sparkSession)
    # A gathering's pairs go to one partition after the other, so none gets many of a large one by chance.
    slot = F.pmod(F.pmod(F.xxhash64("gathering"), F.lit(parts)) + F.col("left") * F.col("blocks").cast("long") + F.col("right"), F.lit(parts)).cast("int")
    tasks = tasks.select("gathering", "p.left", "p.right", "cid", "copies", "block", "blocks", "items").repartitionById(parts, slot).drop("blocks")
    dealt = tasks.sortWithinPartitions("gathering", "left", "right", "cid")
    found = durable(dealt.mapInArrow(_product(percent), "a long, b long, links long"), "links")

    # Rows that repeat an id are one node.
    repeated = apart(some.where("id is not null").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1"), "id")
    shared = some.select("id", *key).join(repeated.select("id"), "id", "left_semi").join(classes.select(*key, "cid"), key).select("id", "cid").distinct()
    alike = shared.join(apart(shared.groupBy("id").agg(F.min("cid").alias("b")), "id"), "id").select(F.col("cid").alias("a"), "b")
    component = connected_components(found.select("a", "b").union(alike)).withColumnRenamed("node", "cid")
    component = component.join(classes.select("cid", "least"), "cid")
    component = component.drop("least").join(apart(component.groupBy("component").agg(F.min("least").alias("smallest")), "component"), "component")
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    of = classes.join(component, "cid", "left").join(links, "cid", "left")
    of = of.select(*key, F.coalesce("component", "cid").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("least"), F.coalesce("links", F.lit(0)).alias("links"), (F.col("copies") - 1).alias("same"))
    linked = some.select("row", "id", "digest", *key).join(of, key).select("row", "id", "digest", "n", "component", "least", (F.col("links") + F.col("same")).alias("links"), "same")
    none = F.lit(0).cast("long")
    return linked.union(all_.where("n = 0").select("row", "id", "digest", "n", F.col("row").alias("component"), F.col("id").alias("least"), none.alias("links"), none.alias("same")))


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links, n_same.

    Two documents link when their sets of distinct size-word shingles have a Jaccard similarity of percent / 100 or
    more; component_id is the smallest id that links reach. n_links counts the other documents linked, of which n_same
    have an equal set. Null or blank texts have an empty set and no link; a text of fewer words than size is one shingle.
    Every row is returned. Rows that repeat an id are one node, with the links of each of their texts; a blank one
    keeps its own id. Rows of a null id are nodes of their own; a component without any id has a null component_id.
    Other columns are ignored, an empty table gives no rows.
    """
    out = _components(_rows(docs, id, text), size, percent)
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("links").alias("n_links"), F.col("same").alias("n_same"))


def near_unique(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, but of each component only one.

    Of a component the row of the smallest id stays (one without an id only if all are), of several the one of the
    smallest digest of its text, and of rows alike in id and text the least one by its other columns. Null and blank
    texts link with nothing, so all of them stay. An empty table gives no rows.
    """
    found = _components(_rows(docs, id, text), size, percent).where("n > 0")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "digest")).alias("best")).select("best.id", "best.digest")
    text_ = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id).cast("long").alias("id"), F.xxhash64(text_).alias("digest"), text_.rlike(r"[^\x20\x09-\x0D]").alias("some"))
    chosen = rows.alias("r").where("some").join(best.alias("b"), F.col("r.id").eqNullSafe(F.col("b.id")) & (F.col("r.digest") == F.col("b.digest")), "left_semi")
    return one_of_each(chosen, "id", "digest").select("row.*").union(rows.where("not some").select("row.*"))


def _ratio(percent: int) -> float:
    """Of the sizes of neighbouring bands; a little over what linked sets may differ by, so that rounding loses no link."""
    return 100 / percent * (1 + 1e-6)


def _heavy(some: DataFrame, classes: DataFrame, key: list[str], percent: int) -> DataFrame:
    """(h, heavy): shingles of very many classes, HEAVY at most; each is in several classes. Others may be missing.

    Of the shingles of a sample of classes, those with a share of 1 / HEAVY of its entries, and at least 4. Only how rows
    are dealt out, and the order among frequent shingles, depends on it.
    """
    sampled = F.pmod(F.xxhash64(*key), F.lit(SAMPLE)) == 0
    needed = _needed_sql(percent)
    entries = classes.where(sampled).agg(F.sum(F.expr(f"n - {needed} + {_slack_sql('n')}"))).first()[0] or 0
    each = some.where(sampled).select(*key, F.explode("prefix").alias("h")).distinct().groupBy("h").agg(F.count("*").alias("c"))
    return durable(each.where(F.col("c") >= max(4.0, entries / HEAVY)).select("h", F.lit(True).alias("heavy")), "heavy")


def _needed_sql(percent: int) -> str:
    return f"ceil(n * {percent} / 100)"


def _slack_sql(n: str) -> str:
    return f"1 + floor({n} / 12)"
