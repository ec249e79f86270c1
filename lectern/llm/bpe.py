"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of up to CHUNK characters is encoded as it is. A longer one is cut into chunks that overlap by OVERLAP
characters; the chunks are dealt out and pre-tokenised in parallel, each from its own start. The pattern looks only
ahead, so from a position where two neighbours both have a boundary their pre-tokens agree to the end; the first such
position after a non-space becomes the cut between them (after a space the pattern's look-ahead could see another end).
A chunk is in step from its cut on, if the chunk before was in step there; the first chunk is. Where a chunk has no such
position, for example in one long run of letters, it and what follows stay joined to the one before, as nothing tells
whether they are in step. The pieces between cuts are dealt out again and encoded, and their ids concatenated in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import spread

CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Texts are encoded in rounds of about so many characters, so ids of a whole batch are never held at once.
ROUND = 1 << 20

_encoders: dict = {}


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Ranks in a file of lines `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def encoder(data: bytes, pattern: str) -> tiktoken.Encoding:
    key = hash((data, pattern))
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(data), special_tokens={})
    return _encoders[key]


def boundaries(text: str, pattern: regex.Pattern) -> list[int]:
    """Starts of the pre-tokens and the end."""
    return [m.start() for m in pattern.finditer(text)] + [len(text)]


def _split(chunk: int, overlap: int):
    """(id, text) into (id, chunk, text) with the overlap at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                i, text = i.as_py(), text.as_py()
                for k, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), pa.array([k], pa.int32()), pa.array([text[at : at + chunk + overlap]])], names=["id", "chunk", "text"])

    return run


def _outer(chunk: int, pattern: str):
    """Boundaries of each chunk in its first overlap and in the one that it shares with the next chunk, as positions in the text; those after a space are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            head, tail = [], []
            for k, text in zip(batch.column("chunk").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sure = [b for b in boundaries(text, compiled) if 0 < b < len(text) and not text[b - 1].isspace()]
                head.append([k * chunk + b for b in sure if b < OVERLAP])
                tail.append([k * chunk + b for b in sure if b > chunk])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("chunk"), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=["id", "chunk", "head", "tail"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text, cuts in zip(batch.column("id"), batch.column("text"), batch.column("cuts"), strict=True):
            text, cuts = text.as_py(), [0, *sorted(cuts.as_py() or [])]
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(text)], strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.string()), pa.array([k], pa.int32()), pa.array([text[a:b]])], names=["id", "piece", "text"])


def _encode(vocabulary, pattern: str, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            i = 0
            while i < len(texts):
                j, total = i, 0
                while j < len(texts) and (j == i or total + len(texts[j]) <= ROUND):
                    total += len(texts[j])
                    j += 1
                ids = [enc.encode_ordinary(t) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in keys), pa.array(ids, pa.list_(pa.int32()))], names=[*keys, "ids"])
                i = j

    return run


def _digest(vocabulary, pattern: str):
    """Whole short texts: encode, decode and hash, without sending the ids back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value, pattern)
        name = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text"):
                ids = enc.encode_ordinary(text.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([name[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _decode(vocabulary, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([enc.decode_bytes(x.as_py()) for x in batch.column("ids")], pa.binary())], names=["key", "bytes"])

    return run


def _vocabulary(spark, path: str):
    """The rank file as the driver reads it, sent once to each executor (under a megabyte, whatever the corpus)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _long_pieces(rows: DataFrame, pattern: str, chunk: int) -> DataFrame:
    """(key, piece, text) of texts longer than a chunk, cut where pre-tokens resynchronise."""
    long = rows.select(F.col("key").alias("id"), "text").where(F.length("text") > chunk)
    chunks = spread(long.mapInArrow(_split(chunk, OVERLAP), "id string, chunk int, text string"), "id", "chunk")
    outer = chunks.mapInArrow(_outer(chunk, pattern), "id string, chunk int, head array<long>, tail array<long>")
    line = Window.partitionBy("id").orderBy("chunk")
    found = outer.withColumn("cut", F.array_min(F.array_intersect("head", F.lag("tail").over(line))))
    in_step = F.every((F.col("chunk") == 0) | F.col("cut").isNotNull()).over(line.rowsBetween(Window.unboundedPreceding, 0))
    cuts = found.withColumn("in_step", in_step).where("in_step and cut is not null").groupBy("id").agg(F.collect_list("cut").alias("cuts"))
    cut = long.join(cuts, "id", "left").mapInArrow(_pieces, "id string, piece int, text string")
    return spread(cut, "id", "piece").select(F.col("id").alias("key"), "piece", "text")


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (of decimal ids joined by one space), decoded_sha256.

    Null counts as the empty text, which has no ids. Rows that repeat an id are all kept and told apart inside by their
    text; null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    vocabulary = _vocabulary(docs.sparkSession, ranks_path)
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(_digest(vocabulary, pattern), f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    # Rows alike in id and text have the same pieces: the key is both, and copies are counted.
    long = rows.where(F.length("text") > chunk).withColumn("key", F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.sha2("text", 256)))
    alike = long.groupBy("key").agg(F.first("id").alias("id"), F.count("*").alias("copies"))
    once = long.select("key", "text").dropDuplicates(["key"])
    pieces = _long_pieces(once, pattern, chunk).mapInArrow(_encode(vocabulary, pattern, ["key", "piece"]), "key string, piece int, ids array<int>")
    ids = pieces.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("ids"))
    whole = ids.select("key", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"), "ids")
    decoded = whole.mapInArrow(_decode_digest(vocabulary, pattern), "key string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    back = alike.join(decoded, "key").select("id", "n_tokens", "ids_sha256", "decoded_sha256", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_")
    return short.unionByName(back).withColumnRenamed("id", id)


def _decode_digest(vocabulary, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value, pattern)
        for batch in batches:
            digests = [hashlib.sha256(enc.decode_bytes(x.as_py())).hexdigest() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "n_tokens", "ids_sha256")] + [pa.array(digests, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, ids): the ids of each document, as one encoder over its whole text would give them.

    Ids must be unique; a null text counts as empty and gives no ids.
    """
    vocabulary = _vocabulary(docs.sparkSession, ranks_path)
    rows = docs.select(F.col(id).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInArrow(_encode(vocabulary, pattern, ["key"]), "key string, ids array<int>")
    pieces = _long_pieces(rows, pattern, chunk).mapInArrow(_encode(vocabulary, pattern, ["key", "piece"]), "key string, piece int, ids array<int>")
    ids = pieces.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("ids"))
    return short.unionByName(ids).select(F.col("key").cast(docs.schema[id].dataType).alias(id), "ids")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id: str = "doc_id") -> DataFrame:
    """(id, bytes): the raw bytes of the ids, concatenated."""
    vocabulary = _vocabulary(encoded.sparkSession, ranks_path)
    out = encoded.select(F.col(id).cast("string").alias("key"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(_decode(vocabulary, pattern), "key string, bytes binary")
    return out.select(F.col("key").cast(encoded.schema[id].dataType).alias(id), "bytes")
