"""Quality rules: plain word statistics, and perplexity under a modified Kneser-Ney trigram model with bands by language.

The model is fitted on labelled rows, all of them: the good rows of a language (and of all together, as `*`) are halved
by a hash of the id, each half has a model of its own, and a document is scored by the half that it isn't in. So every
good row is counted, every labelled row sets the bands, and none is judged by itself. N-grams are counted where a hash of
their context puts them; documents ask there in packets and get counts back, so no model is collected or broadcast.

A packet is all that a slice of documents asks of one place, as arrays of 64-bit hashes. Counts are whole numbers and a
text's logs are added in the order of its words, so every perplexity is the same to the last bit however the rows are
dealt out. Models are built and asked a few at a time, which bounds the space that their packets need.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lectern.llm import tokens
from lectern.llm.common import drop_durable, durable, partitions, release

#: Bytes of text in a slice of documents that asks together.
SLICE = 4 << 20
#: Bytes of text whose models are built and asked at once, if no model has more: it bounds the space, not the result.
WAVE = 1 << 27
#: Turns that the places of a level take at most, which bounds the space as well, and the bytes of text that add a turn.
TURNS, TURN = {3: 5, 2: 3, 1: 1}, 1 << 26
#: Good labelled rows that a language's bands need: of fewer, nothing follows about the next one.
LEAST_GOOD = 5
#: Word types that the probability of unknown words is spread over.
OPEN_TYPES = 1_000_000
#: A band may not lose more than this share of a language's good labelled rows on either side.
LOSS = 0.004
ALL = "*"

_A, _B, _C = (np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xD6E8FEB86659FD93))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = " \t\n\v\f\r"


def _seed(language: str) -> np.uint64:
    """What is added to the hashes of a language's n-grams; not a hash of words, so two languages' names can't change places with words."""
    return np.uint64(int.from_bytes(hashlib.sha256(f"language {language}".encode()).digest()[:8], "little"))


def _grams(words: np.ndarray, first: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all rows' n-grams and the place of each word: one[place] is of the word, two[place] of it and the word before, three[place] of the last three.

    Two blanks stand before each row; what is at their places is of no use but as a context.
    """
    n = np.diff(first)
    rows = len(n)
    row = np.repeat(np.arange(rows), n)
    place = np.arange(len(words)) + 2 * (row + 1)
    w = np.zeros(len(words) + 2 * rows, np.uint64)
    w[place] = words
    seed = np.repeat(seeds, n + 2)
    one = tokens.mix(w + seed)
    two, three = w * _B + seed, w * _C + seed
    two[1:] += w[:-1] * _A
    three[1:] += w[:-1] * _B
    three[2:] += w[:-2] * _A
    return one, tokens.mix(two), tokens.mix(three), place


def _train_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tokens.slices(whole, "text", 1 << 20):
            words, first = tokens.words(batch.column("text"), lower=False)
            names = batch.column("model").to_pylist()
            one, two, three, at = _grams(words, first, np.array([_seed(x) for x in names], np.uint64))
            columns = [x.view(np.int64) for x in (three[at], two[at - 1], two[at], one[at - 1], one[at])]
            model = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), np.diff(first))))
            yield pa.RecordBatch.from_arrays([model, *map(pa.array, columns)], names=["model", "h3", "c2", "s2", "v", "w"])


def _discounts(counts: DataFrame) -> DataFrame:
    """Per model the three discounts of counts c, from how many n-grams have a count of 1 to 4."""
    n = counts.groupBy("model").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    cut = lambda k: F.least(F.greatest(F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0)), F.lit(0.1)), F.lit(k - 0.05))
    return n.select("model", cut(1).alias("d1"), cut(2).alias("d2"), cut(3).alias("d3"))


def _level(counts: DataFrame, key: str, context: str) -> tuple[DataFrame, DataFrame]:
    """(key, p) the discounted probabilities and (context, g) the weights left to the lower order."""
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    cuts = F.broadcast(_discounts(counts))  # a row a language
    some = lambda test: F.sum(F.when(test, 1).otherwise(0))
    total = counts.groupBy("model", context).agg(F.sum("c").alias("total"), some(F.col("c") == 1).alias("k1"), some(F.col("c") == 2).alias("k2"), some(F.col("c") > 2).alias("k3"))
    each = counts.join(total.select("model", context, "total"), ["model", context]).join(cuts, "model")
    p = each.select(F.col(key).alias("key"), ((F.col("c") - d) / F.col("total")).alias("p"))
    left = (F.col("k1") * F.col("d1") + F.col("k2") * F.col("d2") + F.col("k3") * F.col("d3")) / F.col("total")
    return p, total.join(cuts, "model").select(F.col(context).alias("key"), left.alias("p"))


class Arrays:
    """A sorted hash array and its values. Hashes are even, so the first bits tell nearly where one is."""

    def __init__(self, key: np.ndarray, p: np.ndarray):
        order = np.argsort(key)
        self.key, self.p = key[order], p[order].astype(np.float32)
        if (self.key[1:] == self.key[:-1]).any():
            raise RuntimeError("two n-grams have the same hash")
        bits = max(1, int(len(key)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.key, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        # An end that no search goes beyond.
        self.key = np.append(self.key, np.uint64(2**64 - 1))
        self.p = np.append(self.p, np.float32(0))

    @classmethod
    def of(cls, rows: DataFrame) -> Arrays:
        got = rows.toArrow()
        return cls(got.column("key").to_numpy().view(np.uint64), got.column("p").to_numpy())

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and whether each key is there."""
        at = self.start[(keys >> self.shift).astype(np.int64)]
        low = np.flatnonzero(self.key[at] < keys)
        while len(low):
            at[low] += 1
            low = low[self.key[at[low]] < keys[low]]
        return at, (self.key[at] == keys) & (at < len(self.key) - 1)

    def __call__(self, keys: np.ndarray, missing: float, where: np.ndarray | None = None) -> np.ndarray:
        """Values of keys; where: only these can be there."""
        if where is not None:
            out = np.full(len(keys), missing, np.float32)
            some = np.flatnonzero(where)
            out[some] = self(keys[some], missing)
            return out
        at, found = self.find(keys)
        return np.where(found, self.p[at], np.float32(missing))


class Model:
    """Trigram arrays of few texts in memory; what `asked` answers for any number of texts is tested against it."""

    def __init__(self, rows: DataFrame):
        grams = rows.mapInArrow(_train_grams, "model string, h3 long, c2 long, s2 long, v long, w long")
        three = durable(grams.groupBy("model", "h3", "c2", "s2", "v", "w").agg(F.count("*").alias("c")), "trigrams")
        two = durable(three.groupBy("model", "s2", "v", "w").agg(F.count("*").alias("c")), "bigrams")
        one = two.groupBy("model", "w").agg(F.count("*").alias("c")).withColumn("none", F.xxhash64("model"))
        (self.p3, self.g3), (self.p2, self.g2) = (map(Arrays.of, _level(*x)) for x in ((three, "h3", "c2"), (two, "s2", "v")))
        p1, left = _level(one, "w", "none")
        self.p1 = Arrays.of(p1)
        named = {r.key: r.p for r in left.collect()}  # a row a language
        self.unknown = {r.model: named[r.key] / OPEN_TYPES for r in one.select("model", F.xxhash64("model").alias("key")).distinct().collect()}
        self.seeds = {x: _seed(x) for x in self.unknown}

    def __call__(self, words: np.ndarray, first: np.ndarray, languages: list[str | None]) -> np.ndarray:
        """log10 probabilities of the rows' words, in their languages' models; of a language without one, in that of all; without any, 0."""
        n, names = np.diff(first), [x if x in self.seeds else ALL for x in languages]
        one, two, three, at = _grams(words, first, np.array([self.seeds.get(x, 0) for x in names], np.uint64))
        p1, g2 = self.p1(one, 0.0), self.g2(one, np.nan)
        # What a shorter n-gram doesn't have, a longer one can't.
        follows = ~np.isnan(g2)
        g3 = self.g3(two, np.nan, follows)
        p1, p2 = p1[at], self.p2(two[at], 0.0, follows[at - 1] & (p1[at] > 0))
        p3 = self.p3(three[at], 0.0, ~np.isnan(g3[at - 1]) & (p2 > 0))
        p = p1.astype(np.float64) + np.repeat(np.array([self.unknown.get(x, 1.0) for x in names]), n)
        p = p2 + np.nan_to_num(g2[at - 1], nan=1.0) * p
        p = p3 + np.nan_to_num(g3[at - 1], nan=1.0) * p
        # Sums by row in the order of its words, whatever rows are beside it.
        return np.bincount(np.repeat(np.arange(len(n)), n), weights=np.log10(np.maximum(p, 1e-12)), minlength=len(n))


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit keys.

    Sorting numbers is several times faster than sorting their places, so the place of each key replaces its lowest bits;
    where keys differ in these alone and come out in another order, places are sorted after all.
    """
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order = (order & low).view(np.int64)
    got = keys[order]
    return order if (got[1:] >= got[:-1]).all() else np.argsort(keys, kind="stable")


def repeated_words(words: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """By row, words that lie in a window of size words which the row has twice or more."""
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    windows = tokens.shingles(words, size) if len(words) >= size else words[:0]
    inside = np.flatnonzero(row[: len(windows)] == row[size - 1 :])
    # Equal only in the same row.
    h = windows[inside] + tokens.mix(np.arange(1, rows + 1, dtype=np.uint64))[row[inside]]
    order = _order(h)
    same = h[order[1:]] == h[order[:-1]]
    often = np.zeros(len(h), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    cover = np.zeros(len(words), bool)
    for k in range(size):
        cover[inside[often] + k] = True
    return np.bincount(row[cover], minlength=rows)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


_STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log10 double"


def _statistics(batch: pa.RecordBatch) -> tuple[list[pa.Array], Words]:
    text = batch.column("text")
    data, offsets = tokens.raw(text)
    starts, ends = tokens.spans(data, offsets)
    words = tokens.hash_words(data, starts, ends, lower=False)
    first = np.searchsorted(starts, offsets)
    sizes = np.concatenate([[0], np.cumsum(ends - starts)])
    count = lambda those: np.diff(np.searchsorted(np.flatnonzero(those), offsets))
    columns = [
        np.diff(first),
        # All bytes of words but those that continue a code point, which white space has none of.
        sizes[first[1:]] - sizes[first[:-1]] - count((data & 0xC0) == 0x80),
        count(_SYMBOL[data]),
        [duplicate_lines(t) for t in text.to_pylist()],
        repeated_words(words, first),
    ]
    return [pa.array(c, pa.int64()) for c in columns], Words.of(words, np.diff(first))


_NAMES = [c.split()[0] for c in _STATISTICS.split(", ")]
_PACKET = "kind int, level int, model int, slice long, place int, a binary, b binary, n binary, v binary"
_TRAIN, _ASK, _REPLY, _COUNTS, _DATA = range(5)
_NONE = np.zeros(0, np.uint64)


def _row(kind: int, level: int, model: int, slice_: int, place: int, *arrays: np.ndarray) -> tuple:
    return (kind, level, model, slice_, place, *(x.tobytes() for x in arrays), *[None] * (4 - len(arrays)))


_ARROW = pa.schema([("kind", pa.int32()), ("level", pa.int32()), ("model", pa.int32()), ("slice", pa.int64()), ("place", pa.int32()), *[(c, pa.binary()) for c in "abnv"]])


def _packets(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Packets of some MB together."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(map(len, filter(None, row[5:])))
        if size > SLICE:
            yield _packets(out)
            out, size = [], 0
    if out:
        yield _packets(out)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they all need."""
    return x.astype(np.min_scalar_type(x.max(initial=0)))


def _wide(data: bytes, n: int) -> np.ndarray:
    """n numbers that _narrow made narrow."""
    return np.frombuffer(data, f"u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _places(home: np.ndarray, places: int) -> np.ndarray:
    """The place of each hash; sorted hashes have sorted places."""
    return (((home >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)).astype(np.int64)


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tokens.mix(context * _B + word * _C)


def _heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _by_place(place: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, from, to) of sorted places."""
    at = _heads(place)
    return [(int(place[a]), int(a), int(b)) for a, b in zip(at, [*at[1:], len(place)], strict=False)]


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts keys, where runs begin in it, and how long they are."""
    by = _order(keys)
    at = _heads(keys[by])
    return by, at, np.diff(np.append(at, len(by)))


def _inverse(by: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of what by puts in order, where they were before."""
    out = np.empty(len(by), np.int64)
    out[by] = values
    return out


def _distinct(keys: np.ndarray, home: np.ndarray, places: int, ranks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Of keys, each once, by place and then by key: where each is first found, how often, its place, and (ranks) for every key which of them it is.

    Equal keys are of one home, whose hash gives the place.
    """
    by, at, n = _by_key(keys)
    first = by[at]
    place = _places(home[first], places)
    order = np.argsort(place.astype(np.uint16 if places < 1 << 16 else np.int64), kind="stable")
    rank = _inverse(by, np.repeat(_inverse(order, np.arange(len(order))), n)) if ranks else None
    return first[order], n[order], place[order], rank


class Words:
    """The words of a slice's rows: a vocabulary of hashes, the more frequent first, and numbers in it."""

    def __init__(self, vocabulary: np.ndarray, codes: np.ndarray, sizes: np.ndarray):
        self.vocabulary, self.codes, self.sizes = vocabulary, codes, sizes

    @classmethod
    def of(cls, words: np.ndarray, sizes: np.ndarray) -> Words:
        by, at, n = _by_key(words)
        order = np.argsort(-n, kind="stable")
        code = _inverse(order, np.arange(len(order)))
        return cls(words[by[at]][order], _inverse(by, np.repeat(code, n)), sizes)

    def packed(self) -> bytes:
        kind = np.dtype(np.uint16 if len(self.vocabulary) <= 1 << 16 else np.uint32)
        # Bytes of like weight side by side take less space.
        planes = self.codes.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T
        columns = [self.vocabulary, *np.ascontiguousarray(planes), self.sizes.astype(np.uint32)]
        return _pack(pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.large_binary()) for x in columns], names=[str(k) for k in range(len(columns))]))

    @classmethod
    def unpacked(cls, data: bytes) -> Words:
        columns = [np.frombuffer(c[0].as_buffer(), np.uint8) for c in _unpack(data).columns]
        planes = np.stack(columns[1:-1], 1)
        codes = np.ascontiguousarray(planes).reshape(-1).view(f"u{planes.shape[1]}")
        return cls(columns[0].view(np.uint64), codes.astype(np.int64), columns[-1].view(np.uint32).astype(np.int64))

    def where(self, rows: np.ndarray) -> Words:
        return Words(self.vocabulary, self.codes[np.repeat(rows, self.sizes)], self.sizes[rows])

    def ones(self, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words that the rows have, each once, and which of them each word is."""
        there = np.bincount(self.codes, minlength=len(self.vocabulary)) > 0
        return tokens.mix(self.vocabulary[there] + seed), (np.cumsum(there) - 1)[self.codes]

    def _before(self, codes: np.ndarray) -> np.ndarray:
        """The numbers that stand before each word in its row; a blank, whose number follows the vocabulary, stands before the first."""
        out = np.empty_like(codes)
        out[1:] = codes[:-1]
        out[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = len(self.vocabulary)
        return out

    def grams(self, level: int, seed: np.uint64, span: tuple[np.uint64, np.uint64] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By word: the hashes of its context at a level above 1, of itself and of the word before; span: the least and greatest hash of the contexts that count.

        Words are hashed once each, and what isn't in the span only where its context is a pair.
        """
        known = np.append(self.vocabulary, np.uint64(0))
        one, codes, before = tokens.mix(known + seed), self.codes, self._before(self.codes)
        if level == 3:
            context = (known * _A)[self._before(before)]
            context += (known * _B + seed)[before]
            context = tokens.mix(context)
        if span is not None:
            inside = lambda x: (x >= span[0]) & (x <= span[1])
            now = np.flatnonzero(inside(context) if level == 3 else inside(one)[before])
            codes, before, context = codes[now], before[now], context[now] if level == 3 else None
        last = one[before]
        return context if level == 3 else last, one[codes], last


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]


def _slice(lang: str | None, half: int, whole: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in tokens.slices(whole.combine_chunks().to_batches()[0], "text", SLICE):
        statistics, words = _statistics(batch)
        held = [c for c in batch.schema.names if c != "text"]
        full = pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *statistics], names=[*held, *_NAMES[:-1]])
        size = len(tokens.raw(batch.column("text"))[0])
        columns = [(uuid.uuid4().int >> 65, pa.int64()), (lang, pa.string()), (half, pa.int32()), (size, pa.int64()), (_pack(full), pa.binary()), (words.packed(), pa.binary())]
        ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id"))
        yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in columns), ids], names=["slice", "lang", "half", "size", "data", "words", "ids"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices: rows of a language and half, with their statistics and words. What is left of a batch waits for the next ones."""
    waiting: dict[tuple, list[pa.RecordBatch]] = {}
    sizes: dict[tuple, int] = {}
    for whole in batches:
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(whole.column("lang").to_pylist(), whole.column("half").to_pylist(), strict=True)):
            groups.setdefault(key, []).append(i)
        for key, at in groups.items():
            for some in tokens.slices(whole.take(pa.array(at)), "text", SLICE):
                waiting.setdefault(key, []).append(pa.Table.from_batches([some]).combine_chunks().to_batches()[0])
                sizes[key] = sizes.get(key, 0) + len(tokens.raw(some.column("text"))[0])
                if sizes[key] >= SLICE:
                    yield from _slice(*key, pa.Table.from_batches(waiting.pop(key)))
                    sizes.pop(key)
        if sum(sizes.values()) > 16 * SLICE:
            for key in list(waiting):
                yield from _slice(*key, pa.Table.from_batches(waiting.pop(key)))
            sizes = {}
    for key, parts in waiting.items():
        yield from _slice(*key, pa.Table.from_batches(parts))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two bits for each row of a slice: whether it has a label, and whether a good one."""
    for batch in batches:
        out = []
        for n, labels in zip(batch.column("n").to_pylist(), batch.column("labels").to_pylist(), strict=True):
            bits = np.zeros((2, n), bool)
            for x in labels:
                bits[0, x // 2], bits[1, x // 2] = True, x % 2
            out.append((np.packbits(bits).tobytes(), int(bits[1].sum())))
        yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.int64())], names=["slice", "marks", "good"])


def _marks(data: bytes | None, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a label, and which a good one."""
    if data is None:
        return np.zeros(rows, bool), np.zeros(rows, bool)
    return tuple(np.unpackbits(np.frombuffer(data, np.uint8), count=2 * rows).astype(bool).reshape(2, rows))


def _turn(turn: int, turns: int, places: int) -> tuple[int, int]:
    """The places whose turn it is: the first, and the one after the last."""
    return turn * places // turns, (turn + 1) * places // turns


def _span(first: int, end: int, places: int) -> tuple[np.uint64, np.uint64]:
    """The least and the greatest hash of these places, which are some."""
    least = lambda place: -(-(place << 32) // places) << 32
    return np.uint64(least(first)), np.uint64(least(end) - 1)


def _ask(level: int, seeds: list[np.uint64], places: int, turn: int, turns: int):
    """What slices ask of a level and, at the level of trigrams, what their good rows count there; of the places whose turn it is."""
    span = _span(*_turn(turn, turns, places), places) if turns > 1 else None

    def taken(words: Words, seed: np.uint64, kind: int, model: int, number: int) -> Iterator[tuple]:
        if level == 1:
            word, _ = words.ones(seed)
            if span is not None:
                word = word[(word >= span[0]) & (word <= span[1])]
            context = before = word
        else:
            context, word, before = words.grams(level, seed, span)
        pair = context if level == 1 else _pair(context, word)
        first, n, place, _ = _distinct(pair, context, places)
        if kind == _TRAIN:
            n = _narrow(n)
            for p, a, b in _by_place(place):
                by = np.argsort(before[first[a:b]])  # equal words side by side take less space
                i = first[a:b][by]
                yield _row(_TRAIN, level, model, -1, p, context[i], word[i], n[a:b][by], before[i])
            return
        pair = pair[first]
        own = np.sort(context) if level > 1 else _NONE
        own = own[_heads(own)]
        contexts = {p: own[a:b] for p, a, b in _by_place(_places(own, places))}
        for p, a, b in _by_place(place):
            yield _row(_ASK, level, model, number, p, contexts.get(p, _NONE), pair[a:b])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in range(batch.num_rows):
                number, data, marks, train, ask, some = (batch.column(c)[r].as_py() for c in ("slice", "words", "marks", "train", "ask", "some"))
                words = Words.unpacked(data)
                labelled, good = _marks(marks, len(words.sizes))
                if train is not None and level == 3 and good.any():
                    yield from taken(words.where(good), seeds[train], _TRAIN, train, -1)
                if ask is not None:
                    yield from taken(words.where(labelled) if some else words, seeds[ask], _ASK, ask, number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(rows(batches))

    return run


def _found(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of keys in a sorted table, 0 where they aren't there."""
    if not len(table):
        return np.zeros((len(keys), *values.shape[1:]), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    out = values[at]
    out[table[at] != keys] = 0
    return out


def _once(keys: np.ndarray, *of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where runs begin in it; keys are hashes of what stands beside them."""
    order, at, n = _by_key(keys)
    run = np.repeat(order[at], n)
    if any((x[order] != x[run]).any() for x in of):
        raise RuntimeError("two n-grams have the same hash")
    return order, at


def _count(level: int, places: int):
    """At a place: counts of a level's n-grams, answers to what was asked, and what the level below counts, which is how many words each n-gram follows."""

    def rows(train: list, asked: list) -> Iterator[tuple]:
        join = lambda k, kind=np.uint64: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x[k], kind) for x in train)])
        context = join(3)
        word = join(4) if level > 1 else context
        n = np.concatenate([np.zeros(0, np.int64), *(_wide(x[5], len(x[3]) // 8) for x in train)])
        model = np.repeat(np.array([x[0] for x in train], np.int32), [len(x[3]) // 8 for x in train])
        before = join(6) if level == 3 else word
        train.clear()
        pairs = _pair(context, word) if level > 1 else context
        order, at = _once(pairs, context, word)
        c = np.add.reduceat(n[order], at) if len(at) else n
        order = order[at]
        pairs, context, word, before, model = (x[order] for x in (pairs, context, word, before, model))
        order, at, _ = _by_key(context)
        own = context[order]
        sums = [np.add.reduceat(x[order], at) if len(at) else np.zeros(0, np.int64) for x in (c, *((x.astype(np.int64)) for x in (c == 1, c == 2, c > 2)))]
        contexts, stats, whose = own[at], np.stack(sums, 1), model[order][at]
        for k in np.unique(model):
            of, some = c[model == k], whose == k
            yield _row(_COUNTS, level, int(k), -1, -1, np.array([*((of == k).sum() for k in (1, 2, 3, 4)), *(x[some].sum() for x in sums)], np.int64))
        if level > 1 and len(c):
            home = before if level == 3 else word
            order, at = _once(_pair(home, word) if level == 3 else home, home, word)
            n = np.diff(np.append(at, len(order)))
            order = order[at]
            home, word, of = home[order], word[order], model[order]
            order = _order(home)
            order = order[np.argsort(of[order], kind="stable")]  # so by place as well
            for k, i, j in _by_place(of[order].astype(np.int64) * places + _places(home[order], places)):
                at = order[i:j]
                yield _row(_TRAIN, level - 1, k // places, -1, k % places, home[at], word[at] if level == 3 else _NONE, _narrow(n[at]))
        c, stats = _narrow(c), _narrow(stats)
        for whose, number, place, a, b, *_ in asked:
            got = _found(pairs, np.frombuffer(b, np.uint64), c)
            known = _found(contexts, np.frombuffer(a, np.uint64), stats)
            yield _row(_REPLY, level, whose, number, place, _narrow(got), _narrow(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, asked = [], []
        for batch in batches:
            for kind, *packet in zip(*(batch.column(c).to_pylist() for c in ("kind", "model", "slice", "place", "a", "b", "n", "v")), strict=True):
                (train if kind == _TRAIN else asked).append(packet)
        return _batched(rows(train, asked))

    return run


def _cuts(n: np.ndarray) -> np.ndarray:
    """The discounts of counts of 0, 1, 2 and more, from how many n-grams have a count of 1 to 4."""
    y = n[0] / max(n[0] + 2 * n[1], 1)
    return np.array([0.0] + [min(max(k - (k + 1) * y * n[k] / max(n[k - 1], 1), 0.1), k - 0.05) for k in (1, 2, 3)])


def _finish(totals: dict[tuple[int, int], np.ndarray], seeds: list[np.uint64], held: list[str], places: int):
    """Statistics and log10 probability of each row, from a slice's data and the answers that it got."""

    def score(words: Words, model: int, replies: dict) -> np.ndarray:
        rows = np.repeat(np.arange(len(words.sizes)), words.sizes)
        if (1, model) not in totals:
            return np.zeros(len(words.sizes))
        # Once for each n-gram that the slice has; which is the one of each word.
        for level in (1, 2, 3):
            if level == 1:
                context, each = words.ones(seeds[model])
                pair = context
            else:
                context, word, _ = words.grams(level, seeds[model])
                pair = _pair(context, word)
            first, _, place, rank = _distinct(pair, context, places, ranks=True)
            cut = _cuts(totals[level, model])
            c = np.concatenate([np.zeros(0, np.int64), *(_wide(replies[level, q][0], j - i) for q, i, j in _by_place(place))])
            if level == 1:
                stats, of, below, which = totals[level, model][None, 4:8], np.zeros(len(first), np.int64), 1 / OPEN_TYPES, rank[each]
            else:
                by, at, n = _by_key(context[first])
                place, of = _places(context[first[by[at]]], places), _inverse(by, np.repeat(np.arange(len(at)), n))
                stats = np.concatenate([np.zeros((0, 4), np.int64), *(_wide(replies[level, q][1], 4 * (j - i)).reshape(-1, 4) for q, i, j in _by_place(place))])
                below, which = p[which[first]], rank
            total = np.maximum(stats[:, 0], 1)
            left = np.where(stats[:, 0] > 0, (stats[:, 1] * cut[1] + stats[:, 2] * cut[2] + stats[:, 3] * cut[3]) / total, 1.0)
            p = (c - cut[np.minimum(c, 3)]) / total[of] + left[of] * below
        # Sums by row in the order of its words, whatever rows are beside it.
        return np.bincount(rows, weights=np.log10(p)[which], minlength=len(words.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(data, packed, marks, model, some, replies):
            batch, words = _unpack(data), Words.unpacked(packed)
            labelled, good = _marks(marks, batch.num_rows)
            quality = pa.array(good.astype(np.int32), mask=~labelled)
            if some:
                batch, words, quality = batch.filter(pa.array(labelled)), words.where(labelled), quality.filter(pa.array(labelled))
            log10 = score(words, model, replies) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), quality, *(batch.column(c) for c in _NAMES[:-1]), pa.array(log10, pa.float64()), pa.array([bool(some)] * batch.num_rows, pa.bool_())], names=[*held, "quality", *_NAMES, "probe"])

        now, data, replies = None, None, {}
        for rows in batches:
            for kind, level, whose, number, place, a, b, n in zip(*(rows.column(c).to_pylist() for c in ("kind", "level", "model", "slice", "place", "a", "b", "n")), strict=True):
                if number != now:
                    if data is not None:
                        yield from done(*data, replies)
                    now, data, replies = number, None, {}
                if kind == _DATA:
                    data = a, b, n, whose, place
                else:
                    replies[level, place] = a, b
        if data is not None:
            yield from done(*data, replies)

    return run


def asked(slices: DataFrame, models: list[str], size: int, held: list[str], schema: StructType) -> DataFrame:
    """The rows of slices (slice, data, words, marks, train, ask, some) that ask, with log10 probabilities.

    train and ask are places in models or null: the model that a slice's good rows are counted in, and the one that its
    rows (if some: only labelled ones) ask. Without models the logs are 0. size: bytes of text that count or ask; there
    are as many places as it has slices, so that small inputs in many partitions don't send a packet for every few words.
    """
    spark = slices.sparkSession
    places, seeds = max(1, min(partitions(spark), -(-size // SLICE))), [_seed(x) for x in models]
    tables, totals, above = [], {}, []
    # Tables of all turns in one scan, whose tasks take files of several.
    read = lambda some: spark.read.schema(_PACKET).parquet(*[x._lectern_path for x in some])
    for level in (3, 2, 1) if models else ():
        # Places take turns, so that not all packets are there at once.
        turns, mine = max(1, min(TURNS[level], -(-size // TURN), places)), []
        for turn in range(turns):
            first, end = _turn(turn, turns, places)
            source = slices.select("slice", "words", "marks", "train", "ask", "some").where("ask is not null" if level < 3 else "true").mapInArrow(_ask(level, seeds, places, turn, turns), _PACKET)
            if above:
                source = source.unionByName(read(above).where((F.col("kind") == _TRAIN) & (F.col("place") >= first) & (F.col("place") < end)))
            mine.append(durable(source.repartition("place").mapInArrow(_count(level, places), _PACKET), f"level{level}"))
            del source
            release(spark, wait=turns > 1)
        above = mine
        tables += mine
        for r in read(mine).where(F.col("kind") == _COUNTS).select("model", "a").collect():  # a row a place and model
            totals[level, r.model] = totals.get((level, r.model), 0) + np.frombuffer(r.a, np.int64)
    columns = ["kind", "level", "model", "slice", "place", "a", "b", "n"]
    data = slices.where("ask is not null").select(F.lit(_DATA).alias("kind"), F.lit(0).alias("level"), F.col("ask").alias("model"), "slice", F.col("some").cast("int").alias("place"), F.col("data").alias("a"), F.col("words").alias("b"), F.col("marks").alias("n"))
    if tables:
        data = data.unionByName(read(tables).where(F.col("kind") == _REPLY).select(columns))
    # Slices take turns as well.
    turns, parts = max(1, min(TURNS[3], -(-size // TURN))), []
    for turn in range(turns):
        own = data.where(F.col("slice") % turns == turn)
        parts.append(durable(own.repartition("slice").sortWithinPartitions("slice").mapInArrow(_finish(totals, seeds, held, places), schema), "scored"))
        release(spark, wait=turns > 1)
    for x in tables:
        drop_durable(x)
    return reduce(DataFrame.unionByName, parts)


def student(share: float, freedom: int) -> float:
    """The quantile of Student's distribution, by the expansion around the normal one."""
    z = NormalDist().inv_cdf(share)
    return z + (z**3 + z) / (4 * freedom) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * freedom**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * freedom**3)


def band(scored: list[tuple[float, int]]) -> tuple[float, float]:
    """Lower and upper bound of log10 perplexity from (value, quality): each side rejects as many bad rows as it can without losing more than LOSS of the good ones, and must reject more bad rows than good ones; without rows that support it, no bound."""
    good = np.sort([x for x, q in scored if q])
    bad = np.sort([x for x, q in scored if not q])
    if len(good) < LEAST_GOOD:
        return -np.inf, np.inf
    spare = int(LOSS * len(good))
    edge, top = _edges(good)
    above, below = bad[bad > top], bad[bad < edge]
    return _bounds(edge, top, spare, len(below), below.max(initial=-np.inf), len(above), above.min(initial=np.inf))


def _edges(good: np.ndarray) -> tuple[float, float]:
    """The values of sorted good rows between which bands may not reject."""
    spare = int(LOSS * len(good))
    edge, top = good[spare], good[len(good) - 1 - spare]
    if not spare:
        # So few rows don't show where LOSS of them lies: the bounds are at least those of the next row, by the spread of either side.
        middle = np.median(good)
        reach = student(1 - LOSS, len(good) - 1) * (1 + 1 / len(good)) ** 0.5
        below, above = ((good[x] - middle) for x in (good <= middle, good >= middle))
        edge, top = min(edge, middle - reach * (below**2).mean() ** 0.5), max(top, middle + reach * (above**2).mean() ** 0.5)
    return float(edge), float(top)


def _bounds(edge: float, top: float, spare: int, n_below: int, below: float, n_above: int, above: float) -> tuple[float, float]:
    # Half way to the next bad row, so that good rows a little beyond the labelled ones stay.
    return float((edge + below) / 2 if n_below > spare else -np.inf), float((top + above) / 2 if n_above > spare else np.inf)


def _bands(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """Bands by `lang` of rows (lang, value, quality), as band() has them; only a language's few good rows, or its edges, are collected."""
    good = {r.lang: r.n for r in rows.where("quality = 1").groupBy("lang").agg(F.count("*").alias("n")).collect() if r.n >= LEAST_GOOD}  # a row a language
    few = [x for x, n in good.items() if not int(LOSS * n)]
    values: dict[str, list[float]] = {}
    for r in rows.where("quality = 1").where(F.col("lang").isin(few)).select("lang", "value").collect() if few else []:  # under 1 / LOSS a language
        values.setdefault(r.lang, []).append(r.value)
    edges = {x: _edges(np.sort(v)) for x, v in values.items()}
    for x in good:
        if x not in edges:
            own, most = rows.where("quality = 1").where(F.col("lang") == x).select("value"), int(LOSS * good[x]) + 1
            edges[x] = own.orderBy("value").limit(most).agg(F.max("value")).first()[0], own.orderBy(F.desc("value")).limit(most).agg(F.min("value")).first()[0]
    if not edges:
        return {}
    side = rows.sparkSession.createDataFrame([(x, *map(float, e)) for x, e in edges.items()], "lang string, edge double, top double")
    bad = rows.where("quality = 0").join(F.broadcast(side), "lang")  # a row a language
    under, over = (F.when(F.col("value") < F.col("edge"), F.col("value")), F.when(F.col("value") > F.col("top"), F.col("value")))
    found = bad.groupBy("lang").agg(F.count(under).alias("n_below"), F.max(under).alias("below"), F.count(over).alias("n_above"), F.min(over).alias("above")).collect()
    return {r.lang: _bounds(*edges[r.lang], int(LOSS * good[r.lang]), r.n_below, r.below, r.n_above, r.above) for r in found}


def _parse(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log10_perplexity.

    base_failed: under 50 words, or more than half the words in repeated three-word windows. kept: not base_failed, and
    the perplexity lies within the bands of the document's language. A language whose labelled rows don't support a band
    has none, so nothing of it is rejected by perplexity; a null one has the bands of all languages together. A null text has no words. Null and
    repeated ids pass through (of an id's labels the least quality counts); an empty table gives no rows; other
    columns are ignored, but for those to carry, which come along.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), *[F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)])
    known = labels.where("quality in (0, 1)").select(F.col(id).alias("id"), F.col("quality").cast("int").alias("quality")).where("id is not null").groupBy("id").agg(F.min("quality").alias("quality"))
    # Texts stay where they are: labels go to them as two bits a row.
    rows = src.withColumn("half", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)).cast("int"))
    held = [c for c in src.columns if c != "text"]
    schema = StructType([src.schema[c] for c in held] + _parse(f"quality int, {_STATISTICS}, probe boolean").fields)
    cut = StructType(_parse("slice long, lang string, half int, size long, data binary, words binary").fields + [StructField("ids", ArrayType(src.schema["id"].dataType))])
    slices = durable(rows.mapInArrow(_cut, cut), "slices")
    found = slices.select("slice", F.size("ids").alias("n"), F.posexplode("ids").alias("at", "id")).join(known, "id")
    found = found.groupBy("slice", "n").agg(F.collect_list(2 * F.col("at") + F.col("quality")).alias("labels"))
    marks = durable(found.mapInArrow(_mark, "slice long, marks binary, good long"), "marks")
    slices, stored = slices.drop("ids").join(F.broadcast(marks), "slice", "left"), (slices, marks)  # two bits a document
    del found, rows
    release(spark)
    there = slices.groupBy("lang", "half").agg(F.sum("size").alias("size"), F.sum("good").alias("good")).collect()  # two rows a language
    trained = [r for r in there if r.good]
    models = {(r.lang, r.half) for r in trained if r.lang is not None} | {(ALL, r.half) for r in trained}
    # Who asks whom: the other half of the own language, else of all together, else nobody.
    size = {(r.lang, r.half): r.size for r in there}
    asks = {x: next((m for m in ((x[0], 1 - x[1]), (ALL, 1 - x[1])) if m in models), None) for x in size}
    own = lambda m: sum(n for x, n in size.items() if x == m or asks[x] == m or (m[0] == ALL and (blank or x[1] == m[1])))
    blank = any(x[0] is None for x in size)  # their bands are of all labelled rows
    waves: list[list[tuple[str, int]]] = [[x] for x in sorted(m for m in models if m[0] == ALL and (blank or m in asks.values()))]
    room = 0
    for m in sorted((m for m in set(asks.values()) if m and m[0] != ALL), key=lambda m: (-size.get(m, 0), m)):
        if own(m) > room:
            waves.append([])
            room = max(WAVE, max(size.values()))
        waves[-1].append(m)
        room -= own(m)
    if None in asks.values():
        waves.append([])
    pick = lambda of: reduce(lambda c, x: c.when(F.col("lang").eqNullSafe(F.lit(x[0][0])) & (F.col("half") == x[0][1]), F.lit(x[1])), of.items(), F.when(F.lit(False), F.lit(0)))
    parts = []
    for wave in waves:
        at = {m: k for k, m in enumerate(wave)}
        ask = pick({x: at.get(m, -1) for x, m in asks.items() if m in at or (m is None and not wave)})
        train, some = pick({x: k for x, k in at.items() if x in size}), F.lit(False)
        if wave and wave[0][0] == ALL:
            train = F.when(F.col("half") == wave[0][1], F.lit(0))
            if blank:
                some = (F.col("half") == 1 - wave[0][1]) & ask.isNull()
        chosen = slices.select("slice", "data", "words", "marks", train.alias("train"), F.coalesce(ask, F.when(some, F.lit(0))).alias("ask"), some.alias("some"))
        parts.append(asked(chosen.where("train is not null or ask is not null"), [f"{x} {half}" for x, half in wave], sum(own(m) for m in wave), held, schema))
    for x in stored:
        drop_durable(x)
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    tried = out.where("quality is not null and n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").withColumn("value", -F.col("log10") / F.col("n_words"))
    bands = _bands(tried.where("not probe and lang is not null").select("lang", "value", "quality"))
    if blank:
        bands[ALL] = _bands(tried.where("probe or lang is null").select(F.lit(ALL).alias("lang"), "value", "quality")).get(ALL, (-np.inf, np.inf))
    out = out.where("not probe")
    value = F.when(F.col("n_words") > 0, -F.col("log10") / F.col("n_words"))
    low, high = (F.when(F.lit(False), F.lit(0.0)) for _ in range(2))
    for x, (a, b) in bands.items():
        if x != ALL:
            low, high = low.when(F.col("lang") == x, F.lit(a)), high.when(F.col("lang") == x, F.lit(b))
    a, b = bands.get(ALL, (-np.inf, np.inf))
    low, high = low.when(F.col("lang").isNull(), F.lit(float(a))), high.when(F.col("lang").isNull(), F.lit(float(b)))
    low, high = low.otherwise(F.lit(-np.inf)), high.otherwise(F.lit(np.inf))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & F.coalesce((value >= low) & (value <= high), F.lit(False))
    return out.select(
        F.col("id").alias(id),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        kept.alias("kept"),
        value.alias("log10_perplexity"),
        *[F.col(f"_carry{k}").alias(c) for k, c in enumerate(carry)],
    )


def good_rows(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that quality keeps.

    The verdict follows from language and text, so it comes back by the id and a digest of these, whatever columns there
    are; a large group of copies is spread by its ids.
    """
    digest = F.xxhash64(F.coalesce(F.col(lang), F.lit("")), F.col(lang).isNull(), F.coalesce(F.col(text), F.lit("")))
    asked = docs.select(F.col(id).alias(id), F.col(text).alias("text"), F.col(lang).alias("lang"), digest.alias("digest"))
    kept = quality(asked, labels, id, carry=("digest",)).where("kept").select(F.col(id).alias("id"), "digest")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id).alias("id"), digest.alias("digest"))
    return rows.alias("r").join(kept.alias("k"), F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.digest") == F.col("k.digest")), "left_semi").select("row.*")
