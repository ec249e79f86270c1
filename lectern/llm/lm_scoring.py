"""Class-based bigram language model by exchange clustering, and the scores of documents under it.

Spark counts all words of the training documents (64-bit word hashes, counted per task before the shuffle). The HEAD most
frequent words are clustered: starting from a round-robin assignment, each word in turn moves to the class that raises
the class-bigram likelihood most, until a sweep moves nothing. Each further word goes to the class that makes its
neighbours most likely, by counts of (word, classes before and after) that are gathered and placed by word on the
executors. Class transitions are then counted over all words.

A text's probability is the product of class transitions (Dirichlet smoothing towards class frequencies) and word
emissions (relative frequency in the class with an absolute discount). The discounts' mass is the probability of an
unknown word, as one type, summed over the classes it may be of.

Texts go through with the TABLE most frequent words' counts and classes, a broadcast of bounded size; less frequent words
meet theirs in a join, and their transitions are put together by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.common import drop_durable, durable, spread

#: Words that are clustered, classes, and sweeps of the exchange at most.
HEAD, CLASSES, SWEEPS = 2000, 64, 8
#: Words whose counts and classes are broadcast: 18 bytes each.
TABLE = 500_000
#: Weight of class frequencies in a transition's probability.
PRIOR = 5.0
#: Entries that a task gathers before it hands them on.
GATHER = 2_000_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c) of the words of a task's texts; each h at most once per GATHER entries."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([x[0] for x in held])
        c = np.concatenate([x[1] for x in held])
        u, at = np.unique(h, return_inverse=True)
        return u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)

    for whole in batches:
        for batch in tokens.slices(whole, "text"):
            words, _ = tokens.words(batch.column("text"))
            held.append(np.unique(words, return_counts=True))
            size += len(held[-1][0])
            if size > GATHER:
                held = [merged()]
                size = len(held[0][0])
                if size > GATHER // 2:
                    yield from _packed(*held[0])
                    held, size = [], 0
    if held:
        yield from _packed(*merged())


def _packed(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(h), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000].astype(np.int64))], names=["h", "c"])


def _index(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in a sorted table, or its length where a word isn't in it."""
    if not len(table):
        return np.zeros(len(words), np.int64)
    at = np.searchsorted(table, words)
    at[at == len(table)] = 0
    return np.where(table[at] == words, at, len(table))


def _chain(words: np.ndarray, first: np.ndarray, symbol: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, symbol, row) of all tokens: each row's words and then its end; an end also stands before the first."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n + 1)
    end = np.cumsum(n + 1) - 1
    out = np.full(len(row), edge, np.int64)
    inner = np.ones(len(row), bool)
    inner[end] = False
    out[inner] = symbol
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[:1] = edge
    return before, out, row


def _count_pairs(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        k = len(known) + 2
        total = np.zeros(k * k, np.int64)
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                words, first = tokens.words(batch.column("text"))
                before, symbol, _ = _chain(words, first, _index(words, known), k - 1)
                total += np.bincount(before * k + symbol, minlength=k * k)
        at = np.flatnonzero(total)
        yield from _packed(at.astype(np.int64), total[at])

    return run


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Parts (key columns, counts) summed by key, GATHER entries at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def merged() -> tuple[np.ndarray, ...]:
        *keys, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort(keys)
        keys = [x[order] for x in keys]
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
        at = np.flatnonzero(new)
        return *(x[at] for x in keys), np.add.reduceat(n[order], at) if len(at) else n

    def batches() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(held[0][0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in held[0]], names=names)

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > GATHER:
            held = [merged()]
            size = len(held[0][0])
            if size > GATHER // 2:
                yield from batches()
                held, size = [], 0
    if held:
        held = [merged()]
        yield from batches()


def _count_contexts(sent):
    """(h, code, c) of the words outside the head: code has the classes before and after."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        known, label = sent.value
        rest, edge = int(label[-2]), int(label[-1])
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                words, first = tokens.words(batch.column("text"))
                at = _index(words, known)
                before, symbol, row = _chain(words, first, label[at], edge)
                inner = np.arange(len(words)) + np.repeat(np.arange(batch.num_rows), np.diff(first))
                far = at == len(known)
                code = before[inner[far]] * (edge + 1) + symbol[inner[far] + 1]
                yield words[far].view(np.int64), code.astype(np.int64), np.ones(len(code), np.int64)

    return lambda batches: _gathered(parts(batches), ["h", "code", "c"])


def _place(grid: np.ndarray):
    """(h, c, k): a word's class from its contexts, under the class transitions of the head."""
    k = len(grid) - 2
    p = (grid + PRIOR * (grid.sum(axis=0) + 1) / (grid.sum() + len(grid))) / (grid.sum(axis=1, keepdims=True) + PRIOR)
    mass = np.log(grid.sum(axis=0)[:k] + 1)
    into, out = np.log(p)[:, :k], np.log(p)[:k].T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 5000):
                batch = whole.slice(i, 5000)
                n, rows = len(grid), batch.num_rows
                seen = batch.column("seen")
                word = np.repeat(np.arange(rows), seen.value_lengths().to_numpy())
                code, c = (seen.flatten().field(x).to_numpy() for x in ("code", "c"))
                left, right = (np.bincount(word * n + x, weights=c, minlength=rows * n).reshape(rows, n) for x in (code // n, code % n))
                total = left.sum(axis=1)
                # Rounded, so that the order of sums doesn't decide between classes that are as good.
                best = np.round((left @ into + right @ out - total[:, None] * mass) / total[:, None], 9).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(total.astype(np.int64)), pa.array(best.astype(np.int32))], names=["h", "c", "k"])

    return run


def _count_steps(sent):
    """(kind, x, y, c) of neighbours: classes, but of kind 1 and 3 x, and of kind 2 and 3 y, is a word outside the broadcast."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        known, label, edge = sent.value
        total = np.zeros((edge + 1) ** 2, np.int64)
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                words, first = tokens.words(batch.column("text"))
                before, symbol, row = _chain(words, first, np.append(label, -1)[_index(words, known)], edge)
                kind = (before < 0) + 2 * (symbol < 0)
                near = kind == 0
                total += np.bincount(before[near] * (edge + 1) + symbol[near], minlength=len(total))
                own = np.zeros(len(row), np.int64)
                own[np.arange(len(words)) + np.repeat(np.arange(batch.num_rows), np.diff(first))] = words.view(np.int64)
                x = np.where(before < 0, np.concatenate([own[:1], own[:-1]]), before)[~near]
                y = np.where(symbol < 0, own, symbol)[~near]
                yield kind[~near].astype(np.int64), x, y, np.ones(len(x), np.int64)
        at = np.flatnonzero(total)
        yield np.zeros(len(at), np.int64), at // (edge + 1), at % (edge + 1), total[at]

    return lambda batches: _gathered(parts(batches), ["kind", "x", "y", "c"])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the words 0 .. n - 3 of a bigram count matrix; the last two rows keep classes of their own.

    Each move raises sum f(class pair) - sum f(left class) - sum f(right class), f(x) = x log x.
    """
    n = len(pairs)
    words, c = n - 2, min(classes, max(1, n - 2))
    label = np.concatenate([np.arange(words) % c, [c, c + 1]])
    k = c + 2
    member = np.zeros((n, k))
    member[np.arange(n), label] = 1
    grid = member.T @ pairs @ member
    out, into = pairs @ member, pairs.T @ member
    everything = np.arange(c)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a = label[w]
            r, l, self_ = out[w].copy(), into[w].copy(), pairs[w, w]  # noqa: E741
            r[a] -= self_
            l[a] -= self_
            # Without the word.
            grid[a] -= r
            grid[:, a] -= l
            grid[a, a] -= self_
            # With it in each class: its row and column of the grid change.
            rows, columns = grid[:c], grid[:, :c].T
            add = r.sum() + self_, l.sum() + self_
            gain = (_f(rows + r) - _f(rows)).sum(axis=1) + (_f(columns + l) - _f(columns)).sum(axis=1)
            own = grid[everything, everything]
            gain -= (_f(own + r[:c]) - _f(own)) + (_f(own + l[:c]) - _f(own))
            gain += _f(own + r[:c] + l[:c] + self_) - _f(own)
            left, right = rows.sum(axis=1), columns.sum(axis=1)
            gain -= _f(left + add[0]) - _f(left) + _f(right + add[1]) - _f(right)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += r
            grid[:, b] += l
            grid[b, b] += self_
            if b != a:
                moved += 1
                label[w] = b
                out[:, a] -= pairs[:, w]
                out[:, b] += pairs[:, w]
                into[:, a] -= pairs[w]
                into[:, b] += pairs[w]
        if not moved:
            break
    return label


class Model:
    """What scoring needs: sorted words with counts, their classes and emissions, transitions; bounded by TABLE and CLASSES.

    Symbols are the classes, then an unknown word, then the end of a text.
    """

    def __init__(self, words, counts, label, grid, mass, types, n_ends, discount):
        order = np.argsort(words)
        self.words, self.counts, self.label = words[order], counts[order].astype(np.float64), label[order].astype(np.int16)
        c = len(mass)
        self.rare, self.edge = c, c + 1
        self.n_tokens, self.n_types, self.n_ends = int(mass.sum()) + n_ends, int(types.sum()) + (n_ends > 0), int(n_ends)
        self.floor = float(np.log10(self.n_tokens + self.n_types + 1))
        into = grid.sum(axis=0)
        share = np.where(into > 0, into + 1, 0.0)
        p = (grid + PRIOR * share / max(share.sum(), 1.0)) / (grid.sum(axis=1, keepdims=True) + PRIOR)
        # A class's discounts, as a share of its mass, and where the discounts of all classes lie.
        left = discount * types / np.maximum(mass, 1.0)
        lies = types / max(types.sum(), 1.0)
        p[:, c] = p[:, :c] @ left
        p[c] = lies @ p[:c]
        with np.errstate(divide="ignore"):
            self.step = np.maximum(np.log10(p), -self.floor - 1)
        self.discount, self.mass = float(discount), np.maximum(mass, 1.0).astype(np.float64)
        self.emit = self.emission(self.counts, self.label)

    def emission(self, counts: np.ndarray, label: np.ndarray) -> np.ndarray:
        """log10 probability of known words in their classes."""
        return np.log10((counts - self.discount) / self.mass[label])


_SCORED = "key long, id string, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<long>, place array<int>, before array<int>, after array<int>"


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = model.value
        key = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in tokens.slices(whole, "text", 4 << 20):
                rows = batch.num_rows
                words, first = tokens.words(batch.column("text"))
                at = _index(words, m.words)
                known = at < len(m.words)
                of = np.repeat(np.arange(rows), np.diff(first))
                before, symbol, row = _chain(words, first, np.append(m.label, -1)[at], m.edge)
                near = (before >= 0) & (symbol >= 0)
                score = np.bincount(row[near], weights=m.step[before[near], symbol[near]], minlength=rows)
                score += np.bincount(of[known], weights=m.emit[at[known]], minlength=rows)
                n = np.diff(first) + 1
                base = np.bincount(of, weights=np.log10(np.append(m.counts, 0.0)[at] + 1), minlength=rows) + np.log10(m.n_ends + 1) - n * m.floor
                n_known = np.bincount(of[known], minlength=rows) + (m.n_ends > 0)
                where = np.flatnonzero(~known)
                cut = np.searchsorted(where, first)
                inner = where + of[where]
                place = where - first[of[where]]
                offsets = pa.array(cut.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(key, key + rows)),
                        batch.column("id"),
                        batch.column("held_out"),
                        pa.array(n.astype(np.int64)),
                        pa.array(n_known.astype(np.int64)),
                        pa.array(base),
                        pa.array(score),
                        pa.ListArray.from_arrays(offsets, pa.array(words[where].view(np.int64))),
                        *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (place, before[inner], symbol[inner + 1])),
                    ],
                    names=["key", "id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "place", "before", "after"],
                )
                key += rows

    return run


def _score_tail(model):
    """What the words outside the broadcast add to their documents' sums: their emissions and all transitions from and to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            tail, rows = batch.column("tail"), batch.num_rows
            row = np.repeat(np.arange(rows), tail.value_lengths().to_numpy())
            place, k, c, before, after = (tail.flatten().field(x).to_numpy() for x in ("place", "k", "c", "before", "after"))
            order = np.lexsort((place, row))
            place, k, c, before, after = (x[order] for x in (place, k, c, before, after))
            k = np.where(k < 0, m.rare, k)
            after = np.where(after < 0, np.append(k[1:], m.edge)[: len(k)], after)  # the next word of the text is the next here
            score = m.step[k, after] + np.where(before >= 0, m.step[before, k], 0.0)
            known = c > 0
            score[known] += m.emission(c[known], k[known])
            total = lambda x: np.bincount(row, weights=x, minlength=rows)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(total(known).astype(np.int64)), pa.array(total(np.log10(c + 1.0))), pa.array(total(score))], names=["key", "more_known", "more_base", "more_score"])

    return run


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, ...]:
    """Words, counts and further columns from a least count on, most frequent first: so many words at most.

    The least count comes from a histogram in eighths of an octave (some hundred rows), so no task sorts all words.
    """
    step = F.floor(F.log2("c") * 8)
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect(), reverse=True):
        left -= r.n
        if left < 0:
            break
        least = r.b
    top = counts.where(step >= F.lit(least)).toArrow()  # no row if least is null
    h, c, *more = (top.column(x).to_numpy() for x in top.column_names)
    order = np.lexsort((h, -c))
    return h[order].view(np.uint64), c[order], *(x[order] for x in more)


def train(rows: DataFrame, head: int = HEAD, classes: int = CLASSES, table: int = TABLE) -> tuple[Model, DataFrame]:
    """The model of the rows (id, text, held_out) that aren't held out, and counts and classes (h, c, k) of all their words."""
    spark = rows.sparkSession
    share = spark.sparkContext.broadcast
    kept = rows.where("not held_out").select("text")
    counts = durable(kept.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    ends = kept.count()
    words, count = _frequent(counts, max(table, head))
    chosen, n = np.sort(words[:head]), dict(zip(words[:head].tolist(), count[:head].tolist(), strict=True))
    sent = share(chosen)
    pairs = kept.mapInArrow(_count_pairs(sent), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).toArrow()  # (head + 2) ** 2 rows at most
    k = len(chosen) + 2
    grid = np.zeros(k * k)
    grid[pairs.column("h").to_numpy()] = pairs.column("c").to_numpy()
    grid = grid.reshape(k, k)
    label = exchange(grid, classes)
    edge = int(label[-1])
    member = np.zeros((k, edge + 1))
    member[np.arange(k), label] = 1
    # The words outside the head; all contexts of a word are dealt to one task.
    seen = spread(kept.mapInArrow(_count_contexts(share((chosen, label))), "h long, code long, c long"), "h").groupBy("h", "code").agg(F.sum("c").alias("c"))
    placed = seen.groupBy("h").agg(F.collect_list(F.struct("code", "c")).alias("seen")).mapInArrow(_place(member.T @ grid @ member), "h long, c long, k int")
    top = pa.table({"h": chosen.view(np.int64), "c": pa.array([n[x] for x in chosen.tolist()], pa.int64()), "k": label[:-2].astype(np.int32)})
    known = durable(placed.union(spark.createDataFrame(top, "h long, c long, k int")), "classes")
    drop_durable(counts)
    words, count, of = _frequent(known, max(table, head))
    # Transitions between the classes of all words.
    order = np.argsort(words)
    steps = durable(kept.mapInArrow(_count_steps(share((words[order], of[order].astype(np.int64), edge))), "kind long, x long, y long, c long"), "steps")
    first, second = (known.select(F.col("h").alias(x), F.col("k").cast("long").alias("k")) for x in ("x", "y"))
    left = steps.where("kind in (1, 3)").join(first, "x").select(F.col("kind") - 1, F.col("k").alias("x"), "y", "c").toDF("kind", "x", "y", "c")
    half = steps.where("kind in (0, 2)").union(left)
    whole = half.where("kind = 0").select("x", "y", "c").union(half.where("kind = 2").join(second, "y").select("x", F.col("k").alias("y"), "c"))
    got = whole.groupBy("x", "y").agg(F.sum("c").alias("c")).toArrow()  # (classes + 2) ** 2 rows at most
    drop_durable(steps)
    grid = np.zeros((edge + 1, edge + 1))
    grid[got.column("x").to_numpy(), got.column("y").to_numpy()] = got.column("c").to_numpy()
    mass, types = np.zeros(edge - 1), np.zeros(edge - 1)
    one = two = 0
    for r in known.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("one"), F.sum((F.col("c") == 2).cast("long")).alias("two")).collect():
        mass[r.k], types[r.k] = r.c, r.n
        one, two = one + r.one, two + r.two
    discount = min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
    return Model(words, count, of, grid, mass, types, ends, discount), known


def lm_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", head: int = HEAD, classes: int = CLASSES, table: int = TABLE) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity.

    Documents whose crc32 of the id as text, modulo 7, is 2 are held out of the training. A null text counts as empty
    (only its end is a token), a null id as the empty text. Repeated rows are scored and counted each; an empty table
    gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id]
    name = F.coalesce(F.col(id).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.crc32(name) % 7 == 2).alias("held_out"))
    model, counts = train(rows, head, classes, table)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = durable(rows.mapInArrow(_score(sent), _SCORED), "scores")
    rest = scored.select("key", F.explode(F.arrays_zip("tail", "place", "before", "after")).alias("t")).select("key", F.col("t.tail").alias("h"), "t.place", "t.before", "t.after")
    # A word that the training doesn't have stays, as an unknown one.
    found = rest.join(counts, "h", "left").select("key", F.struct("place", F.coalesce("k", F.lit(-1)).alias("k"), F.coalesce("c", F.lit(0)).alias("c"), "before", "after").alias("t"))
    found = found.groupBy("key").agg(F.collect_list("t").alias("tail")).mapInArrow(_score_tail(sent), "key long, more_known long, more_base double, more_score double")
    out = scored.drop("tail", "place", "before", "after").join(found, "key", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    score = plus("score", "more_score")
    return out.select(
        F.col("id").cast(kind).alias(id),
        "held_out",
        "n_tokens",
        plus("n_known", "more_known").cast("long").alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
