"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Template and document words (letters and digits, lowered) are hashed into GRAM-word runs; of each WINDOW of runs the
least hash is kept (winnowing), so any common stretch of GRAM + WINDOW - 1 words shares a fingerprint. The templates'
fingerprints form an inverted index, whose size depends on the templates alone and which every task holds. A hit of a
document lies on a diagonal, its place in the text less that in the template. Diagonals of one template that lie within
half its length are aligned together, in a band that holds all of them and a margin on both sides, so a copy that drifts
by no more than the margin is wholly in the band of its least diagonal. Matched words over template words is the coverage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm.license_templates import TEMPLATES

#: Words of a run, runs of a window, and words by which an alignment may drift beyond its hits at least (more where a template's coverage leaves out more).
GRAM, WINDOW, BAND = 3, 2, 12
#: Share of a template's words that must match in order.
COVERAGE = 0.8
#: Templates of so many words need hits at two of their places.
LONG = 20

#: Words are runs of ASCII letters and digits and of characters beyond ASCII.
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_PLAIN = np.array([c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256)], np.uint8)


def _words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [x for _, x in found]


def _hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    return tokens.words(pa.array(["\x20".join(words)], pa.string()))[0]


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column of texts, and the first word's index of each row."""
    data, offsets = tokens.raw(column)
    data = _PLAIN[data]
    starts, ends = tokens.spans(data, offsets)
    return tokens.hash_words(data, starts, ends), np.searchsorted(starts, offsets)


def winnow(words: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the chosen runs: of each window the least hash, the rightmost of equal ones."""
    runs = tokens.shingles(words, gram)
    if len(runs) <= window:
        return (runs, np.arange(len(runs))) if len(runs) <= 1 else (runs[[runs.argmin()]], np.array([runs.argmin()]))
    view = np.lib.stride_tricks.sliding_window_view(runs, window)[:, ::-1]
    at = np.unique(np.arange(len(view)) + window - 1 - view.argmin(axis=1))
    return runs[at], at


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of two word lists within the diagonals low to high (place in words less place in template).

    A row of the table is the running maximum of what a match, or the row above, gives; only the band is kept. Of several
    longest ones it is one that ends first, and begins late for that end.
    """
    n, m, width = len(template), len(words), high - low + 1
    best = np.zeros((n + 1, width + 1), np.int32)  # best[i, d]: of the first i template words and the first i + low + d words
    offset = low + np.arange(width)
    hits = np.zeros((n, width), bool)
    for i in range(1, n + 1):
        at = i - 1 + offset  # the word that diagonal d has for template word i - 1
        inside = (at >= 0) & (at < m)
        hit = hits[i - 1]
        hit[inside] = words[at[inside]] == template[i - 1]
        # Diagonal d of the row above ends one word earlier; d + 1 of it ends at the same word.
        row = np.where(hit, best[i - 1, :width] + 1, best[i - 1, 1 : width + 1])
        best[i, :width] = np.maximum.accumulate(np.maximum(row, best[i - 1, 1 : width + 1]))
    # From the earliest end back over the latest matches, so that the pairs lie close together.
    i, d, out = n, int(np.argmax(best[n, :width])), []
    while i > 0 and d >= 0:
        here = best[i, d]
        if here == 0:
            break
        if hits[i - 1, d] and here == best[i - 1, d] + 1:
            out.append((i - 1, i - 1 + low + d))
            i -= 1
        elif d and best[i, d - 1] == here:
            d -= 1
        else:
            i, d = i - 1, d + 1
    return out[::-1]


class Index:
    """Fingerprint to (template, place); bounded by the templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [_words(templates[n])[0] for n in self.names]
        self.hashes = [_hashes(w) for w in self.words]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, h in enumerate(self.hashes):
            for x, at in zip(*winnow(h), strict=True):
                self.places.setdefault(int(x), []).append((t, int(at)))
        self.keys = np.array(sorted(self.places), np.uint64)


def matches(index: Index, text: str, coverage: float) -> list[tuple[str, int, int, float, int]]:
    """(template, start, end, coverage, matched words) in code points; overlapping ones give way to the longer match."""
    h = _hashes(_words(text)[0])
    return _matches(index, text, h, coverage)


def _matches(index: Index, text: str, h: np.ndarray, coverage: float) -> list[tuple[str, int, int, float, int]]:
    runs, at = winnow(h)
    place = np.searchsorted(index.keys, runs)
    place[place == len(index.keys)] = 0
    hit = index.keys[place] == runs if len(index.keys) else np.zeros(len(runs), bool)
    if not hit.any():
        return []
    spans = _words(text)[1]
    begin: dict[int, list[tuple[int, int]]] = {}
    for x, place in zip(runs[hit].tolist(), at[hit].tolist(), strict=True):
        for t, where in index.places[x]:
            begin.setdefault(t, []).append((place - where, where))
    found = []
    for t, hits in begin.items():
        template = index.hashes[t]
        n = len(template)
        band, reach = max(BAND, int((1 - coverage) * n) + 1), max(BAND, n // 2)  # a margin of all words that the coverage leaves out
        hits.sort()
        i = 0
        while i < len(hits):
            low, places = hits[i][0], set()
            while i < len(hits) and hits[i][0] <= low + reach:
                high = hits[i][0]
                places.add(hits[i][1])
                i += 1
            if n >= LONG and len(places) < 2:
                continue
            begins = max(0, low - band)
            part = h[begins : max(0, high + band + n)]
            pairs = align(template, part, low - band - begins, high + band - begins)
            if pairs and len(pairs) >= coverage * n:
                a, b = begins + pairs[0][1], begins + pairs[-1][1]
                found.append((index.names[t], spans[a][0], spans[b][1], len(pairs) / n, len(pairs)))
    found.sort(key=lambda x: (-x[4], -x[3], x[1], x[0]))
    kept: list[tuple] = []
    for x in found:
        if all(x[2] <= y[1] or y[2] <= x[1] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[1])


def _scan(index, coverage: float):
    kind = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64()), ("words", pa.int64())]))
    names = ("template", "start", "end", "coverage", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, "text"):
                text = batch.column("text")
                h, first = _hashed(text)
                found = [[dict(zip(names, x, strict=True)) for x in _matches(index.value, text[i].as_py(), h[first[i] : first[i + 1]], coverage)] for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], names=["id", "found"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per document: id, n_licenses, licenses (names, comma-joined, by start), best_coverage, spans, found.

    found is an array of (template, start, end, coverage, words); spans joins it as template:start:end. Positions are
    code points, end exclusive. A null text counts as empty and has no matches; null and repeated ids pass through; an
    empty table gives no rows; other columns are ignored. No shuffle.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))
    src = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(src.dtypes)["id"]
    out = src.mapInArrow(_scan(index, coverage), f"id {kind}, found array<struct<template:string,start:long,end:long,coverage:double,words:long>>")
    return out.select(
        F.col("id").alias(id),
        F.size("found").cast("long").alias("n_licenses"),
        F.array_join("found.template", ",").alias("licenses"),
        F.array_max("found.coverage").alias("best_coverage"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["template"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        "found",
    )
