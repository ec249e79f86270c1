"""Secret scans with DataFrame functions only.

Three base patterns find assignments, access keys and runs of hex digits. A pair of character Markov models, one of
random strings and one of ordinary identifiers, then judges every other long token by its log-likelihood ratio.

The models learn from labelled samples. Random strings are the values that the base patterns find in a sample of rows
and generated ones; ordinary identifiers are the words of the same rows once everything that a base pattern matches is
cut out. Running sums over a text's matches are folded by blocks, so their cost grows little faster than the matches.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.arrays import running
from lectern.llm.common import doubles, durable, share

# The base patterns. Groups: the whole match.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: A match's value is its last run of value characters after the key, [:=] and an opening quote.
ASSIGN_GROUP = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Whole runs of 24 or more; a shorter run would be dropped and gives way to nothing else.
HEX = r"[0-9a-f]{24,}+"
#: What the models judge: long runs of key characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}+"

#: The models' characters; others count as the last one.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Labelled samples: so many generated strings, and secrets and identifiers of so many rows at most (by a hash of the row).
RANDOM_STRINGS, SAMPLE_ROWS = 4000, 2000
#: A token is a secret at this log-likelihood ratio (natural) per transition, or more.
RATIO = 0.5


def _spans(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Array of (start, end, order, kind, match): where a pattern matches, from the lengths of the matches and of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("g"))).otherwise(F.array().cast("array<struct<m:string,g:string>>"))


_SPAN = "struct<s:int,e:int,o:int,k:string,m:string>"


def _located(pairs: Column, kind: str, order: int) -> Column:
    def step(at: Column, p: Column) -> Column:
        s = at + F.length(p["g"])
        e = s + F.length(p["m"])
        return F.struct(e.alias("state"), F.struct(s.alias("s"), e.alias("e"), F.lit(order).alias("o"), F.lit(kind).alias("k"), p["m"].alias("m")).alias("out"))

    return running(F.filter(pairs, lambda p: p["m"].isNotNull()), 0, step, _SPAN)


def _untouched(tokens: Column, base: Column) -> Column:
    """Tokens that no base span overlaps, by two passes over all spans in order: how far the base spans before reach, and where the next one begins."""
    is_base = lambda x: x["o"] < 3
    reach = running(F.array_sort(F.concat(base, tokens)), 0, lambda at, x: F.struct(F.when(is_base(x), F.greatest(at, x["e"])).otherwise(at).alias("state"), F.struct(x["s"].alias("s"), x["e"].alias("e"), x["o"].alias("o"), x["k"].alias("k"), x["m"].alias("m"), at.alias("reach")).alias("out")), f"{_SPAN[:-1]},reach:int>")
    after = running(F.reverse(reach), 2**31 - 1, lambda at, x: F.struct(F.when(is_base(x), x["s"]).otherwise(at).alias("state"), F.struct(x["s"].alias("s"), x["e"].alias("e"), x["o"].alias("o"), x["k"].alias("k"), x["m"].alias("m"), (~is_base(x) & (x["reach"] <= x["s"]) & (at >= x["e"])).alias("free")).alias("out")), f"{_SPAN[:-1]},free:boolean>")
    free = F.transform(F.filter(after, lambda x: x["free"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["o"].alias("o"), x["k"].alias("k"), x["m"].alias("m")))
    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(free.cast(f"array<{_SPAN}>"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _pairs(words: DataFrame) -> DataFrame:
    """Counts of neighbouring characters; the start of a word is -1."""
    chars = F.transform(F.split("word", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    each = words.select(chars.alias("c")).where("size(c) > 1").select(F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("p"))
    return each.select("p.a", "p.b").where("a >= 0 and b >= 0").groupBy("a", "b").count()


def train(docs: DataFrame, id: str, text: str) -> list[float]:
    """Log-likelihood ratios by pair of characters, row after row: log P(b | a, random) - log P(b | a, ordinary).

    The labelled rows are SAMPLE_ROWS rows at most. The random sample are the values of their base matches, and
    RANDOM_STRINGS digests of the numbers from 0 as hex, base 64 and base 36; the ordinary sample are the words of what
    the base patterns leave of them, without those long ones that models of all of them take for random. The table has
    one entry for each pair.
    """
    spark = docs.sparkSession
    seed = spark.range(RANDOM_STRINGS).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    made = seed.select(F.explode(F.array("h", F.translate(F.base64(F.unhex("h")), "=", ""), F.conv(F.substring("h", 1, 15), 16, 36))).alias("word"))
    rows = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("string").alias("k"), F.col(text).alias("t")).withColumn("u", share("k", seed=29))
    rows = rows.where(F.col("u") <= F.lit(1.2 * SAMPLE_ROWS / max(1, docs.count()))).orderBy("u", "k").limit(SAMPLE_ROWS)
    rows = durable(rows.select("t"), "secrets-sample")
    values = F.filter(F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(0)), lambda m: F.regexp_extract(m, ASSIGN_GROUP, 1)), lambda v: F.length(v) >= 16)
    known = F.concat(values, *[F.filter(F.regexp_extract_all("t", F.lit(p), F.lit(0)), lambda m: F.length(m) >= 20) for p in (ACCESS, HEX)])
    random = made.union(rows.where(F.col("t").rlike(f"{ASSIGN}|{ACCESS}|{HEX}")).select(F.explode(known)))
    rest = F.regexp_replace("t", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    plain = rows.select(F.explode(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9+/_-]{4,}"), F.lit(0))).alias("word"))
    plain = durable(plain, "ordinary")
    sure = _table(random, plain)
    # Words that are as random as secrets are none of the ordinary ones: without them, once more.
    return _table(random, plain.where((F.length("word") < 16) | (_ratio(F.col("word"), doubles(sure)) < RATIO / 2)))


def _table(random: DataFrame, plain: DataFrame) -> list[float]:
    n = len(ALPHABET)
    count = {kind: {(r.a, r.b): r["count"] for r in _pairs(w).collect()} for kind, w in (("random", random), ("plain", plain))}  # one row a pair of characters at most
    table = []
    for a in range(n):
        total = {k: sum(c.get((a, b), 0) for b in range(n)) for k, c in count.items()}
        for b in range(n):
            table.append(log((count["random"].get((a, b), 0) + 1) / (total["random"] + n)) - log((count["plain"].get((a, b), 0) + 1) / (total["plain"] + n)))
    return table


def _ratio(word: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    at = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return F.aggregate(
        at,
        F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda acc, c: F.struct(
            c.alias("before"),
            F.when((acc["before"] >= 0) & (c >= 0), acc["sum"] + F.get(table, acc["before"] * len(ALPHABET) + c)).otherwise(acc["sum"]).alias("sum"),
            F.when((acc["before"] >= 0) & (c >= 0), acc["n"] + 1).otherwise(acc["n"]).alias("n"),
        ),
        lambda acc: F.when(acc["n"] > 0, acc["sum"] / acc["n"]).otherwise(F.lit(-1.0)),
    )


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_markov, found.

    found is an array of (start, end, kind, score) in code points, end exclusive; spans joins it as kind:start:end, by
    start and then by kind (assign, access, hex, markov). Base spans always stay; a markov span is a token that no base
    span touches. Null counts as the empty text; null and repeated ids pass through; an empty table gives no rows;
    other columns are ignored. There is no shuffle apart from the training sample's.
    """
    values = doubles(train(docs, id, text))
    t = F.col("t")
    at = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kinds = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("markov", CANDIDATE)]
    at = at.select("id", *[_spans(t, p, k, i).alias(k) for i, (k, p) in enumerate(kinds)])
    at = at.select("id", *[_located(F.col(k), k, i).alias(k) for i, (k, _) in enumerate(kinds)])
    at = at.select(
        "id",
        F.filter("assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN_GROUP, 1)) >= 6).alias("assign"),
        F.filter("access", lambda x: F.length(x["m"]) >= 20).alias("access"),
        "hex",
        "markov",
    )
    at = at.withColumn("base", F.concat("assign", "access", "hex"))
    at = at.withColumn("markov", F.filter("markov", lambda x: _ratio(x["m"], values) >= ratio))
    at = at.withColumn("markov", _untouched(F.col("markov"), F.col("base")))
    all_ = F.concat("base", "markov")
    return at.select(
        F.col("id").alias(id),
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(all_).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
        F.transform(F.array_sort(all_), lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), x["k"].alias("kind"))).alias("found"),
    )
