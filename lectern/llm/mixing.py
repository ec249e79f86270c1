"""Mixing sources to target weights, with DataFrame functions only.

A naive Bayes classifier is fitted on labelled rows: presence of the words and shapes of text that tell the domains apart
best. It gives every document a posterior over domains (soft membership). Projected gradient least squares then fits
nonnegative document rates r so that the expected tokens of each domain, sum of r * n * p, match targets; each step is
one aggregation to a few sums, and a document's rate is a fold over the steps' gradients, so no row moves.

A document is drawn floor(rate) times, and once more if its hash lies below a threshold. Thresholds go by membership and
size: one histogram of bounded size tells, from the largest documents down, at which threshold the domains' drawn tokens
come nearest to those of the rates, and what larger documents leave over or short is made up by smaller ones. So the drawn
totals meet the targets, not only their expectation.
"""

from __future__ import annotations

from math import exp, log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import doubles, durable, share, strings

DOMAINS = ("clean", "toxic", "junk")
#: Shares of the tokens that each domain should have after mixing.
TARGETS = {"clean": 0.97, "toxic": 0.02, "junk": 0.01}
#: Labelled rows that the classifier is fitted on, and marks of each domain but the first, at most.
SAMPLE_ROWS, FEATURES = 12_000, 150
#: Documents of the sample that a feature needs.
LEAST = 6
#: Chi-squared that a feature needs.
EVIDENCE = 30.0
#: Steps of the descent at most, and the relative distance from the targets at which it ends (or half of it from the step before).
STEPS, CLOSE = 40, 0.002
#: Of the draw's histogram: sizes of documents in octaves, steps of a membership, and bins of hashes.
OCTAVES, SOFT, BINS = 40, 4, 512


def _measured(rows: DataFrame) -> DataFrame:
    """rows with `text` get their words (without outer punctuation) and counts, as columns of their own, so that each is worked out once."""
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    rows = rows.withColumns({"words": F.split(F.lower("text"), r"[\x09-\x0D\x20.,;:!?\"()]+", -1), "symbols": count("[#*$%&|<>]"), "capitals": count("[A-Z]{3,}")})
    blank = (F.get("words", F.lit(0)) == "").cast("long"), ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("long")
    return rows.withColumn("n", F.size("words") - blank[0] - blank[1])


def _shape() -> Column:
    """Steps of how many symbols and capital runs a measured text has by word."""
    step = lambda name, cuts: F.concat(F.lit(f"#{name}="), sum(((F.col(name) > c * F.col("n")).cast("int") for c in cuts), F.lit(0)).cast("string"))
    return F.array(step("symbols", (0.02, 0.1, 0.4, 1.0)), step("capitals", (0.05, 0.2, 0.5)))


def train(docs: DataFrame, labels: DataFrame, id: str, text: str) -> tuple[list[float], dict[str, list[float]]]:
    """Log scores of a text without any feature, and what a feature's presence adds, by domain; from a sample of labelled rows by a hash of the id."""
    domain = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 2)
    known = labels.select(F.col(id).alias("id"), domain.alias("domain")).where("id is not null and domain is not null").dropDuplicates(["id"])
    known = known.withColumn("u", share("id", seed=11)).where(F.col("u") <= F.lit(1.2 * SAMPLE_ROWS / max(1, labels.count()))).orderBy("u", "id").limit(SAMPLE_ROWS).drop("u")
    sample = docs.select(F.col(id).alias("id"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(known), "id")  # SAMPLE_ROWS ids at most
    sample = _measured(sample.select("domain", F.col("t").alias("text")))
    sample = durable(sample.select("domain", F.array_distinct(F.concat("words", _shape())).alias("tokens")), "mixing-sample")
    size = {r.domain: r["count"] for r in sample.groupBy("domain").count().collect()}
    rows = [size.get(k, 0) for k in range(len(DOMAINS))]
    prior = [log((x + 1) / (sum(rows) + len(rows))) for x in rows]
    if not sum(rows):
        return prior, {}
    seen = sample.select("domain", F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("n"), *[F.sum((F.col("domain") == k).cast("long")).alias(f"n{k}") for k in range(len(DOMAINS))])
    # Ranked by chi-squared of presence against domain, summed over domains.
    n, total = F.col("n"), float(sum(rows))
    chi = F.lit(0.0)
    for k, x in enumerate(rows):
        want = n * F.lit(x / total)
        chi = chi + F.when(want > 0, (F.col(f"n{k}") - want) * (F.col(f"n{k}") - want) / want).otherwise(0.0)
    # Marks of the other domains: a short text lacks the first domain's common words too, so these tell nothing.
    by = [F.col(f"n{k}") / F.lit(x + 1.0) for k, x in enumerate(rows)]
    seen = seen.where(n >= LEAST).withColumn("chi", chi).where(F.col("chi") >= EVIDENCE)
    best = []
    for k in range(1, len(DOMAINS)):
        mine = (by[k] > 2 * by[0]) & (by[k] >= F.greatest(F.lit(0.0), *by[1:]))
        best += seen.where(mine).orderBy(F.desc("chi"), "w").limit(FEATURES).collect()  # FEATURES rows
    weight = {}
    for r in {r.w: r for r in best}.values():
        has = [(r[f"n{k}"] + 0.5) / (x + 1.0) for k, x in enumerate(rows)]
        prior = [a + log(1 - x) for a, x in zip(prior, has, strict=True)]
        weight[r.w] = [log(x / (1 - x)) for x in has]
    return prior, weight


def _posteriors(rows: DataFrame, prior: list[float], weight: dict[str, list[float]]) -> DataFrame:
    """rows with `text` get `n` (words) and `p`, in steps so that each is evaluated once."""
    if not weight:
        total = sum(exp(x) for x in prior)
        return _measured(rows).drop("words", "symbols", "capitals").withColumn("p", F.array(*[F.lit(exp(x) / total) for x in prior]))
    names = sorted(weight)
    rows = _measured(rows).withColumn("found", F.concat(F.array_intersect("words", strings(names)), F.array_intersect(_shape(), strings(names)))).drop("words")
    place = F.transform("found", lambda w: F.array_position(strings(names), w).cast("int"))
    rows = rows.withColumn("found", place)
    for k in range(len(DOMAINS)):
        rows = rows.withColumn(f"s{k}", _total(F.col("found"), prior[k], [weight[w][k] for w in names]))
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(DOMAINS))])
    up = [F.exp(F.col(f"s{k}") - top) for k in range(len(DOMAINS))]
    total = sum(up[1:], up[0])
    return rows.withColumn("p", F.array(*[u / total for u in up])).drop("found", "symbols", "capitals", *[f"s{k}" for k in range(len(DOMAINS))])


def _total(places: Column, start: float, values: list[float]) -> Column:
    table = doubles(values)
    return F.aggregate(places, F.lit(float(start)), lambda acc, i: acc + F.get(table, i - 1))


def _dot(a: Column, g: Column) -> Column:
    return sum((F.get(a, F.lit(k)) * F.get(g, F.lit(k)) for k in range(1, len(DOMAINS))), F.get(a, F.lit(0)) * F.get(g, F.lit(0)))


def rate(p: Column, pushes: list[list[float]], looks: list[float]) -> Column:
    """The rate after the given steps: a fold of r <- max(0, y + p . push), y <- r + look * (r - previous r)."""
    if not pushes:
        return F.lit(1.0)
    steps = F.array(*[F.struct(doubles(g).alias("g"), F.lit(float(m)).alias("m")) for g, m in zip(pushes, looks, strict=True)])
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))

    def step(acc: Column, s: Column) -> Column:
        r = F.greatest(F.lit(0.0), acc["y"] + _dot(p, s["g"]))
        return F.struct(r.alias("r"), (r + s["m"] * (r - acc["r"])).alias("y"))

    return F.aggregate(steps, start, step)


def fit(members: DataFrame, targets: dict[str, float], steps: int = STEPS) -> tuple[list[list[float]], list[float]]:
    """The steps' pushes and looks, from members (n, p). The target total keeps as many tokens of the first
    domain as there are; a domain that has fewer tokens than its target is repeated by rates over 1, unless it has less
    than one token, which no rate can raise.

    A domain's distance counts relative to the root w of its tokens, and steps are scaled by 1 / n of each document. The
    curvature is then that of sum n p p' / w w', near 1 for sharp memberships, and the step length is the inverse of a
    bound of its largest eigenvalue (the largest row sum).
    """
    k = len(DOMAINS)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    first = members.agg(*[F.sum(F.col("n") * p[i]).alias(f"s{i}") for i in range(k)], *[F.sum(F.col("n") * p[i] * p[j]).alias(f"q{i}{j}") for i in range(k) for j in range(k)]).first()
    if not first.s0:
        return [], []
    goal = [targets[x] * first.s0 / targets[DOMAINS[0]] if first[f"s{i}"] >= 1 else first[f"s{i}"] for i, x in enumerate(DOMAINS)]
    w = [max(first[f"s{i}"], 1e-9) ** 0.5 for i in range(k)]
    reach = max(sum(first[f"q{i}{j}"] / (w[i] * w[j]) for j in range(k)) for i in range(k))
    pushes: list[list[float]] = []
    looks: list[float] = []
    t, before = 1.0, None
    for _ in range(steps):
        state = rate(F.col("p"), pushes, looks) if pushes else F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
        got = members.withColumn("z", state).agg(*[F.sum(F.col("n") * F.col("z.y") * p[i]).alias(f"y{i}") for i in range(k)], *[F.sum(F.col("n") * F.col("z.r") * p[i]).alias(f"r{i}") for i in range(k)]).first()
        off = [abs(got[f"r{i}"] - goal[i]) / max(goal[i], 1.0) for i in range(k)]
        if max(off) <= CLOSE or before is not None and max(abs(a - b) for a, b in zip(off, before, strict=True)) <= CLOSE / 2:
            break
        before = off
        pushes.append([(goal[i] - got[f"y{i}"]) / (w[i] * w[i] * reach) for i in range(k)])
        after = (1 + sqrt(1 + 4 * t * t)) / 2
        looks.append((t - 1) / after)
        t = after
    return pushes, looks


def _hash(id: str) -> Column:
    """A number from 0 to 1 by id and text."""
    return share(id, "text", seed=23)


def _drawn(members: DataFrame, pushes: list[list[float]], looks: list[float]) -> DataFrame:
    """members (n, p, u) get `rate` and `copies`."""
    members = members.withColumn("rate", rate(F.col("p"), pushes, looks)["r"] if pushes else F.lit(1.0))
    more = F.col("rate") - F.floor("rate")
    octave = F.least(F.floor(F.log2(F.col("n") + 1)).cast("int"), F.lit(OCTAVES - 1))
    cell = octave
    for k in range(len(DOMAINS) - 1):
        cell = cell * (SOFT + 1) + F.round(F.get("p", F.lit(k)) * SOFT).cast("int")
    # Below the middle are the hashes that are less than the rate's fraction.
    bin_ = F.least(F.floor((F.col("u") - more + 1) * (BINS // 2)).cast("int"), F.lit(BINS - 1))
    of = lambda x: [F.sum(F.col("n") * F.get("p", F.lit(k)) * x) for k in range(len(DOMAINS))]
    whole = members.agg(F.array(*of(F.col("rate"))).alias("w")).first().w
    seen = members.where(more > 0).groupBy(cell.alias("c"), bin_.alias("q")).agg(F.array(*of(F.lit(1.0))).alias("w"), F.array(*of(more)).alias("want")).collect()  # cells x BINS rows at most
    cells: dict[int, list] = {}
    for r in seen:
        cells.setdefault(r.c, []).append(r)
    plus = lambda a, b, sign=1: [x + sign * y for x, y in zip(a, b, strict=True)]
    far = lambda left: sum((x / max(y or 0.0, 1.0)) ** 2 for x, y in zip(left, whole, strict=True))
    left, at = [0.0] * len(DOMAINS), {}
    for c in sorted(cells, reverse=True):
        for r in cells[c]:
            left = plus(left, r.want)
        after, cut = left, 0
        for r in sorted(cells[c], key=lambda r: r.q):
            left = plus(left, r.w, -1)
            if far(left) < far(after):
                after, cut = left, r.q + 1
        at[c], left = cut, after
    below = F.try_element_at(F.expr(f"map({', '.join(f'{c}, {x}' for c, x in at.items())})"), cell) if at else F.lit(0)
    return members.withColumn("copies", (F.floor("rate") + F.coalesce((more > 0) & (bin_ < below), F.lit(False)).cast("long")).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_tokens (words between white space and punctuation), p_clean, p_toxic, p_junk, rate, copies.

    copies is the rate rounded down or up, so that the tokens drawn of each domain add up to those of the rates; how near
    both come to the targets is said by shares(). Rows alike in id and text are rounded alike. Targets are shares by domain (the first one's must be over 0). A null text counts as empty and has rate by its shape;
    null and repeated ids pass through, repeated labels count once; without labelled rows the memberships are the prior
    and every rate follows from them; an empty table gives no rows; other columns are ignored.
    """
    prior, weight = train(docs, labels, id, text)
    src = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    members = durable(_posteriors(src.withColumn("u", _hash("id")), prior, weight).select("id", "n", "p", "u"), "members")
    out = _drawn(members, *fit(members, targets))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_tokens"), *[F.get("p", F.lit(k)).alias(f"p_{x}") for k, x in enumerate(DOMAINS)], "rate", "copies")


def shares(rows: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(domain, target, reached, drawn) of what mix() returns: shares of the tokens at the rates, and as the copies have them."""
    at = lambda by, x: F.sum(F.col("n_tokens") * F.col(by) * F.col(f"p_{x}"))
    sums = rows.agg(*[at(by, x).alias(f"{by}_{x}") for by in ("rate", "copies") for x in DOMAINS])
    part = lambda by, x: F.try_divide(F.col(f"{by}_{x}"), sum((F.col(f"{by}_{y}") for y in DOMAINS), F.lit(0.0)))
    whole = float(sum(targets[x] for x in DOMAINS))
    each = [F.struct(F.lit(x).alias("domain"), F.lit(targets[x] / whole).alias("target"), part("rate", x).alias("reached"), part("copies", x).alias("drawn")) for x in DOMAINS]
    return sums.select(F.inline(F.array(*each)))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents drawn at their rates, with all their columns: a row of c copies appears c times."""
    prior, weight = train(docs, labels, id, text)
    src = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id).alias("id"))
    # Written once, so that the texts are read and judged once; the steps read narrow columns of it.
    members = durable(_posteriors(src.withColumn("u", _hash("id")), prior, weight).select("row", "n", "p", "u"), "members")
    drawn = _drawn(members, *fit(members.select("n", "p"), targets)).select("row", "copies").where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).select("row.*")
