"""Mixing sources to target weights: soft domain membership and rates fitted to token targets, in DataFrame expressions.

A naive Bayes classifier is learnt from a labelled table (a bounded sample of its rows for each domain): for its most
telling words it keeps a row of log-likelihoods by domain. Every document's words meet that table in a join, and the sums
give the posterior of each domain, so that a document may belong to several domains. Then each document gets a
nonnegative rate (how often it is to be read). Projected gradient descent minimises the squared distances between the
expected token totals of the domains, sum of rate * tokens * posterior, and their targets, each weighted by the
domain's own mass, so that a small domain's target counts as much as a large one's. Documents of equal posterior get
equal rates, so an iteration is one aggregation over the distinct posteriors, to a few numbers a domain; rates are
written to the shared folder every few iterations. It ends when the targets are met, when no rate moves any more or a
step brings less than a ten-thousandth of the distance (targets that the bounds do not allow), or after 100 rounds.
`unmet` tells how far off its target the worst domain is then.

Edge cases: null and empty texts have no tokens, the prior as posterior, and the rate of that posterior; targets of domains
that the labelled table does not know are an error; domains without any expected tokens cannot be reached and keep what
they have. The result has one row a key: texts of equal key are one document, whose tokens add up. Rows with a null key
have no row and take no part. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, saved

#: Labelled rows of each domain that the classifier is learnt from, and words that it keeps.
SAMPLE = 500
WORDS = 400
#: Weight of one telling word: words of a text are not independent.
TEMPER = 0.5
#: Parts that the documents of one posterior are dealt to.
SALTS = 16


def words_of(text: Column) -> Column:
    """Lower-cased runs of characters other than white space and common punctuation; the first and last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,]+")


@dataclass(frozen=True)
class DomainModel:
    """The domains, their log priors, and the telling words' log-likelihood table (word, one column a domain)."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    table: tuple[tuple, ...]


def learn(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain") -> DomainModel:
    """Fit on at most SAMPLE labelled rows of each domain, drawn by the hash of their key. labelled: (key, domain).

    The priors are those of all labelled rows.
    """
    known = labelled.where(F.col(key).isNotNull() & F.col(domain).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(domain).alias("_d"))
    counts = {r._d: r["count"] for r in known.groupBy("_d").count().collect()}  # one row a domain
    if not counts:
        return DomainModel((), (), ())
    # a hash leaves about four times as many rows as are wanted, so that a large domain does not meet in one task
    share = F.create_map(*(x for d, n in counts.items() for x in (F.lit(d), F.lit(4.0 * SAMPLE / n))))
    few = known.where(F.pmod(F.xxhash64("_k", F.lit("few")), F.lit(1 << 20)) / (1 << 20) < share[F.col("_d")])
    place = F.row_number().over(Window.partitionBy("_d").orderBy(F.xxhash64("_k"), "_k"))
    drawn = few.withColumn("_r", place).where(F.col("_r") <= SAMPLE).drop("_r")  # SAMPLE rows a domain
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(drawn), "_k")
    seen = rows.select("_d", F.explode(words_of(F.col("_t"))).alias("word")).where("word <> ''").groupBy("_d", "word").agg(F.count("*").alias("n"))
    seen = saved(seen, "words")
    totals = {r._d: r.n for r in seen.groupBy("_d").agg(F.sum("n").alias("n")).collect()}  # one row a domain
    domains = tuple(sorted(counts))
    wide = seen.groupBy("word").pivot("_d", list(domains)).agg(F.sum("n"))
    logs = [F.log((F.coalesce(F.col(f"`{d}`"), F.lit(0)) + 0.5) / (totals.get(d, 0) + 1.0)) for d in domains]
    # the sum of all pairs' distances, from the sorted values: the i-th of k counts 2 i + 1 - k times
    ordered = F.array_sort(F.array(*logs))
    spread = F.aggregate(F.transform(ordered, lambda x, i: x * (2 * i + 1 - len(domains))), F.lit(0.0), lambda a, x: a + x)
    weight = F.aggregate(F.array(*(F.coalesce(F.col(f"`{d}`"), F.lit(0)) / max(totals.get(d, 0), 1) for d in domains)), F.lit(0.0), lambda a, x: a + x)
    telling = wide.select("word", *(x.alias(f"l{i}") for i, x in enumerate(logs)), (spread * weight).alias("worth")).orderBy(F.desc("worth"), "word").limit(WORDS).collect()
    whole = sum(counts[d] for d in domains)
    prior = tuple(math.log(counts[d] / whole) for d in domains)
    return DomainModel(domains, prior, tuple((r.word, *(r[f"l{i}"] for i in range(len(domains)))) for r in telling))


def posteriors(docs: DataFrame, model: DomainModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens, p): words and domain posteriors of each key; texts of equal key add up.

    A model without domains gives empty posteriors.
    """
    spark = docs.sparkSession
    k = len(model.domains)
    if not k:
        words = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.explode(words_of(F.col(text))).alias("word"))
        none = F.array().cast("array<double>").alias("p")
        return words.groupBy(F.col("_k").alias(key)).agg(F.sum(F.when(F.col("word") != "", 1).otherwise(0)).alias("tokens")).select(key, "tokens", none)
    table = spark.createDataFrame([tuple(r) for r in model.table], "word string, " + ", ".join(f"l{i} double" for i in range(k)))  # WORDS rows
    words = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.explode(words_of(F.col(text))).alias("word"))
    hits = words.join(F.broadcast(table), "word", "left")
    # likelihoods relative to the first domain, so that words outside the table say nothing
    sums = [F.sum(F.coalesce(F.col(f"l{i}") - F.col("l0"), F.lit(0.0))).alias(f"s{i}") for i in range(k)]
    per = hits.groupBy("_k").agg(F.sum(F.when(F.col("word") != "", 1).otherwise(0)).alias("tokens"), *sums)
    scores = F.array(*(F.round(F.col(f"s{i}") * TEMPER + (model.prior[i] - model.prior[0]), 6) for i in range(k)))
    top = F.array_max("z")
    weights = F.transform("z", lambda x: F.exp(x - top))
    share = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    p = F.transform(weights, lambda x: F.round(x / share, 3))
    return per.withColumn("z", scores).withColumn("p", p).select(F.col("_k").alias(key), "tokens", "p")


@dataclass(frozen=True)
class Fit:
    """How the fit ended: rounds, the domains' totals and what was wanted, and whether that is met."""

    rounds: int
    totals: tuple[float, ...]
    wanted: tuple[float, ...]
    met: bool

    @property
    def unmet(self) -> float:
        """The largest distance of a domain's total from its target, as a share of all that is wanted."""
        return max((abs(t - w) for t, w in zip(self.totals, self.wanted, strict=True)), default=0.0) / max(sum(self.wanted), 1e-300)


def fit_rates(members: DataFrame, targets: list[float], budget: float | None = None, low: float = 0.0, high: float | None = None, rounds: int = 100, every: int = 8, tolerance: float = 1e-4) -> tuple[DataFrame, Fit]:
    """(members with rate, how the fit ended): rates from `low` on (and up to `high`) whose expected domain totals come to the targets.

    targets: shares of the token budget by domain; budget: wanted tokens (the corpus's own number by default). With the
    totals' distances e and G the table of sums of tokens * p_i * p_j, a step takes the sum of u_i * p_i from each rate.
    First u solves G u = e over the rates that no bound holds. Once such a step has not come nearer, all further ones
    take u_i = e_i / (sum of row i of G): projected gradient steps that cannot go too far, as that sum bounds G.
    """
    k = len(targets)
    top = float("inf") if high is None else high
    state = saved(members.groupBy("p").agg(F.sum("tokens").alias("tokens")).withColumn("rate", F.lit(float(min(max(1.0, low), top)))), "rates")
    share = lambda i: F.col("tokens") * F.col("p")[i]
    mass = state.agg(F.sum("tokens").alias("t"), *(F.sum(share(i) * F.aggregate("p", F.lit(0.0), lambda a, x: a + x)).alias(f"g{i}") for i in range(k))).first()
    wanted = [t * (budget if budget is not None else mass.t or 0) for t in targets]
    rows = np.array([float(mass[f"g{i}"] or 0) for i in range(k)])
    rate, move, met, before, solving = F.col("rate"), F.lit(1.0), False, float("inf"), True
    for turn in range(rounds + 1):
        free = (F.col("r") > low) & (F.col("r") < top) if turn else F.lit(True)
        sums = [F.sum(share(i) * F.col("r")).alias(f"t{i}") for i in range(k)] + [F.sum(F.when(free, share(i) * F.col("p")[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]
        now = state.select("tokens", "p", rate.alias("r"), move.alias("m")).agg(F.max(F.abs("m")).alias("m"), *sums).first()
        totals = [float(now[f"t{i}"] or 0) for i in range(k)]
        away = np.array(totals) - np.array(wanted)
        met = float(np.abs(away).max(initial=0.0)) <= tolerance * sum(wanted)
        if met or now.m is None or now.m <= 1e-5 or not mass.t:
            break
        distance = float((away**2 / np.maximum(rows, 1e-300)).sum())
        if turn == rounds or not solving and before - distance <= 1e-4 * distance:
            break
        solving, before = solving and distance < before, distance
        step = np.where(rows > 0, away / np.maximum(rows, 1e-300), 0.0)
        if solving:
            gram = np.array([[float(now[f"g{max(i, j)}_{min(i, j)}"] or 0) for j in range(k)] for i in range(k)])
            step = np.linalg.lstsq(gram + 1e-9 * np.diag(rows), away, rcond=None)[0] if gram.any() else step
        down = sum((F.lit(float(x)) * F.col("p")[i] for i, x in enumerate(step)), F.lit(0.0))
        new = F.greatest(F.lit(float(low)), rate - down) if high is None else F.greatest(F.lit(float(low)), F.least(rate - down, F.lit(float(high))))
        if turn % every == every - 1:
            later = saved(state.select("p", "tokens", rate.alias("before"), new.alias("rate")), "rates")
            drop(state)
            state, rate, move = later, F.col("rate"), F.col("rate") - F.col("before")
        else:
            rate, move = new, new - rate
    known = saved(state.select("p", F.round(rate, 6).alias("rate")), "rates")
    # few posteriors are shared by most documents: those rows are spread over salts
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64(*members.columns), F.lit(SALTS)).cast("int"))
    # the distinct posteriors have no bound: merged, never broadcast
    return salted.join(spread.hint("merge"), ["p", "salt"]).select(*members.columns, "rate"), Fit(turn, tuple(totals), tuple(wanted), met)


def copies(rate: Column, key: Column) -> Column:
    """A whole number of readings with the rate as its mean; the fraction is settled by the key's hash."""
    return (F.floor(rate) + (F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1_000_000)) / 1_000_000 < rate - F.floor(rate)).cast("int")).cast("long")


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float], key: str = "doc_id", text: str = "text", strict: bool = True, **options) -> DataFrame:
    """(key, tokens, p, rate, n_copies, unmet) of each key; unmet is the same on all rows: how far off its target the worst domain is.

    A target whose domain has no labelled rows cannot be met. That is an error if `strict`; else the others are fitted to
    their own shares, and `unmet` is at least that target's share. Without any domain all rates are 1.
    """
    unknown = set(targets) - set(model.domains)
    if strict and unknown and model.domains:
        raise ValueError(f"no labelled rows for {sorted(unknown)}")
    whole = sum(targets.values())
    missing = max((t / whole for d, t in targets.items() if d not in model.domains and whole), default=0.0)
    members = saved(posteriors(docs, model, key, text), "members")
    known = sum(targets.get(d, 0.0) for d in model.domains)
    if not known:
        fitted, off = members.withColumn("rate", F.lit(1.0)), 1.0 if whole else 0.0
    else:
        fitted, fit = fit_rates(members, [targets.get(d, 0.0) / known for d in model.domains], **options)
        off = max(fit.unmet, missing)
    return fitted.withColumn("n_copies", copies(F.col("rate"), F.col(key))).withColumn("unmet", F.lit(round(off, 6)))


def tempered(members: DataFrame, model: DomainModel, power: float) -> dict[str, float]:
    """Targets that flatten the corpus's own expected domain shares by a power."""
    row = members.agg(*(F.sum(F.col("tokens") * F.col("p")[i]).alias(f"t{i}") for i in range(len(model.domains)))).first()
    shares = [max(float(row[f"t{i}"] or 0), 0.0) ** power for i in range(len(model.domains))]
    total = sum(shares) or 1.0
    return {d: s / total for d, s in zip(model.domains, shares, strict=True)}
