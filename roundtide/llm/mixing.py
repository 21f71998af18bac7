"""Mixing with soft memberships: posteriors of domains, then rates by Gram-scaled projected gradient.

A hashed naive Bayes model from a labelled table gives every document a posterior over domains. The
expected tokens of a domain are the sum of rate * tokens * posterior; nonnegative rates are fitted so
that these totals meet the targets in the least-squares sense. The rates are the iterate: they start
at 1, and each round moves a document's rate against its posterior times the scaled residual and cuts
it off at 0. A round is one aggregate over the table of posteriors; a rate follows from the document's
posterior and the scaled residuals of the rounds before, so no state is carried between rounds. The
residual is scaled by the Gram matrix of the posteriors of documents whose rate is above 0, which makes
rounds quick however soft the memberships are. Where such rounds stop gaining, the best rates so far are
taken up by rounds scaled by the Gram matrix of all documents, which never lose: the best of several
step lengths is taken, all measured in the same aggregate. Rounds end when the targets are met, when a round
gains next to nothing, or after a number of them. Rates that meet the targets are not
unique; these are the ones reached from rate 1. Targets that no rates can meet are met as nearly as
possible, with a warning of the shares reached. Everything is DataFrame expressions.

Edge cases: null and empty texts have no tokens, get the domains' prior as posterior, and a rate like
any other document; rows that repeat an id (null included) count as one document with all their
tokens; labels of several rows per id and domain count once; a domain without labelled rows is
unknown and gets posterior 0; without any labelled row all documents keep rate 1; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundtide.llm.common import stage_table, texts

#: Hash buckets of words: the size of the model is buckets times domains.
BUCKETS = 4096
#: Labelled documents that the classifier is fitted on at most (a uniform sample by hash beyond that).
MAX_TRAIN_DOCS = 10_000
#: A document counts as at most this many words of evidence, so that memberships stay soft.
EVIDENCE_WORDS = 16
#: Added to the Gram matrix, times a domain's size, so that domains without documents can be divided by.
RIDGE = 1e-6
#: Rounds scaled by the documents in use may go without gaining for this long.
PATIENCE = 4
#: Step lengths that a round scaled by all documents chooses from; at 1 or less the residual never grows.
STEPS = tuple(4.0**i for i in range(8))
#: Shares further than this from their targets are warned of.
MISS = 1e-3


def word_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """(every column but text, bucket): a row per word; words are split at ASCII white space."""
    plain = F.translate(F.lower("text"), "\n\r\t\x0b\x0c", "     ")
    words = docs.withColumn("word", F.explode(F.split(plain, " "))).drop("text").where("word != ''")
    return words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")).drop("word")


def domain_model(docs: DataFrame, labelled: DataFrame, domains: list[str], buckets: int, max_docs: int):
    """(bucket, one log likelihood per domain) with ``buckets`` rows, and the log priors; None without labels."""
    known = (
        labelled.select(labelled["doc_id"].cast("long").alias("doc_id"), labelled["domain"].cast("string").alias("domain"))
        .where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .distinct()
    )
    share = min(1.0, max_docs / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # about max_docs rows of an id and a name, whatever the corpus
    sample = stage_table(texts(docs).join(F.broadcast(known), "doc_id"), "mixing-train")
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None, {}
    n = sum(sizes.values())
    priors = {d: math.log((sizes.get(d, 0) + 1) / (n + len(domains))) if d in sizes else None for d in domains}
    counts = word_buckets(sample.select("domain", "text"), buckets).groupBy("bucket").agg(
        *[F.count(F.when(F.col("domain") == d, 1)).alias(f"c{i}") for i, d in enumerate(domains)]
    )
    counts = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    counts = stage_table(counts.na.fill(0), "mixing-model")
    totals = counts.agg(*[F.sum(f"c{i}") for i in range(len(domains))]).first()
    model = counts.select(
        "bucket", *[(F.log((F.col(f"c{i}") + 0.5) / ((totals[i] or 0) + 0.5 * buckets))).alias(f"l{i}") for i in range(len(domains))]
    )
    return model, priors


def posteriors(
    docs: DataFrame, labelled: DataFrame, domains: list[str], buckets: int = BUCKETS, max_docs: int = MAX_TRAIN_DOCS
) -> DataFrame:
    """doc_id, n_tokens, p0, p1, ...: a row per id; the posteriors sum to 1 (all 0 without labels)."""
    k = range(len(domains))
    rows = texts(docs)
    model, priors = domain_model(docs, labelled, domains, buckets, max_docs)
    if model is None:
        counted = word_buckets(rows, buckets).groupBy("doc_id").agg(F.count("*").alias("n_tokens"))
        scores = counted.select("doc_id", "n_tokens", *[F.lit(0.0).alias(f"p{i}") for i in k])
        prior = [F.lit(0.0) for _ in k]
    else:
        # the model has exactly `buckets` rows, a fixed size
        summed = (
            word_buckets(rows, buckets)
            .join(F.broadcast(model), "bucket")
            .groupBy("doc_id")
            .agg(F.count("*").alias("n_tokens"), *[F.sum(f"l{i}").alias(f"s{i}") for i in k])
        )
        weight = F.least(F.lit(float(EVIDENCE_WORDS)), F.col("n_tokens").cast("double")) / F.col("n_tokens")
        there = [i for i in k if priors[domains[i]] is not None]
        logit = {i: F.col(f"s{i}") * weight + priors[domains[i]] for i in there}
        summed = summed.withColumns({f"g{i}": logit[i] for i in there})
        top = F.greatest(*[F.col(f"g{i}") for i in there]) if len(there) > 1 else F.col(f"g{there[0]}")
        summed = summed.withColumns({f"e{i}": F.exp(F.col(f"g{i}") - top) for i in there})
        total = reduce(lambda a, b: a + b, [F.col(f"e{i}") for i in there])
        scores = summed.select(
            "doc_id", "n_tokens", *[(F.col(f"e{i}") / total if i in there else F.lit(0.0)).alias(f"p{i}") for i in k]
        )
        mass = sum(math.exp(priors[domains[i]]) for i in there)
        prior = [F.lit(math.exp(priors[domains[i]]) / mass if i in there else 0.0) for i in k]
    blank = rows.where(F.trim(F.translate("text", "\n\r\t\x0b\x0c", "     ")) == "").select("doc_id").distinct()
    every = scores.withColumn("o", F.lit(1)).unionByName(
        blank.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), *[prior[i].alias(f"p{i}") for i in k], F.lit(0).alias("o"))
    )
    # an id with both blank and filled rows keeps the posterior of its words
    best = F.max(F.struct("o", "n_tokens", *[f"p{i}" for i in k])).alias("b")
    return every.groupBy("doc_id").agg(best).select("doc_id", "b.n_tokens", *[f"b.p{i}" for i in k])


def fit_rates(
    table: DataFrame, weights: list[float], rounds: int = 32, ridge: float = RIDGE, tolerance: float = 1e-6
) -> tuple[F.Column, list[float]]:
    """The rate of a document, and the domain shares that these rates give.

    The squared residual in the metric of the whole Gram matrix never grows under rounds scaled by that matrix
    at step length 1, the bound of the gradient, so these settle what the quicker rounds leave.
    """
    k = len(weights)
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return F.lit(1.0), [0.0] * k
    wanted, pairs = np.array(weights), [(i, j) for i in range(k) for j in range(i, k)]

    def measured(rates: list[F.Column]) -> tuple[list[np.ndarray], np.ndarray]:
        """Shares at each of the rates, and the Gram matrix of the documents in use at the first."""
        mass = F.col("n_tokens") / F.lit(total)
        sums = [F.sum(F.col(f"r{s}") * mass * F.col(f"p{i}")) for s in range(len(rates)) for i in range(k)]
        used = [F.sum(F.when(F.col("r0") > 0, mass * F.col(f"p{i}") * F.col(f"p{j}")).otherwise(0.0)) for i, j in pairs]
        row = table.select("*", *[r.alias(f"r{s}") for s, r in enumerate(rates)]).agg(*sums, *used).first()
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, row[len(sums) :]):
            gram[i, j] = gram[j, i] = x
        return [np.array(row[s * k : s * k + k], dtype=float) for s in range(len(rates))], gram

    def moved(rate: F.Column, pull: np.ndarray) -> F.Column:
        against = reduce(lambda a, b: a + b, [F.col(f"p{i}") * F.lit(float(x)) for i, x in enumerate(pull)])
        return F.greatest(F.lit(0.0), rate - against)

    rate = F.lit(1.0)
    (shares,), gram = measured([rate])
    bound = np.diag(ridge * np.maximum(shares, 1e-6))
    whole = gram + bound

    def cost(shares: np.ndarray) -> float:
        return float((shares - wanted) @ np.linalg.solve(whole, shares - wanted))

    best, quick, since = (rate, shares), True, 0
    for _ in range(rounds):
        miss, last = shares - wanted, cost(best[1])
        if np.abs(miss).max() < tolerance:
            break
        pull = np.linalg.solve(gram + bound if quick else whole, miss)
        tried = [moved(rate, pull * size) for size in ((1.0,) if quick else STEPS)]
        reached, gram = measured(tried)
        at = min(range(len(tried)), key=lambda s: cost(reached[s]))
        rate, shares = tried[at], reached[at]
        gain = last - cost(shares)
        if gain > 0:
            best = (rate, shares)
        since = 0 if gain > 0 else since + 1
        if quick and (since >= PATIENCE or 0 < gain < 1e-4 * last):
            quick, (rate, shares) = False, best
        elif not quick and gain < 1e-4 * last:
            break
    return best[0], best[1].tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], rounds: int = 32, ridge: float = RIDGE) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), p_<domain>, rate, copies.

    ``labelled`` holds (doc_id, domain); ``targets`` the wanted share of the tokens of each domain.
    ``copies`` is the rate rounded up or down by a hash of the id, so that it is right on average.
    """
    domains = sorted(targets)
    whole = sum(targets.values())
    k = range(len(domains))
    table = stage_table(posteriors(docs, labelled, domains), "posteriors")
    has_labels = table.where(reduce(lambda a, b: a + b, [F.col(f"p{i}") for i in k]) > 0).limit(1).count() > 0
    weights = [targets[d] / whole for d in domains]
    rate, shares = fit_rates(table, weights, rounds, ridge) if has_labels else (F.lit(1.0), weights)
    missed = {d: (round(s, 6), round(w, 6)) for d, s, w in zip(domains, shares, weights) if abs(s - w) > MISS}
    if missed:
        warnings.warn(f"no rates give the wanted shares; domain: (reached, wanted) {missed}", stacklevel=2)
    best = F.greatest(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(domains[i]).alias("d")) for i in k])["d"] if len(domains) > 1 else F.lit(domains[0])
    rated = table.select("*", rate.alias("rate"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1_000_000)) / F.lit(1e6)
    return rated.select(
        "doc_id",
        "n_tokens",
        best.alias("domain"),
        *[F.col(f"p{i}").alias(f"p_{domains[i]}") for i in k],
        F.col("rate"),
        (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"),
    )
