"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over evidence terms (words and
word stems); the document's score is the noisy-or of its sentences. Only document labels are known:
the gradient of the bag likelihood reaches the sentences through the noisy-or, so training finds
which sentences carry the label, and scoring reports where they stand.

Edge cases: null or empty text scores 0; a sentence without any evidence term has probability 0;
an empty label table (or one of a single class) gives a model without terms, so all scores are 0;
several labels of one document count as their maximum; rows are scored one by one, so repeated rows
get equal results; a null doc_id is scored and never held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundtide.llm.common import CACHE_WORDS, map_columns, small_batches, stage_table, texts

WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"(?<=[.!?…。！？])\s+|\n+")
STEM_LENGTHS = (4, 5, 6)
#: Labelled rows used for training at most (a uniform sample by hash beyond that).
MAX_TRAIN_DOCS = 8000
#: Evidence terms kept at most: the size of the model.
MAX_TERMS = 4096
MIN_Z = 3.0
THRESHOLD = 0.7


@dataclass
class ToxicityModel:
    """Weights of evidence terms; a stem is written with a trailing ``*``."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEM_LENGTHS if len(word) >= n)]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every sentence, in code points of the text."""
    spans, start = [], 0
    for m in SENTENCE_END.finditer(text):
        spans.append((start, m.start()))
        start = m.end()
    spans.append((start, len(text)))
    return [(a, b) for a, b in spans if a < b]


def is_held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text has remainder 1 modulo 3; those rows never train."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out third, at most about ``max_docs`` of them."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, max_docs / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    # the broadcast side holds about max_docs rows of two numbers, whatever the corpus
    return texts(docs).join(F.broadcast(picked), "doc_id").select("text", "toxic")


def _count_terms():
    def step(text, toxic):
        every, hits = Counter(), Counter()
        for t, y in zip(text, toxic):
            found = {term for w in set(WORD.findall(t.lower())) for term in terms_of(w)}
            every.update(found)
            if y:
                hits.update(found)
        return [list(every), [hits[k] for k in every], list(every.values())]

    return step


def select_terms(rows: DataFrame, max_terms: int = MAX_TERMS, min_z: float = MIN_Z) -> list[str]:
    """Terms whose document frequency is significantly higher in toxic documents (log-odds z-score)."""
    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    n_pos, n = int(totals[0] or 0), int(totals[1])
    n_neg = n - n_pos
    if not n_pos or not n_neg:
        return []
    counts = map_columns(rows, _count_terms, "term string, hits long, docs long")
    pos, neg = F.col("hits"), F.col("docs") - F.col("hits")
    odds = F.log((pos + 0.5) / (n_pos - pos + 0.5)) - F.log((neg + 0.5) / (n_neg - neg + 0.5))
    spread = F.sqrt(1 / (pos + 0.5) + 1 / (n_pos - pos + 0.5) + 1 / (neg + 0.5) + 1 / (n_neg - neg + 0.5))
    best = (
        counts.groupBy("term")
        .agg(F.sum("hits").alias("hits"), F.sum("docs").alias("docs"))
        .where("hits >= 2")
        .withColumn("z", odds / spread)
        .where(F.col("z") >= min_z)
        .orderBy(F.desc("z"), "term")
        .limit(max_terms)
    )
    return [r["term"] for r in best.collect()]


def _bags(vocabulary: dict[str, int]):
    def make():
        def step(text, toxic):
            bags = []
            for t in text:
                bag = []
                for a, b in sentence_spans(t):
                    ids = [
                        vocabulary[k] for w in set(WORD.findall(t[a:b].lower())) for k in terms_of(w) if k in vocabulary
                    ]
                    if ids:
                        bag.append(ids)
                bags.append(bag)
            return [bags, toxic]

        return step

    return make


def fit_noisy_or(bags: list[list[list[int]]], labels: list[int], n_terms: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Gradient ascent on the bag likelihood; returns term weights (never negative) and the bias."""
    flat = [ids for bag in bags for ids in bag]
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    sent = np.repeat(np.arange(len(flat)), [len(x) for x in flat])
    term = np.array([i for ids in flat for i in ids], dtype=np.int64)
    y = np.array(labels, dtype=float)
    weight = np.where(y == 1, math.sqrt(max(1.0, (y == 0).sum() / max(1.0, y.sum()))), 1.0)
    w, b = np.full(n_terms, 0.5), -3.0
    first, second = np.zeros(n_terms + 1), np.zeros(n_terms + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sent, w[term], len(flat)) + b, -30, 30)))
        p = np.clip(p, 1e-9, 1 - 1e-9)
        log_none = np.bincount(doc, np.log1p(-p), len(bags))
        some = np.clip(-np.expm1(log_none), 1e-9, 1)
        per_doc = weight * np.where(y == 1, (1 - some) / some, -1.0)
        per_sent = per_doc[doc] * p
        grad = np.append(np.bincount(term, per_sent[sent], n_terms) - 0.05 * w, per_sent.sum() - 0.05 * (b + 3))
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w + move[:-1], 0), b + move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_terms: int = MAX_TERMS) -> ToxicityModel:
    """Train on document labels. The driver holds only the bounded sample's evidence terms."""
    rows = stage_table(training_rows(docs, labels, max_docs), "toxicity-train")
    names = select_terms(rows, max_terms)
    if not names:
        return ToxicityModel()
    bags = map_columns(rows, _bags({k: i for i, k in enumerate(names)}), "bag array<array<int>>, toxic int").collect()
    w, b = fit_noisy_or([r["bag"] for r in bags], [r["toxic"] for r in bags], len(names))
    return ToxicityModel({k: float(v) for k, v in zip(names, w) if v > 1e-3}, float(b))


def scorer(model: ToxicityModel):
    """A function from a text to (score, offending sentences as (start, end, probability))."""
    known: dict[str, float] = {}

    def weight(word: str) -> float:
        got = known.get(word)
        if got is None:
            if len(known) > CACHE_WORDS:
                known.clear()
            got = known[word] = sum(model.weights.get(k, 0.0) for k in terms_of(word))
        return got

    def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
        if not any(map(weight, set(WORD.findall(text.lower())))):
            return 0.0, []
        log_none, found = 0.0, []
        for a, b in sentence_spans(text):
            evidence = math.fsum(sorted(map(weight, set(WORD.findall(text[a:b].lower())))))
            if evidence > 0:
                p = min(1 / (1 + math.exp(-min(evidence + model.bias, 30.0))), 1 - 1e-9)
                log_none += math.log1p(-p)
                if p >= 0.5:
                    found.append((a, b, p))
        return -math.expm1(log_none), found

    return score


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending sentences as ``start:end:probability``."""

    def make():
        score = scorer(model)

        def step(ids, text, held):
            got = [score(t) for t in text]
            spans = [",".join(f"{a}:{b}:{p:.4f}" for a, b, p in found) for _, found in got]
            return [ids, held, [s for s, _ in got], [int(s >= threshold) for s, _ in got], spans]

        return step

    rows = texts(docs).withColumn("held_out", is_held_out(F.col("doc_id")))
    return map_columns(rows, make, "doc_id long, held_out boolean, score double, predicted int, sentences string")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents whose score stays below the threshold, all columns as they came; no shuffle."""
    import pyarrow as pa

    model = fit(docs, labels)
    at = docs.columns.index(text_col)

    def run(batches):
        score = scorer(model)
        for batch in batches:
            keep = [score(t or "")[0] < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
