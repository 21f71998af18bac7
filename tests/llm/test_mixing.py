import random

import numpy as np
import pytest
from roundtide.llm import mixing


def corpus(rng, n=300):
    rows, labels = [], []
    for i in range(n):
        domain = "ab"[i % 5 == 0]
        words = [(domain if rng.random() < 0.7 else "c") + str(rng.randrange(40)) for _ in range(rng.randrange(3, 60))]
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, domain))
    return rows, labels


def nearest_to_one(p, t, wanted):
    """Of the nonnegative rates that meet the totals, those nearest to 1: Newton steps on the dual, in one piece."""
    dual = np.zeros(len(wanted))
    for _ in range(100):
        r = np.maximum(0, 1 + p @ dual)
        slope = (r * t) @ p - wanted
        used = p[r > 0]
        move = np.linalg.solve((used * t[r > 0, None]).T @ used + 1e-12 * np.eye(len(wanted)), -slope)
        value = lambda d: t @ np.maximum(0, 1 + p @ d) ** 2 / 2 - wanted @ d
        size = 1.0
        while size > 1e-9 and value(dual + size * move) > value(dual) + 1e-4 * size * (slope @ move):
            size /= 2
        dual = dual + size * move
    assert np.abs((r * t) @ p - wanted).max() < 1e-9
    return r


def test_totals_meet_targets_and_rates_are_least_squares(spark, make_docs):
    rows, labels = corpus(random.Random(1))
    labelled = spark.createDataFrame(labels, "doc_id long, domain string")
    got = mixing.mix(make_docs(rows), labelled, {"a": 0.4, "b": 0.6}).toPandas()
    assert len(got) == len(rows) and (got.rate >= 0).all()
    assert np.allclose(got.p_a + got.p_b, 1)
    assert (got.n_tokens == [len(dict(rows)[i].split()) for i in got.doc_id]).all()
    truth = got.doc_id.map(lambda i: "ab"[i % 5 == 0])
    assert (got.domain == truth).mean() > 0.97
    total = got.n_tokens.sum()
    for d, share in (("a", 0.4), ("b", 0.6)):
        assert abs((got.rate * got.n_tokens * got[f"p_{d}"]).sum() / total - share) < 0.01
    # among all rates that meet the targets, these are about as near to 1 as any
    p, t = got[["p_a", "p_b"]].to_numpy(), got.n_tokens.to_numpy() / total
    least = nearest_to_one(p, t, np.array([0.4, 0.6]))
    assert np.abs((got.rate * t) @ p - [0.4, 0.6]).max() < 1e-5
    assert t @ (got.rate - 1) ** 2 <= 1.1 * (t @ (least - 1) ** 2)
    assert ((got.copies - got.rate).abs() < 1).all() and abs(got.copies.sum() - got.rate.sum()) < 40


def test_native_plan(spark, make_docs):
    rows, labels = corpus(random.Random(2), 40)
    df = mixing.mix(make_docs(rows), spark.createDataFrame(labels, "doc_id long, domain string"), {"a": 0.5, "b": 0.5})
    assert "Python" not in df._jdf.queryExecution().toString()


def test_a_target_of_zero_takes_documents_out(spark, make_docs):
    rows, labels = corpus(random.Random(3))
    got = mixing.mix(make_docs(rows), spark.createDataFrame(labels, "doc_id long, domain string"), {"a": 1.0, "b": 0.0}).toPandas()
    assert got.rate[got.doc_id % 5 == 0].mean() < 0.1 < got.rate[got.doc_id % 5 != 0].mean()


def test_odd_rows(spark, odd_docs, empty_docs, odd_rows):
    labelled = spark.createDataFrame([(6, "a"), (6, "a"), (8, "b"), (None, "a"), (4, None), (9, "z")], "doc_id long, domain string")
    for labels in (labelled, labelled.limit(0)):
        got = mixing.mix(odd_docs, labels, {"a": 0.5, "b": 0.3, "unseen": 0.2}).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted({str(i) for i, _ in odd_rows})
        assert all(r["rate"] >= 0 for r in got)
    assert all(r["rate"] == 1 for r in got)
    assert mixing.mix(empty_docs, labelled, {"a": 1.0}).count() == 0


def test_soft_memberships_meet_their_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([6, 3, 0.6], 2000)
    n = rng.integers(1, 200, 2000)
    table = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(n, p)], "n_tokens long, p0 double, p1 double, p2 double")
    for weights in ([0.73, 0.25, 0.02], [0.5, 0.3, 0.2]):
        rate, shares = mixing.fit_rates(table, weights)
        r = np.array([x[0] for x in table.select(rate).collect()])
        assert (r >= 0).all()
        reached = (r * n) @ p / n.sum()
        assert np.abs(reached - weights).max() < 1e-5 and np.allclose(reached, shares)
        assert n @ (r - 1) ** 2 <= 1.1 * (n @ (nearest_to_one(p, n / n.sum(), np.array(weights)) - 1) ** 2)


def test_targets_out_of_reach_are_told(spark, make_docs):
    rows, labels = corpus(random.Random(6), 60)
    labelled = spark.createDataFrame(labels, "doc_id long, domain string")
    with pytest.warns(UserWarning, match="unseen"):
        mixing.mix(make_docs(rows), labelled, {"a": 0.5, "b": 0.3, "unseen": 0.2})


def test_targets_at_the_edge_of_what_rates_can_reach(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([6, 3], 500)
    table = spark.createDataFrame([(10, *map(float, q)) for q in p], "n_tokens long, p0 double, p1 double")
    _, shares = mixing.fit_rates(table, [1.0, 0.0])
    gram = p.T @ p / len(p)

    def cost(reached):
        return (reached - [1, 0]) @ np.linalg.solve(gram, reached - [1, 0])

    # one document alone, the one with the largest posterior, is best; nothing is nearer along its ray
    ray = p[p[:, 0].argmax()]
    nearest = min(cost(x * ray) for x in np.linspace(0.5, 1.5, 2001))
    assert cost(np.array(shares)) <= nearest + 0.02
