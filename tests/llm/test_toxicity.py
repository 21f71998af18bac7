import random

from roundtide.llm import toxicity


def test_noisy_or_learns_sentences_from_document_labels(spark, make_docs):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        parts = [f"{sentence_of(rng)}." for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            parts[rng.randrange(6)] = f"You {rng.choice(['vilething', 'vilestuff', 'scumbag'])} {sentence_of(rng)}."
        rows.append((i, " ".join(parts)))
        labels.append((i, 1, int(toxic)))
    docs = make_docs(rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i, _ in rows if got[i]["held_out"]]
    assert 80 < len(held) < 190
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in held)
    for i in held:
        if i % 4 == 0:
            a, b, _ = got[i]["sentences"].split(",")[0].split(":")
            assert any(w in rows[i][1][int(a) : int(b)] for w in ("vile", "scumbag"))
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 4}


def sentence_of(rng):
    return " ".join(f"word{rng.randrange(300)}" for _ in range(8))


def test_sentence_spans_cover_the_text_but_for_separators():
    text = "One. Two!\nThree? 次。 Four"
    assert [text[a:b] for a, b in toxicity.sentence_spans(text)] == ["One.", "Two!", "Three?", "次。", "Four"]
    assert toxicity.sentence_spans("") == []


def test_odd_rows(odd_docs, odd_labels, no_labels, empty_docs, odd_rows):
    for labels in (odd_labels, no_labels):
        rows = toxicity.score_documents(odd_docs, toxicity.fit(odd_docs, labels)).collect()
        assert len(rows) == len(odd_rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
        assert {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0.0}
    kept = toxicity.drop_toxic(odd_docs, no_labels)
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_rows)
    assert toxicity.score_documents(empty_docs, toxicity.fit(empty_docs, odd_labels)).count() == 0
    assert toxicity.drop_toxic(empty_docs, odd_labels).count() == 0
