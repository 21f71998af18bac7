"""Keyword postings against all pairs."""

import random

from roundtide.operators.postings import texts_of_keywords


def grams(text):
    text = (text or "").replace(" ", "")
    return {text[i : i + 2] for i in range(len(text) - 1)}


def test_no_pair_is_lost_or_added(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aaabbcde公演東") for _ in range(n))
    keywords = [(i, word(rng.randint(2, 24))) for i in range(30)] + [(30, ""), (31, "a"), (32, None), (33, "a b")]
    texts = [(i, word(rng.randint(0, 40))) for i in range(200)] + [(200, None), (201, keywords[0][1]), (202, keywords[0][1])]
    left = spark.createDataFrame(keywords, "keyword_id long, keyword string")
    right = spark.createDataFrame(texts, "text_id long, text string")
    for limit in (0.2, 0.45, 1.0):
        want = {
            (i, j): len(grams(k) & grams(t)) / len(grams(k)) for i, k in keywords for j, t in texts
            if grams(k) and len(grams(k) & grams(t)) / len(grams(k)) >= limit
        }
        assert want
        assert {(r.keyword_id, r.text_id): r.overlap for r in texts_of_keywords(left, right, limit).collect()} == want
    assert texts_of_keywords(left, right.limit(0)).count() == 0


def test_blocks_and_chunks_of_any_size_give_the_same_pairs(spark, monkeypatch):
    from roundtide.operators import postings

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcd東京🎫𠮷") for _ in range(n))
    keywords = [(i, word(rng.randint(2, 12))) for i in range(40)] + [(None, "abab")]
    texts = [(i, word(rng.randint(0, 60))) for i in range(150)] + [(None, "abab")]
    left = spark.createDataFrame(keywords, "keyword_id int, keyword string")
    right = spark.createDataFrame([(None if j is None else str(j), t) for j, t in texts], "text_id string, text string")
    want = {
        (i, str(j)): len(grams(k) & grams(t)) / len(grams(k)) for i, k in keywords for j, t in texts
        if i is not None and j is not None and len(grams(k) & grams(t)) / len(grams(k)) >= 0.45
    }
    monkeypatch.setattr(postings, "BLOCK_COST", 300)
    monkeypatch.setattr(postings, "CHUNK", 40)
    monkeypatch.setattr(postings, "CELLS", 200)
    assert {(r.keyword_id, r.text_id): r.overlap for r in texts_of_keywords(left, right).collect()} == want


def test_sentences_meet_blocks_and_not_each_other(spark, monkeypatch):
    """Sentences share nearly all bigrams: a text enters the comparison once a block, not once a keyword or bigram."""
    from roundtide.operators import postings

    tables, write = {}, postings.written
    monkeypatch.setattr(postings, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    sentence = "the thing in the rain and the train of thought "
    left = spark.createDataFrame([(i, sentence + str(i)) for i in range(100)], "keyword_id long, keyword string")
    right = spark.createDataFrame([(i, sentence * 3 + str(i)) for i in range(50)], "text_id long, text string")
    assert texts_of_keywords(left, right).count() == 100 * 50
    assert tables["met"].count() == 50
