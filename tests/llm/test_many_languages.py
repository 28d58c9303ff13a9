"""Every language with training rows is learned."""

import random

from harborlight.llm import language_id
from harborlight.llm.common import prepare


def test_more_than_two_hundred(spark):
    prepare(spark)
    rows = [(k, f"word{k}", f"l{k:03}") for k in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.fit(docs, steps=1).languages == [r[2] for r in rows]


def made_up(rng, languages, docs, words=40):
    """Languages with letter pairs of their own."""
    rows = []
    for k in range(languages):
        pairs = [chr(97 + rng.randrange(26)) + chr(97 + rng.randrange(26)) for _ in range(12)]
        for _ in range(docs):
            rows.append((f"l{k:03d}", " ".join("".join(rng.choice(pairs) for _ in range(rng.randrange(1, 5))) for _ in range(words))))
    return rows


def test_two_hundred_languages_are_told_apart(spark):
    """With the default steps; the sample is shared out evenly."""
    prepare(spark)
    rng = random.Random(3)
    rows = made_up(rng, 200, 6)
    docs = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(rows)], "doc_id long, text string, lang string")
    network = language_id.fit(docs.filter("doc_id % 6 <> 0"), most=600)
    assert len(network.languages) == 200
    found = language_id.predict(docs.filter("doc_id % 6 = 0"), network).collect()
    right = sum(r.lang_pred == rows[r.doc_id][0] for r in found)
    assert right >= 0.9 * len(found) == 180
    least = language_id.least_score(docs.filter("doc_id % 6 = 0"), network)
    assert 1 / 200 < least < min(sorted(r.score for r in found)[20:])


def test_long_words_are_learned_whole():
    """Words alike in their first 32 bytes; what follows tells the languages apart."""
    rng = random.Random(5)
    front = b"abcdefgh" * 4
    words = [[front + bytes(rng.choice(letters) for _ in range(96)) for _ in range(60)] for letters in (b"klmn", b"opqr")]
    network = language_id.Network(["aa", "bb"])
    network.train([ws[:40] for ws in words], steps=150)
    reader = language_id.Reader(network)
    for k in (0, 1):
        p = reader.documents(words[k][40:])
        assert (p.argmax(axis=1) == k).all()


def test_least_score_without_rows(spark):
    prepare(spark)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.least_score(docs, language_id.Network([])) == 0.0
    assert language_id.least_score(docs, language_id.Network(["a", "b", "c", "d"])) == 0.25
