"""Language, toxicity and neighbours: plain versions and held-out accuracy."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from harborlight.llm import language_id, neighbours, queries, toxicity
from harborlight.llm.common import prepare, table

FOLDER = "/root/testdata/sf0.01"


# language


@pytest.fixture(scope="module")
def network():
    net = language_id.Network(["aa", "bb"], units=6)
    net.train([[b"abab", b"ba", b"aabb"], [b"xyx", b"yyx", b"xx"]], steps=60, batch=64)
    return net


def test_gradients():
    """Backpropagation against differences."""
    rng = np.random.default_rng(0)
    cell = language_id.Cell(rng, 3)
    cell.inputs, cell.state = cell.inputs.astype(np.float64), cell.state.astype(np.float64)
    codes = np.array([[97, 98], [99, 256], [97, 256]])
    push = rng.standard_normal((3, 2, 3))

    def value():
        return float((cell.forward(codes)[0].astype(np.float64) * push).sum())

    _, tape = cell.forward(codes, keep=True)
    dx, dw = cell.backward(codes, tape, push)
    for grad, param, places in ((dx, cell.inputs, [(97, 0), (97, 4), (99, 8), (98, 5)]), (dw, cell.state, [(0, 0), (1, 4), (2, 8)])):
        for at in places:
            old = param[at]
            param[at] = old + 1e-3
            up = value()
            param[at] = old - 1e-3
            down = value()
            param[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


def test_reader_agrees_with_one_word_at_a_time(network):
    texts = [b"", b"abab ba 12", b"xyx  ba\nxyx", b"%%%", b"a" * 70, "é x".encode()]
    reader = language_id.Reader(network)
    reader.ROOM = 2  # forgets between calls
    first, second = reader.documents(texts), reader.documents(texts[::-1])[::-1]
    for k, t in enumerate(texts):
        total, n = np.zeros(2), 0
        for w in t.split():
            for at in range(0, len(w), language_id.STRETCH):
                codes = np.frombuffer(w[at:at + language_id.STRETCH], np.uint8).astype(int)[:, None]
                held = language_id.LETTER[codes[:, 0]]
                total += network.label(codes)[:, 0][held].sum(0)
                n += held.sum()
        assert np.allclose(first[k], total / max(n, 1), atol=1e-5)
        assert np.allclose(first[k], second[k], atol=1e-6)


def test_language_edges(spark, network):
    prepare(spark)
    rows = [(1, None), (2, ""), (3, "12 %%"), (4, "abab"), (4, "abab"), (None, "xyx yyx"), (5, "日"), (6, "xy " * 20_000)]
    df = spark.createDataFrame([(i, t, "q", "q") for i, t in rows], "doc_id long, text string, lang_pred string, score string")
    found = sorted(language_id.predict(df, network).collect(), key=lambda r: r.doc_id or 0)
    assert [r.lang_pred for r in found[1:4]] == ["und"] * 3 and [r.score for r in found[1:4]] == [0.0] * 3
    assert [r.lang_pred for r in found if r.doc_id == 4] == ["aa"] * 2
    assert found[0].lang_pred == found[-1].lang_pred == "bb" and len(found) == len(rows)
    assert all(0 <= r.score <= 1 for r in found)
    kept = language_id.recognised(df, network, 0.5)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {4, 6, None}
    assert language_id.predict(df.limit(0), network).count() == 0
    none = language_id.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.predict(df, none).collect()} == {"und"}


def test_language_held_out(spark, con):
    rows = queries.op10_language_id(spark, FOLDER).collect()
    truth = {r.doc_id: r.lang for r in table(spark, FOLDER, "documents").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


# toxicity


def test_block_max_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(300):
        terms = np.sort(rng.choice(40, rng.integers(0, 8), replace=False))
        w = rng.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, w / np.linalg.norm(w) if len(w) else w))
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, 40, block=8)
    for i in range(300):
        sims = np.round(dense @ dense[i], 12)
        sims[i] = 0
        want = [j for j in np.lexsort((np.arange(300), -sims)) if sims[j] > 0][:15]
        found, cosine = index.nearest(*vectors[i], 15, skip=i)
        assert found.tolist() == want
        assert np.allclose(cosine, sims[want])


def test_toxicity_held_out(spark):
    rows = queries.op6_toxicity(spark, FOLDER).collect()
    truth = {r.doc_id: r.toxic for r in table(spark, FOLDER, "labels").collect()}
    assert len(rows) == table(spark, FOLDER, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    said = Counter((truth[r.doc_id], r.predicted) for r in rows if r.doc_id in truth)
    assert said[1, 1] > 0.6 * (said[1, 1] + said[1, 0])
    assert said[0, 1] < 0.05 * (said[0, 0] + said[0, 1])
    assert all(r.evidence for r in rows if r.predicted)


def test_toxicity_edges(spark):
    prepare(spark)
    texts = [(i, f"you are a nasty brute number {i}" if i % 3 == 0 else f"a calm and kind remark number {i}", "x") for i in range(60)]
    texts += [(100, None, "x"), (101, "", "x"), (102, "nasty BRUTE! " * 9000, "x"), (102, "nasty", "x"), (None, "kind", "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score string")
    marks = [(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0), (None, 1), (7, None), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    found = {(r.doc_id, r.score): r for r in toxicity.toxicity(docs, labels).collect()}
    by = {}
    for r in found.values():
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.predicted for r in by[102]) and not by[100][0].predicted and by[100][0].score == by[101][0].score
    assert all(e.doc_id % 5 or zlib.crc32(str(e.doc_id).encode()) % 5 for r in by[102] for e in r.evidence)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == len(texts) and {r.predicted for r in none} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_words():
    assert toxicity.words_of("Don't PANIC, 42 été!") == re.findall(r"[^\W\d_]+", "don't panic, 42 été!")


# neighbours


def best(vectors, query, k):
    """The k largest inner products, one pair at a time."""
    q = vectors[query]
    found = sorted(((-float(np.dot(v, q)), i) for i, v in vectors.items() if i != query))
    return [(i, -s) for s, i in found[:k]]


def test_neighbours_against_all_pairs(spark):
    rows = queries.op2_neighbours(spark, FOLDER).collect()
    vectors = {r.vec_id: np.array(r.embedding) for r in table(spark, FOLDER, "embeddings").collect()}
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        assert all(r.score == pytest.approx(float(np.dot(vectors[q], vectors[r.vec_id])), abs=1e-12) for r in found)
        hits += len({r.vec_id for r in found} & {i for i, _ in best(vectors, q, 20)})
    assert hits >= 0.9 * 20 * len(by)


def test_neighbours_widen_and_split(spark):
    """Clustered vectors, small leaves and parts, one very frequent vector."""
    prepare(spark)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 8)) * 3
    points = [centres[rng.integers(12)] + rng.standard_normal(8) * 0.3 for _ in range(1500)] + [centres[0]] * 700
    rows = [(i, [float(x) for x in p], "c") for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    limits = {"leaf": 30, "part": 100, "calibration": 40}
    from pyspark.sql import functions as F

    found = neighbours.nearest(df, F.col("vec_id") % 50 == 0, 5, 0.98, limits).collect()
    vectors = {i: np.array(p) for i, p, _ in rows}
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    hits = sum(len({r.vec_id for r in by[q]} & {i for i, _ in best(vectors, q, 5)}) for q in by)
    assert len(by) == len(rows) // 50 and hits >= 0.9 * 5 * len(by)
    copies = [q for q in by if q >= 1500]
    assert copies
    for q in copies:  # ties go to the smallest ids
        top = [r.vec_id for r in sorted(by[q], key=lambda r: r.rank)]
        ties = sorted(i for i in range(1500, 2200) if i != q)[:5]
        assert top == ties or all(vectors[i] @ vectors[q] >= centres[0] @ centres[0] for i in top)


def test_neighbours_edges(spark):
    from pyspark.sql import functions as F

    prepare(spark)
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]),
            (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [1.0, 1.0]), (8, [1.0, 1.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = F.col("vec_id") % 20 == 0
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, asks, 20).collect())
    assert found == [(0, 1, 8, 1.0), (0, 2, 9, 1.0), (0, 3, 20, 0.0), (0, 4, 10, -1.0),
                     (20, 1, 8, 2.0), (20, 2, 9, 2.0), (20, 3, 0, 0.0), (20, 4, 10, 0.0)]
    assert neighbours.nearest(df.limit(0), asks, 3).count() == 0
    assert neighbours.nearest(df, F.lit(False), 3).count() == 0
