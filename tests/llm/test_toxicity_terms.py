"""Rare terms of the examples stay in the index."""

from collections import Counter

import numpy as np

from harborlight.llm import queries, toxicity
from harborlight.llm.common import table


def test_rare_toxic_words_have_neighbours():
    rows = [(i, f"calm kind remark {'abcdefghij'[i % 10] * 3}", 0) for i in range(200)]
    rows += [(200 + i, f"nasty brute {'klmnopqrst'[i % 10] * 3}", 1) for i in range(200)]
    rows += [(400, "hassuva sana", 1)]
    judge = toxicity.Judge(rows, {0: 200, 1: 201})
    score, found, cosine = judge.score(Counter(toxicity.words_of("Hassuva sana!")))
    assert judge.ids[found].tolist() == [400] and abs(cosine[0] - 1) < 1e-9 and score > 0.5


def zipf_texts(rng, n, languages=4, words=6000):
    """Texts in several languages of common and rare words."""
    out = []
    for i in range(n):
        lang = rng.integers(languages)
        ids = np.minimum(rng.zipf(1.3, rng.integers(5, 120)), words)
        out.append(Counter(f"l{lang}w{k}" for k in ids))
    return out


def test_few_blocks_are_opened_of_a_full_index():
    """4000 examples: the nearest are those of all pairs, and the bounds leave most blocks closed."""
    rng = np.random.default_rng(5)
    examples = [(i, c, int(rng.random() < 0.5)) for i, c in enumerate(zipf_texts(rng, 4000))]
    judge = toxicity.Judge(examples, {0: 2000, 1: 2000})
    terms, index = len(judge.terms), judge.index
    vectors = [judge.vector(c) for _, c, _ in examples]
    asked = [judge.vector(c) for c in zipf_texts(rng, 300)] + vectors[:20]
    index.opened = 0
    found = index.nearest_of(asked, toxicity.NEAREST)
    assert index.opened / len(asked) < 0.6 * index.blocks
    dense = np.zeros((4000, terms), np.float32)
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for (t, w), (names, cosine) in zip(asked, found):
        sims = dense[:, t].astype(float) @ w
        best = np.sort(sims)[::-1][:toxicity.NEAREST]
        assert np.allclose(cosine, best[best > 0], atol=1e-6)
        assert np.allclose(sims[names], cosine, atol=1e-6)
    for i in range(20):
        assert found[300 + i][0][0] == i and abs(found[300 + i][1][0] - 1) < 1e-9


def test_examples_are_gone_through_once():
    """The judge keeps numbers of words only, so examples may come one at a time; the result is that of texts in a list."""
    rows = [(i, f"common w{i % 7} w{i % 5} {'bad' if i % 3 == 0 else 'good'} own{i}", int(i % 3 == 0)) for i in range(90)]
    listed = toxicity.Judge(rows, {0: 60, 1: 30})
    once = toxicity.Judge(((i, toxicity.Counter(toxicity.words_of(t)), k) for i, t, k in rows), {0: 60, 1: 30})
    assert once.terms == listed.terms and once.curve == listed.curve and (once.ids == listed.ids).all()
    some = [once.vector(toxicity.Counter(toxicity.words_of(t))) for _, t, _ in rows]
    few, many = (once.index.nearest_of(some, 15, texts=k) for k in (7, 512))
    assert all((a[0] == b[0]).all() and abs(a[1] - b[1]).max() < 1e-12 for a, b in zip(few, many, strict=True))


def marked_texts(rng, n, per=60):
    """(text, label): one in eight texts is toxic, by two of twenty words among many that say nothing."""
    out = []
    for i in range(n):
        words = [f"w{k}x".translate(str.maketrans("0123456789", "abcdefghij")) for k in np.minimum(rng.zipf(1.3, per), 3000)]
        label = int(i % 8 == 0)
        out.append((" ".join(words + [f"bad{'abcdefghijklmnopqrst'[k]}" for k in rng.integers(20, size=2 * label)]), label))
    return out


def test_words_that_tell_outweigh_those_that_do_not():
    """texts share far more neutral words than toxic ones; those with toxic words are caught all the same."""
    rng = np.random.default_rng(8)
    rows = marked_texts(rng, 1600)
    judge = toxicity.Judge([(i, t, k) for i, (t, k) in enumerate(rows)], {0: 1400, 1: 200})
    asked = marked_texts(rng, 800)
    scores = np.array([x[0] for x in judge.scores([judge.vector(Counter(toxicity.words_of(t))) for t, _ in asked])])
    truth = np.array([k for _, k in asked])
    bar = np.quantile(scores[truth == 0], 0.9)
    assert (scores[truth == 1] > bar).mean() > 0.95
    assert (scores[truth == 1] >= 0.5).mean() > 0.9 and (scores[truth == 0] < 0.5).mean() > 0.98


def test_no_label_of_one_text_makes_its_words_tell():
    """Words of one example, or of its copies, keep their idf; so do those that are as frequent in both labels."""
    copies = [(300 + i, "own odd thing", 1) for i in range(50)]
    rows = [(i, f"even {'nasty' if i % 10 == 0 else 'kind'} own{'abcdefghij'[i % 10]}", int(i % 10 == 0)) for i in range(100)]
    rows += [(100 + i, f"even {'nasty' if i % 10 == 0 else 'kind'} more {'klmnopqrst'[i // 10]}{'klmnopqrst'[i % 10]}", int(i % 10 == 0))
             for i in range(100)]
    judge = toxicity.Judge(rows + copies, {0: 180, 1: 70})
    factor = {w: judge.weights[i] / judge.idf[i] for w, i in judge.terms.items()}
    assert all(factor[w] == 1 for w in ("own", "odd", "thing", "even", "kk", "tt"))
    assert factor["nasty"] > 2 and min(factor.values()) >= 1


def test_held_out_labels_are_found_by_score(spark):
    """On sf0.1, at a bar that one in ten clean held-out documents passes."""
    folder = "/root/testdata/sf0.1"
    rows = queries.op6_toxicity(spark, folder).filter("held_out").select("doc_id", "score").collect()
    truth = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    by = [np.array([r.score for r in rows if truth.get(r.doc_id) == k]) for k in (0, 1)]
    assert (by[1] > np.quantile(by[0], 0.9)).mean() > 0.9
