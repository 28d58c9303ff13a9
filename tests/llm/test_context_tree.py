"""Context-tree weighting against the recursion over all contexts, bit by bit; the word model against plain counts."""

import functools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from harborlight.llm import context_tree as ct
from harborlight.llm.common import prepare

SCHEMA = "doc_id long, text string, block string, key string, word string, n int, train string"


def bits_of(byte):
    return [((1 << j) | (byte >> (8 - j)), byte >> (7 - j) & 1) for j in range(8)]


@functools.cache
def kt(zeros, ones):
    """Product of the sequential estimates."""
    out, z, o = 0.0, 0, 0
    for _ in range(zeros):
        out, z = out + math.log((z + 0.5) / (z + o + 1)), z + 1
    for _ in range(ones):
        out, o = out + math.log((o + 0.5) / (z + o + 1)), o + 1
    return out


class Plain:
    """The tree as a dictionary from (prefix, context) to counts."""

    def __init__(self, bodies, depth):
        self.depth, self.counts, self.below = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for b in bodies:
            b = b"\n" * depth + b
            for i in range(depth, len(b)):
                for prefix, bit in bits_of(b[i]):
                    for d in range(depth + 1):
                        ctx = b[i - d:i]
                        self.counts[prefix, ctx][bit] += 1
                        if d:
                            self.below[prefix, ctx[1:]].add(ctx)
        self.memo = {}

    def weight(self, prefix, ctx):
        if (prefix, ctx) not in self.memo:
            own = kt(*self.counts[prefix, ctx])
            if len(ctx) < self.depth:
                deeper = sum(self.weight(prefix, c) for c in self.below[prefix, ctx])
                a, b = own - math.log(2), deeper - math.log(2)
                total = max(a, b) + math.log1p(math.exp(-abs(a - b)))
                self.memo[prefix, ctx] = total
            else:
                self.memo[prefix, ctx] = own
        return self.memo[prefix, ctx]

    def one(self, prefix, context, d=0):
        ctx = context[len(context) - d:]
        zeros, ones = self.counts.get((prefix, ctx), (0, 0))
        if not zeros + ones:
            return 0.5  # only at the root
        own = (ones + 0.5) / (zeros + ones + 1)
        if d == self.depth or not sum(self.counts.get((prefix, context[len(context) - d - 1:]), (0, 0))):
            return own
        share = math.exp(kt(zeros, ones) - math.log(2) - self.weight(prefix, ctx))
        return share * own + (1 - share) * self.one(prefix, context, d + 1)

    def score(self, b):
        b, out = b"\n" * self.depth + b, 0.0
        for i in range(self.depth, len(b)):
            for prefix, bit in bits_of(b[i]):
                p = self.one(prefix, b[i - self.depth:i])
                out += math.log10(p if bit else 1 - p)
        return out


def expected(rows, held, depth):
    bodies = [ct.body((t or "").encode()) for _, t in rows]
    train = [b for b, h in zip(bodies, held) if not h]
    tree, words = Plain(train, depth), Counter(w for b in train for w in [*b.split(), None])
    total, distinct = sum(words.values()), len(words)
    out = []
    for (i, _), b, h in zip(rows, bodies, held):
        tokens = [*b.split(), None]
        base = sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in tokens)
        out.append((i, h, len(tokens), sum(words[w] > 0 for w in tokens), total, base, tree.score(b)))
    return out


def texts(seed, n=40):
    rng = random.Random(seed)
    names = ["the", "Tree", "of", "näive", "bits", "日本", "a", "🙂x", "zz\x00q", "weights"]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(names) for _ in range(rng.randrange(40)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\r\n"), (None, "the tree"), (3, "the the the"), (3, "the the the"),
            (n + 4, "never seen ŵords Qx" * 3)]


@pytest.mark.parametrize("depth,block,piece,rows", [(5, 1 << 20, 1 << 20, 1 << 20), (3, 200, 64, 40), (4, 1000, 100, 10)])
def test_scores_against_the_recursion(spark, monkeypatch, depth, block, piece, rows):
    prepare(spark)
    data = texts(depth)
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data]
    docs = spark.createDataFrame([(*r, "b", "k", "w", 1, "t") for r in data], SCHEMA).repartition(3)
    monkeypatch.setattr(ct, "ROWS", rows)
    monkeypatch.setattr(ct, "PIECE", piece)
    found = ct.scored(docs, ct.fold(7) != 2, depth, block)
    got = sorted(((r.doc_id, not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect()), key=str)
    # a null id is never learned from
    want = sorted(expected(data, [h or i is None for h, (i, _) in zip(held, data)], depth), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)
    assert any(held) and min(r[6] for r in got) < -20


def test_words_with_equal_keys(spark):
    """Words that one hash does not tell apart are told apart by the other."""
    prepare(spark)
    data = texts(8)
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data]
    docs = spark.createDataFrame([(*r, "b", "k", "w", 1, "t") for r in data], SCHEMA).repartition(2)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 9)) for r in ct.scored(docs, ct.fold(7) != 2, word_bits=1).collect()), key=str)
    assert got == sorted(((r[0], r[2], r[3], round(r[5], 9)) for r in expected(data, held, 3)), key=str)


def test_long_text_in_parts(monkeypatch):
    rng = random.Random(2)
    bodies = [bytes(rng.randrange(97, 101) for _ in range(n)) + b"\n" for n in (0, 5, 3000, 1, 700)]
    want = {}
    for size in (1 << 20, 64):
        monkeypatch.setattr(ct, "PIECE", size)
        keys, n = ct.counted(bodies, 5)
        assert n.sum() == sum(map(len, bodies))
        log_p = -np.arange(1, len(keys) + 1) / 100
        want[size] = keys.tolist(), n.tolist(), ct._sums(bodies, keys, log_p, 5).round(9).tolist()
    assert want[64] == want[1 << 20]


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 100.5, 1e6, 3e9])
    assert np.allclose(ct.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
    assert np.allclose(ct.estimate([0, 3, 2], [0, 0, 5]), [0, kt(3, 0), kt(2, 5)])


def test_empty_and_nothing_to_learn(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "ab c", "b", "k", "w", 1, "t")], SCHEMA)
    assert ct.language_model(docs.limit(0)).collect() == []
    from pyspark.sql import functions as F

    row = ct.scored(docs, F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert abs(row.score - 5 * 8 * math.log10(0.5)) < 1e-9


def test_probabilities_of_all_bytes_sum_to_one(spark):
    """Every byte in one context, seen or not."""
    prepare(spark)
    train = [ct.body(b"some words of the tree"), ct.body(b"the tree of words")]
    keys, n = ct.counted(train, 5)
    asked, base = dict(zip(keys.tolist(), n.tolist())), int.from_bytes(b"the t", "big") << 8
    for b in range(256):
        asked.setdefault(base | b, 0)
    df = spark.createDataFrame([(k >> 8 & 0xFFFFFF, k, c) for k, c in asked.items()], "ctx long, key long, n long")
    p = {r.key: 10**r.log_p for r in ct.log_probabilities(df, 5).collect()}
    assert len(p) == len(asked)
    assert abs(sum(p[base | b] for b in range(256)) - 1) < 1e-9
    assert max(range(256), key=lambda b: p[base | b]) == ord("r")


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_groups_stay_whole(monkeypatch, rows):
    import pyarrow as pa

    monkeypatch.setattr(ct, "ROWS", rows)
    group = [1, 1, 1, 2, 3, 3, 3, 3, 4, 5, 5]
    batches = [pa.RecordBatch.from_pydict({"g": group[a:b]}) for a, b in ((0, 2), (2, 2), (2, 6), (6, 7), (7, 11))]
    found = [t.column(0).to_pylist() for t in ct._groups(iter(batches))]
    assert [x for t in found for x in t] == group
    assert not any(a[-1] == b[0] for a, b in zip(found, found[1:]))
    assert len(found) == {1: 4, 3: 3, 1000: 1}[rows] or len(found) > 1
