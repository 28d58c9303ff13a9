"""Merkle manifest and fill-in-the-middle against plain versions, with gaps, ties and long texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborlight.llm import fill_middle, merkle
from harborlight.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place string, idx int, node string, h1 string, n string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout):
    def leaf(r, lower=False):
        i, text, lang, source, n = r
        if lower and text is not None:
            text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([h(*last[k:k + fanout]) for k in range(0, len(last), fanout)])
        return levels

    def path(levels, at):
        for nodes in levels[:-1]:
            lo = at - at % fanout
            yield nodes[lo:at], nodes[at + 1:lo + fanout]
            at //= fanout

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: climb([leaf(r) for r in by[s]]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(by[s]):
            steps = [*path(trees[s], at), *path(top, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf(r, bad)
            for left, right in steps:
                fold = h(*left, fold, *right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*(x for a, b in steps for x in a + b)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def sample(seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["Some Text", "lower only", None, "", "Ünï ", "A" * 5000]), rng.choice(["en", None]),
             rng.choice(["hot"] * 6 + ["b", "ä", "Z", None, ""]), rng.choice([0, 7, None])) for i in range(n)]
    return [*rows, (None, "Null id", "en", "hot", 1), (None, "Null id 2", "en", None, 1), (3, "Again", "en", "hot", 2), (3, "Again", "en", "hot", 2)]


def with_more(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "n", "h", "n") for r in rows], DOCS)


@pytest.mark.parametrize("n,fanout,parts", [(0, 16, 1), (1, 16, 1), (300, 16, 5), (90, 2, 3), (90, 3, 4)])
def test_manifest(spark, n, fanout, parts):
    prepare(spark)
    rows = sample(n, n) if n > 1 else [(5, "One Text", "en", "s", 3)] * n
    docs = with_more(spark, rows).repartition(parts)
    got = merkle.manifest(docs, merkle.tampered_fold(), fanout)
    found = sorted((tuple(r) for r in got.collect()), key=str)
    assert found == plain_manifest(rows, fanout)
    if n > 1:
        assert {r[6] for r in found} == {True, False}
        # without tampering all folds lead to the root
        assert merkle.manifest(docs, fanout=fanout).filter("NOT verified").count() == 0


def test_a_source_on_many_ranges(spark):
    """Numbers go on over ranges."""
    prepare(spark)
    df = spark.range(5000).select(F.lit("s").alias("place"), (F.col("id") * 7919 % 5000).alias("k"))
    bad = merkle.numbered(df, "k").filter("idx <> k OR n <> 5000")
    assert bad.count() == 0


def plain_fim(i, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    s = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, f = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, text, len(u), "plain", None, None, text
    if h4 % 100 < 20:
        return i, text, len(u), "spm", len(p), len(m), f"<S>{f}<P>{p}<M>{m}"
    return i, text, len(u), "psm", len(p), len(m), f"<P>{p}<S>{f}<M>{m}"


def fim_texts():
    rng = random.Random(4)
    atoms = ["word", "Übung", " ", "\n", "日本語", "🙂", "x" * 900, "1234", "<", ">", "<P", "S>", "\x00", "é" * 70, "ab1"]
    rows = [(i, "".join(rng.choice(atoms) for _ in range(rng.randrange(60)))) for i in range(250)]
    shared = "".join(rng.choice(atoms) for _ in range(400))
    rows += [(1000 + i, "pre" * i + shared + "post" * i) for i in range(20)]
    return [*rows, (2000, None), (2001, ""), (None, "null id here"), (2002, "has <P> in it"), (2003, "a" * 50000), (2004, "日" * 20000),
            (2005, "".join(rng.choice("abc deé") for _ in range(60000))), (7, "again"), (7, "again")]


def test_fill_in_the_middle(spark):
    prepare(spark)
    rows = fim_texts()
    docs = with_more(spark, [(i, t, "en", "s", 1) for i, t in rows])
    found = fill_middle.transformed(docs).withColumn("back", fill_middle.restored()).collect()
    assert sorted((tuple(r)[:7] for r in found), key=str) == sorted((plain_fim(i, t) for i, t in rows), key=str)
    assert all(r.back == r.text for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.transformed(docs.limit(0)).collect() == []


@pytest.mark.parametrize("step,most", [(1 << 20, 4096), (100, 64)])
def test_counts_do_not_depend_on_chunks(monkeypatch, step, most):
    monkeypatch.setattr(fill_middle, "STEP", step)
    monkeypatch.setattr(fill_middle, "MOST", most)
    memory = fill_middle.Memory(room=3000)  # forgets between batches
    texts = [(t or "").encode() for _, t in fim_texts()]
    for at in range(0, len(texts), 40):
        part = texts[at:at + 40]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in part])])
        n, chars = fill_middle.located(memory, b"".join(part), bounds, lambda n: np.stack([n // 3, n // 2, n], axis=1))
        for t, k, c in zip(part, n, chars):
            u = re.findall("[A-Za-z]+|[^A-Za-z]", t.decode())
            assert k == len(u)
            assert c.tolist() == [len("".join(u[:x])) for x in (k // 3, k // 2, k)]


def test_shared_passages_become_the_same_chunks():
    rng = random.Random(1)
    passage = bytes(rng.randrange(97, 123) for _ in range(20000))
    sets = []
    for front in (b"", b"some words before", b"x" * 333):
        text = front + passage
        ends = fill_middle.cuts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        sets.append({text[s:e] for s, e in zip([0, *ends.tolist()], ends.tolist())})
    assert len(sets[0] & sets[1] & sets[2]) > 0.9 * len(sets[0])
