"""SimHash, exact and line duplicates against plain versions."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from harborlight.llm import components, exact_dedup, line_dedup, queries, simhash
from harborlight.llm.common import prepare

DOCS = "doc_id long, text string, fp string, h string, keep_id long, pos int, key string, recipe int"


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names the operators use themselves."""
    prepare(spark)

    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", 1, 2, "z", 3) for i, t in rows], DOCS)

    return make


def plain_fingerprint(text, shingle=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [
    "", " \t\n", "One", "a b c", "A b  C\td\x0be\x0cf", "Été É   x y z", "w " * 300, "\x1c a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def walk(prints, radius):
    """Smallest entry of each component, by comparing all pairs."""
    label = np.arange(len(prints))
    for i in range(len(prints)):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= radius)
        label = simhash.join_labels(label, np.full(len(near), i), near)
    return label


@pytest.mark.parametrize("limits", [
    {}, {"task_variants": 1 << 14, "pass_variants": 1 << 10}, {"task_prints": 300, "wave_copies": 64}])
def test_links_against_all_pairs(spark, limits):
    prepare(spark)
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(seeds.tolist()) | {0}
    for s in seeds[:20].tolist():  # chains and clusters around some of them
        at = s
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                at ^= 1 << int(b)
            prints.add(at)
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.near_links(df, 4, **limits)).collect()}
    label = walk(prints, 4)
    got, signed = {}, prints.view(np.int64).tolist()
    for p, k in zip(signed, label.tolist(), strict=True):
        got.setdefault(k, set()).add(roots.get(p, p))
    assert all(len(x) == 1 for x in got.values())
    assert len({next(iter(x)) for x in got.values()}) == len(got)


def test_near_duplicates(docs):
    base = "the quick brown fox jumps over the lazy dog and runs far away " * 30
    near = base + "again"
    rows = [(7, base), (3, near), (9, base.upper()), (4, None), (2, ""), (8, " \n"), (5, "alone in the world"),
            (5, "alone in the world"), (None, base)]
    found = sorted(((r.doc_id or -1, r.component_id, r.group_size, r.fingerprint)
                    for r in simhash.near_duplicates(docs(rows)).collect()))
    by = {}
    for i, c, n, f in found:
        by.setdefault(i, (c, n, f))
    assert len(found) == len(rows)
    assert by[4] == by[2] == by[8] == (2, 3, "0" * 16)
    assert by[5][:2] == (5, 2)
    assert by[7][2] == by[9][2] == f"{plain_fingerprint(base):016x}"
    linked = (plain_fingerprint(base) ^ plain_fingerprint(near)).bit_count() <= 4
    assert by[7][0] == (3 if linked else 7) == by[-1][0]
    assert simhash.near_duplicates(docs([])).count() == 0


def test_components_of_chains_and_loops(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(200, 200), (300, 301), (301, 300), (500, 400), (600, 500)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(n + 1))
    assert found[301] == found[300] == 300 and found[600] == found[500] == 400 and 200 not in found
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


ROWS = [(3, "a  b\tc"), (1, "a b c"), (2, "a b c "), (9, None), (4, ""), (6, " "), (7, "\n\t"), (5, "a b c"), (5, "a b c"),
        (8, "word " * 5000), (12, "word " * 5000), (11, "word " * 4999 + "wOrd "), (None, "a b c"), (None, "other")]


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_duplicates(docs, bits):
    """With two bits nearly all chunks collide, and the ranks must tell them apart."""
    want = {}
    for i, t in ROWS:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        want.setdefault(n, []).append(i)
    found = exact_dedup.exact_duplicates(docs(ROWS), bits).collect()
    assert len(found) == len(ROWS)
    plain = {hashlib.sha256(n.encode()).hexdigest(): ids for n, ids in want.items()}
    for r in found:
        ids = plain[r.text_sha256]
        least = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (least, len(ids), r.doc_id == least)
    assert exact_dedup.exact_duplicates(docs([]), bits).count() == 0


def test_chunks_are_the_text(spark):
    text = "Some words, and some others; é 日本 \U0001f389" * 700 + "x" * 20_000
    row = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks("t").alias("c")).first()
    assert "".join(row.c) == text
    assert max(map(len, row.c)) <= 4096


def plain_repeats(rows, least=50):
    """Line numbers to delete, by looking up every stretch of lines."""
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    seen, gone = {}, {}
    spans = []
    for d, (_, _, t) in enumerate(order):
        lines = t.split("\n")
        words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        held = [k for k, w in enumerate(words) if w]
        for a in range(len(held)):
            total = 0
            for b in range(a, len(held)):
                total += words[held[b]]
                if total >= least:
                    spans.append((d, held[a], held[b], tuple(lines[k] for k in held[a:b + 1])))
                    break
        for b in range(len(held)):
            total = 0
            for a in range(b, -1, -1):
                total += words[held[a]]
                if total >= least:
                    spans.append((d, held[a], held[b], tuple(lines[k] for k in held[a:b + 1])))
                    break
    for d, a, b, key in sorted(spans):
        seen.setdefault(key, (d, a, b))
    for d, a, b, key in spans:
        d0, _, b0 = seen[key]
        if d > d0 or a > b0:
            gone.setdefault(d, set()).update(range(a, b + 1))
    return {order[d]: g for d, g in gone.items()}


def test_line_repeats(docs):
    rng = np.random.default_rng(11)
    pool = [" ".join(f"w{rng.integers(30)}" for _ in range(rng.integers(1, 40))) for _ in range(25)]
    shared = pool[:8]
    rows = []
    for i in range(40):
        lines = [pool[k] for k in rng.integers(0, 25, rng.integers(0, 12))]
        if i % 3 == 0:
            at = rng.integers(0, len(lines) + 1)
            lines[at:at] = shared[rng.integers(0, 4):rng.integers(4, 9)]
        if i % 5 == 0:
            lines.insert(len(lines) // 2, "")
        rows.append((int(i), "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "same line here\n" * 60), (1, rows[1][1]), (None, rows[3][1]),
             (54, "x " * 3000), (55, "x " * 3000)]
    gone = plain_repeats(rows)
    found = line_dedup.without_repeats(docs(rows)).collect()
    assert len(found) == len(rows)
    want = sorted(
        (str(i), str(None if t is None else "\n".join(
            x for k, x in enumerate(t.split("\n")) if k not in gone.get((i is None, i or 0, t), ()))),
         0 if t is None else len(t.split("\n")), len(gone.get((i is None, i or 0, t), ()))) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.text), r.lines_total, r.lines_removed) for r in found) == want
    assert sum(w[3] for w in want) > 50
    assert found[0].asDict().keys() >= {"fp", "h", "key", "pos"}
    assert line_dedup.without_repeats(docs([])).count() == 0


def test_queries_return_whole_tables(spark, con):
    n = con.execute("SELECT count(*) FROM documents").fetchone()[0]
    rows = queries.op1_simhash(spark, "/root/testdata/sf0.001").collect()
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert len(rows) == n
    prints = {i: plain_fingerprint(t or "") for i, t in texts.items()}
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] for r in rows)
    ids = np.array(sorted(prints))
    label = walk(np.array([prints[i] for i in ids.tolist()], np.uint64), 4)
    assert all(r.component_id == ids[label[np.searchsorted(ids, r.doc_id)]] for r in rows)
