"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A term's weight is its idf, times what it tells of the label: most words of a text tell nothing, and what they
share would drown the few that do. Every term of the examples keeps its idf at least.

The examples' vectors stand in an inverted index whose postings are cut into
blocks of alike examples. Rare terms, those with the largest impact, are looked up for every text, so what they add to each example is
known. Of the common terms the largest weight in each block is known. Both together bound the cosine
in a block; blocks are opened from the highest bound on, for many texts at once, until no bound reaches the k-th
best cosine found. What is left out cannot be among the nearest, so the result is exact.

The k nearest vote, each with its cosine as weight, and a logistic curve, fitted on the
examples themselves with each one left out in turn, makes the vote a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from harborlight.llm.common import whole
from harborlight.llm.language_id import fold

EXAMPLES = 4000   # labelled documents in the index at most, half of them toxic where there are enough
NEAREST = 15
BLOCK = 64        # examples in a block
COMMON = 20       # a term of one example in so many, and of 8 at least, is common
ROUNDS = (6, 16)  # blocks opened for a text before its bounds are looked at again
TEXTS = 512       # texts that are looked up at once
FITTED = 64       # examples that are looked up at once on the driver
CHANCE = 3.0      # standard deviations that a term's share of toxic examples may be off by chance
EVIDENCE = 5

_WORD = re.compile(r"[^\W\d_]+")

Vector = tuple[np.ndarray, np.ndarray]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _alike(rows: np.ndarray, groups: int, rounds: int = 8) -> np.ndarray:
    """An order of the rows in which alike ones stand together: by the nearest of a few centres, which move to their rows' mean."""
    if groups < 2:
        return np.arange(len(rows))
    centres = rows[np.linspace(0, len(rows) - 1, groups).astype(int)]
    for _ in range(rounds):
        near = rows @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    return np.lexsort((np.arange(len(rows)), -near[np.arange(len(rows)), own], own))


def _telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """A factor of 1 or more for each term: by how many standard deviations beyond ``CHANCE`` its share of toxic examples is off.

    toxic, clean: the examples of either label that hold the term. The deviation is the root of the likelihood ratio of both
    shares against one. The side that is too frequent counts with an example less, so no example's own label makes its words tell.
    """
    n = n_toxic + n_clean
    if not n_toxic or not n_clean:
        return np.ones(len(toxic))
    more = toxic * n_clean > clean * n_toxic
    a = np.where(more, np.maximum(toxic - 1, 0), toxic)
    b = np.where(more, clean, np.maximum(clean - 1, 0))

    def part(seen: np.ndarray, share: float, of: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(share * of, 1e-9)), 0)

    held, rest = a + b, n - a - b
    ratio = 2 * (part(a, n_toxic / n, held) + part(b, n_clean / n, held)
                 + part(n_toxic - a, n_toxic / n, rest) + part(n_clean - b, n_clean / n, rest))
    still = (a * n_clean > b * n_toxic) == more  # without that example the share may lean to the other side
    return 1 + np.where(still, np.maximum(np.sqrt(np.maximum(ratio, 0)) - CHANCE, 0), 0)


class BlockMaxIndex:
    """Postings of unit vectors by term, in blocks of alike examples, with each block's largest weights.

    ``opened`` counts the blocks that were opened for a text.
    """

    def __init__(self, vectors: Sequence[Vector], terms: int, block: int = BLOCK):
        self.n, self.blocks, self.opened = len(vectors), -(-len(vectors) // block), 0
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        df = np.bincount(term, minlength=terms)
        common = np.flatnonzero(df >= max(8, -(-self.n // COMMON)))
        self.column = np.full(terms, -1)
        self.column[common] = np.arange(len(common))
        rows = np.zeros((self.n, len(common)))
        often = self.column[term] >= 0
        rows[example[often], self.column[term[often]]] = weight[often]
        # place in the blocks, from here on in place of the example's number
        self.examples = _alike(rows, self.blocks // 2)
        place = np.empty(self.n, np.int64)
        place[self.examples] = np.arange(self.n)
        self.rows = rows[self.examples]
        self.starts = np.arange(0, self.n, block)
        self.block = block
        self.largest = np.maximum.reduceat(self.rows, self.starts, axis=0).T.copy() if self.n else np.zeros((len(common), 0))
        term, example, weight = term[~often], place[example[~often]], weight[~often]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(terms + 1))
        self.places = place

    def nearest_of(self, queries: Sequence[Vector], k: int, skip: np.ndarray | None = None, texts: int = TEXTS) -> list[Vector]:
        """For each query the k examples of largest positive cosine, ties to the smaller one; ``skip`` names one to leave out of each.

        ``texts`` are looked up at once, which bounds the memory.
        """
        out: list[Vector] = []
        for at in range(0, len(queries), texts):
            out += self._some(queries[at:at + texts], k, None if skip is None else skip[at:at + texts])
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> Vector:
        return self.nearest_of([(terms, weights)], k, None if skip < 0 else np.array([skip]))[0]

    def _some(self, queries: Sequence[Vector], k: int, skip: np.ndarray | None) -> list[Vector]:
        m, n = len(queries), self.n
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        row = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        term = np.concatenate([t for t, _ in queries])
        weight = np.concatenate([w for _, w in queries])
        column = self.column[term] if len(term) else term.astype(np.int64)
        often = column >= 0
        asked = np.zeros((m, self.rows.shape[1]))
        asked[row[often], column[often]] = weight[often]
        # rare terms: what they add to every example
        row, term, weight = row[~often], term[~often].astype(np.int64), weight[~often]
        held = self.first[term + 1] - self.first[term]
        ends = np.cumsum(held)
        at = np.repeat(self.first[term] - (ends - held), held) + np.arange(ends[-1] if len(ends) else 0)
        rare = np.bincount(
            np.repeat(row, held) * n + self.example[at], np.repeat(weight, held) * self.weight[at], m * n).reshape(m, n)
        bound = np.maximum.reduceat(rare, self.starts, axis=1) + asked @ self.largest
        order = np.argsort(-bound, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(self.blocks)[None, :], axis=1)
        cosine = np.full((m, n), -1.0)
        best = np.full((m, k), 0.0)
        done = 0
        for upto in (*ROUNDS, self.blocks):
            upto = min(upto, self.blocks)
            wanted = (rank >= done) & (rank < upto) & (bound > 0) & (bound >= best[:, :1] - 1e-9)
            if not wanted.any():
                break
            self.opened += int(wanted.sum())
            for b in np.flatnonzero(wanted.any(axis=0)):
                lo, hi = self.starts[b], min(self.starts[b] + self.block, n)
                who = np.flatnonzero(wanted[:, b])
                cosine[who, lo:hi] = rare[who, lo:hi] + asked[who] @ self.rows[lo:hi].T
            if skip is not None:
                cosine[np.arange(m), self.places[skip]] = -1.0
            done = upto
            if done == self.blocks:
                break
            # the k best so far, the worst of them first
            best = np.maximum(np.sort(np.partition(cosine, n - k, axis=1)[:, n - k:], axis=1) if n > k else
                              np.pad(np.sort(cosine, axis=1), ((0, 0), (k - n, 0)), constant_values=-1.0), 0.0)
        out = []
        who, where = np.nonzero((cosine > 0) & (cosine >= best[:, :1] - 1e-9))
        bounds = np.searchsorted(who, np.arange(m + 1))
        value, name = cosine[who, where], self.examples[where]
        for i in range(m):
            v, e = value[bounds[i]:bounds[i + 1]], name[bounds[i]:bounds[i + 1]]
            top = np.lexsort((e, -np.round(v, 12)))[:k]
            out.append((e[top], v[top]))
        return out


class Judge:
    """Vocabulary, index, and the curve from votes to probabilities."""

    def __init__(self, examples: Iterable[tuple[int, str | Counter, int]], counts: dict[int, int]):
        """examples: (doc_id, text or counts of its words, label); counts: labelled rows of each label in all of the training folds.

        Examples are gone through once, and only the numbers of their words are kept.
        """
        ids, labels, held, seen = [], [], [], {}
        for doc_id, text, label in examples:
            words = Counter(words_of(text)) if isinstance(text, str) else text
            codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
            by = np.argsort(codes)
            held.append((codes[by], np.fromiter(words.values(), np.int32, len(words))[by]))
            ids.append(doc_id)
            labels.append(label)
        self.ids, self.labels = np.array(ids, np.int64), np.array(labels, np.int64)
        n = len(held)
        # every term of the examples; copies of one set of words count once, so they make no term common
        sets: dict[bytes, list[int]] = {}
        for (codes, _), label in zip(held, labels, strict=True):
            marks = sets.setdefault(codes.tobytes(), [0, 0])
            marks[label] += 1
        df, toxic, n_toxic = np.zeros(len(seen), np.int64), np.zeros(len(seen)), 0.0
        for codes, marks in sets.items():
            at = np.frombuffer(codes, np.int32)
            df[at] += 1
            toxic[at] += marks[1] / sum(marks)
            n_toxic += marks[1] / sum(marks)
        kept = sorted(seen)
        self.terms = {w: i for i, w in enumerate(kept)}
        first = np.fromiter((seen[w] for w in kept), np.int64, len(kept))
        place = np.empty(len(kept), np.int64)
        place[first] = np.arange(len(kept))
        self.idf = np.array([np.log((1 + len(sets)) / (1 + k)) + 1 for k in df[first].tolist()])
        self.weights = self.idf * _telling(toxic[first], (df - toxic)[first], n_toxic, len(sets) - n_toxic)
        vectors = []
        for codes, tf in held:
            by = np.argsort(place[codes])
            vectors.append(self.weighed(place[codes][by], tf[by].astype(float)))
        del seen, held, sets
        self.index = BlockMaxIndex(vectors, len(kept))
        # every class weighs as it does among all labelled rows
        total = sum(counts.values()) or 1
        share = np.array([counts.get(k, 0) / total for k in (0, 1)])
        held = np.maximum(np.bincount(self.labels, minlength=2), 1)
        each = (share / held)[self.labels] * n
        self.base = (share[1] * 2 + 1) / 4 if not n else 0.0
        votes = np.array([self.vote(*x) for x in self.index.nearest_of(vectors, NEAREST, np.arange(n), FITTED)])
        alone = np.isnan(votes)
        self.base = float((each[alone] @ self.labels[alone] + share[1]) / (each[alone].sum() + 1)) if n else share[1]
        self.curve = _logistic(votes[~alone], self.labels[~alone], each[~alone])

    def vector(self, counts: Counter) -> Vector:
        """Unit TF-IDF vector: (1 + ln tf) times idf and what the term tells, over the vocabulary."""
        held = sorted((self.terms[w], k) for w, k in counts.items() if w in self.terms)
        return self.weighed(np.array([t for t, _ in held], np.int64), np.array([k for _, k in held], float))

    def weighed(self, terms: np.ndarray, tf: np.ndarray) -> Vector:
        weights = (1 + np.log(tf)) * self.weights[terms] if len(terms) else np.zeros(0)
        return terms, weights / np.linalg.norm(weights) if len(terms) else weights

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        """Share of the cosines that is toxic; nan without a neighbour."""
        return float(cosine @ self.labels[found] / cosine.sum()) if len(found) else np.nan

    def scores(self, vectors: Sequence[Vector]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Probability, nearest examples and their cosines of each text."""
        out = []
        for found, cosine in self.index.nearest_of(vectors, NEAREST):
            p = self.base
            if len(found):
                p = float(1 / (1 + np.exp(-(self.curve[0] * self.vote(found, cosine) + self.curve[1]))))
            out.append((p, found, cosine))
        return out

    def score(self, counts: Counter) -> tuple[float, np.ndarray, np.ndarray]:
        return self.scores([self.vector(counts)])[0]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton's method."""
    a = np.zeros(2)
    z = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        grad = z.T @ (weight * (y - p)) - ridge * a
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a += step
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Judge:
    """Learn from labelled documents outside fold 0 of 5.

    At most ``examples`` documents go into the index, half of them toxic where there are enough: of each label those
    with the smallest hash of their id. Only the counts of their words come to the driver. Ids with several labels
    count as toxic if one says so; null ids and labels are left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold(5) != 0).groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # hashes spread evenly, so twice the wanted share of them holds the smallest ones of a label
    limit = F.lit(None).cast("long")
    for mark, n in counts.items():
        below = int(min(1.0, (examples + 50) / n) * 2**64) - 2**63
        limit = F.when(F.col("toxic") == mark, F.lit(min(below, 2**63 - 1))).otherwise(limit)
    order = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.filter(F.xxhash64("doc_id") <= limit).withColumn("k", F.row_number().over(order)).filter(
        F.col("k") <= examples // 2).collect()
    label = {r["doc_id"]: r["toxic"] for r in picked}
    if not label:
        return Judge([], counts)
    chosen = docs.sparkSession.createDataFrame([(int(i),) for i in label], "doc_id long")  # ``examples`` rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).join(
        F.broadcast(chosen), "doc_id").distinct()
    found = word_counts(rows).toArrow()  # not as rows: a word takes its bytes only
    ids, words, numbers = (found.column(k) for k in range(3))
    times = Counter(ids.to_pylist())

    def counted(i: int) -> Counter:
        return Counter(dict(zip(words[i].as_py(), numbers[i].as_py(), strict=True)))

    # several texts of an id in the order of their words
    order = sorted(range(len(ids)), key=lambda i: (ids[i].as_py(), sorted(counted(i).items()) if times[ids[i].as_py()] > 1 else []))
    return Judge(((ids[i].as_py(), counted(i), label[ids[i].as_py()]) for i in order), counts)


def word_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, words, n): the distinct words of each text of rows (doc_id, text), and how often they stand there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [Counter(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([list(c) for c in each], pa.list_(pa.string())),
                pa.array([list(c.values()) for c in each], pa.list_(pa.int64()))], ["doc_id", "words", "n"])

    return rows.mapInArrow(run, "doc_id long, words array<string>, n array<long>")


class Vectors:
    """Vectors of texts; what a raw word stands for is remembered per worker."""

    ROOM = 400_000

    def __init__(self, judge: Judge):
        self.judge = judge
        self.words: dict[bytes, int] = {}        # the term of a raw word, -1 for none
        self.several: dict[bytes, list[int]] = {}  # raw words of several terms

    def _learn(self, fresh: set[bytes]) -> None:
        if len(self.words) > self.ROOM:
            self.words, self.several = {}, {}
        terms = self.judge.terms
        for raw in fresh:
            found = [terms[w] for w in words_of(raw.decode("utf-8", "replace")) if w in terms]
            self.words[raw] = found[0] if len(found) == 1 else -1
            if len(found) > 1:
                self.several[raw] = found

    def of(self, texts: list[bytes]) -> list[Vector]:
        out = []
        for text in texts:
            ws = text.split()
            fresh = {w for w in ws if w not in self.words}
            if fresh:
                self._learn(fresh)
                if len(self.words) == len(fresh):  # forgotten, with the text's other words
                    self._learn(set(ws) - fresh)
            ids = np.fromiter(map(self.words.__getitem__, ws), np.int64, len(ws))
            more = [i for w in ws if w in self.several for i in self.several[w]]
            ids = np.concatenate([ids[ids >= 0], np.array(more, np.int64)])
            out.append(self.judge.weighed(*np.unique(ids, return_counts=True)))
        return out


RESULT = ("doc_id long, score double, predicted int, "
          "evidence array<struct<doc_id:long,similarity:double,toxic:int>>")


def scored(docs: DataFrame, judge: Judge) -> DataFrame:
    """Per document: doc_id, score, predicted (score of 0.5 or more), evidence (the nearest examples).

    Whole texts; a null, empty or unmatched text gets the share of toxic ones among such examples. Without any example
    the score is 0. Rows given twice come twice; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(judge)  # bounded by the number of examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = sent.value
        vectors = Vectors(j)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            each = dict.fromkeys(texts)  # a repeated text is judged once
            judged = dict(zip(each, j.scores(vectors.of(list(each))), strict=True))
            scores, evidence = [], []
            for score, found, cosine in map(judged.__getitem__, texts):
                scores.append(min(max(score, 0.0), 1.0))
                evidence.append([
                    {"doc_id": int(j.ids[i]), "similarity": float(s), "toxic": int(j.labels[i])}
                    for i, s in zip(found[:EVIDENCE], cosine, strict=False)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array(evidence, pa.list_(pa.struct(
                    [("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))),
            ], ["doc_id", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(run, RESULT)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence; learned outside fold 0 of 5."""
    return scored(docs, fit(docs, labels)).withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False))).select(
        "doc_id", "held_out", "score", "predicted", "evidence")
