"""Language of a text, by a bidirectional gated recurrent network over bytes.

The network reads a word byte by byte in both directions and gives every byte
probabilities of the languages. A document's probabilities are the mean over
the bytes of all its letters. It is trained here, in numpy, by backpropagation
through time on a bounded sample of labelled documents.

Words are the network's sequences (longer ones are read in stretches), so each
distinct word of a batch is read once, all of them in step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from harborlight.llm.common import whole

UNKNOWN = "und"
STRETCH = 32       # bytes of a word that are read as one sequence
UNITS = 12         # hidden units for each direction
STEPS, BATCH = 700, 256
PER_LANGUAGE = 250  # training documents for each language at most
TRAINING = 4000    # training documents in all at most, but one for each language


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Cell:
    """A gated recurrent unit: update gate, reset gate and candidate, in that order."""

    def __init__(self, rng: np.random.Generator, units: int):
        self.inputs = (rng.standard_normal((257, 3 * units)) * 0.3).astype(np.float32)  # byte 256: padding
        self.state = (rng.standard_normal((units, 3 * units)) / np.sqrt(units)).astype(np.float32)

    def forward(self, codes: np.ndarray, keep: bool = False):
        """States (time, rows, units) for codes (time, rows); padding leaves the state as it is."""
        steps, rows = codes.shape
        u = self.state.shape[0]
        h = np.zeros((rows, u), np.float32)
        out = np.empty((steps, rows, u), np.float32)
        tape = []
        for t in range(steps):
            x = self.inputs[codes[t]]
            s = h @ self.state
            gates = _sigmoid(x[:, :2 * u] + s[:, :2 * u])
            z, r = gates[:, :u] * (codes[t] < 256)[:, None], gates[:, u:]
            c = np.tanh(x[:, 2 * u:] + r * s[:, 2 * u:])
            if keep:
                tape.append((h, z, r, c, s[:, 2 * u:], gates[:, :u]))
            h = h + z * (c - h)
            out[t] = h
        return out, tape

    def backward(self, codes: np.ndarray, tape: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of inputs and state weights, back through time."""
        u = self.state.shape[0]
        dx, dw = np.zeros_like(self.inputs), np.zeros_like(self.state)
        dh = np.zeros_like(dout[0])
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, c, sc, gate = tape[t]
            dh = dh + dout[t]
            real = (codes[t] < 256)[:, None]
            da_c = dh * z * (1 - c * c)
            da_z = dh * (c - h) * gate * (1 - gate) * real
            da_r = da_c * sc * r * (1 - r)
            da = np.concatenate([da_z, da_r, da_c], axis=1)
            ds = np.concatenate([da_z, da_r, da_c * r], axis=1)
            np.add.at(dx, codes[t], da)
            dw += h.T @ ds
            dh = dh * (1 - z) + ds @ self.state.T
        dx[256] = 0
        assert dx.shape[1] == 3 * u
        return dx, dw


class Network:
    """Both directions and the output layer; ``languages`` in the order of the outputs."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.cells = [Cell(rng, units), Cell(rng, units)]
        self.out = (rng.standard_normal((2 * units + 1, len(languages))) * 0.1).astype(np.float32)

    def _states(self, codes: np.ndarray, keep: bool = False):
        left, tape_l = self.cells[0].forward(codes, keep)
        right, tape_r = self.cells[1].forward(codes[::-1], keep)
        both = np.concatenate([left, right[::-1], np.ones((*codes.shape, 1), np.float32)], axis=2)
        return both, tape_l, tape_r

    def label(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities (time, rows, languages) of every position."""
        logits = self._states(codes)[0] @ self.out
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def train(self, words: list[list[bytes]], steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> None:
        """Fit by Adam; words[k] are words of language k, drawn alike for every language. Long words are drawn by stretches, as they are read."""
        words = [[s for w in ws for s in stretches(w)] for ws in words]
        rng = np.random.default_rng(seed)
        params = [self.out, *(p for c in self.cells for p in (c.inputs, c.state))]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        u = self.cells[0].state.shape[0]
        for step in range(1, steps + 1):
            truth = rng.integers(0, len(words), batch)
            codes = padded([words[k][rng.integers(len(words[k]))] for k in truth])
            both, tape_l, tape_r = self._states(codes, keep=True)
            logits = both @ self.out
            p = np.exp(logits - logits.max(axis=2, keepdims=True))
            p /= p.sum(axis=2, keepdims=True)
            p[:, np.arange(batch), truth] -= 1
            real = codes < 256
            p *= (real / real.sum())[:, :, None]  # cross entropy of every position
            p = p.astype(np.float32)
            d_out = np.tensordot(both, p, axes=([0, 1], [0, 1]))
            d_both = p @ self.out.T
            gl = self.cells[0].backward(codes, tape_l, d_both[:, :, :u])
            gr = self.cells[1].backward(codes[::-1], tape_r, d_both[::-1, :, u:2 * u])
            rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
            for p_, m, v, g in zip(params, first, second, [d_out, *gl, *gr], strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def stretches(word: bytes) -> list[bytes]:
    """A word in parts of STRETCH bytes; the last may be shorter."""
    return [word[k:k + STRETCH] for k in range(0, len(word), STRETCH)]


def padded(words: list[bytes]) -> np.ndarray:
    """Codes (time, rows) of words of up to STRETCH bytes; 256 pads."""
    width = max(map(len, words), default=0)
    lens = np.array([len(w) for w in words])
    rows = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    codes = rows.astype(np.int64)
    codes[np.arange(width)[None, :] >= lens[:, None]] = 256
    return np.ascontiguousarray(codes.T)


# bytes of letters: A-Z, a-z and all of UTF-8 beyond ASCII
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)] + [False])


class Reader:
    """Sums of probabilities for words, each distinct word read once while it is remembered."""

    ROOM, ROWS = 200_000, 4096

    def __init__(self, network: Network):
        self.network = network
        self.words: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(network.languages) + 1))

    def _read(self, words: list[bytes]) -> np.ndarray:
        """Per word: sum of probabilities over its letters' bytes, and their number."""
        parts = [(i, s) for i, w in enumerate(words) for s in stretches(w)]
        parts.sort(key=lambda x: len(x[1]))
        out = np.zeros((len(words), len(self.network.languages) + 1))
        for at in range(0, len(parts), self.ROWS):
            part = parts[at:at + self.ROWS]
            codes = padded([w for _, w in part])
            held = LETTER[codes]
            p = np.einsum("trk,tr->rk", self.network.label(codes), held.astype(np.float32))
            np.add.at(out, [i for i, _ in part], np.concatenate([p, held.sum(0)[:, None]], axis=1))
        return out

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of the languages over the letters of each text; 0 without letters."""
        split = [t.split() for t in texts]
        if len(self.words) > self.ROOM:
            self.words, self.sums = {}, self.sums[:0]
        fresh = list({w for ws in split for w in ws} - self.words.keys())
        if fresh:
            self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh)), strict=True))
            self.sums = np.concatenate([self.sums, self._read(fresh)])
        find, out = self.words.__getitem__, np.zeros((len(texts), self.sums.shape[1]))
        for k, ws in enumerate(split):
            if ws:
                out[k] = self.sums[np.fromiter(map(find, ws), np.int64, len(ws))].sum(0)
        return out[:, :-1] / np.maximum(out[:, -1:], 1)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, steps: int = STEPS, most: int = TRAINING) -> Network:
    """Train on up to ``per_language`` documents of each value of lang, and about ``most`` in all.

    Every language with rows that have letters is learned, with an equal share of the sample. Of a language's rows those with the smallest hash of doc_id and
    text are taken. Only the sampled texts come to the driver. Rows without lang or text are left out.
    """
    texts = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = texts.select(
        "lang", F.xxhash64("doc_id", "text").alias("h"), F.rlike("text", F.lit(r"\p{L}")).alias("letters"),
    ).filter("letters")
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Network([])
    each = max(1, min(per_language, most // len(counts)))
    # hashes spread evenly, so twice the wanted share of them holds the smallest ones of a language
    below = [(r["lang"], min(int(min(1.0, (2 * each + 50) / r["count"]) * 2**64) - 2**63, 2**63 - 1)) for r in counts]
    limits = labelled.sparkSession.createDataFrame(below, "lang string, most long")
    order = W.partitionBy("lang").orderBy("h")
    picked = rows.join(limits, "lang").filter("h <= most").select("lang", "h", F.row_number().over(order).alias("n")).filter(
        F.col("n") <= each).select("lang", "h").distinct()
    sample = texts.withColumn("h", F.xxhash64("doc_id", "text")).join(picked, ["lang", "h"]).select("lang", "text").distinct().collect()
    words: dict[str, list[bytes]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["text"])):
        found = [w for w in r["text"].encode().split() if LETTER[np.frombuffer(w, np.uint8)].any()]
        if found:
            words.setdefault(r["lang"], []).extend(found)
    names = sorted(words)
    network = Network(names)
    if len(names) > 1:
        network.train([words[n] for n in names], steps)
    return network


def least_score(held: DataFrame, network: Network, share: float = 0.001) -> float:
    """A score that rightly recognised documents hardly ever fall under, from labelled rows that were not learned from.

    Halfway between the score of no knowledge, one over the number of languages, and the one that ``share`` of the rightly recognised rows fall
    under, so it means the same at any number of languages. Without such rows it is the former.
    """
    n = len(network.languages)
    if not n:
        return 0.0
    sent = held.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(sent.value)
        for batch in batches:
            names, score = label(batch.column(1).cast(pa.binary()).to_pylist())
            right = names == np.array(batch.column(0).to_pylist(), object)
            yield pa.RecordBatch.from_arrays([pa.array(score[right.astype(bool)])], ["score"])

    rows = held.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(run, "score double")
    low = rows.agg(F.percentile_approx("score", share, 10_000)).first()[0]
    return 1 / n if low is None else 1 / n + (low - 1 / n) / 2


_LETTERS = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTERS.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


class Labeller:
    """Languages and scores of batches of texts; one for each task."""

    def __init__(self, network: Network):
        self.reader, self.names = Reader(network), np.array([*network.languages, UNKNOWN], object)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.names) - 1
        if not n or not texts:
            return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        p = self.reader.documents(texts)
        known = np.array([has_letter(t) for t in texts], bool)
        best = p.argmax(axis=1)
        score = np.clip(np.where(known, p[np.arange(len(texts)), best], 0.0), 0.0, 1.0)
        return self.names[np.where(known, best, n)], score


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """Per document: doc_id, lang_pred, score (the mean probability of that language).

    The whole text is read. Texts that are null or have no letter, and all texts if no
    language was learned, give 'und' and 0. Equal probabilities go to the first
    language by name. Rows given twice come twice; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(sent.value)
        for batch in batches:
            names, score = label(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, network: Network, least: float) -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(sent.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            names, score = label(texts)
            yield batch.filter(pa.array((names != UNKNOWN) & (score >= least), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids give null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def identified(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the rows outside fold 1 of 3.

    Rows with a null id are never learned from and not held out.
    """
    network = fit(docs.filter(fold(3) != 1))
    return predict(docs, network).withColumn("held_out", F.coalesce(fold(3) == 1, F.lit(False))).select(
        "doc_id", "held_out", "lang_pred", "score")
