"""Language-model scores by context-tree weighting over bytes.

A text is its words, A-Z in lower case, with one space between them and an end byte. Each of a byte's eight bits is
predicted by itself: for every prefix of the byte there is one tree over the bytes before it. A node of a tree is a
context of 0 to ``DEPTH`` bytes with two counts; its Krichevsky-Trofimov estimate is the probability of those
counts. A node's weighted probability is the mean of its own estimate and the product of its children's
weighted probabilities, so the training text itself says how much each depth is worth.

The counts come from all training texts. Spark gathers them by (context, byte); contexts are dealt out by their
last three bytes, below which a task works its part of the tree out alone, and the three levels above are plain
aggregates. Texts that are only scored add their contexts with a count of zero, so every context that is asked for has its answer.

Texts lie in blocks of bounded size. A block asks for each of its distinct contexts and words once, and the answers come
back to the block, where the texts are summed up; so what is moved follows the distinct contexts of a block, not the bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborlight import session
from harborlight.llm.common import parallelism, saved, whole
from harborlight.llm.language_id import fold

DEPTH = 5              # bytes of the longest context; 5 at most, so that context, byte and text fit into 64 bits
TOP = 3                # levels that are aggregates over all tasks
BLOCK = 24 << 20       # bytes of text in a block
PIECE = 1 << 20        # bytes that are worked on at once
ROWS = 1 << 20         # contexts that a task works out at once, and the rest of the last group
END = b"\n"

_LOG2 = float(np.log(2.0))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers, by Stirling's series from x + 8 on."""
    x = np.asarray(x, float)
    below = np.ones_like(x)
    for k in range(8):
        below *= x + k
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(below)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    zeros, ones = np.asarray(zeros, float), np.asarray(ones, float)
    out = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)
    return np.where(zeros + ones > 0, out, 0.0)


def weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of a node's weighted probability, and the share of its own estimate in it; ``below``: sum over the children."""
    own = estimate(zeros, ones) - _LOG2
    total = np.logaddexp(own, below - _LOG2)
    return total, np.exp(own - total)


def one_next(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability that the next bit is 1."""
    return (ones + 0.5) / (zeros + ones + 1.0)


# -- texts ----------------------------------------------------------------

def body(text: bytes) -> bytes:
    """Words in lower case, one space between them, and the end."""
    return b" ".join(text.lower().split()) + END


PACKS = "block long, ids array<long>, train array<boolean>, length array<long>, bodies binary"


def packs(docs: DataFrame, train: Column, size: int = BLOCK) -> DataFrame:
    """Bodies, compressed together: (block, ids, train, length, bodies).

    A block is a run of rows of one partition, with ``size`` bytes or one longer text; a pack is what one batch of rows has of it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        for batch in batches:
            bodies = [body(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            length = np.array([len(b) for b in bodies], np.int64)
            before = at + np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            at = int(before[-1])
            block = (np.int64(task) << 32) + before[:-1] // size
            for k in np.unique(block):
                lo, hi = np.searchsorted(block, [k, k + 1])
                yield pa.RecordBatch.from_arrays([
                    pa.array([k]), pa.array([batch.column(0)[lo:hi].to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column(1)[lo:hi].to_pylist()], pa.list_(pa.bool_())),
                    pa.array([length[lo:hi]], pa.list_(pa.int64())),
                    pa.array([pack.compress(b"".join(bodies[lo:hi]))], pa.binary())], ["block", "ids", "train", "length", "bodies"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), whole().alias("text"))
    return rows.mapInArrow(run, PACKS)


def unpacked(length: list[int], packed: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(packed) if length else b""
    ends = np.cumsum(length)
    return [data[e - n:e] for e, n in zip(ends.tolist(), length, strict=True)]


def pieces(bodies: Iterable[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, texts): for every byte, context and byte as one number, and which body it is of; PIECE bytes at a time.

    Ends stand before the first byte of a text. The oldest byte of the context is the highest one of a key.
    """
    parts: list[tuple[int, bytes]] = []
    held = 0
    for i, b in enumerate(bodies):
        b = END * depth + b
        for at in range(0, len(b) - depth, PIECE):  # a long text goes in parts that overlap by a context
            parts.append((i, b[at:at + PIECE + depth]))
            held += len(parts[-1][1])
            if held >= PIECE:
                yield _keys(parts, depth)
                parts, held = [], 0
    if parts:
        yield _keys(parts, depth)


def _keys(parts: list[tuple[int, bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
    length = np.array([len(p) for _, p in parts])
    key = np.zeros(len(data) - depth, np.uint64)
    for k in range(depth + 1):
        key <<= np.uint64(8)
        key |= data[k:len(data) - depth + k]
    real = np.ones(len(data), bool)
    starts = np.cumsum(length) - length
    for k in range(depth):
        real[starts + k] = False
    real = real[depth:]
    return key[real], np.repeat(np.array([i for i, _ in parts]), length - depth)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def counted(bodies: Iterable[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the bodies and how often each stands there."""
    keys, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for key, _ in pieces(bodies, depth):
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        keys.append(key[first])
        counts.append(np.diff(np.append(first, len(key))))
        held += len(first)
        if held > ROWS + 2 * len(keys[0]):  # what is held stays a few times the result
            one = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [one[0]], [one[1]], 0
    return summed(np.concatenate(keys), np.concatenate(counts))


def chunks(bodies: Iterable[bytes], size: int) -> Iterator[list[bytes]]:
    """The bodies in lists of about ``size`` bytes."""
    held, n = [], 0
    for b in bodies:
        held.append(b)
        n += len(b)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def counted_words(bodies: Iterable[bytes], bits: int) -> np.ndarray:
    """Rows (key, check, count) of the distinct words of the bodies, in order."""
    found = [np.zeros((0, 3), np.int64)]
    for part in chunks(bodies, PIECE):
        words = Counter(w for b in part for w in b.split())
        found.append(np.stack([*word_keys(list(words), bits), np.fromiter(words.values(), np.int64, len(words))], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
    return np.column_stack([rows[first, :2], np.add.reduceat(rows[:, 2], first) if len(rows) else np.zeros(0, np.int64)])


REQUESTS = "block long, key long, check long, n long"


def word_keys(words: Sequence[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, check) of words: a negative number from ``bits`` of one hash, and another hash that tells words with equal keys apart."""
    key = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    check = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    return (key & np.uint64((1 << bits) - 1) | np.uint64(1 << 63)).view(np.int64), check.view(np.int64)


def requests(texts: DataFrame, depth: int, bits: int) -> DataFrame:
    """What each block asks for: its distinct contexts with their byte, and its distinct words, with their counts in training texts."""
    def asked(block: int, bodies: dict[bool, list[bytes]]) -> Iterator[pa.RecordBatch]:
        keys, n = counted(bodies[True], depth)
        other, _ = counted(bodies[False], depth)
        keys, n = summed(np.concatenate([keys, other]), np.concatenate([n, np.zeros(len(other), np.int64)]))
        words, more = counted_words(bodies[True], bits), counted_words(bodies[False], bits)
        more[:, 2] = 0  # a word of both kinds asks twice
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(keys) + len(words) + len(more), block, np.int64)),
            pa.array(np.concatenate([keys.view(np.int64), words[:, 0], more[:, 0]])),
            pa.array(np.concatenate([np.zeros(len(keys), np.int64), words[:, 1], more[:, 1]])),
            pa.array(np.concatenate([n, words[:, 2], more[:, 2]]))], ["block", "key", "check", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bodies, size = None, {True: [], False: []}, 0
        for batch in batches:
            for r in batch.select(["block", "train", "length", "bodies"]).to_pylist():
                if r["block"] != block or size > BLOCK:  # a part of a block may ask by itself
                    if size:
                        yield from asked(block, bodies)
                    block, bodies, size = r["block"], {True: [], False: []}, 0
                for train, text in zip(r["train"], unpacked(r["length"], r["bodies"]), strict=True):
                    bodies[train].append(text)
                    size += len(text)
        if size:
            yield from asked(block, bodies)

    return texts.select("block", "train", "length", "bodies").mapInArrow(run, REQUESTS)


def dealt(rows: DataFrame, label: str) -> DataFrame:
    """Write a table in buckets by ``key``, so that it is shuffled once for all that is done by key."""
    spark, n = rows.sparkSession, parallelism(rows.sparkSession)
    path = session.run_dir(spark, label)
    name = "harborlight_" + path.rsplit("/", 1)[-1].replace("-", "_")
    rows.repartition(n, "key").write.format("parquet").mode("errorifexists").option("path", path).option(
        "compression", "zstd").bucketBy(n, "key").saveAsTable(name)
    return spark.table(name)


# -- the tree -------------------------------------------------------------

def _bits(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and bit: the number of its prefix (1 to 255) and the bit, as (bytes, 8)."""
    j = np.arange(8)
    byte = byte.astype(np.int64)[:, None]
    return (1 << j) | (byte >> (8 - j)), byte >> (7 - j) & 1


class Branches:
    """The tree at and below depth ``top``, for keys whose contexts share their last ``top`` bytes or do so group by group."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int, top: int):
        self.prefix, self.bit = _bits(key & np.uint64(255))
        context = key >> np.uint64(8)
        self.levels = []   # from ``depth`` up to ``top``: node keys, zeros, ones, log weight, share of the own estimate
        self.places = []   # on each level, the node of each (key, bit)
        for d in range(depth, top - 1, -1):
            ctx = (context & np.uint64((1 << 8 * d) - 1)).astype(np.int64)
            node = ((ctx << 8)[:, None] | self.prefix).ravel()
            nodes, place = np.unique(node, return_inverse=True)
            self.places.append(place.reshape(self.prefix.shape))
            each = np.repeat(n, 8).astype(float)
            ones = np.bincount(place, each * self.bit.ravel(), len(nodes))
            zeros = np.bincount(place, each, len(nodes)) - ones
            if d == depth:
                log_w, share = estimate(zeros, ones), np.ones(len(nodes))
            else:
                child, _, _, child_w, _ = self.levels[-1]
                parent = (child >> 8 & (1 << 8 * d) - 1) << 8 | child & 255
                below = np.bincount(np.searchsorted(nodes, parent), child_w, len(nodes))
                log_w, share = weighted(zeros, ones, below)
            self.levels.append((nodes, zeros, ones, log_w, share))

    def one(self) -> np.ndarray:
        """Probability that each bit is 1, from depth ``top`` on; as (keys, 8). A context without counts leaves it to the shorter one."""
        out = None
        for (_, zeros, ones, _, share), place in zip(self.levels, self.places, strict=True):
            z, o, s = zeros[place], ones[place], share[place]
            own = one_next(z, o)
            out = own if out is None else np.where(deeper, s * own + (1 - s) * out, own)
            deeper = z + o > 0
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole groups of the first column, each of ROWS rows or one group more."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS:
            table = pa.Table.from_batches(held)
            group = table.column(0).to_numpy()
            whole_to = int(np.searchsorted(group, group[-1], "left"))
            if whole_to:
                yield table.slice(0, whole_to)
                held, size = table.slice(whole_to).to_batches(), table.num_rows - whole_to
    if held:
        yield pa.Table.from_batches(held)


def _lower(keys: DataFrame, depth: int) -> DataFrame:
    """(ctx, prefix, zeros, ones, log_w): the nodes of depth TOP."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            tree = Branches(t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy(), depth, TOP)
            nodes, zeros, ones, log_w, _ = tree.levels[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes >> 8), pa.array((nodes & 255).astype(np.int32)), pa.array(zeros), pa.array(ones), pa.array(log_w)],
                ["ctx", "prefix", "zeros", "ones", "log_w"])

    return keys.repartition("ctx").sortWithinPartitions("ctx").mapInArrow(
        run, "ctx long, prefix int, zeros double, ones double, log_w double")


@F.pandas_udf(T.StructType([T.StructField("log_w", T.DoubleType()), T.StructField("share", T.DoubleType())]))
def _weigh(zeros: pd.Series, ones: pd.Series, below: pd.Series) -> pd.DataFrame:
    log_w, share = weighted(zeros.to_numpy(), ones.to_numpy(), below.to_numpy())
    return pd.DataFrame({"log_w": log_w, "share": share})


def _upper(nodes: DataFrame) -> DataFrame:
    """(ctx, prefix, a, r): what the levels above depth TOP say of a 1, and the weight that is left for the deeper ones."""
    level, above = nodes, []
    for d in range(TOP - 1, -1, -1):
        level = level.groupBy((F.col("ctx") % (1 << 8 * d)).alias("ctx"), "prefix").agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_w").alias("below"))
        level = saved(level.withColumn("w", _weigh("zeros", "ones", "below")).select(
            "ctx", "prefix", "zeros", "ones", "w.log_w", "w.share"), f"level-{d}")
        above.append(level)
    out = nodes.select("ctx", "prefix", (F.col("zeros") + F.col("ones")).alias("n"))
    for d, level in zip(range(TOP - 1, -1, -1), above, strict=True):
        named = level.select(
            F.col("ctx").alias(f"c{d}"), "prefix", (F.col("zeros") + F.col("ones")).alias(f"n{d}"),
            ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)).alias(f"p{d}"), F.col("share").alias(f"s{d}"))
        out = out.withColumn(f"c{d}", F.col("ctx") % (1 << 8 * d)).join(named, [f"c{d}", "prefix"])
    a, r = F.lit(0.0), F.lit(1.0)
    for d in range(TOP):
        deeper = F.col("n" if d == TOP - 1 else f"n{d + 1}") > 0
        seen, share, p = F.col(f"n{d}") > 0, F.col(f"s{d}"), F.col(f"p{d}")
        if d == 0:  # nothing is known of a prefix that no training text has
            p, seen = F.when(seen, p).otherwise(0.5), F.lit(True)
        a, r = (F.when(seen & deeper, a + r * share * p).when(seen, a + r * p).otherwise(a),
                F.when(seen & deeper, r * (1.0 - share)).otherwise(0.0))
    return out.select("ctx", "prefix", a.alias("a"), r.alias("r"))


def log_probabilities(keys: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, log_p): log10 of the probability of the byte in its context, for every row of keys (ctx, key, n).

    ``ctx`` are the last three bytes of the context. Keys are distinct; those with n = 0 are answered but not learned from.
    """
    upper = _upper(saved(_lower(keys, depth), "nodes"))
    rows = upper.select("ctx", F.lit(0).alias("kind"), F.col("prefix").cast("long").alias("key"), F.lit(0).cast("long").alias("n"), "a", "r").unionByName(
        keys.select("ctx", F.lit(1).alias("kind"), "key", "n", F.lit(0.0).alias("a"), F.lit(0.0).alias("r")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            ctx, kind, key, n, a, r = (t.column(k).to_numpy() for k in range(6))
            asked = kind == 1
            tree = Branches(key[asked].view(np.uint64), n[asked], depth, TOP)
            node = (ctx[~asked] << 8) | key[~asked]
            order = np.argsort(node)
            place = order[np.searchsorted(node[order], (ctx[asked] << 8)[:, None] | tree.prefix)]
            one = a[~asked][place] + r[~asked][place] * tree.one()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[asked]), pa.array(np.log10(np.where(tree.bit == 1, one, 1 - one)).sum(axis=1))], ["key", "log_p"])

    return rows.repartition("ctx").sortWithinPartitions("ctx", "kind").mapInArrow(run, "key long, log_p double")


# -- scores ---------------------------------------------------------------

RESULT = ("doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
          "n_bytes long")


def _sums(bodies: list[bytes], keys: np.ndarray, log_p: np.ndarray, depth: int) -> np.ndarray:
    """log10 of the probability of each body. Sorting the asked keys brings them into the answers' order."""
    out = np.zeros(len(bodies))
    shift = np.uint64(8 * (depth + 1))
    for key, text in pieces(bodies, depth):
        first = int(text[0])
        span = int(text[-1]) - first + 1
        if int(shift) + span.bit_length() <= 64:
            key = key << np.uint64(64 - int(shift)) | (text - first).astype(np.uint64)
            key.sort()
            text = (key & np.uint64((1 << 64 - int(shift)) - 1)).astype(np.int64)
            key >>= np.uint64(64 - int(shift))
            bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            each = np.repeat(log_p[np.searchsorted(keys, key[bounds])], np.diff(np.append(bounds, len(key))))
        else:
            text, each = text - first, log_p[np.searchsorted(keys, key)]
        out[first:first + span] += np.bincount(text, each, span)
    return out


def scored(docs: DataFrame, train: Column, depth: int = DEPTH, block: int = BLOCK, word_bits: int = 63) -> DataFrame:
    """One row per document: doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    Learns from the rows where ``train`` is true and scores all. ``score`` is log10 of the probability of the
    whole text under the tree, its end included, over ``n_bytes`` bytes. ``base_score`` is that of an
    add-one model of whole words and the end over ``n_tokens`` tokens, of which ``n_known`` stand in
    the ``train_tokens`` tokens of training; words are told apart by 127 bits of two hashes
    (``word_bits`` makes equal keys frequent in tests).

    Texts of any length are cut in overlapping parts; null counts as empty and still has its end. Without training rows every
    bit has one half. Rows given twice count twice and come twice; other columns are not read; an empty table gives no rows.
    """
    if not TOP <= depth <= DEPTH:
        raise ValueError("depth must be from 3 to 5")
    texts = saved(packs(docs, train, block), "bodies")
    asked = dealt(requests(texts, depth, word_bits), "requests")
    counts = saved(asked.groupBy("key", "check").agg(F.sum("n").alias("n")), "keys")
    ctx = F.shiftright("key", 8).bitwiseAND((1 << 8 * TOP) - 1)
    found = saved(log_probabilities(counts.filter("key >= 0").select(ctx.alias("ctx"), "key", "n"), depth), "probabilities")
    words = counts.filter("key < 0")
    # three numbers come back: words, distinct words, and training texts, each of which has one end
    held = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    ends = texts.agg(F.coalesce(F.sum(F.size(F.filter("train", lambda t: t))), F.lit(0)).alias("n")).first().n
    total, distinct = held.n + ends, held.v + (ends > 0)
    values = found.select("key", F.lit(0).cast("long").alias("right_check"), F.col("log_p").alias("value")).unionByName(
        words.select("key", F.col("check").alias("right_check"), F.col("n").cast("double").alias("value")))
    # not an equality of columns, so that the buckets by key still do for the join
    answers = asked.select("block", "key", "check").join(values, "key").filter(
        F.col("check").bitwiseXOR(F.col("right_check")) == 0).select("block", "key", "check", "value")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, check, value = (right.column(c).to_numpy() for c in ("key", "check", "value"))
        order = np.lexsort((check, key))  # parts of a block may have asked for the same
        key, check, value = key[order], check[order], value[order]
        first = int(np.searchsorted(key, 0))
        keys, at = np.unique(key[first:], return_index=True)
        rows = left.select(["ids", "train", "length", "bodies"]).to_pylist()
        bodies = [b for r in rows for b in unpacked(r["length"], r.pop("bodies"))]
        score = _sums(bodies, keys.view(np.uint64), value[first:][at], depth)
        n_tokens, n_known, base = [], [], []
        for part in chunks(bodies, PIECE):
            split = [b.split() for b in part]
            names = list({w for ws in split for w in ws})
            asked_key, asked_check = word_keys(names, word_bits)
            place = np.searchsorted(key[:first], asked_key)
            wrong = check[place] != asked_check
            while wrong.any():  # words with equal keys stand side by side
                place[wrong] += 1
                wrong = check[place] != asked_check
            n_of = dict(zip(names, value[place].astype(np.int64).tolist(), strict=True))
            for ws in split:
                c = np.array([*map(n_of.__getitem__, ws), ends], np.int64)
                n_tokens.append(len(c))
                n_known.append(int((c > 0).sum()))
                base.append(float(np.log10((c + 1) / (total + distinct + 1)).sum()))
        return pa.table({
            "doc_id": pa.array([i for r in rows for i in r["ids"]], pa.int64()),
            "train": pa.array([t for r in rows for t in r["train"]], pa.bool_()), "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([total] * len(bodies), pa.int64()),
            "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
            "n_bytes": pa.array([len(b) for b in bodies], pa.int64())})

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, RESULT)


def language_model(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Scores with ``held_out`` (crc32 of the id as text leaves ``held``) and bits_per_byte, the code length of a byte.

    Rows with a null id are scored, never learned from and not held out.
    """
    rows = scored(docs, fold(folds) != held)
    bits = -F.col("score") * F.lit(float(np.log2(10.0))) / F.col("n_bytes")
    return rows.select(
        "doc_id", F.coalesce(fold(folds) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score", bits.alias("bits_per_byte"))
