"""Near duplicates by SimHash, linked by meet-in-the-middle ball hashing.

Two fingerprints differ in at most four bits exactly if some value lies within
two bits of both. So every distinct fingerprint emits all 2081 variants within
two bits, variants are dealt out, and fingerprints that meet in a variant are
linked. Meeting in one variant bounds the distance, so a bucket is linked as a
chain of neighbours and never as all its pairs.

Variants are dealt out by a linear hash: the XOR of a fixed random code for
each bit that is set. The hash of a variant is then the hash of the fingerprint
XOR that of the flipped bits, so a mapper knows which fingerprints have a variant
for a partition without listing the variants, and sends the fingerprint, eight
bytes, once for a partition. The partition lists the variants that belong to
it, a bounded number at a time.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import parallelism, saved, whole
from harborlight.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4

PASS_VARIANTS = 1 << 22   # variants a task sorts at once
TASK_VARIANTS = 1 << 28   # variants a task goes through
TASK_PRINTS = 1 << 24     # fingerprints a task holds
WAVE_COPIES = 128         # copies of a fingerprint on the way at once
LEAST_PARTS = 64
FEW_PARTS = 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; 0 if it has no words."""
    joined = b" ".join(text.lower().split())  # on bytes: A-Z only, and ASCII white space only
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(joined)]])
    n = max(1, len(starts) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)),
        np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i:i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the SimHash as a signed long. Null texts are empty and give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class Ball:
    """The flips within ``radius`` bits and the linear hash that deals variants out."""

    def __init__(self, radius: int, part_bits: int, pass_bits: int, few: bool = False):
        self.part_bits, self.bits = part_bits, part_bits + pass_bits
        codes = np.random.default_rng(1).integers(0, 1 << 30, 64, dtype=np.int32)
        if few:  # the partition is that of as many bits of the fingerprint; other flips stay in it
            codes &= ~np.int32((1 << part_bits) - 1)
            codes[:part_bits] |= np.int32(1) << np.arange(part_bits, dtype=np.int32)
        flips = [c for r in range(radius + 1) for c in itertools.combinations(range(64), r)]
        self.masks = np.array([sum(1 << b for b in c) for c in flips], np.uint64)
        self.codes = codes & ((1 << self.bits) - 1)
        self.flip_codes = np.array([np.bitwise_xor.reduce(self.codes[list(c)]) if c else 0 for c in flips], np.int32)
        # what each byte of a fingerprint adds to its code
        byte = np.arange(256)
        self.tables = [
            np.bitwise_xor.reduce([np.where(byte >> i & 1, self.codes[8 * k + i], np.int32(0)) for i in range(8)], axis=0)
            for k in range(8)]

    def code(self, prints: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prints), np.int32)
        by_byte = prints.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            out ^= self.tables[k][by_byte[:, k]]
        return out

    def sent(self, prints: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each partition from lo to hi, the fingerprints with a variant in it."""
        parts = 1 << self.part_bits
        own = self.code(prints) & (parts - 1)
        has = np.zeros(parts, bool)
        has[self.flip_codes & (parts - 1)] = True
        for target in range(lo, hi):
            mine = prints if has.all() else prints[has[own ^ target]]
            if len(mine):
                yield target, mine

    def links(self, prints: np.ndarray, target: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """A forest over the fingerprints that meet in the variants of a partition."""
        code = self.code(prints)
        order = np.argsort(code, kind="stable")
        prints = prints[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=1 << self.bits))])
        del code, order
        label = np.arange(len(prints), dtype=np.int32)
        for high in range(1 << (self.bits - self.part_bits)):
            wanted = (target | high << self.part_bits) ^ self.flip_codes
            lo, hi = bounds[wanted], bounds[wanted + 1]
            held = np.flatnonzero(hi > lo)
            if not len(held):
                continue
            variant = np.concatenate([prints[lo[i]:hi[i]] ^ self.masks[i] for i in held])
            index = np.concatenate([np.arange(lo[i], hi[i], dtype=np.int32) for i in held])
            by = np.argsort(variant)
            variant = variant[by]
            met = np.flatnonzero(variant[1:] == variant[:-1])
            a, b = index[by[met]], index[by[met + 1]]
            near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
            label = join_labels(label, a[near], b[near])
        moved = np.flatnonzero(label != np.arange(len(label)))
        return prints[moved], prints[label[moved]]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each entry's smallest entry that it reaches by the labels so far and the edges a-b."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _bits(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1)))))


def near_links(prints: DataFrame, radius: int = RADIUS, few: bool = False, **limits: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all those within ``radius`` bits.

    Two fingerprints are connected by the edges exactly if a chain of
    fingerprints leads from one to the other with steps of at most ``radius`` bits.
    Only the number of fingerprints comes to the driver. With ``few`` a partition is that of the lowest bits, which must be
    evenly spread: a fingerprint is sent to fewer partitions, for many fingerprints and a small radius.
    """
    spark = prints.sparkSession
    n = prints.count()
    half = radius // 2 + radius % 2
    ball = sum(1 for r in range(half + 1) for _ in itertools.combinations(range(64), r))
    task, held = limits.get("task_variants", TASK_VARIANTS), limits.get("task_prints", TASK_PRINTS)
    parts = max(LEAST_PARTS if n > 10_000 else 8, n * ball / task)
    if n > held:
        parts = max(parts, n * ball / held)
    part_bits = _bits(parts)
    sent = ball
    if few:
        part_bits = _bits(max(FEW_PARTS if n > 10_000 else 8, n * ball / task))
        while n * (sent := sum(math.comb(part_bits, r) for r in range(half + 1))) > held << part_bits:
            part_bits += 1
    pass_bits = _bits(n * ball / (1 << part_bits) / limits.get("pass_variants", PASS_VARIANTS))
    parts = 1 << part_bits
    shape = Ball(half, part_bits, min(pass_bits, 12), few)
    waves = -(-min(parts, sent) // limits.get("wave_copies", WAVE_COPIES))
    found = None
    for wave in range(waves):
        lo, hi = parts * wave // waves, parts * (wave + 1) // waves

        def deal(batches: Iterator[pa.RecordBatch], lo=lo, hi=hi) -> Iterator[pa.RecordBatch]:
            def rows(held: list[np.ndarray]):
                for target, mine in shape.sent(np.concatenate(held), lo, hi):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([target], pa.int32()), pa.array([mine.tobytes()], pa.binary())], ["part", "prints"])

            kept, size = [], 0
            for batch in batches:
                kept.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                size += len(batch)
                if size >= 1 << 18:
                    yield from rows(kept)
                    kept, size = [], 0
            if size:
                yield from rows(kept)

        def meet(key: tuple, group: pa.Table) -> pa.Table:
            mine = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("prints").to_pylist()])
            a, b = shape.links(mine, key[0].as_py(), radius)
            return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

        dealt = prints.select("fp").mapInArrow(deal, "part int, prints binary")
        edges = dealt.repartition(max(hi - lo, parallelism(spark)), "part").groupBy("part").applyInArrow(
            meet, "a long, b long")
        edges = saved(edges, "near")
        found = edges if found is None else found.unionByName(edges)
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, **limits: int) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, group_size.

    Documents are linked when their fingerprints differ in ``radius`` bits or fewer;
    component_id is the smallest doc_id that a chain of links reaches, the
    document's own included. Texts without words have fingerprint zero and are
    linked like any other; null texts are empty. Null ids take part but never
    name a component unless all its ids are null. Rows given twice are two members.
    """
    prints = saved(fingerprints(docs, shingle), "fingerprints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(distinct, radius, **limits))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    groups = member.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"))
    member = member.join(groups, "root").select("fp", "component_id", "group_size")
    return prints.join(member, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")
