"""Fill-in-the-middle transformation with content-defined chunk memoization.

A rolling hash cuts the bytes of a text into chunks, so passages that texts share become the same
chunks. What a chunk adds to a text is remembered under its content: units, characters,
and whether it begins and ends inside a run of letters. A text's counts are sums over its chunks, less one
unit where a run of letters goes on over a border. The same sums say in which chunk a cut lies, and only
that chunk is looked through for it.

A unit is a run of the letters A-Z and a-z, or any other single character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import gather, whole

WINDOW = 32                  # bytes that the rolling hash sees
MEAN_BITS = 8                # a chunk has 2 ** 8 bytes on average
MOST = 4096                  # bytes of a chunk at most
ROOM = 48 << 20              # bytes of chunks that a worker remembers
STEP = 4 << 20               # bytes that are hashed at once
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_LETTER = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)
_LEADS = np.array([b & 0xC0 != 0x80 for b in range(256)])  # first bytes of characters


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes up to each byte: each one's random number, shifted once for every byte behind it."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks end: at ends of texts (all of ``bounds`` but the first), where the hash says so, and after MOST bytes."""
    found = []
    for at in range(int(bounds[0]), int(bounds[-1]), STEP):
        begin, end = max(at - WINDOW + 1, int(bounds[0])), min(at + STEP, int(bounds[-1]))
        h = rolling(data[begin:end])[at - begin:]
        found.append(np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + at + 1)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    ends = ends[ends < bounds[-1]]
    ends = ends[_LEADS[data[ends]]]
    # the window must lie in the text
    ends = ends[ends - bounds[np.searchsorted(bounds, ends, "right") - 1] >= WINDOW]
    ends = np.unique(np.concatenate([ends, bounds[1:][bounds[1:] > bounds[0]]]))
    starts = np.concatenate([bounds[:1], ends[:-1]])
    far = np.flatnonzero(ends - starts > MOST)
    if len(far):
        extra = np.concatenate([np.arange(starts[i] + MOST, ends[i], MOST) for i in far])
        for _ in range(3):
            extra = np.where(_LEADS[data[extra]], extra, extra - 1)
        ends = np.unique(np.concatenate([ends, extra]))
    return ends


def unit_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Bytes at which a unit starts; each of ``firsts`` begins a chunk that is read by itself."""
    letter = _LETTER[data]
    before = np.concatenate([[False], letter[:-1]])
    before[firsts] = False
    return np.where(letter, ~before, _LEADS[data])


class Memory:
    """What is known of chunks: units, characters, and letters at the front and at the end."""

    def __init__(self, room: int = ROOM):
        self.room, self.held = room, 0
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, 4), np.int64)

    def summaries(self, chunks: list[bytes]) -> np.ndarray:
        """A row for each chunk. Chunks are found by hash and compared by content; new ones are counted once."""
        if self.held > self.room:
            self.known, self.table, self.held = {}, self.table[:0], 0
        known, fresh = self.known, []
        for c in chunks:
            if c not in known:
                known[c] = len(known)
                fresh.append(c)
        if fresh:
            self.held += sum(map(len, fresh))
            self.table = np.concatenate([self.table, self._counted(fresh)])
        return self.table[np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))]

    @staticmethod
    def _counted(chunks: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(chunks), np.uint8)
        length = np.array([len(c) for c in chunks])
        firsts = np.cumsum(length) - length
        return np.stack([
            np.add.reduceat(unit_starts(data, firsts), firsts, dtype=np.int64),
            np.add.reduceat(_LEADS[data], firsts, dtype=np.int64),
            _LETTER[data[firsts]], _LETTER[data[firsts + length - 1]]], axis=1)


def located(memory: Memory, data: bytes, bounds: np.ndarray, choose) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and the characters before the cuts.

    ``bounds`` are the texts' borders in ``data``. ``choose`` maps the texts' numbers of units to
    the wanted cuts, an array (texts, cuts) of units before each; the second result has its shape.
    """
    raw = np.frombuffer(data, np.uint8)
    ends = cuts(raw, bounds)
    starts = np.concatenate([bounds[:1], ends[:-1]])[:len(ends)]
    found = memory.summaries([data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    lo, hi = np.searchsorted(ends, bounds[:-1], "right"), np.searchsorted(ends, bounds[1:], "right")
    goes_on = np.zeros(len(ends), np.int64)
    goes_on[1:] = found[1:, 2] & found[:-1, 3]
    goes_on[lo[lo < hi]] = 0
    units = np.concatenate([[0], np.cumsum(found[:, 0] - goes_on)])
    chars = np.concatenate([[0], np.cumsum(found[:, 1])])
    n, size = units[hi] - units[lo], chars[hi] - chars[lo]
    wanted = choose(n)
    out = np.broadcast_to(size[:, None], wanted.shape).copy()
    text, which = np.nonzero(wanted < n[:, None])
    if len(text):
        target = units[lo[text]] + wanted[text, which]
        chunk = np.searchsorted(units, target, "right") - 1
        local = target - units[chunk] + goes_on[chunk]
        part, part_ends = gather(starts, ends - starts, raw, chunk)
        firsts = part_ends - (ends - starts)[chunk]
        places = np.flatnonzero(unit_starts(part, firsts))
        place = places[np.searchsorted(places, firsts) + local]
        leads = np.concatenate([[0], np.cumsum(_LEADS[part])])
        out[text, which] = chars[chunk] - chars[lo[text]] + leads[place] - leads[firsts]
    return n, out


def _borders(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """A string column's bytes and the borders of its rows."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = bytes(memoryview(held)[bounds[0]:bounds[-1]]) if held is not None and len(column) else b""
    return data, bounds - bounds[0]


def _draw(group: int) -> Column:
    """One of the eight-digit groups of the hash of seed and id, as an integer."""
    return F.conv(F.substring("seeded", 8 * group + 1, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, plain: int = 10, suffix_first: int = 20, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, text, n, form, prefix_chars, middle_chars, output.

    ``n`` is the number of units. Two draws from the hash of seed and id choose the ends of prefix and middle
    among the n + 1 places. ``plain`` percent of the texts stay as they are, so do empty ones and those that
    hold a marker; of the others ``suffix_first`` percent begin with the suffix (spm), the rest with the prefix (psm).

    Whole texts of any length; null counts as empty, a null id as no digits. Rows given twice come twice; other
    columns are not read; an empty table gives no rows.
    """
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), seeded.alias("seeded")).select(
        "doc_id", "text", *(_draw(k).alias(f"h{k + 1}") for k in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            draws = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)], axis=1)
            n, chars = located(memory, *_borders(batch.column(1)), lambda n, d=draws: np.sort(d % (n[:, None] + 1), axis=1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in (0, 1, 4, 5)), pa.array(n), pa.array(chars[:, 0]), pa.array(chars[:, 1])],
                ["doc_id", "text", "h3", "h4", "n", "a", "b"])

    rows = rows.mapInArrow(run, "doc_id long, text string, h3 long, h4 long, n long, a long, b long")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain), "plain").when(
        F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    prefix = F.substr("text", F.lit(1), F.col("a").cast("int"))
    middle = F.substr("text", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    suffix = F.substr("text", (F.col("b") + 1).cast("int"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(
        F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(
        F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        "doc_id", "text", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"),
        F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again, from output and form alone. No marker can arise across a border, as none begins as another ends."""
    whole_out, kind = F.col(output), F.col(form)
    head = F.substring_index(whole_out, MIDDLE, 1)
    middle = F.substr(whole_out, F.char_length(head) + len(MIDDLE) + 1)
    second = F.when(kind == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    first = F.when(kind == "psm", F.substring_index(head, SUFFIX, 1)).otherwise(F.substring_index(head, PREFIX, 1))
    rest = F.substr(head, F.char_length(first) + F.char_length(second) + 1)
    first = F.substr(first, F.lit(len(PREFIX) + 1))
    return F.when(kind == "plain", whole_out).when(kind == "psm", F.concat(first, middle, rest)).otherwise(
        F.concat(rest, middle, first))
