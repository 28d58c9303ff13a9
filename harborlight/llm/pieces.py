"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The best segmentation has the largest sum of piece scores. A character without a
piece is spelled in byte pieces, at a score below every piece. Spaces become
the marker U+2581 and one stands in front of a text; decoding turns markers
into spaces again and drops the first.

No piece of a usual model goes over the start of a marker run or over a line
feed, so a text falls into units that are segmented by themselves, each
distinct one once per batch and all of them in step, position by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import gather, whole

MARKER = "▁"
UNK_PENALTY = 10.0  # below the lowest score of a piece


class DoubleArray:
    """A trie over bytes: the child of node s for byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for value, key in enumerate(keys):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            if node:
                ends[node] = value
        size = 2 * len(children) + 600
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.value = np.full(size, -1, np.int64)
        used = np.zeros(size, bool)
        used[0] = True
        # single children fill the gaps from the front; families try a few places, then go behind all others
        slots, free, room, top = [0] * len(children), 1, 1, 1
        queue = [0]
        for node in queue:  # grows as it goes: breadth first
            here = slots[node]
            self.value[here] = ends[node]
            codes = [c + 1 for c in sorted(children[node])]
            if not codes:
                continue
            while free < top and used[free]:
                free += 1
            at = max(free if len(codes) == 1 else room, codes[0])
            tries = 0
            while True:
                base = at - codes[0]
                if base + 300 >= len(used):
                    used, self.base, self.check, self.value = self._grown(used)
                if not any(used[base + c] for c in codes):
                    break
                at, tries = at + 1 if tries < 8 else max(at + 1, top), tries + 1
            if tries > 8:
                room = at
            top = max(top, base + codes[-1] + 1)
            self.base[here] = base
            for c in codes:
                self.check[base + c] = here
                used[base + c] = True
                child = children[node][c - 1]
                slots[child] = base + c
                queue.append(child)
        used, self.base, self.check, self.value = self._grown(used)
        last = int(self.base.max()) + 300  # any byte can be looked up from any node
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]

    def _grown(self, used: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(used)
        return (np.concatenate([used, np.zeros(n, bool)]), np.concatenate([self.base, np.zeros(n, np.int64)]),
                np.concatenate([self.check, np.full(n, -1, np.int64)]),
                np.concatenate([self.value, np.full(n, -1, np.int64)]))

    def find(self, key: bytes) -> int:
        node = 0
        for c in key:
            step = self.base[node] + c + 1
            if self.check[step] != node:
                return -1
            node = step
        return int(self.value[node])


class PieceModel:
    """Pieces, scores and special ids, as (text, score, kind) with kind normal, byte or other."""

    CHAR = np.array([1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)])
    CELLS = 1 << 20  # bytes of words in step at once

    def __init__(self, pieces: list[tuple[str, float, str]], prefix: bool = True):
        self.prefix = prefix
        normal = [i for i, (_, _, kind) in enumerate(pieces) if kind == "normal"]
        keys = [pieces[i][0].replace(MARKER, " ").encode() for i in normal]
        self.trie = DoubleArray(keys)
        self.ids = np.array(normal, np.int64)
        self.scores = np.array([pieces[i][1] for i in normal])
        self.unk_score = self.scores.min(initial=0.0) - UNK_PENALTY
        self.unk = next((i for i, (text, _, _) in enumerate(pieces) if text == "<unk>"), 0)
        self.bytes = np.full(256, self.unk, np.int64)
        spelled = []
        for i, (text, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.bytes[int(text[3:5], 16)] = i
                spelled.append(bytes([int(text[3:5], 16)]))
            else:
                spelled.append(text.replace(MARKER, " ").encode() if kind == "normal" else
                               " ⁇ ".encode() if text == "<unk>" else b"")
        self.length = np.array([len(x) for x in spelled])
        self.first = np.cumsum(self.length) - self.length
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        apart = all(b"\n" not in k and b" " not in k.lstrip(b" ") for k in keys)
        self.units = re.compile(rb"\n| +[^ \n]*|[^ \n]+" if apart else rb"(?s).+")

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) \
            else "normal"
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.vocab_size())])

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of each word (spaces for markers): all ids, and how many each word has."""
        lens = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lens, kind="stable")
        found, counts = [], np.zeros(len(words), np.int64)
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * lens[order[to]] <= self.CELLS:
                to = min(len(order), to + max(1, (to - at) // 4))
                if (to - at) * lens[order[to - 1]] > self.CELLS:
                    to = at + max(1, self.CELLS // max(1, int(lens[order[to - 1]])))
                    break
            block = order[at:to]
            tokens = self._viterbi([words[i] for i in block], lens[block])
            has = tokens >= 0
            counts[block] = has.sum(1)
            found.append(tokens[has])
            at = to
        ids = np.concatenate(found) if found else np.zeros(0, np.int64)
        sorted_counts = counts[order]
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(sorted_counts) - sorted_counts
        return gather(first, counts, ids, np.arange(len(words)))[0], counts

    def _viterbi(self, words: list[bytes], lens: np.ndarray) -> np.ndarray:
        """Ids of each word at the byte where the piece starts, -1 elsewhere."""
        n, width = len(words), int(lens.max(initial=0))
        if width == 0:
            return np.zeros((n, 0), np.int64)
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        score = np.full((n, width + 1), -np.inf)
        score[:, 0] = 0.0
        start = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        for s in range(width):
            rows = np.flatnonzero((lens > s) & (score[:, s] > -np.inf))
            if not len(rows):
                continue
            char = self.CHAR[text[rows, s]]
            single = np.zeros(n, bool)
            r, before, ends, node = rows, score[rows, s], s + char, np.zeros(len(rows), np.int64)
            for j in range(s, width):
                step = base[node] + text[r, j] + 1
                ok = (check[step] == node) & (lens[r] > j)
                r, before, ends, node = r[ok], before[ok], ends[ok], step[ok]
                if not len(r):
                    break
                v = value[node]
                hit = v >= 0
                rr, v = r[hit], v[hit]
                sums = before[hit] + self.scores[v]
                single[rr[ends[hit] == j + 1]] = True
                better = sums > score[rr, j + 1]
                rr = rr[better]
                score[rr, j + 1], start[rr, j + 1], piece[rr, j + 1] = sums[better], s, v[better]
            lost = ~single[rows]
            if lost.any():
                rr = rows[lost]
                end = np.minimum(s + char[lost], lens[rr])
                sums = score[rr, s] + self.unk_score
                better = sums > score[rr, end]
                rr, end = rr[better], end[better]
                score[rr, end], start[rr, end], piece[rr, end] = sums[better], s, -1
        tokens = np.full((n, width), -1, np.int64)
        rows, pos = np.arange(n)[lens > 0], lens[lens > 0]
        while len(rows):
            s, p = start[rows, pos].astype(np.int64), piece[rows, pos]
            known = p >= 0
            tokens[rows[known], s[known]] = self.ids[p[known]]
            for k in range(4):
                spell = ~known & (s + k < pos)
                if not spell.any():
                    break
                tokens[rows[spell], s[spell] + k] = self.bytes[text[rows[spell], s[spell] + k]]
            more = s > 0
            rows, pos = rows[more], s[more]
        return tokens

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, given in UTF-8."""
        front = b" " if self.prefix else b""
        marked = [front + t.replace(MARKER.encode(), b" ") if t else b"" for t in texts]
        split = [self.units.findall(t) for t in marked]
        words = list({w for ws in split for w in ws})
        ids, counts = self.segment(words)
        find = dict(zip(words, range(len(words)), strict=True)).__getitem__
        sizes = list(map(len, split))
        index = np.fromiter((i for ws in split for i in map(find, ws)), np.int64, sum(sizes))
        flat, ends = gather(np.cumsum(counts) - counts, counts, ids, index)
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *sizes])]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """The text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for ids in lists:
            data = gather(self.first, self.length, self.spelled, np.asarray(ids, np.int64))[0].tobytes()
            out.append((data[1:] if self.prefix and data[:1] == b" " else data).decode("utf-8", "replace"))
        return out


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The worker's model for a file; built once per worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel.load(path)
    return _MODELS[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, ids, n_tokens, n_bytes (ids that spell a byte), round_trip.

    ``round_trip`` says that decoding the ids gives the text again; U+2581 in a text
    decodes to a space, as for any SentencePiece model, and makes it false. Whole
    texts; a null or empty text has no ids. Rows given twice come twice; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        spell = np.zeros(len(m.length), bool)
        spell[m.bytes] = True
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            lists = m.encode(texts)
            back = m.decode(lists)
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), ids, pa.array(sizes),
                pa.array(np.array([int(spell[x].sum()) for x in lists], np.int64)),
                pa.array([b.encode() == t for b, t in zip(back, texts, strict=True)]),
            ], ["doc_id", "ids", "n_tokens", "n_bytes", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, text. Null ids are an empty list; ids outside the model raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = model(path).decode([x or [] for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
