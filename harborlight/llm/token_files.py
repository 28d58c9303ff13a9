"""Token ids in seekable binary files.

A file holds independent zstandard frames and, behind them, a seek table:

    frame 0 .. frame n-1       each a run of whole documents: their ids as little-endian uint32
    seek table                 zstandard frame of two arrays of records (FRAME, then DOC)
    footer                     FOOTER: places and sizes of the seek table, counts, its checksum, magic

A frame record has the frame's offset, packed and unpacked size, and the CRC32 of
the unpacked bytes. A document record has its id, frame, first token in the
frame and number of tokens. A reader fetches the footer, the seek table and the
frames it needs, and nothing else.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborlight import session
from harborlight.llm.common import gather, parallelism, saved, whole

MAGIC = b"HLTOKEN1"
FRAME = np.dtype([("offset", "<u8"), ("packed", "<u8"), ("size", "<u8"), ("crc", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("frame", "<u4"), ("first", "<u8"), ("n", "<u8")])
FOOTER = np.dtype([("offset", "<u8"), ("packed", "<u8"), ("frames", "<u8"), ("docs", "<u8"), ("tokens", "<u8"),
                   ("crc", "<u4"), ("magic", "S8")])

FRAME_TOKENS = 1 << 16  # a frame ends with the document that reaches so many


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a plain path or of a URI that pyarrow knows."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_file(uri: str, docs: Iterable[tuple[int | None, np.ndarray]], frame_tokens: int = FRAME_TOKENS) -> dict:
    """Write documents in the given order; what the file holds. A half-written file never gets the name."""
    fs, path = open_fs(uri)
    draft = f"{path}.{uuid.uuid4().hex[:8]}.draft"
    packer = zstandard.ZstdCompressor(level=1)
    frames, table, held, offset, tokens, in_frame = [], [], [], 0, 0, 0
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(draft) as out:

        def flush():
            nonlocal offset, held, in_frame
            raw = b"".join(held)
            packed = packer.compress(raw)
            out.write(packed)
            frames.append((offset, len(packed), len(raw), zlib.crc32(raw)))
            offset, held, in_frame = offset + len(packed), [], 0

        for doc_id, ids in docs:
            table.append((doc_id or 0, doc_id is None, len(frames), in_frame, len(ids)))
            held.append(np.asarray(ids, "<u4").tobytes())
            in_frame, tokens = in_frame + len(ids), tokens + len(ids)
            if in_frame >= frame_tokens:
                flush()
        if held:
            flush()
        raw = np.array(frames, FRAME).tobytes() + np.array(table, DOC).tobytes()
        packed = packer.compress(raw)
        out.write(packed)
        out.write(np.array([(offset, len(packed), len(frames), len(table), tokens, zlib.crc32(raw), MAGIC)],
                           FOOTER).tobytes())
    fs.move(draft, path)
    return {"docs": len(table), "tokens": tokens}


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self._file = fs.open_input_file(path)
        size = self._file.size()
        if size < FOOTER.itemsize:
            raise ValueError(f"{uri} is no token file")
        foot = np.frombuffer(self._file.read_at(FOOTER.itemsize, size - FOOTER.itemsize), FOOTER)[0]
        if foot["magic"] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        raw = zstandard.ZstdDecompressor().decompress(
            self._file.read_at(int(foot["packed"]), int(foot["offset"])),
            max_output_size=int(foot["frames"]) * FRAME.itemsize + int(foot["docs"]) * DOC.itemsize)
        if zlib.crc32(raw) != foot["crc"]:
            raise ValueError(f"{uri}: the seek table is damaged")
        split = int(foot["frames"]) * FRAME.itemsize
        self.frames, self.docs = np.frombuffer(raw[:split], FRAME), np.frombuffer(raw[split:], DOC)
        self.tokens, self._uri, self._at, self._ids = int(foot["tokens"]), uri, -1, np.zeros(0, "<u4")

    def frame(self, k: int) -> np.ndarray:
        """All ids of a frame; the last one read is kept."""
        if k != self._at:
            f = self.frames[k]
            raw = zstandard.ZstdDecompressor().decompress(
                self._file.read_at(int(f["packed"]), int(f["offset"])), max_output_size=int(f["size"]))
            if zlib.crc32(raw) != f["crc"]:
                raise ValueError(f"{self._uri}: frame {k} is damaged")
            self._at, self._ids = k, np.frombuffer(raw, "<u4")
        return self._ids

    def ids(self, place: int) -> np.ndarray:
        """Ids of the document at a place in the file."""
        d = self.docs[place]
        if d["n"] == 0:
            return np.zeros(0, "<u4")
        return self.frame(int(d["frame"]))[int(d["first"]):int(d["first"]) + int(d["n"])]

    def find(self, doc_id: int) -> list[int]:
        """Places of a document id."""
        return np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["no_id"] == 0)).tolist()

    def close(self) -> None:
        self._file.close()


_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# letters that are composed already and go to lower case one by one, and punctuation behind them
_LETTERS = re.compile(rf"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([{re.escape(_PUNCTUATION)}]*)")
_LOWER = re.compile("[a-zß-öø-ÿ]+")


class WordEncoder:
    """Whole texts to ids with a tokenizer file whose tokens never cross white space.

    A text's ids are those of its words in order, so each distinct word is
    encoded once per worker. ``room`` words are remembered at most. Punctuation behind a
    letter or digit is a token group of its own and is looked up by itself.
    """

    MARK = "\x01"  # a group and a token of its own; parts the units of one library call
    BLOCK = 200

    def __init__(self, path: str, room: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        # for lower-case words of plain letters the same model without the steps that leave them as they are
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix)
                              for i in range(self.tokenizer.get_vocab_size())])
        trial = ["a", "the", "straße", "ñandú", "internationalisation", "qqqq"]
        self.has_plain = self.ends.any() and all(
            self.tokenizer.encode(w, add_special_tokens=False).ids == self.plain.encode(w, add_special_tokens=False).ids
            for w in [*trial, " ".join(trial)])
        self._forget()

    def _forget(self) -> None:
        self._forget_words()
        self.units: dict[str, int] = {}
        self.first, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a unit: where its ids are
        self.ids = np.zeros(0, np.uint32)

    def _forget_words(self) -> None:
        self.words: dict[bytes, int] = {}
        self.pairs = np.zeros((0, 2), np.int64)  # of a word: its units, -1 for none

    @staticmethod
    def split(raw: bytes) -> tuple[str, str]:
        """A word and the punctuation behind it, if that is a group of its own."""
        if raw.isalpha():  # ASCII letters only
            return raw.lower().decode(), ""
        word = raw.decode("utf-8", "replace")
        if m := _LETTERS.fullmatch(word):
            return m[1].lower(), m[2]
        if "<|" in word:  # may hold a special token, which stands as it is
            return word, ""
        if word.isascii():
            word = word.lower()
        stem = word.rstrip(_PUNCTUATION)
        if len(stem) < len(word) and stem:
            # the tokenizer composes and lower-cases first, which may leave a mark behind the letter
            if unicodedata.normalize("NFC", stem[-1]).lower()[-1].isalnum():
                return stem, word[len(stem):]
        return word, ""

    def _joined(self, tokenizer, blocks: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(blocks, add_special_tokens=False)]

    def _encode_plain(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of lower-case words of plain letters, and how many each one has: a word is one group."""
        if not new:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.concatenate(self._joined(
            self.plain, [" ".join(new[i:i + self.BLOCK]) for i in range(0, len(new), self.BLOCK)]))
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _encode_units(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, and how many each one has."""
        if not new:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.mark) != 1 or any(self.MARK in u for u in new):
            lists = self._joined(self.tokenizer, new)
            return np.concatenate(lists), np.array([len(x) for x in lists])
        blocks = [new[i:i + self.BLOCK] for i in range(0, len(new), self.BLOCK)]
        parts, counts = [], []
        for block, ids in zip(blocks, self._joined(self.tokenizer, [f" {self.MARK} ".join(b) for b in blocks]), strict=True):
            cut = ids == self.mark[0]
            parts.append(ids[~cut])
            counts.append(np.bincount(np.cumsum(cut)[~cut], minlength=len(block)))
        return np.concatenate(parts), np.concatenate(counts)

    def _learn(self, fresh: list[bytes]) -> None:
        split = list(map(self.split, fresh))
        new = list({u for pair in split for u in pair}.difference(self.units, ("",)))
        if new:
            plain = [u for u in new if _LOWER.fullmatch(u)] if self.has_plain else []
            new = plain + list(set(new).difference(plain))
            (ids, length), (more, longer) = self._encode_plain(plain), self._encode_units(new[len(plain):])
            ids, length = np.concatenate([ids, more]), np.concatenate([length, longer])
            self.units.update(zip(new, range(len(self.units), len(self.units) + len(new)), strict=True))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, ids])
        if fresh:
            find, n = self.units.get, len(fresh)
            pairs = np.stack([np.fromiter((find(x[k], -1) for x in split), np.int64, n) for k in (0, 1)], axis=1)
            self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh)), strict=True))
            self.pairs = np.concatenate([self.pairs, pairs])

    def encode(self, texts: list[bytes], end: int | None = None) -> list[np.ndarray]:
        """Ids of each text, given in UTF-8; ``end`` is put behind every text."""
        split = [t.split() for t in texts]  # on bytes: ASCII white space only
        if len(self.units) > self.room:
            self._forget()
        if len(self.words) > self.room:
            self._forget_words()
        self._learn(list(set(chain.from_iterable(split)).difference(self.words)))
        sizes = np.cumsum([0, *map(len, split)])
        words = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, sizes[-1])
        units = self.pairs[words].ravel()
        held = units >= 0
        ids, at = gather(self.first, self.length, self.ids, units[held])
        ends = np.concatenate([[0], at])[np.concatenate([[0], np.cumsum(held)])[2 * sizes]]
        tail = [] if end is None else [np.array([end], np.uint32)]
        return [np.concatenate([ids[a:b], *tail]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


MANIFEST = "part int, file string, docs long, tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order, one file per range of ids.

    Returns the manifest (part, file, docs, tokens); files that a lost task
    left behind are not in it. Null ids come first; rows with one id are ordered by
    a hash of their text. Null texts are empty. No documents give no files.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), encoder(tokenizer)

        def rows():
            for batch in batches:
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                yield from zip(batch.column(0).to_pylist(), made.encode(texts, end), strict=True)

        stream = rows()
        first = next(stream, None)
        if first is None:
            return

        def again():
            yield first
            yield from stream

        file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.tok"
        done = write_file(file, again())
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "file": [file], "docs": [done["docs"]], "tokens": [done["tokens"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    ordered = rows.repartitionByRange(parallelism(spark), F.asc_nulls_first("doc_id")).sortWithinPartitions(
        F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    return saved(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Every frame is read and checked."""
    # one row per file, not per document
    before = F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                f = TokenFile(file)
                for lo in range(0, len(f.docs), 4096):
                    some = f.docs[lo:lo + 4096]
                    n = some["n"].astype(np.int64)
                    crc = [zlib.crc32(f.ids(k).tobytes()) for k in range(lo, lo + len(some))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(some["doc_id"].astype(np.int64), mask=some["no_id"] == 1),
                        pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(n.sum())
                f.close()

    return files.repartition(parallelism(manifest.sparkSession)).mapInArrow(read, DOCS)


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files below the shared one."""
    return session.run_dir(spark, "tokens")
