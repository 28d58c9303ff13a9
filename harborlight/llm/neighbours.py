"""Approximate nearest neighbours by a hierarchical k-means tree.

Nearness is the inner product. Vectors get one more component that gives all of
them the same length, which turns the largest inner product into the smallest
distance; the tree is built over those. It is fitted on a bounded sample, and every vector goes to a
leaf. A query walks the tree best bin first: a priority queue holds the nodes
next to the path taken, nearest centre first. How many leaves it opens is
calibrated: exact answers for a sample of queries, over all vectors, say how far the
visits must widen until the wanted recall is reached.

Leaves are packed into parts of bounded size, neighbouring leaves together; a leaf that
is larger is dealt to several parts. A query goes once to each part that holds a leaf it
opens, and a part reads its vectors first and then its queries as a stream.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from harborlight.llm.common import parallelism, saved

SAMPLE = 20_000      # vectors that the tree is fitted on
BRANCHES = 8
LEAF = 128           # vectors that a leaf is meant to hold
LEAVES = 4096        # leaves at most; with more vectors each holds more
CALIBRATION = 100    # queries with exact answers
RECALL = 0.95        # wanted mean recall of these
PART = 8192          # vectors of a part
PARTS = 8            # parts at least


class Tree:
    """Centres of a k-means tree; node 0 is the root, ``leaf`` numbers the leaves in tree order."""

    def __init__(self, points: np.ndarray, leaves: int, seed: int = 5):
        self.centres, self.children, self.leaf, self.leaves = [points.mean(0)], [[]], [-1], 0
        rng = np.random.default_rng(seed)
        self._split(0, points, leaves, rng)
        self.centres = np.array(self.centres)

    def _split(self, node: int, points: np.ndarray, leaves: int, rng: np.random.Generator) -> None:
        k = min(BRANCHES, leaves, len(points))
        groups = self._means(points, k, rng) if k > 1 else []
        if len(groups) < 2:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
            return
        for centre, own in groups:
            child = len(self.centres)
            self.centres.append(centre)
            self.children.append([])
            self.leaf.append(-1)
            self.children[node].append(child)
            self._split(child, own, max(1, round(leaves * len(own) / len(points))), rng)

    @staticmethod
    def _means(points: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        distinct = np.unique(points, axis=0)
        centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(8):
            near = np.argmax(points @ centres.T - (centres * centres).sum(1) / 2, axis=1)
            centres = np.array([points[near == i].mean(0) for i in range(len(centres)) if (near == i).any()])
        near = np.argmax(points @ centres.T - (centres * centres).sum(1) / 2, axis=1)
        return [(centres[i], points[near == i]) for i in range(len(centres)) if (near == i).any()]

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: down the tree to the nearest child."""
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = np.argmax(points[rows] @ c.T - (c * c).sum(1) / 2, axis=1)
            stack += [(kid, rows[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> np.ndarray:
        """The first leaves in best-bin-first order."""
        gap = ((self.centres - query) ** 2).sum(1).tolist()
        queue, found = [(0.0, 0)], []
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            while self.children[node]:  # down the nearest branch, the others wait
                kids = sorted((gap[k], k) for k in self.children[node])
                for other in kids[1:]:
                    heapq.heappush(queue, other)
                node = kids[0][1]
            found.append(self.leaf[node])
        return np.array(found, np.int64)


def usable(column: str) -> Column:
    """Not null, not empty, every component present and finite, and not all of them zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _raised(points: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate(
        [points, np.sqrt(np.maximum(norm * norm - (points * points).sum(1), 0.0))[:, None]], axis=1)


def _best(queries: np.ndarray, own: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int,
          allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each query's k best points, ties to smaller ids.

    Products of one pair are summed in one order wherever it stands, so that
    equal vectors get equal scores.
    """
    s = queries @ points.T
    if allowed is not None:
        s[~allowed] = -np.inf
    s[own[:, None] == ids[None, :]] = -np.inf
    if s.shape[1] > k:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        keep = (s >= (least - slack)[:, None]) & (s > -np.inf)
    else:
        keep = s > -np.inf
    rows, cols = np.nonzero(keep)
    score = np.empty(len(rows))
    for at in range(0, len(rows), 1 << 16):
        part = slice(at, at + (1 << 16))
        score[part] = (queries[rows[part]] * points[cols[part]]).sum(1)
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    starts = np.searchsorted(rows, np.arange(len(queries)))
    first = np.arange(len(rows)) - starts[rows] < k
    return rows[first], cols[first], score[first]


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: Column, k: int, recall: float = RECALL, limits: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, leaves_opened) of the k largest inner products found for each query.

    ``vectors`` has vec_id and embedding; ``queries`` says which rows are queries. All rows are candidates but
    the query's own id. Unusable vectors, those of another length than most, and null ids take no part. Fewer candidates
    than k give fewer rows; an empty table gives none. Scores are double-precision inner products of the vectors as given.
    Rows with one id count as one vector each. Other columns are not read.
    """
    limits = limits or {}
    spark = vectors.sparkSession
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(queries, F.lit(False)).alias("asks"))
    result = "query_id long, rank int, vec_id long, score double, leaves_opened int"
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("m")
    ).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    width, n, norm = sizes.d, sizes.n, float(np.sqrt(sizes.m)) * (1 + 1e-12)
    rows = rows.filter(F.size("embedding") == width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(limits.get("sample", SAMPLE)).select("embedding").collect()
    points = _raised(np.array([r.embedding for r in sample]), norm)
    tree = Tree(points, max(1, min(limits.get("leaves", LEAVES), n // limits.get("leaf", LEAF))))
    asked = rows.filter("asks").orderBy(F.xxhash64("vec_id", F.lit("calibration")), "vec_id").limit(
        limits.get("calibration", CALIBRATION)).select("vec_id", "embedding").collect()
    if not asked:
        return spark.createDataFrame([], result)
    known = spark.sparkContext.broadcast(
        (tree, np.array([r.vec_id for r in asked]), np.array([r.embedding for r in asked])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector with its leaf."""
        t = known.value[0]
        for batch in batches:
            x = _matrix(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(t.assign(_raised(x, norm)).astype(np.int32)), batch.column(1),
                 batch.column(2)], ["vec_id", "leaf", "embedding", "asks"])

    placed = saved(rows.mapInArrow(place, "vec_id long, leaf int, embedding array<double>, asks boolean"), "leaves")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of a task's vectors for the calibration queries."""
        _, ids, q = known.value
        for batch in batches:
            x, own = _matrix(batch.column(2)), batch.column(0).to_numpy()
            r, c, s = _best(q, ids, x, own, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[r]), pa.array(own[c]), pa.array(s), batch.column(1).take(pa.array(c))],
                ["query_id", "vec_id", "score", "leaf"])

    truth = _top(placed.mapInArrow(exact, "query_id long, vec_id long, score double, leaf int"), k).select(
        "query_id", "leaf").collect()  # calibration queries times k
    opened = _calibrated(tree, known.value[1], known.value[2], truth, recall)
    counts = dict(placed.groupBy("leaf").count().collect())  # one row per leaf of the tree
    parts = max(limits.get("parts", PARTS), -(-n // limits.get("part", PART)))
    first, last = _packed([counts.get(i, 0) for i in range(tree.leaves)], parts)
    plan = spark.sparkContext.broadcast((first, last))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors to their part (kind 0); queries to every part with a leaf they open (kind 1)."""
        t, (lo, hi) = known.value[0], plan.value
        for batch in batches:
            ids, leaf, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            asks = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = lo[leaf] + (mix % (hi[leaf] - lo[leaf] + 1).astype(np.uint64)).astype(np.int64)
            out = [(part.tolist(), [0] * len(ids), ids.tolist(), [v.tobytes() for v in x], [int(v) for v in leaf], [b""] * len(ids))]
            for i in np.flatnonzero(asks):
                seen = t.visits(np.append(x[i], 0.0), opened)
                wanted: dict[int, list[int]] = {}
                for v in seen.tolist():
                    for p in range(lo[v], hi[v] + 1):
                        wanted.setdefault(p, []).append(v)
                data, m = x[i].tobytes(), len(wanted)
                out.append((list(wanted), [1] * m, [int(ids[i])] * m, [data] * m, [-1] * m,
                            [np.array(v, np.int32).tobytes() for v in wanted.values()]))
            columns = [[v for o in out for v in o[j]] for j in range(6)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t_) for c, t_ in zip(columns, (
                    pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)],
                ["part", "kind", "id", "vector", "leaf", "opens"])

    dealt = placed.mapInArrow(deal, "part int, kind int, id long, vector binary, leaf int, opens binary").repartition(
        max(parts, parallelism(spark)), "part").sortWithinPartitions("part", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's vectors are kept, its queries pass by."""
        now, held, ready = None, [], None
        for batch in batches:
            part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(part * 2 + kind)) + 1
            for a, b in zip([0, *edges], [*edges, len(part)], strict=True):
                ids = batch.column(2).to_numpy()[a:b]
                x = np.frombuffer(b"".join(batch.column(3)[a:b].to_pylist()), np.float64).reshape(b - a, -1)
                if part[a] != now:
                    now, held, ready = part[a], [], None
                if kind[a] == 0:
                    held.append((x, ids, batch.column(4).to_numpy()[a:b]))
                    continue
                if not held:
                    continue
                if ready is None:
                    ready = [np.concatenate(v) for v in zip(*held, strict=True)]
                points, names, leaf = ready
                opens = [np.frombuffer(v, np.int32) for v in batch.column(5)[a:b].to_pylist()]
                for at in range(0, b - a, 256):
                    q, own = x[at:at + 256], ids[at:at + 256]
                    may = np.zeros((len(q), known.value[0].leaves), bool)
                    for i, v in enumerate(opens[at:at + 256]):
                        may[i, v] = True
                    r, c, s = _best(q, own, points, names, k, may[:, leaf])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[r]), pa.array(names[c]), pa.array(s)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(answer, "query_id long, vec_id long, score double")
    return _top(found, k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(opened).alias("leaves_opened"))


def _calibrated(tree: Tree, ids: np.ndarray, queries: np.ndarray, truth: list, recall: float) -> int:
    """The fewest leaves that hold the wanted share of the exact answers."""
    place = {}
    for i, q in zip(ids.tolist(), queries, strict=True):
        place[i] = {v: j for j, v in enumerate(tree.visits(np.append(q, 0.0), tree.leaves).tolist())}
    needed = np.sort([place[r.query_id][r.leaf] + 1 for r in truth])
    if not len(needed):
        return tree.leaves
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def _packed(counts: list[int], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last part of each leaf: leaves in order, parts alike in vectors."""
    total, size = sum(counts), np.array(counts, np.int64)
    room = max(1, -(-total // parts))
    end = np.cumsum(size)
    first = (end - size) // room
    # only a leaf above the size of a part is dealt to several
    last = np.where(size > room, np.maximum(end - 1, 0) // room, first)
    return first.astype(np.int64), last.astype(np.int64)
