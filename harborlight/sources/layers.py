"""Layer tables: read one if it is there, else an older form; write one safely."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.session import CLEARED, path_exists, run_dir, with_conf

BUCKET_BYTES = 32 << 20
WAVE_BYTES = 256 << 20
MOST_WAVES = 8

_BUILT: dict[tuple[str, str, str], str] = {}


def read_first(spark: SparkSession, candidates: Sequence[tuple[str, str]], **options) -> DataFrame:
    """The first of (format, path) that exists, in the given order."""
    for fmt, path in candidates:
        if path_exists(spark, path):
            return spark.read.format(fmt).options(**options).load(path)
    raise FileNotFoundError(f"none of {[path for _, path in candidates]} exists")


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Changes whenever a file at or below the paths is added, dropped or rewritten; ends with their bytes.

    Lists files only; no content is read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(list(paths))
        .select("path", "modificationTime", "length")
    )
    row = files.agg(
        F.bit_xor(F.xxhash64("path", "modificationTime", "length")).alias("h"),
        F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
    ).first()
    return f"{(row.h or 0) & 0xFFFFFFFFFFFFFFFF:016x}-{row.n}-{row.bytes}"


def _bytes(state: str) -> int:
    return int(state.rsplit("-", 1)[1])


def wave_count(size: int) -> int:
    """Waves in which a table is written: one for each ``WAVE_BYTES`` of its sources, but a bounded number, as each may scan them."""
    return max(1, min(MOST_WAVES, -(-size // WAVE_BYTES)))


def bucket_count(spark: SparkSession, state: str) -> int:
    """Buckets of a layer: one for each ``BUCKET_BYTES`` of its sources, one for each core and wave at least; no more than Spark takes."""
    wanted = max(spark.sparkContext.defaultParallelism * wave_count(_bytes(state)), -(-_bytes(state) // BUCKET_BYTES))
    return min(wanted, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))


def built(spark: SparkSession, name: str, folder: str, state: str) -> bool:
    """Has this session written the layer for this state of its sources?"""
    path = _BUILT.get(_key(spark, name, folder, state))
    return path is not None and path_exists(spark, path + "/_SUCCESS")


def _key(spark: SparkSession, name: str, folder: str, state: str) -> tuple[str, str, str]:
    return spark.sparkContext.applicationId, name, f"{folder}@{state}"


def materialized(
    spark: SparkSession, name: str, folder: str, build: Callable[[], DataFrame],
    state: str | None = None, bucket_by: str | None = None, share: Callable[[int, int], DataFrame] | None = None,
) -> DataFrame:
    """A layer table built once per input state and read back by every later job.

    Writing it cuts the lineage, so a lost executor re-reads files instead of
    repeating the joins, and later scans prune columns in Parquet. ``state`` is
    the fingerprint of the tables that the layer reads; the whole folder's without it.

    ``bucket_by`` names a key without hot values, such as the id of a table with
    one row per id: joins and windows on it then need no shuffle.

    A layer over large sources is written in waves, one after the other, and the shuffle files of a wave go before the next
    one: what lies on disk beside the layer is that of one wave. The rows of a wave are those of a run of buckets; without buckets they
    are ``share(k, n)``, the k-th of n parts of ``build()``, and a layer with neither is one wave.
    """
    state = state or fingerprint(spark, folder)
    key = _key(spark, name, folder, state)
    if not built(spark, name, folder, state):
        path = run_dir(spark, f"layer-{name}")
        with with_conf(spark, CLEARED):
            if bucket_by is None:
                _write_shares(build, share, wave_count(_bytes(state)), path)
            else:
                _write_buckets(spark, build, bucket_by, wave_count(_bytes(state)), bucket_count(spark, state), path)
        _BUILT[key] = path
    path = _BUILT[key]
    return spark.table(_table(path)) if bucket_by else spark.read.parquet(path)


def _write_shares(
    build: Callable[[], DataFrame], share: Callable[[int, int], DataFrame] | None, waves: int, path: str
) -> None:
    if share is None or waves == 1:
        build().write.mode("errorifexists").parquet(path)
        return
    for k in range(waves):
        share(k, waves).write.mode("append").parquet(path)


def _write_buckets(
    spark: SparkSession, build: Callable[[], DataFrame], by: str, waves: int, parts: int, path: str
) -> None:
    """Rows by ``parts`` buckets. The filter of a wave is one on the key, which Spark takes through windows and joins to the scan."""
    bucket = F.pmod(F.hash(by), F.lit(parts))
    # a shuffle by the key that the rows come from deals them out as the buckets do, so that there is no second one
    with with_conf(spark, {"spark.sql.shuffle.partitions": str(parts)}):
        for k in range(waves):
            rows = build() if waves == 1 else build().filter(
                bucket.between(parts * k // waves, parts * (k + 1) // waves - 1))
            # one task per bucket, so that a bucket is one file
            rows.repartition(parts, by).write.format("parquet").mode("append" if k else "errorifexists").option(
                "path", path).bucketBy(parts, by).sortBy(by).saveAsTable(_table(path))


def _table(path: str) -> str:
    """Catalog name of a bucketed layer; its files stay in the shared folder."""
    return "harborlight_" + path.rsplit("/", 1)[-1].replace("-", "_")
