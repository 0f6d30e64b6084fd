"""Shared machinery of the training-data operators.

* ``materialise`` cuts lineage with a table in the folder that all executors share.
* ``snapshot`` packs documents into compressed chunks, a stable unit of work.
* ``Exchange``-style helpers (``scatter``, ``reduce_buckets``, ``attach``) let chunks ask
  questions of a hash-partitioned table: each chunk sends its *distinct* keys, packed by
  bucket, so a key that fills a third of the corpus still sends one entry per chunk.
* ``components`` finds connected components by alternating large-star and small-star.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one if it is unset and the session is local too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "tidewell-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, so that no later failure recomputes it; ``by``: a column of strings that folders part it by."""
    spark = df.sparkSession
    gc.collect()  # shuffle files of earlier steps go once the driver has collected their plans
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/tidewell-{uuid.uuid4().hex}"
    schema = df.schema
    if by is not None:  # a folder can't be named '' (it would be read as null)
        df = df.withColumn(by, F.concat(F.lit("="), by))
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    _written.append((spark, path))
    back = spark.read.schema(schema).parquet(path)
    return back if by is None else back.withColumn(by, F.expr(f"substring({by}, 2)"))


def bucketed(rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder as a table bucketed by chunk, so that joins by chunk don't move it."""
    spark = rows.sparkSession
    gc.collect()  # shuffle files of earlier steps go once the driver has collected their plans
    spark.sparkContext._jvm.System.gc()
    name = f"tidewell_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(n, "chunk").saveAsTable(name)
    _written.append((spark, path))
    return spark.table(name)


def _delete(spark: SparkSession, path: str) -> None:
    name = path.rsplit("/", 1)[-1]
    if name.startswith("tidewell_"):  # a table, see bucketed()
        spark.sql(f"drop table if exists `{name}`")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete the table that ``materialise`` wrote for df, which nothing reads any more."""
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for spark, path in [x for x in _written if x[1].rsplit("/", 1)[-1] in names]:
        _delete(spark, path)
        _written.remove((spark, path))


@atexit.register
def _clean() -> None:
    """Best effort: intermediate tables go when the driver's Python ends."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """Hash buckets: a few for each shuffle partition, so each is a fraction of a task's memory."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def trimmed(run: Callable) -> Callable:
    """run, giving what it has freed back to the system at its end: Spark keeps workers for later tasks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim is not None:
            trim(0)

    return inner


# ---------------------------------------------------------------- chunks of documents


def pack(ids: list, texts: list) -> bytes:
    """ids (int or None) and texts (bytes or None) as one compressed blob."""
    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], ["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpack(blob: bytes) -> tuple[list, list]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    batch = pa.ipc.open_stream(raw).read_all()
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()


def snapshot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, packed: Callable[[list, list], bytes] = pack) -> DataFrame:
    """(chunk, blob): all documents, about chunk_bytes of text to a chunk; a longer text has its own.

    ``packed`` makes the blob of ids and texts.  Written once to the shared folder as a table bucketed by chunk, so that later joins with
    replies move the replies only.  A file holds one task's chunks of one bucket; on large
    inputs choose chunk_bytes so that these files have a good size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, size, ids, texts = TaskContext.get().partitionId() << 32, 0, 0, [], []

        def out():
            return pa.record_batch([pa.array([base + n], pa.int64()), pa.array([packed(ids, texts)], pa.binary())], ["chunk", "blob"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                if ids and size + len(t or b"") > chunk_bytes:
                    yield out()
                    n, size, ids, texts = n + 1, 0, [], []
                ids.append(i)
                texts.append(t)
                size += len(t or b"") + 64
        if ids:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "chunk long, blob binary")
    return bucketed(rows)


# ---------------------------------------------------------------- questions to hash buckets

MESSAGE = "chunk long, bucket int, payload binary"


def scatter(chunks: DataFrame, ask: Callable) -> DataFrame:
    """ask(chunk, blob, replies) yields (bucket, payload); replies: what attach() brought, by bucket."""
    has = "replies" in chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                chunk = b.column(0)[k].as_py()
                got = list(ask(chunk, b.column(1)[k].as_py(), _replies(b.column(2)[k]) if has else {}))
                yield pa.record_batch([pa.array([chunk] * len(got), pa.int64()), pa.array([x for x, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["chunk", "bucket", "payload"])

    return chunks.select("chunk", "blob", *(["replies"] if has else [])).mapInArrow(trimmed(run), MESSAGE)


def _replies(value: pa.Scalar) -> dict[int, bytes]:
    return {x["bucket"]: x["payload"] for x in value.as_py() or ()}


def reduce_buckets(messages: DataFrame, answer: Callable, schema: str = MESSAGE) -> DataFrame:
    """answer(bucket, chunks, payloads) for each bucket: a list of replies, one for each payload,
    or a record batch of the given schema."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        got = answer(bucket, chunks, table.column("payload").to_pylist())
        if isinstance(got, pa.Table):
            return got
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "payload": pa.array(got, pa.binary())})

    return messages.groupBy("bucket").applyInArrow(run, schema)


def attach(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    """Each chunk with all replies to it."""
    by = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "payload")).alias("replies"))
    return chunks.select("chunk", "blob").join(by, "chunk", "left")


def each_chunk(chunks: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(chunk, blob, replies) gives a dict of columns, or None."""
    has = "replies" in chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                got = work(b.column(0)[k].as_py(), b.column(1)[k].as_py(), _replies(b.column(2)[k]) if has else {})
                if got is not None:
                    yield pa.RecordBatch.from_pydict(got)

    return chunks.select("chunk", "blob", *(["replies"] if has else [])).mapInArrow(trimmed(run), schema)


def split_sorted(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted uint64 keys; a key's bucket is its range of the hash space."""
    width = np.uint64((1 << 64) // n_buckets + 1)
    return np.searchsorted(keys, np.arange(1, n_buckets, dtype=np.uint64) * width)


# ---------------------------------------------------------------- hashes of word and byte windows

_R1, _R2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(r: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get((r, inverse))
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), pow(r, -1, 1 << 64) if inverse else r, np.uint64)
        p[0] = 1
        have = _powers[r, inverse] = np.multiply.accumulate(p)
    return have[:n]


def rolling(values: np.ndarray, width: int, r: int = _R1) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` values (uint64): one for each start that fits."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    s = np.empty(n + 1, np.uint64)
    s[0] = 0
    np.cumsum(values * powers(r, n), out=s[1:])
    return mix((s[width:] - s[:-width]) * powers(r, n - width + 1, True))


# ---------------------------------------------------------------- connected components


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex reachable from each of 0..n-1 by links a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link for each vertex, which connect what a-b connect: (vertex, smallest reachable)."""
    v, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local_components(len(v), at[: len(a)], at[len(a) :])
    keep = label != np.arange(len(v))
    return v[keep], v[label[keep]]


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for x in batches:
        a, b = np.concatenate([a, x.column(0).to_numpy()]), np.concatenate([b, x.column(1).to_numpy()])
        a, b = forest(a, b)
        if len(a) > 2_000_000:
            yield pa.record_batch([pa.array(a), pa.array(b)], ["u", "v"])
            a, b = a[:0], b[:0]
    yield pa.record_batch([pa.array(a), pa.array(b)], ["u", "v"])


HUB = 512  # rows with one key from which joined_once() looks after the key by itself
HUBS = 200_000  # such keys that are broadcast (16 bytes each)


def joined_once(rows: DataFrame, key: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with a table that has each key once: (key, one more column), key long.

    Rows of a key that has HUB of them or more don't move: their entries of the table are
    broadcast.  There are at most count(rows) / HUB such keys; if there are more than HUBS,
    they are joined like the others, and adaptive execution splits large partitions.
    """
    value = next(c for c in table.columns if c != key)
    hubs = materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HUB).select(key))
    n = hubs.count()
    if not n or n > HUBS:
        return rows.join(table, key, how)
    hubs = hubs.withColumn("hub", F.lit(True))
    own = hubs.join(table, key, "left").select(key, "hub", F.col(value).alias("hub_value"))
    marked = rows.join(F.broadcast(own), key, "left")
    rest = marked.where("hub is null").drop("hub", "hub_value").join(table, key, how)
    mine = marked.where("hub" if how == "left" else "hub and hub_value is not null").withColumnRenamed("hub_value", value).drop("hub")
    return mine.select(*rest.columns).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """(vertex, component) of all vertices in links (u, v: long): the smallest vertex reachable.

    Each task first shrinks its links to a forest; then large-star and small-star rounds
    alternate until nothing changes.  Minima are partial aggregates, and a star's centre
    isn't a key that its rows move by (joined_once), so a huge component stays spread.
    """
    e = materialise(links.where("u <> v").mapInArrow(_forest_batches, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # large-star: what is larger than a vertex goes to its least neighbour, or to itself if it has none below
        low = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = materialise(joined_once(e, "v", low, "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        discard(e)
        # small-star: a vertex and what is smaller go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined_once(large, "u", low).select(F.explode(F.array("u", "v")).alias("u"), "m").where("u <> m").select("u", F.col("m").alias("v")).distinct()
        e = materialise(small)
        discard(large)
        n = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr("cast(pmod(xxhash64(u, v), 1000000007) as long)")), F.lit(0))).first()
        if tuple(n) == before:
            break
        before = tuple(n)
    own = e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(own)
