"""Line dedup with two Bloom filters, once-seen and twice-seen, and exact confirmation.

Filters have a fixed size (``filter_bytes``), cut into segments by hash.  Tasks send the
hashes of their lines, four bytes each, to the segments, where a key is entered in the
once-seen filter and, when it is there already, in the twice-seen one.  The twice-seen
filter alone is broadcast: its size is the parameter, whatever the corpus.  When the corpus
outgrows it, more lines are suspected and shuffle for confirmation; the result is the same.

Documents are written once as chunks bucketed by chunk.  Suspected keys go out with the place
of their row and come back to its chunk, so whole texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import bucketed, materialise, mix, trimmed

FILTER_BYTES = 16 << 20
SEGMENTS = 64
PROBES = 4
SPACE = " \t\n\x0b\x0c\r"
CHUNK_BYTES = 4 << 20


def line_key(line: str, least: int) -> bytes | None:
    """The key of a line, None if it is shorter than ``least`` code points."""
    key = line.strip(SPACE)
    return key.encode().lower() if len(key) >= least else None


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def _segment(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % n


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    """The places of each hash in a filter of ``size`` bits, one row per probe."""
    a, b = mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return np.stack([((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64) for k in range(PROBES)])


def _chunks(rows: DataFrame) -> DataFrame:
    """(chunk, blob): all rows of (id, text, extra) in order, about CHUNK_BYTES of text to a chunk; a longer text has its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, size, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as w:
                w.write_table(whole)
            blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
            return pa.record_batch([pa.array([part + n], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            start = 0
            while start < b.num_rows:
                before = int(upto[start - 1]) if start else 0
                fits = int(np.searchsorted(upto, before + CHUNK_BYTES - size, "right"))
                stop = max(fits, start + (not held))
                if stop > start:
                    held.append(b.slice(start, stop - start))
                    size += int(upto[stop - 1]) - before
                    start = stop
                if start < b.num_rows:
                    yield out()
                    n, size, held = n + 1, 0, []
        if held:
            yield out()

    return bucketed(rows.mapInArrow(trimmed(run), "chunk long, blob binary"))


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def _keys(text: str | None, least: int) -> set[bytes]:
    """The distinct keys of a text's lines that are long enough."""
    return {k for x in (text or "").split("\n") if len(x) >= least and (k := line_key(x, least))}


def twice_seen(chunks: DataFrame, least: int, filter_bytes: int, segments: int = SEGMENTS) -> dict[int, bytes]:
    """The segments of the twice-seen filter: a key of two documents is surely in it."""
    size = filter_bytes // segments * 8

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                seen = [_hash(k) for t in _table(blob.as_py()).column(1).to_pylist() for k in _keys(t, least)]
                once, n = np.unique(np.array(seen, np.uint64), return_counts=True)
                at = _segment(once, segments)
                for s in range(segments):
                    mine = at == s
                    if mine.any():
                        yield pa.record_batch([pa.array([s], pa.int32()), pa.array([_short(once[mine]).tobytes()], pa.binary()), pa.array([_short(once[mine & (n > 1)]).tobytes()], pa.binary())], ["segment", "keys", "again"])

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, bool), np.zeros(size, bool)
        for b in batches:
            for keys, again in zip(b.column("keys").to_pylist(), b.column("again").to_pylist()):
                at = _bits(np.frombuffer(keys, np.uint32).astype(np.uint64), size)
                known = once[at].all(axis=0)
                twice[at[:, known]] = True
                once[at] = True
                twice[_bits(np.frombuffer(again, np.uint32).astype(np.uint64), size)] = True
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

    rows = chunks.select("blob").mapInArrow(trimmed(send), "segment int, keys binary, again binary").groupBy("segment").applyInArrow(fill, "segment int, bits binary")
    return {r["segment"]: bytes(r["bits"]) for r in rows.collect()}  # at most ``filter_bytes``


def _short(h: np.ndarray) -> np.ndarray:
    """What is sent of a hash: 32 bits that don't decide its segment."""
    return (mix(h) >> np.uint64(32)).astype(np.uint32)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, documents: int = 5, filter_bytes: int = FILTER_BYTES, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: (id_col, n_lines, n_dropped, kept_sha256), and text if keep_text.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.  Keys of at
    least ``least`` code points in at least ``documents`` documents lose all their lines
    except in the largest id that holds them.  Null or empty text: one empty line, kept.
    Rows with one id are one document, and each keeps the lines that its id keeps.  A null
    id counts as no document and loses the lines that another document keeps.  Extra columns
    are kept with ``keep_text`` and not read otherwise.
    """
    spark = docs.sparkSession
    id_, text_ = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    extra = [c for c in docs.columns if c not in (id_col, text_col)] if keep_text else []
    rows = docs.select(id_.alias("id"), text_.alias("text"), F.struct(*[F.col(f"`{c}`") for c in extra]).alias("extra") if extra else F.lit(None).cast("int").alias("extra"))
    chunks = _chunks(rows)
    segments = twice_seen(chunks, least, filter_bytes)
    shared = spark.sparkContext.broadcast(segments)
    size = filter_bytes // SEGMENTS * 8

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: np.frombuffer(x, np.uint8) for s, x in shared.value.items()}
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1)):
                table, at_row, keys = _table(blob.as_py()), [], []
                for k, t in enumerate(table.column(1).to_pylist()):
                    own = _keys(t, least)
                    keys += own
                    at_row += [k] * len(own)
                h = np.array(list(map(_hash, keys)), np.uint64)
                hit, short = np.zeros(len(h), bool), _short(h).astype(np.uint64)
                at = _segment(h, SEGMENTS)
                for s, bits in filters.items():
                    mine = np.flatnonzero(at == s)
                    place = _bits(short[mine], size)
                    hit[mine] = ((bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).all(axis=0)
                pick = np.flatnonzero(hit)
                row = np.array(at_row, np.int64)[pick]
                ids = table.column(0).combine_chunks().take(pa.array(row))
                yield pa.record_batch([pa.array(np.full(len(pick), chunk)), pa.array(row.astype(np.int32)), ids, pa.array([xxhash.xxh3_128_digest(keys[k]) for k in pick.tolist()], pa.binary())], ["chunk", "row", "id", "key"])

    found = materialise(chunks.select("chunk", "blob").mapInArrow(trimmed(suspects), "chunk long, row int, id long, key binary"))
    # a row for each document and key; without repeated ids the count of rows is that of documents
    counted = materialise(found.where("id is not null").select("id", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).where(F.col("n") >= documents).drop("n"))
    # with both sides straight from a table, a very common key's partition of the join is split at run time
    drop = found.join(counted, "key").where("id is null or id < last").groupBy("chunk").agg(F.collect_list(F.struct("row", "key")).alias("drop"))  # at most the lines of a chunk
    joined = chunks.select("chunk", "blob").join(drop, "chunk", "left").select("blob", "drop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, gone in zip(b.column(0), b.column(1)):
                table, lost = _table(blob.as_py()), {}
                for x in gone.as_py() or ():
                    lost.setdefault(x["row"], set()).add(x["key"])
                out = []
                for k, t in enumerate(table.column(1).to_pylist()):
                    lines = kept = (t or "").split("\n")
                    if mine := lost.get(k):
                        kept = [x for x in lines if len(x) < least or (key := line_key(x, least)) is None or xxhash.xxh3_128_digest(key) not in mine]
                    text = "\n".join(kept)
                    out.append((len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text if t is not None or kept != [""] else None))
                n, dropped, digest, text = zip(*out)
                cols = [table.column(0).combine_chunks(), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string())]
                yield pa.record_batch([*cols, pa.array(text, pa.string()), table.column(2).combine_chunks()] if keep_text else cols, ["id", "n_lines", "n_dropped", "kept_sha256", *(["text", "extra"] if keep_text else [])])

    kind = rows.schema["extra"].dataType.simpleString() if keep_text else ""
    out = joined.mapInArrow(trimmed(cut), "id long, n_lines long, n_dropped long, kept_sha256 string" + (f", text string, extra {kind}" if keep_text else ""))
    if not keep_text:
        return out.withColumnRenamed("id", id_col)
    back = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col("extra").getField(c) for c in extra}
    return out.select(*[back[c].alias(c) for c in docs.columns], "n_lines", "n_dropped", "kept_sha256")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_lines": op5_lines}
ORACLES = {
    "op5_lines": r"""
with lines as (
  select doc_id, generate_subscripts(l, 1) as k, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), repeated as (
  select key, max(doc_id) as last from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5
)
select doc_id, count(*) as n_lines,
       count(*) filter (last is not null and doc_id < last) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by k) filter (last is null or doc_id >= last), '')) as kept_sha256
from keyed left join repeated using (key)
group by doc_id
"""
}
