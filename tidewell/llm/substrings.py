"""Substring dedup by fixed-block anchors.

A window of ``width`` words holds exactly one whole block of its document's non-overlapping
blocks of ``(width + 1) // 2`` words.  All blocks are indexed by hash, every rolling window
of a block's length probes the index, and a block hit from anywhere else anchors a repeat:
the windows around it are the candidates, confirmed by 96-bit hashes of whole windows, and
the union of confirmed windows is what the maximal exact repeats cover.

Index and probes meet in hash buckets.  Chunks send distinct hashes only, so a passage in a
third of all documents sends one hash per chunk, and answers are bits; pairs are never made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import _R2, attach, buckets, each_chunk, materialise, mix, reduce_buckets, rolling, scatter, snapshot, split_sorted, unpack

CHUNK = 4 << 20


class Words:
    """The words of a chunk's texts and hashes of their windows."""

    def __init__(self, blob: bytes, width: int):
        self.ids, texts = unpack(blob)
        self.words = [(t or b"").split() for t in texts]
        self.width, self.block = width, (width + 1) // 2
        self.count = np.fromiter(map(len, self.words), np.int64, len(self.words))
        f = xxhash.xxh3_64_intdigest
        self.hash = np.fromiter((f(w) for x in self.words for w in x), np.uint64, int(self.count.sum()))
        self.end = np.cumsum(self.count)
        self.doc = np.repeat(np.arange(len(self.words)), self.count)

    def whole(self, width: int) -> np.ndarray:
        """Where windows of that many words start."""
        n = max(0, len(self.hash) - width + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[width - 1 :]) if n else np.empty(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Distinct hashes of rolling windows: (hash, occurs twice here, is a block here), and each block's (start, place among the block hashes)."""
        start = self.whole(self.block)
        key, at, n = np.unique(rolling(self.hash, self.block)[start], return_inverse=True, return_counts=True)
        own = (start - (self.end - self.count)[self.doc[start]]) % self.block == 0
        is_block = np.zeros(len(key), bool)
        is_block[at[own]] = True
        return key, n > 1, is_block, start[own], (np.cumsum(is_block) - 1)[at[own]]

    def candidates(self, hit: np.ndarray, start: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold a block that was hit."""
        mark = np.zeros(len(self.hash) + 1, np.int64)
        block = start[hit[place]]
        np.add.at(mark, np.maximum(block - self.width + self.block, (self.end - self.count)[self.doc[block]]), 1)
        np.add.at(mark, block + 1, -1)
        near = np.cumsum(mark[:-1]) > 0
        whole = self.whole(self.width)
        return whole[near[whole]]

    def windows(self, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct candidate windows: two hashes, occurs twice here, and each start's place."""
        key, first, at, n = np.unique(rolling(self.hash, self.width)[start], return_index=True, return_inverse=True, return_counts=True)
        more = (rolling(mix(self.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.width, _R2)[start[first]] >> np.uint64(32)).astype(np.uint32)
        return key, more, n > 1, at


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _ask_blocks(n_buckets: int, width: int):
    def ask(chunk: int, blob: bytes, replies: dict):
        key, twice, block, _, _ = Words(blob, width).anchors()
        bounds = [0, *split_sorted(key, n_buckets).tolist(), len(key)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                yield k, (b - a).to_bytes(8, "little") + (key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + _bits(twice[a:b]) + _bits(block[a:b])

    return ask


def _answer_blocks(bucket: int, chunks: list, payloads: list) -> list[bytes]:
    """For each chunk's block hashes, whether another window has them: two occurrences or more."""
    keys, twice, block = [], [], []
    for p in payloads:
        n = int.from_bytes(p[:8], "little")
        keys.append(np.frombuffer(p, np.uint32, n, 8))
        m = (n + 7) // 8
        twice.append(_flags(p[8 + 4 * n : 8 + 4 * n + m], n))
        block.append(_flags(p[8 + 4 * n + m :], n))
    key = np.concatenate(keys)
    one = np.concatenate(twice)
    ordered = np.sort(key)
    repeat = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], key[one]]))
    out = []
    for k, b in zip(keys, block):
        at = np.searchsorted(repeat, k[b])
        out.append(_bits(repeat[np.minimum(at, len(repeat) - 1)] == k[b] if len(repeat) else np.zeros(len(at), bool)))
    return out


def _gather(replies: dict, sizes: np.ndarray) -> np.ndarray:
    """The answers of all buckets as one array of flags; sizes: how many each was asked."""
    parts = [_flags(replies[k], n) if n else np.zeros(0, bool) for k, n in enumerate(sizes.tolist())]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _hit_blocks(w: Words, replies: dict, n_buckets: int) -> np.ndarray:
    key, _, block, start, place = w.anchors()
    bounds = np.concatenate([[0], split_sorted(key, n_buckets), [len(key)]])
    sizes = np.diff(np.concatenate([[0], np.cumsum(block)])[bounds])
    return w.candidates(_gather(replies, sizes), start, place)


def _tagged(replies: dict, tag: int, n_buckets: int) -> dict:
    return {k - tag * n_buckets: v for k, v in replies.items() if k // n_buckets == tag}


def _ask_windows(n_buckets: int, width: int):
    def ask(chunk: int, blob: bytes, replies: dict):
        w = Words(blob, width)
        key, more, twice, _ = w.windows(_hit_blocks(w, replies, n_buckets))
        bounds = [0, *split_sorted(key, n_buckets).tolist(), len(key)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                yield k + n_buckets, (b - a).to_bytes(8, "little") + key[a:b].tobytes() + more[a:b].tobytes() + _bits(twice[a:b])

    return ask


def _answer_windows(bucket: int, chunks: list, payloads: list) -> list[bytes]:
    size = [int.from_bytes(p[:8], "little") for p in payloads]
    key = np.concatenate([np.frombuffer(p, np.uint64, n, 8) for p, n in zip(payloads, size)])
    more = np.concatenate([np.frombuffer(p, np.uint32, n, 8 + 8 * n) for p, n in zip(payloads, size)])
    repeated = np.concatenate([_flags(p[8 + 12 * n :], n) for p, n in zip(payloads, size)])
    order = np.lexsort((more, key))
    same = (key[order][1:] == key[order][:-1]) & (more[order][1:] == more[order][:-1])
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    # what is twice in one chunk is repeated in every chunk that has it, as the key is then found twice
    return [_bits(x) for x in np.split(repeated, np.cumsum(size)[:-1])]


def _cut(n_buckets: int, width: int, keep_text: bool):
    def work(chunk: int, blob: bytes, replies: dict):
        w = Words(blob, width)
        start = _hit_blocks(w, _tagged(replies, 0, n_buckets), n_buckets)
        key, _, _, at = w.windows(start)
        bounds = np.concatenate([[0], split_sorted(key, n_buckets), [len(key)]])
        repeated = _gather(_tagged(replies, 1, n_buckets), np.diff(bounds))
        gone = start[repeated[at]]
        mark = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + width, -1)
        keep = np.cumsum(mark[:-1]) == 0
        removed = w.count - np.bincount(w.doc[keep], minlength=len(w.count))
        out = []
        for k, words in enumerate(w.words):
            if removed[k]:
                words = [x for x, ok in zip(words, keep[w.end[k] - w.count[k] : w.end[k]].tolist()) if ok]
            out.append(b" ".join(words))
        cols = {"id": pa.array(w.ids, pa.int64()), "n_words": pa.array(w.count), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out])}
        return cols | ({"kept": pa.array([x.decode() for x in out])} if keep_text else {})

    return work


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: (id_col, n_words, n_removed, kept_sha256), and kept text with ``keep_text``.

    Words are runs of anything but ASCII white space.  Each word covered by a window of
    ``width`` words whose sequence also starts anywhere else, in the same document or
    another, is removed; windows are judged on the input.  Null or empty text: no words and
    the digest of the empty string.  Null and repeated ids are kept, and rows are documents
    of their own whatever their ids.  A text of any length is taken whole.
    """
    n = buckets(docs.sparkSession)
    chunks = snapshot(docs, id_col, text_col, CHUNK)
    hits = materialise(reduce_buckets(scatter(chunks, _ask_blocks(n, width)), _answer_blocks))
    confirmed = reduce_buckets(scatter(attach(chunks, hits), _ask_windows(n, width)), _answer_windows)
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return each_chunk(attach(chunks, hits.union(confirmed)), _cut(n, width, keep_text), schema).withColumnRenamed("id", id_col)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_substrings": op3_substrings}
ORACLES = {
    "op3_substrings": r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, p, sha256(array_to_string(w[p : p + 34], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 33)) as p from d where len(w) >= 35)
), repeated as (
  select doc_id, p from windows where h in (select h from windows group by h having count(*) > 1)
), gone as (
  select distinct doc_id, unnest(range(p, p + 35)) as i from repeated
), words as (
  select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d
), kept as (
  select w.doc_id, count(*) as n_words, count(g.i) as n_removed, string_agg(x, ' ' order by w.i) filter (g.i is null) as k
  from words w left join gone g on g.doc_id = w.doc_id and g.i = w.i group by w.doc_id
)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""
}
