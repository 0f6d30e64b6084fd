"""Suffix-array dedup of byte strings by two-stage sorting.

Windows of ``width`` bytes are grouped by their smallest 18-byte gram, so equal windows meet
at equal grams.  Grams seen once in the corpus can't belong to a repeat and end there.  The
text around every other gram goes to the gram's bucket, whose contexts form one text.  Its
suffix array is built in two stages: suffixes smaller than their successors are sorted
directly, to the depth of a window; the rest are induced by scanning the buckets of first
bytes in order.  Neighbours in the array with a common prefix of a window are equal windows,
and the smallest document of each run decides which occurrences go.

Chunks send distinct contexts only, so copies in a third of all documents send one context
per chunk, and a bucket's array holds each once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import _R2, attach, buckets, each_chunk, materialise, mix, powers, reduce_buckets, rolling, scatter, snapshot, split_sorted, unpack
from tidewell.llm.substrings import _bits, _flags, _gather, _tagged

CHUNK = 1 << 20
GRAM = 18
NO_DOC = np.iinfo(np.int64).max


# ---------------------------------------------------------------- two-stage sorting


def pack_symbols(text: np.ndarray) -> np.ndarray:
    """Seven symbols (0 to 511) from each place on as one number that sorts like them; zeros follow the end."""
    long = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    out = np.zeros(len(text), np.uint64)
    for k in range(7):
        out = (out << np.uint64(9)) | long[k : k + len(text)]
    return out


def sort_directly(packed: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``at`` in order of their first ``depth`` symbols; only ties are looked at further."""
    long = np.concatenate([packed, np.zeros(depth + 7, np.uint64)])
    key = long[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    tied = np.concatenate([[False], key[1:] == key[:-1]]) if len(at) else np.zeros(0, bool)
    for d in range(7, depth, 7):
        group = np.cumsum(~tied)
        member = tied.copy()
        member[:-1] |= tied[1:]
        rows = np.flatnonzero(member)
        if not len(rows):
            break
        key = long[at[rows] + d]
        order = np.lexsort((key, group[rows]))
        at[rows] = at[rows][order]
        key, own = key[order], group[rows]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (own[1:] == own[:-1])])
        tied[rows] = same
    return at


def suffix_array(text: np.ndarray, depth: int, want: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` (symbols 0 to 511) in order of at least their first ``depth`` symbols.

    All, or those that ``want`` marks and what their order is induced from: for each, the
    suffixes up to the next one that is smaller than its successor.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    # a suffix is small if it is smaller than its successor; equal symbols pass on what follows
    change = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    run = np.searchsorted(change, np.arange(n))
    rises = np.concatenate([text[change[:-1]] < text[change[:-1] + 1], [False]])
    small = rises[run]
    need = np.ones(n, bool)
    if want is not None:
        at = np.flatnonzero(want)
        place = np.append(np.flatnonzero(small), n - 1)
        stop = place[np.searchsorted(place, at)]
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, at, 1)
        np.add.at(mark, stop + 1, -1)
        need = np.cumsum(mark[:-1]) > 0
    direct = sort_directly(pack_symbols(text), np.flatnonzero(small & need), depth)
    size = np.bincount(text[direct], minlength=512)
    stop = np.cumsum(size)
    waiting: list[list[np.ndarray]] = [[] for _ in range(512)]
    waiting[int(text[n - 1])].append(np.array([n - 1]))

    def induce(scanned: np.ndarray, above: int) -> None:
        before = scanned[scanned > 0] - 1
        before = before[(text[before] > above) & ~small[before] & need[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for part in np.split(before, np.flatnonzero(first[1:] != first[:-1]) + 1) if len(before) else []:
            waiting[int(text[part[0]])].append(part)

    out = []
    for c in range(512):
        new = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        while len(new):  # runs of one symbol induce within their own bucket
            out.append(new)
            induce(new, c)
            before = new[new > 0] - 1
            new = before[(text[before] == c) & ~small[before] & need[before]]
        rest = direct[stop[c] - size[c] : stop[c]]
        if len(rest):
            out.append(rest)
            induce(rest, c)
    return np.concatenate(out)


def common_prefix_reaches(packed: np.ndarray, text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix of ``order`` shares its first ``width`` symbols with the one before it."""
    long, a, b = np.concatenate([packed, np.zeros(width + 7, np.uint64)]), order[:-1], order[1:]
    same = np.ones(len(b), bool)
    for d in range(0, width - 6, 7):
        at = np.flatnonzero(same)
        same[at] = long[a[at] + d] == long[b[at] + d]
    symbols = np.concatenate([text, np.zeros(width, text.dtype)])
    for d in range(width - width % 7, width):
        same &= symbols[a + d] == symbols[b + d]
    return np.concatenate([[False], same]) if len(order) else same


# ---------------------------------------------------------------- chunks


class Contexts:
    """A chunk's windows, grouped by their smallest gram."""

    def __init__(self, blob: bytes, width: int):
        ids, texts = unpack(blob)
        self.ids, self.texts, self.width = ids, [t or b"" for t in texts], width
        self.doc_id = np.array([NO_DOC if i is None else i for i in ids], np.int64)
        self.size = np.fromiter(map(len, self.texts), np.int64, len(ids))
        self.end = np.cumsum(self.size)
        self.byte = np.frombuffer(b"".join(self.texts), np.uint8)
        span = width - GRAM + 1
        value = self.byte.astype(np.uint64) + np.uint64(1)
        gram = rolling(value, GRAM)
        n = max(0, len(self.byte) - width + 1)
        bits = np.uint64(max(24, int(len(gram)).bit_length()))
        low = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
        reach = 1
        while reach < span:  # the least of ``span`` grams from each place on; the first of equals
            step = min(reach, span - reach)
            low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
            reach += step
        anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        inside = np.zeros(n, bool)
        for e, s in zip(self.end.tolist(), self.size.tolist()):
            if s >= width:
                inside[e - s : e - width + 1] = True
        at = np.flatnonzero(inside)
        own = anchor[at]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        self.first, self.last = at[first], at[last]  # starts of a context's first and last window
        self.gram = mix(gram[own[first]])  # least hashes are small; mixed they spread over the buckets
        self.doc = np.searchsorted(self.end, self.first, "right")
        self.sum = None
        self.value = value

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, at, n = np.unique(self.gram, return_inverse=True, return_counts=True)
        return key, n > 1, at

    def repeated(self, hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Contexts with a gram that was hit, and for the distinct ones: (one of them, smallest document), by gram; each context's place among them."""
        rows = np.flatnonzero(hit[at])
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value * powers(_R2, len(self.value)))])
        a, b = self.first[rows], self.last[rows] + self.width
        text = mix((s[b] - s[a]) * powers(_R2, len(self.value) + 1, True)[a] + (b - a).astype(np.uint64))
        order = np.lexsort((self.doc_id[self.doc[rows]], text, self.gram[rows]))
        g, t = self.gram[rows][order], text[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])]) if len(rows) else np.zeros(0, bool)
        place = np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new) - 1
        return rows, rows[order[new]], self.doc_id[self.doc[rows]][order[new]], place


def _ask_grams(n_buckets: int, width: int):
    def ask(chunk: int, blob: bytes, replies: dict):
        key, twice, _ = Contexts(blob, width).grams()
        bounds = [0, *split_sorted(key, n_buckets).tolist(), len(key)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                yield k, (b - a).to_bytes(8, "little") + (key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + _bits(twice[a:b])

    return ask


def _answer_grams(bucket: int, chunks: list, payloads: list) -> list[bytes]:
    size = [int.from_bytes(p[:8], "little") for p in payloads]
    key = np.concatenate([np.frombuffer(p, np.uint32, n, 8) for p, n in zip(payloads, size)])
    hit = np.concatenate([_flags(p[8 + 4 * n :], n) for p, n in zip(payloads, size)])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    return [_bits(x) for x in np.split(hit, np.cumsum(size)[:-1])]


def _hits(c: Contexts, replies: dict, n_buckets: int) -> tuple[np.ndarray, ...]:
    key, _, at = c.grams()
    sizes = np.diff(np.concatenate([[0], split_sorted(key, n_buckets), [len(key)]]))
    return c.repeated(_gather(replies, sizes), at)


def _ask_contexts(n_buckets: int, width: int):
    def ask(chunk: int, blob: bytes, replies: dict):
        c = Contexts(blob, width)
        _, one, doc, _ = _hits(c, replies, n_buckets)
        bounds = [0, *split_sorted(c.gram[one], n_buckets).tolist(), len(one)]
        raw = c.byte.tobytes()
        press = zstandard.ZstdCompressor(level=1)
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                first, last = c.first[one[a:b]], c.last[one[a:b]] + width
                text = b"".join([raw[x:y] for x, y in zip(first.tolist(), last.tolist())])
                yield k + n_buckets, (b - a).to_bytes(8, "little") + press.compress(doc[a:b].tobytes() + (last - first).astype(np.uint8).tobytes() + text)

    return ask


def _answer_contexts(width: int):
    def answer(bucket: int, chunks: list, payloads: list) -> list[bytes]:
        """For each context, a bit for each of its windows that a smaller document has than any here."""
        known: dict[bytes, int] = {}
        which, docs, size = [], [], []
        for p in payloads:
            n = int.from_bytes(p[:8], "little")
            raw = zstandard.ZstdDecompressor().decompress(p[8:])
            docs.append(np.frombuffer(raw, np.int64, n))
            e = 9 * n + np.cumsum(np.frombuffer(raw, np.uint8, n, 8 * n).astype(np.int64))
            s = np.concatenate([[9 * n], e[:-1]])
            which += [known.setdefault(raw[x:y], len(known)) for x, y in zip(s.tolist(), e.tolist())]
            size.append(n)
        place, doc = np.array(which, np.int64), np.concatenate(docs)
        least = np.full(len(known), NO_DOC)
        np.minimum.at(least, place, doc)
        length = np.fromiter(map(len, known), np.int64, len(known))
        # symbols are bytes and 1; a zero ends each context
        stop = np.cumsum(length + 1)
        text = np.zeros(int(stop[-1]), np.uint16)
        body = np.ones(len(text), bool)
        body[stop - 1] = False
        text[body] = np.frombuffer(b"".join(known), np.uint8).astype(np.uint16) + 1
        owner = np.repeat(np.arange(len(known)), length + 1)
        room = stop[owner] - 1 - np.arange(len(text))  # bytes left in the context
        order = suffix_array(text, width, room >= width)
        order = order[room[order] >= width]
        group = np.cumsum(~common_prefix_reaches(pack_symbols(text), text, order, width)) - 1
        low = np.full(int(group[-1]) + 1 if len(group) else 0, NO_DOC)
        np.minimum.at(low, group, least[owner[order]])
        window_low = np.full(len(text), NO_DOC)
        window_low[order] = low[group]
        begin = stop - length - 1
        offset = np.arange(width - GRAM + 1)
        at = begin[place][:, None] + offset[None, :]
        ok = offset[None, :] <= (length[place] - width)[:, None]
        gone = ok & (window_low[np.minimum(at, len(text) - 1)] < doc[:, None])
        mask = (gone.astype(np.uint64) << offset.astype(np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
        return [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(mask, np.cumsum(size)[:-1])]

    return answer


def _cut(n_buckets: int, width: int, keep_text: bool):
    def work(chunk: int, blob: bytes, replies: dict):
        c = Contexts(blob, width)
        rows, one, doc, place = _hits(c, _tagged(replies, 0, n_buckets), n_buckets)
        got = _tagged(replies, 1, n_buckets)
        mask = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(got[k]) for k in sorted(got)), np.uint64)
        own = mask[place] if len(place) else np.empty(0, np.uint64)
        later = c.doc_id[c.doc[rows]] > doc[place] if len(place) else np.zeros(0, bool)
        own = np.where(later, ~np.uint64(0), own)
        mark = np.zeros(len(c.byte) + 1, np.int64)
        for k in range(width - GRAM + 1):
            at = c.first[rows] + k
            at = at[((own >> np.uint64(k)) & np.uint64(1)).astype(bool) & (at <= c.last[rows])]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + width, -1)
        gone = np.cumsum(mark[:-1]) > 0
        removed, spans, out = [], [], []
        keep = ~gone
        touched = np.add.reduceat(np.append(gone, False), c.end - c.size)[: len(c.size)] if len(c.size) else []
        for k, t in enumerate(c.texts):
            a, b = c.end[k] - c.size[k], c.end[k]
            if b > a and touched[k]:
                g = gone[a:b]
                removed.append(int(g.sum()))
                spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()))
                t = c.byte[a:b][keep[a:b]].tobytes()
            else:
                removed.append(0)
                spans.append(0)
            out.append(t)
        cols = {"id": pa.array(c.ids, pa.int64()), "n_bytes": pa.array(c.size), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out])}
        return cols | ({"kept": pa.array(out, pa.binary())} if keep_text else {})

    return work


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, keep_text: bool = False) -> DataFrame:
    """One row per row of docs: (id_col, n_bytes, n_removed, n_spans, kept_sha256), and kept bytes with ``keep_text``.

    Texts are UTF-8 bytes; each byte covered by a ``width``-byte string that also starts in a
    document with a smaller id is removed, judged on the input.  Null or empty text: no
    bytes.  Rows with one id don't remove from each other.  A null id is larger than any
    other.  ``width`` is 25 to 80.  A text of any length is taken whole.
    """
    if not 25 <= width <= 80:
        raise ValueError("width is 25 to 80")
    n = buckets(docs.sparkSession)
    chunks = snapshot(docs, id_col, text_col, CHUNK)
    hits = materialise(reduce_buckets(scatter(chunks, _ask_grams(n, width)), _answer_grams))
    masks = reduce_buckets(scatter(attach(chunks, hits), _ask_contexts(n, width)), _answer_contexts(width))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return each_chunk(attach(chunks, hits.union(masks)), _cut(n, width, keep_text), schema).withColumnRenamed("id", id_col)


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_suffixes": op4_suffixes}
ORACLES: dict[str, str] = {}
