"""Best-fit packing of token sequences by swap-based local search.

Only lengths matter, and there are at most ``capacity`` of them, so the search works on the
histogram of lengths: bins of one content are one pattern with a count.  What the driver gets is at most one count
for each length, whatever the corpus.  Best fit, longest first, gives the first packing; then underfull bins exchange one
document for one, two for one, or move documents, whenever that increases the sum of
squared fills, until no pair of bins has such a step or the lower bound is met.

Each document's rank among its length picks its place.  Ranks come from per-partition
counts, so no length, however common, is gathered in one task.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.bpe import MEMO, SLICE, codec, slices, tokenizer_path
from tidewell.llm.common import materialise, trimmed

CAPACITY = 2048


# ---------------------------------------------------------------- the plan, on a histogram


def best_fit(histogram: dict[int, int], capacity: int) -> Counter:
    """Patterns (lengths, longest first) with the number of bins that have them."""
    free: list[Counter] = [Counter() for _ in range(capacity + 1)]  # by room left
    some = np.zeros(capacity + 1, bool)

    def put(room: int, pattern: tuple, n: int) -> None:
        free[room][pattern] += n
        some[room] = True

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = np.flatnonzero(some[length:])
            if not len(fits):
                per = capacity // length
                if full := left // per:
                    put(capacity - per * length, (length,) * per, full)
                if rest := left % per:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = length + int(fits[0])
            pattern, n = next(iter(free[room].items()))
            per = room // length  # a best-fit bin takes the same length until it has no more room
            if left >= per:
                n = min(n, left // per)
            else:
                n, per = 1, left
            free[room][pattern] -= n
            if not free[room][pattern]:
                del free[room][pattern]
                some[room] = bool(free[room])
            put(room - per * length, pattern + (length,) * per, n)
            left -= n * per
    return sum((x for x in free if x), Counter())


class Open:
    """Underfull patterns by the room they have, with their sums of one and of two lengths as bits of a number."""

    def __init__(self, capacity: int):
        self.capacity, self.by = capacity, [set() for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 1, bool)
        self.sums: dict[tuple, tuple[int, int, int]] = {}

    def add(self, pattern: tuple) -> None:
        fill = sum(pattern)
        if fill < self.capacity and pattern not in self.sums:
            ones, twos = 0, 0
            for x in pattern:
                twos |= ones << x
                ones |= 1 << x
            self.sums[pattern] = fill, ones, twos
            self.by[self.capacity - fill].add(pattern)
            self.some[self.capacity - fill] = True

    def drop(self, pattern: tuple) -> None:
        if pattern in self.sums:
            room = self.capacity - self.sums.pop(pattern)[0]
            self.by[room].discard(pattern)
            self.some[room] = bool(self.by[room])

    def fullest_first(self) -> Iterator[tuple]:
        for room in np.flatnonzero(self.some).tolist():
            yield from sorted(self.by[room])

    def exchange(self, source: tuple, target: tuple) -> tuple | None:
        """The exchange of up to two lengths for one, or of one for two, that raises squared fill and moves most: (lengths that leave, lengths that come back).

        If ``target`` grows by d, the sum of squared fills grows by 2 d (d + its fill - the
        source's fill), so d must be over the difference of fills and at most its room.
        """
        (a, ones, twos), (b, _, back_twos) = self.sums[source], self.sums[target]
        low, high = max(1, a - b + 1), self.capacity - b
        window, best, out, back = (1 << (high - low + 1)) - 1, 0, 0, 0
        for x in {0, *target}:
            found = ((ones | twos) >> (x + low)) & window
            if found and low + found.bit_length() - 1 > best:
                best = low + found.bit_length() - 1
                out, back = best + x, x
        for x in set(source) if back_twos else ():
            least = max(0, x - high)
            found = (back_twos >> least) & ((1 << max(0, x - low - least + 1)) - 1)
            if found and x - least - (found & -found).bit_length() + 1 > best:
                best = x - least - (found & -found).bit_length() + 1
                out, back = x, x - best
        return (_lengths(source, out), _lengths(target, back)) if best else None


def _lengths(pattern: tuple, size: int) -> tuple:
    """One or two of the pattern's lengths with that sum; none for 0."""
    if not size or size in pattern:
        return (size,) if size else ()
    return next((x, size - x) for k, x in enumerate(pattern) if size - x in pattern[k + 1 :])


def improve(bins: Counter, capacity: int) -> Counter:
    """Local search over underfull bins: moves, one-for-one and two-for-one exchanges.

    Each step exchanges up to two lengths of a bin for one of another, or one for two, and raises
    the sum of squared fills; it acts on as many bins of the two patterns as there are.  A
    pattern that comes up, or whose count grows, waits to be tried against all open ones in both
    directions, so once none waits no pair of bins has a step left.  The search ends there or
    at the lower bound; squared fill grows with each step, so it does end.
    """
    bins = Counter(bins)
    total = sum(sum(p) * n for p, n in bins.items())
    least, count = -(-total // capacity), sum(bins.values())
    open_ = Open(capacity)
    for p in bins:
        open_.add(p)
    waiting = [(fill, p) for p, (fill, _, _) in open_.sums.items()]
    heapq.heapify(waiting)
    while count > least and waiting:
        _, pattern = heapq.heappop(waiting)
        step = _step(pattern, open_, bins) if pattern in bins else None
        if step is None:
            continue
        source, target, out, back = step
        n = bins[source] // 2 if target == source else min(bins[source], bins[target])
        new = [tuple(sorted(x.elements(), reverse=True)) for x in (Counter(source) - Counter(out) + Counter(back), Counter(target) - Counter(back) + Counter(out))]
        for p in (source, target):
            bins[p] -= n
            if bins[p] <= 0:
                del bins[p]
                open_.drop(p)
        for p in new:
            if p:
                bins[p] += n
                open_.add(p)
            else:
                count -= n
        for p in {pattern, *new}:
            if p in bins and p in open_.sums:
                heapq.heappush(waiting, (open_.sums[p][0], p))
    return bins


def _step(pattern: tuple, open_: Open, bins: Counter) -> tuple | None:
    """A step of the pattern's bins and others, the fullest first: (source, target, lengths that leave source, lengths that come back)."""
    for other in open_.fullest_first():
        if other == pattern and bins[pattern] < 2:
            continue
        for source, target in ((pattern, other), (other, pattern)):
            if found := open_.exchange(source, target):
                return source, target, *found
    return None


class Places:
    """Where the r-th document of each length goes: bins are numbered pattern by pattern."""

    def __init__(self, bins: Counter):
        self.tables: dict[int, list[list[int]]] = {}
        first = 0
        for pattern in sorted(bins, reverse=True):
            offset = 0
            for length in pattern:
                cum, seq, off = self.tables.setdefault(length, [[0], [], []])
                cum.append(cum[-1] + bins[pattern])
                seq.append(first)
                off.append(offset)
                offset += length
            first += bins[pattern]
        self.tables = {k: [np.array(x, np.int64) for x in v] for k, v in self.tables.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], length[order][1:] != length[order][:-1]])) if len(order) else []
        for rows in np.split(order, at[1:]) if len(order) else []:
            cum, seq, off = self.tables[int(length[rows[0]])]
            k = np.searchsorted(cum, rank[rows], "right") - 1
            sequence[rows], offset[rows] = seq[k] + rank[rows] - cum[k], off[k]
        return sequence, offset


# ---------------------------------------------------------------- the operator


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str, end_id: int, memo: int, at_once: int) -> DataFrame:
    """Pieces of each document's ids and final ``end_id``, with (task, rank) among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c, task, seen = codec(path, memo), TaskContext.get().partitionId(), Counter()
        for b in batches:
            for first, texts in slices(b, 1, at_once):
                flat, at = c.encode(texts)
                ids = b.column(0).slice(first, len(texts)).to_pylist()
                raw = memoryview(np.insert(flat.astype("<u4"), at[1:], end_id).tobytes())
                at = (at + np.arange(len(at))).tolist()
                out = []
                for k, i in enumerate(ids):
                    n = at[k + 1] - at[k]
                    start, length = 0, n if n <= capacity else n % capacity or capacity
                    piece = 0
                    while start < n:
                        a = 4 * (at[k] + start)
                        out.append((i, piece, start, length, zlib.crc32(raw[a : a + 4 * length]), task, seen[length]))
                        seen[length] += 1
                        start, length, piece = start + length, capacity, piece + 1
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, kinds)], ["id", "piece", "start", "length", "ids_crc32", "task", "rank"])
        if memo < MEMO:  # memory matters more than the time to load the vocabulary again
            codec.cache_clear()

    schema = "id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = 0, memo: int = MEMO, at_once: int = SLICE) -> DataFrame:
    """One row per piece: (id_col, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut, the
    remainder first.  Null or empty text: the end id alone.  Null and repeated ids keep
    their rows.  Equal lengths are interchangeable; ties go by task and row.  An empty table
    gives an empty one.  ``memo`` and ``at_once`` trade a task's memory for speed, with the same
    result.  Sequences are numbered from 0 and filled from offset 0 without gaps.
    """
    pieces = materialise(token_pieces(docs, id_col, text_col, capacity, path or tokenizer_path(), end_id, memo, at_once))
    counts = materialise(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = Places(improve(best_fit(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.of(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(offset)], [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict[str, str] = {}
