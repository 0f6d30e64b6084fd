"""SimHash near-duplicates through Gray-order hierarchical indexes.

Fingerprints at ``distance`` or fewer differing bits agree on all bits of one of
``distance`` + 1 segments, so each fingerprint stands in that many tables, once for each
segment, and is looked up among those of its segment value.  A task sorts its table rows by
segment value and Gray rank and builds one index over them all: up to eight neighbours are a
leaf, and each node holds the bits its children share (mask and pattern), the bits already
held by its parent factored out.  Every fingerprint is searched from the root of its segment
value: differences add up on the way down, and a node is pruned, with all below it, once they
exceed the distance.  Links leave a task as a spanning forest, never as all pairs.

A segment value with more than ``block`` fingerprints is cut into blocks and searched by
pairs of blocks, so no task holds more than two blocks and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import components, forest, joined_once, local_components, materialise, trimmed

BLOCK = 16384
FAN = 8
QUERIES_AT_ONCE = 1 << 14
ROWS_AT_ONCE = 1 << 19


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes | None, width: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    f = xxhash.xxh64_intdigest
    if len(words) <= width:
        return f(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    ones, n = np.zeros(64, np.int64), len(words) - width + 1
    for k in range(0, n, 1 << 15):
        hashes = [f(line[a:b], 42) for a, b in zip(starts[k : min(n, k + (1 << 15))].tolist(), ends[k + width - 1 : min(n, k + (1 << 15)) + width - 1].tolist())]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long): fp is null for no row; a text without words, or null, has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([fingerprint(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(run), "id long, fp long")


# ---------------------------------------------------------------- the index


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code (uint64) in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(k))
    return code


class GrayIndex:
    """Trees of (pattern, mask) over codes in Gray order, one tree for each run; level 0 has the codes themselves.

    ``begin[k][x]`` is the first of the children, one level below, of node x of level k + 1;
    ``last[k][x]`` the last code below node x of level k.
    """

    def __init__(self, codes: np.ndarray, run: np.ndarray | None = None):
        """run: rows of a tree stand together and share a number; without it all codes are one tree."""
        n = len(codes)
        run = np.zeros(n, np.int64) if run is None else run
        self.run, self.levels, self.begin, self.last = run, [(codes, np.full(n, ~np.uint64(0)))], [], [np.arange(n)]
        self.pruned = self.visited = 0
        while True:
            fresh = np.ones(len(run), bool)
            fresh[1:] = run[1:] != run[:-1]
            if fresh.all():
                break
            start = np.flatnonzero(fresh)
            within = np.arange(len(run)) - np.repeat(start, np.diff(np.append(start, len(run))))
            at = np.flatnonzero(within % FAN == 0)
            size = np.diff(np.append(at, len(run)))
            p, m = self.levels[-1]
            shared = np.bitwise_and.reduceat(m & ~(p ^ np.repeat(p[at], size)), at)
            self.levels.append((p[at] & shared, shared))
            self.begin.append(at)
            self.last.append(self.last[-1][at + size - 1])
            run = run[at]
        # what a parent holds is factored out of its children
        self.residual = [m & ~np.repeat(up[1], self._size(k)) for k, ((_, m), up) in enumerate(zip(self.levels, self.levels[1:]))]
        self.residual.append(self.levels[-1][1])
        self.root = np.searchsorted(run, self.run)  # a code's own tree; runs are numbered upwards

    def _size(self, level: int) -> np.ndarray:
        return np.diff(np.append(self.begin[level], len(self.levels[level][0])))

    def links(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """A forest of links (code, least place reachable) that connects what pairs at up to ``distance`` connect, and no more."""
        codes = self.levels[0][0]
        n, top = len(codes), len(self.levels) - 1
        first = [np.arange(n)]
        for at in self.begin:
            first.append(first[-1][at])
        label, out_a, out_b = np.arange(n), [], []
        for lo in range(0, n, QUERIES_AT_ONCE):
            uniform = [label]  # the component that all codes below a node belong to, or -1
            for at in self.begin:
                u = uniform[-1]
                low, high = np.minimum.reduceat(u, at), np.maximum.reduceat(u, at)
                uniform.append(np.where(low == high, low, -1))
            ask = np.arange(lo, min(n, lo + QUERIES_AT_ONCE))
            node, acc = self.root[ask], np.zeros(len(ask), np.int64)
            for level in range(top, -1, -1):
                pattern, mask = self.levels[level]
                # pairs are looked for forwards, and not within what is one component already
                keep = (self.last[level][node] > ask) & (uniform[level][node] != label[ask])
                ask, node, acc = ask[keep], node[keep], acc[keep]
                acc = acc + np.bitwise_count((codes[ask] ^ pattern[node]) & self.residual[level][node])
                keep = acc <= distance
                self.visited, self.pruned = self.visited + len(keep), self.pruned + int((~keep).sum())
                ask, node, acc = ask[keep], node[keep], acc[keep]
                # with so few bits open, every code below is within the distance of the query and of each other
                sure = acc + np.bitwise_count(~mask[node]) <= distance
                if sure.any():
                    begin = first[level][node[sure]]
                    out_a.append(ask[sure])
                    out_b.append(begin)
                    if level:
                        whole = np.unique(node[sure])
                        size = self.last[level][whole] - first[level][whole] + 1
                        head = np.repeat(first[level][whole], size)
                        out_a.append(head)
                        out_b.append(head + np.arange(len(head)) - np.repeat(np.cumsum(size) - size, size))
                    ask, node, acc = ask[~sure], node[~sure], acc[~sure]
                if level:
                    size = self._size(level - 1)[node]
                    child = np.repeat(self.begin[level - 1][node] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                    ask, acc, node = np.repeat(ask, size), np.repeat(acc, size), child
            if len(out_a):
                a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b = [a], [b]
                label = local_components(n, a, b)
        if not out_a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_a), np.concatenate(out_b)


def search_runs(run: np.ndarray, code: np.ndarray, rep: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of representatives within each run, which connect what pairs within runs connect."""
    order = np.lexsort((gray_rank(code), run))
    x, y = GrayIndex(code[order], run[order]).links(distance)
    return rep[order[x]], rep[order[y]]


def _search(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) < ROWS_AT_ONCE:
                continue
            at = np.flatnonzero(_change(held))
            if len(at):
                cut = int(at[-1]) + 1  # the last run may go on
                yield _found([x[:cut] for x in held], distance)
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield _found(held, distance)

    return run


def _change(cols: list[np.ndarray]) -> np.ndarray:
    return np.any([x[1:] != x[:-1] for x in cols[:4]], axis=0)


def _found(cols: list[np.ndarray], distance: int) -> pa.RecordBatch:
    run = np.concatenate([[0], np.cumsum(_change(cols))])
    u, v = search_runs(run, cols[4].view(np.uint64), cols[5], distance)
    return pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of distance + 1 segments of nearly one size."""
    cuts = [round(64 * k / (distance + 1)) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def link_fingerprints(fps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(u, v): links between representatives (rep long) of distinct fingerprints (fp long), at any distance from 0 to 63."""
    keys = [f"struct({t} as t, shiftrightunsigned(fp, {s}) & {(1 << w) - 1 if w < 64 else -1}L as key)" for t, (s, w) in enumerate(segments(distance))]
    rows = fps.select("fp", "rep", F.explode(F.expr(f"array({', '.join(keys)})")).alias("k")).select("k.t", "k.key", "fp", "rep")
    hot = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = hot.select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(hot, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(fp), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "rep")
    return rows.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi").mapInArrow(trimmed(_search(distance)), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: (id_col, fingerprint, component_id).

    fingerprint: 16 hex digits of the ``width``-word SimHash; component_id: the smallest id
    reachable by fingerprints ``distance`` or fewer bits apart, itself included.

    Null or empty text: fingerprint zero, which links like any other.  Null ids: the row
    stays and links like any other, but has no id to give, so its component's id is null if
    no document with an id is reachable.  Repeated rows each give a row.  An empty table
    gives an empty one.  Other columns are not read, so their names don't matter.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, width))
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(link_fingerprints(distinct.select("fp", F.col("fp").alias("rep")), distance))  # vertices are fingerprints
    placed = materialise(distinct.join(found, F.col("fp") == F.col("vertex"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = materialise(joined_once(placed.select("fp", "root"), "root", least).select("fp", "component_id"))
    return joined_once(fps, "fp", placed).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
