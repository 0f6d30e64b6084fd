"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

Unit vectors are projected on many random directions.  A pair collides in a projection if
one lies in the window centred on the other; a pair at cosine ``least`` or more collides in
each with a known chance, so a count threshold follows from the recall wanted.  Pairs that
reach it are verified in double precision, so none below ``least`` is linked.

Equal vectors are merged first.  Vectors of a label are cut into blocks and compared by
pairs of blocks; a task holds two blocks, returns each vector's number of links and a
spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import components, forest, materialise

PROJECTIONS = 32
WIDTH = 1.5  # half the window, in standard deviations of a pair's distance at ``least``
BLOCK = 2048
RECALL = 0.9995


def count_threshold(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the least cosine reaches with at least that chance."""
    p = math.erf(width / math.sqrt(2))
    missed = 0.0
    for k in range(projections + 1):
        missed += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if missed > 1 - recall:
            return k
    return projections


def candidates(a: np.ndarray, b: np.ndarray, least: float, projections: int, width: float, recall: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of unit vectors whose collision counts reach the threshold, in parts."""
    direction = np.random.default_rng(20240501).standard_normal((a.shape[1], projections))
    pa_, pb = a @ direction, b @ direction
    half = width * math.sqrt(2 - 2 * least)
    need = count_threshold(projections, width, recall)
    order = np.argsort(pb, axis=0).T.copy()
    for lo in range(0, len(a), 256):
        q = pa_[lo : lo + 256]
        count = np.zeros((len(q), len(b)), np.int8)
        for m in range(projections):
            line = pb[order[m], m]
            first = np.searchsorted(line, q[:, m] - half, "left").tolist()
            last = np.searchsorted(line, q[:, m] + half, "right").tolist()
            for k, (s, e) in enumerate(zip(first, last)):
                count[k, order[m, s:e]] += 1
        x, y = np.nonzero(count >= need)
        yield x + lo, y


def _pairs(least: float, projections: int, width: float, recall: float):
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        uid, copies, own, lo, hi = (t.column(k).to_numpy() for k in ("uid", "copies", "own", "lo", "hi"))
        raw = np.array(t.column("embedding").combine_chunks().flatten(), float).reshape(len(uid), -1)
        raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])  # by a power of two, so that squares neither under- nor overflow and no digit changes
        norm = np.sqrt((raw * raw).sum(axis=1))
        unit = raw / norm[:, None]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        same = int(lo[0]) == int(hi[0])
        degree, links_a, links_b = np.zeros(len(uid), np.int64), [], []
        for x, y in candidates(unit[left], unit[right], least, projections, width, recall):
            a, b = left[x], right[y]
            if same:
                keep = a < b
                a, b = a[keep], b[keep]
            cos = np.concatenate([[0.0], *((raw[a[k : k + 4096]] * raw[b[k : k + 4096]]).sum(axis=1) for k in range(0, len(a), 4096))])[1:] / (norm[a] * norm[b])
            a, b = a[cos >= least], b[cos >= least]
            np.add.at(degree, a, copies[b])
            np.add.at(degree, b, copies[a])
            u, v = forest(a, b)
            links_a.append(u)
            links_b.append(v)
        u, v = forest(np.concatenate(links_a), np.concatenate(links_b)) if links_a else (left[:0], left[:0])
        some = np.flatnonzero(degree)
        return pa.table({"link": pa.array(np.repeat([False, True], [len(some), len(u)])), "u": pa.array(np.concatenate([uid[some], uid[u]])), "v": pa.array(np.concatenate([degree[some], uid[v]]))})

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a key of the vector, null where it can't be compared."""
    for b in batches:
        keys: list[bytes | None] = []
        for v in b.column(2):
            x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, float) + 0.0
            ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
            keys.append(xxhash.xxh3_128_digest(x.tobytes()) if ok else None)
        yield pa.record_batch([*b.columns, pa.array(keys, pa.binary())], ["id", "label", "embedding", "key"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """One row per vector: (id_col, n_links, component_id, kept).

    n_links: other rows of the label at cosine ``least`` or more; component_id: the smallest
    id reachable by links; kept: whether that is its own.  A vector that is null, empty, zero
    or has null or non-finite components, or has a null label, links with nothing, as do
    vectors of different lengths.  Equal vectors are links of each other.  Repeated ids are
    rows of their own; a row with a null id has the component of what it links with, null if
    that has no id, and is not kept.  Vectors of any size are compared, as each is scaled first.
    Other columns aren't read, so their names don't matter.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = materialise(rows.mapInArrow(_keyed, "id long, label string, embedding array<double>, key binary"))
    usable = rows.where("key is not null and label is not null")
    once = usable.groupBy("label", "key").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    once = materialise(once.withColumn("dim", F.size("embedding")).withColumn("uid", F.monotonically_increasing_id()))
    blocks = once.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sides = once.join(blocks, ["label", "dim"]).withColumn("own", F.expr("cast(pmod(xxhash64(uid), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    sides = sides.select("label", "dim", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "uid", "copies", "embedding")
    found = materialise(sides.groupBy("label", "dim", "lo", "hi").applyInArrow(_pairs(least, projections, width, recall), "link boolean, u long, v long"))
    degree = found.where("not link").groupBy("u").agg(F.sum("v").alias("degree"))
    group = components(found.where("link").select("u", "v"))
    own = once.select("label", "key", "uid", "copies", "rep").join(degree, F.col("uid") == F.col("u"), "left").join(group, F.col("uid") == F.col("vertex"), "left").withColumn("component", F.coalesce("component", "uid"))
    own = materialise(own.select("label", "key", "component", "rep", (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links")))
    first = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    own = own.join(first, "component").select("label", "key", "n_links", "component_id")
    out = rows.select("id", "label", "key").join(own, ["label", "key"], "left")
    compared = F.col("n_links").isNotNull()
    component = F.when(compared, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op6_embeddings": op6_embeddings}
ORACLES = {
    "op6_embeddings": """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null
), links as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), reach(u, v) as (
  select vec_id, vec_id from embeddings
  union
  select r.u, l.v from reach r join links l on r.v = l.u
), component as (select u, min(v) as c from reach group by u),
degree as (select u, count(*) as n from links group by u)
select vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, vec_id = c as kept
from embeddings join component on component.u = vec_id left join degree on degree.u = vec_id
"""
}
