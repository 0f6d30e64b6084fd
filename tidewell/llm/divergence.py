"""Source divergence audit: how differently the sources of a language use its terms.

``CountVectorizer`` is fitted for each language with a least document frequency and the
largest integer as vocabulary size, so its sparse vectors count every kept term exactly.
Non-zero entries are summed by (lang, source, term) as Summarizer does by group, but
without a dense buffer for each group: a batch of vectors becomes one row a (source, term).  Chances are whole billionths, smoothed by two
occurrences of every kept term, and divergences are whole numbers, too.

Pairs of sources are evaluated sparsely: each term lists the sources that have it, a task
adds up the divergence of those sources from all others over its terms, and terms that
neither of two sources has count by number.  A task's sums are flushed whenever they are
large; a language with very many sources is dealt out by parts of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What terms consist of: letters and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DF = 10
TOP = 10
CELLS = 1 << 22  # sums that a task holds for one language and part of its sources
ALL_TERMS = 2**31 - 1


#: Bytes of a text in UTF-8: A-Z lower-cased, what separates terms a space, all of other characters as they are.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their terms joined by one space."""
    for b in batches:
        texts = [b" ".join(t.translate(FOLD).split()) for t in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.binary()).cast(pa.string())], ["lang", "source", "terms"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, idx, count) of each batch of sparse vectors (source, indices, values): each pair once."""
    for b in batches:
        source, indices = b.column(0).dictionary_encode(), b.column(1)
        key = np.repeat(source.indices.to_numpy().astype(np.int64), np.diff(indices.offsets.to_numpy())) << 32 | indices.flatten().to_numpy()
        key, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, b.column(2).flatten().to_numpy(), len(key)).astype(np.int64)  # whole numbers, exact up to 2^53
        yield pa.record_batch([source.dictionary.take(pa.array(key >> 32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], ["source", "idx", "count"])


def counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str, min_df: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, cells, terms): all (lang, source), occurrences of kept terms (lang, source, idx, count), and (lang, idx, term)."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    rows = materialise(rows.mapInArrow(_folded, "lang string, source string, terms string"), by="lang")
    groups = materialise(rows.groupBy("lang", "source").agg(F.count(F.when(F.col("terms") != "", 1)).alias("docs")))
    cells, terms = None, []
    for (lang,) in sorted(groups.groupBy("lang").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= max(1, min_df)).select("lang").collect()):
        own = rows.where(F.col("lang") == lang).where("terms <> ''").select("source", F.split("terms", " ").alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=ALL_TERMS).fit(own)
        if not model.vocabulary:
            continue
        terms.append(pa.table({"lang": [lang] * len(model.vocabulary), "idx": pa.array(range(len(model.vocabulary)), pa.int32()), "term": model.vocabulary}))
        v = F.unwrap_udt(F.col("vector"))
        part = model.transform(own).select("source", v["indices"].alias("indices"), v["values"].alias("values")).mapInArrow(_summed, "source string, idx int, count long")
        part = part.groupBy("source", "idx").agg(F.sum("count").alias("count")).select(F.lit(lang).alias("lang"), "source", "idx", "count")
        cells = part if cells is None else cells.unionByName(part)
    if cells is None:
        return groups, spark.createDataFrame([], "lang string, source string, idx int, count long"), spark.createDataFrame([], "lang string, idx int, term string")
    return groups, materialise(cells), spark.createDataFrame(pa.concat_tables(terms))


def chance(count: str, total: str, size: str) -> F.Column:
    """1 + floor(1e9 (count + 2) / (total + 2 size)), exact beyond the range of long, where decimals take over."""
    wide = lambda x: f"cast({x} as decimal(20,0))"
    exact = f"(cast(1000000000 as decimal(10,0)) * ({wide(count)} + 2)) div ({wide(total)} + 2 * {wide(size)})"
    return F.expr(f"1L + case when {count} <= 9000000000 and {total} <= {1 << 61} and {size} <= {1 << 60} then (1000000000L * ({count} + 2)) div ({total} + 2 * {size}) else {exact} end")


def divergence(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _shared(groups: dict[str, tuple[np.ndarray, int]]):
    """Sums over terms of the divergence of source a from source b where a has the term, how many those are, and the same where both have it.

    groups: for each lang the chances of a term that a source doesn't have, by the source's place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def flushed():
            for (lang, part), x in held.items():
                a, b = np.nonzero(x[2] | x[3])
                yield pa.record_batch([pa.array([lang] * len(a), pa.string()), pa.array(a + part * groups[lang][1]), pa.array(b), *(pa.array(x[k][a, b]) for k in range(4))], ["lang", "a", "b", "value", "value_both", "n", "n_both"])
            held.clear()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            for lang in t.column("lang").unique().to_pylist():
                mine = t.filter(pa.compute.equal(t.column("lang"), lang)).combine_chunks()
                absent, size = groups[lang]
                lists = mine.column("have").combine_chunks()
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                src, p = (lists.flatten().field(k).to_numpy() for k in range(2))
                for lo in range(0, len(lists), step := max(1, CELLS // len(absent))):
                    cut = slice(*np.searchsorted(row, [lo, lo + step]))
                    r, s, c = row[cut] - lo, src[cut], p[cut]
                    full = np.tile(absent, (min(step, len(lists) - lo), 1))
                    there = np.zeros(full.shape, bool)
                    full[r, s], there[r, s] = c, True
                    for part in set(mine.column("part").slice(lo, step).to_pylist()):
                        if (lang, part) not in held:
                            if len(held) * CELLS >= 1 << 24:
                                yield from flushed()
                            held[lang, part] = np.zeros((4, min(size, len(absent) - part * size), len(absent)), np.int64)
                        into = held[lang, part]
                        ok = mine.column("part").slice(lo, step).to_numpy()[r] == part
                        for k in np.unique(s[ok]):
                            if not part * size <= k < (part + 1) * size:
                                continue
                            at = r[ok & (s == k)]
                            mine_p, others, both = full[at, k][:, None], full[at], there[at]
                            f = (mine_p - others) ** 2 // (mine_p + others)
                            into[:, k - part * size] += np.stack([f.sum(axis=0), (f * both).sum(axis=0), np.full(len(absent), len(at)), both.sum(axis=0)])
        yield from flushed()

    return run


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_df: int = MIN_DF, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: each other source of the lang with the divergence of both over the lang's
    kept terms (in ``min_df`` documents or more); part ``term``: the ``top`` terms that the
    source uses more than its lang does.  Ranks follow falling values, ties the item's bytes.

    Null lang, source and text are ''.  Documents of any length are read whole, and repeated
    rows and ids count each time.  A source without terms is compared like others; in a lang
    without kept terms all values are 0.  A lang with one source has no pairs.  An empty
    table gives an empty one.  Other columns aren't read, so their names don't matter.
    """
    groups, cells, terms = counts(docs, lang_col, source_col, text_col, min_df)
    size = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    total = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sized = groups.join(size, "lang", "left").join(total, ["lang", "source"], "left").na.fill(0, ["size", "total"]).withColumn("sid", place)
    sized = materialise(sized.withColumn("absent", F.when(F.col("size") > 0, chance("0", "total", "size"))))
    per = sized.where("size > 0").groupBy("lang").agg(F.expr("transform(array_sort(collect_list(struct(sid, absent))), x -> x.absent)").alias("absent"))
    known = {r["lang"]: (np.array(r["absent"], np.int64), max(1, CELLS // len(r["absent"]))) for r in per.collect()}  # one number a source; the result has one row a pair of them
    p = cells.join(sized.select("lang", "source", "size", "total", "sid"), ["lang", "source"]).withColumn("p", chance("count", "total", "size"))
    p = materialise(p.select("lang", "source", "sid", "idx", "count", "size", "p"))
    by_term = p.groupBy("lang", "idx").agg(F.collect_list(F.struct("sid", "p")).alias("have"))  # a source at most once
    parts = {k: -(-len(a) // n) for k, (a, n) in known.items()}
    many = F.coalesce(*[F.when(F.col("lang") == k, F.lit(n)) for k, n in parts.items() if n > 1], F.lit(1))
    dealt = by_term.select("lang", "have", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"))
    sums = dealt.mapInArrow(_shared(known), "lang string, a long, b long, value long, value_both long, n long, n_both long")
    sums = sums.groupBy("lang", "a", "b").agg(*[F.sum(c).alias(c) for c in ("value", "value_both", "n", "n_both")])
    return _pairs(sized, sums).unionByName(_terms(p, terms, top))


def _pairs(sized: DataFrame, sums: DataFrame) -> DataFrame:
    """All pairs of sources of a lang, as the result lists them, with values from what each side's terms add up to."""
    a = sized.select("lang", "source", F.col("sid").alias("a"), F.col("absent").alias("pa"), "size")
    b = sized.select("lang", F.col("source").alias("item"), F.col("sid").alias("b"), F.col("absent").alias("pb"))
    both = a.join(b, (a["lang"] == b["lang"]) & (a["a"] != b["b"])).drop(b["lang"]).withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    either = sums.groupBy("lang", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.sum("value").alias("value"), F.sum("n").alias("n"), F.max("value_both").alias("value_both"), F.max("n_both").alias("n_both"))
    rows = both.join(either, ["lang", "lo", "hi"], "left").na.fill(0, ["value", "value_both", "n", "n_both"])
    neither = F.expr("size - (n - n_both)") * F.coalesce(divergence("pa", "pb"), F.lit(0))
    rows = rows.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") - F.col("value_both") + neither).alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(p: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    whole = p.groupBy("lang", "idx").agg(F.sum("count").alias("all"), F.first("size").alias("size"))
    total = whole.groupBy("lang").agg(F.sum("all").alias("total"))
    q = whole.join(total, "lang").select("lang", "idx", chance("all", "total", "size").alias("q"))
    rows = p.join(q, ["lang", "idx"]).where("p > q").join(terms, ["lang", "idx"])
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_divergence": op12_divergence}
ORACLES = {
    "op12_divergence": rf"""
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') as terms from documents
), words as (select row, lang, source, unnest(terms) as term from docs),
kept as (select lang, term from words group by 1, 2 having count(distinct row) >= {MIN_DF}),
cells as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by 1, 2, 3),
grps as (select lang, source, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from docs) left join cells using (lang, source) group by 1, 2),
v as (select lang, count(*)::hugeint as size from kept group by 1),
p as (select g.lang, g.source, k.term, coalesce(n, 0) as n, (1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (total + 2 * size))::hugeint as p
  from grps g join v using (lang) join kept k using (lang) left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term),
whole as (select lang, term, sum(n)::hugeint as n, sum(sum(n)) over (partition by lang)::hugeint as total from cells group by 1, 2),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (total + 2 * size) as q from whole join v using (lang)),
dist as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0)::bigint as value from grps a join grps b on a.lang = b.lang and a.source <> b.source left join dist d on d.lang = a.lang and d.source = a.source and d.item = b.source),
above as (select p.lang, p.source, 'term' as part, p.term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pairs union all select * from above) qualify part = 'pair' or rank <= {TOP}
"""
}
