"""Quality rules as weak supervision.

Each rule votes for good, votes for bad, or abstains.  Expectation-maximisation over the
counts of vote patterns (at most three to the power of the rules, whatever the corpus)
estimates each rule's accuracy on good and on bad documents, and a document is kept if its
posterior probability of being good is at least one half.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialise, mix, rolling, trimmed

WINDOW = 8
GOOD, BAD, ABSTAIN = 0, 1, 2
Figures = dict[str, np.ndarray]
#: name: figure, good up to, bad from.  Between them a rule abstains.
RULES: dict[str, tuple[Callable[[Figures], np.ndarray], float, float]] = {
    "repeats": (lambda x: x["n_repeat_words"] / x["n_words"], 0.02, 0.20),
    "symbols": (lambda x: x["n_symbols"] / x["word_chars"], 0.004, 0.04),
    "capitals": (lambda x: x["n_upper"] / x["letters"], 0.12, 0.50),
    "exclaims": (lambda x: x["n_exclaims"] / x["n_words"], 0.02, 0.25),
    "lines": (lambda x: x["n_dup_lines"] / x["n_lines"], 0.02, 0.30),
    "variety": (lambda x: -x["n_distinct"] / np.sqrt(x["n_words"]), -4.0, -0.80),
    "word_size": (lambda x: np.abs(x["word_chars"] / x["n_words"] - 6), 2.0, 8.0),
    "prose": (lambda x: -x["n_stops"] / x["n_words"], -0.04, -0.005),
    "plain": (lambda x: x["n_odd"] / x["word_chars"], 0.01, 0.05),
}
#: What is believed of a rule's accuracies beforehand, and the weight of that belief in votes, the same for every corpus.
BELIEF, WEIGHT = 0.9, 20.0
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "letters", "n_exclaims", "n_lines", "n_distinct", "n_stops", "n_odd")

_KIND = np.zeros(256, np.uint8)  # bits: 1 code point outside white space, 2 symbol, 4 upper case, 8 letter, 16 exclamation mark, 32 sign that prose lacks
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (_b & 0xC0 != 0x80 and not (_b == 0x20 or 9 <= _b <= 13)) | 2 * (_c in "#*$%&|<>") | 4 * ("A" <= _c <= "Z") | 8 * (_b < 128 and _c.isalpha()) | 16 * (_c == "!") | 32 * (_c in "!#$%&*+/<=>@[]\\^_`{|}~")


def figures(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The figures of each text, as whole arrays."""
    out = {k: np.zeros(len(texts), np.int64) for k in FIGURES}
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    kind = _KIND[np.frombuffer(b"".join(texts), np.uint8)]
    ends = np.concatenate([[0], np.cumsum(size)])
    for bit, name in enumerate(("word_chars", "n_symbols", "n_upper", "letters", "n_exclaims", "n_odd")):
        out[name] = np.diff(np.concatenate([[0], np.cumsum((kind >> bit) & 1, dtype=np.int64)])[ends])
    hashes: list[int] = []
    f = xxhash.xxh3_64_intdigest
    for k, t in enumerate(texts):
        words = t.split()
        out["n_words"][k] = len(words)
        out["n_distinct"][k] = len(set(words))
        out["n_stops"][k] = t.count(b". ") + t.count(b", ") + t.count(b".\n") + t.count(b",\n") + t.endswith(b".")
        hashes += map(f, words)
        lines = [x for x in t.split(b"\n") if x.strip()]
        out["n_lines"][k], out["n_dup_lines"][k] = len(lines), len(lines) - len(set(lines))
    word = np.array(hashes, np.uint64)
    doc = np.repeat(np.arange(len(texts)), out["n_words"])
    window = rolling(word, WINDOW)
    inside = np.flatnonzero(doc[: len(window)] == doc[WINDOW - 1 :]) if len(window) else np.empty(0, np.int64)
    key = window[inside] ^ mix(doc[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(word) + 1, np.int64)
    start = inside[twice]
    np.add.at(cover, start, 1)
    np.add.at(cover, start + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=len(texts)).astype(np.int64)
    return out


def votes(x: Figures) -> np.ndarray:
    """The votes of all rules on each text as one number in base three; a rule without words to judge abstains."""
    out = np.zeros(len(x["n_words"]), np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        for j, (figure, good, bad) in enumerate(RULES.values()):
            v = figure(x)
            vote = np.where(v >= bad, BAD, np.where(v <= good, GOOD, ABSTAIN))
            out += np.where(np.isfinite(v), vote, ABSTAIN) * 3**j
    return out


def em(patterns: np.ndarray, counts: np.ndarray, rules: int, rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, and each rule's accuracies: how often its vote is right on good and on bad ones.

    Starts from "bad if any rule says bad".  BELIEF counts as WEIGHT votes of each rule on
    either kind, which ties the two classes to the words good and bad.
    """
    vote = (patterns[:, None] // 3 ** np.arange(rules)) % 3
    good = np.where((vote == BAD).any(axis=1), 0.1, 0.95)
    prior, on_good, on_bad = 0.5, np.full(rules, BELIEF), np.full(rules, BELIEF)
    for _ in range(rounds):
        prior = float((counts @ good + 1) / (counts.sum() + 2))
        on_good = ((counts * good) @ (vote == GOOD) + BELIEF * WEIGHT) / ((counts * good) @ (vote != ABSTAIN) + WEIGHT)
        on_bad = ((counts * (1 - good)) @ (vote == BAD) + BELIEF * WEIGHT) / ((counts * (1 - good)) @ (vote != ABSTAIN) + WEIGHT)
        new = posterior(patterns, prior, on_good, on_bad)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return prior, on_good, on_bad


def posterior(patterns: np.ndarray, prior: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    """The probability of good for each vote pattern."""
    vote = (patterns[:, None] // 3 ** np.arange(len(on_good))) % 3
    odds = np.log(prior / (1 - prior)) + (vote == GOOD) @ np.log(on_good / (1 - on_bad)) + (vote == BAD) @ np.log((1 - on_good) / on_bad)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _texts(b: pa.RecordBatch, first: int) -> Iterator[bytes]:
    """Texts of a batch from a row on, a few rows at a time."""
    for k in range(first, b.num_rows, 256):
        for t in b.column(1).slice(k, 256).field("text").cast(pa.binary()).to_pylist():
            yield t or b""


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, figures..., pattern, and the columns to keep as one struct)."""
    own = F.col(text_col).cast("string").alias("text")
    rest = [F.col(f"`{c}`") for c in keep if c != text_col]
    held = F.struct(own, F.struct(*rest).alias("rest") if rest else F.lit(None).cast("int").alias("rest")) if keep else F.struct(own)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"))  # a text to keep is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = 0
            while first < b.num_rows:
                last, size, texts = first, 0, []
                for t in _texts(b, first):
                    if texts and size + len(t) > 4 << 20:
                        break
                    texts.append(t)
                    size += len(t)
                    last += 1
                x = figures(texts)
                yield pa.record_batch([b.column(0).slice(first, last - first), *(pa.array(x[k]) for k in FIGURES), pa.array(votes(x)), b.column(1).slice(first, last - first) if keep else pa.nulls(last - first, pa.int32())], ["id", *FIGURES, "pattern", "held"])
                first = last

    return rows.mapInArrow(trimmed(run), "id long, " + ", ".join(f"{k} long" for k in FIGURES) + f", pattern long, held {rows.schema['held'].dataType.simpleString() if keep else 'int'}")


def learn(rows: DataFrame) -> dict[int, float]:
    """The posterior of every vote pattern that occurs: at most 3 ** len(RULES) entries."""
    seen = sorted((r["pattern"], r["n"]) for r in rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())
    patterns, counts = np.array([p for p, _ in seen], np.int64), np.array([n for _, n in seen], float)
    if not len(patterns):
        return {}
    return dict(zip(patterns.tolist(), posterior(patterns, *em(patterns, counts, len(RULES))).tolist()))


def _judged(rows: DataFrame, good: dict[int, float]) -> DataFrame:
    table = rows.sparkSession.createDataFrame(sorted(good.items()), "pattern long, posterior double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # bounded by the number of rules, see learn()
    return rows.join(F.broadcast(table), "pattern", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("posterior", F.lit(1.0)) >= 0.5))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior).

    Null or empty text: no words, so it fails the base rules.  Null and repeated ids are
    kept.  Texts are measured whole.  An empty table gives an empty one.  Other columns
    aren't read, so their names don't matter.
    """
    rows = materialise(measured(docs, id_col, text_col).drop("held"))
    return _judged(rows, learn(rows)).select(F.col("id").alias(id_col), *FIGURES[:5], "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with their columns, whatever their names.

    Texts are measured once, and their figures kept with them.
    """
    rows = materialise(measured(docs, id_col, text_col, tuple(docs.columns)))
    rows = _judged(rows, learn(rows)).where("kept")
    held = F.col("held")
    kind = docs.schema[text_col].dataType
    return rows.select(*[held["text"].cast(kind).alias(c) if c == text_col else held["rest"].getField(c).alias(c) for c in docs.columns])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
