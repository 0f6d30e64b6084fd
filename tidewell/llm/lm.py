"""LM scoring with a probabilistic suffix tree over words.

The tree's states are contexts of up to ``DEPTH`` words.  A context is a state if a divergence
test favours it: over its training occurrences, its own next-word counts, each with the
occurrence itself left out, must predict better than its parent's distribution.  Nothing else
decides, in any corpus: contexts seen once can't pass the test, so they are left out unasked,
and a context with the same occurrences as its parent has the parent's counts and can't pass
either, so it isn't asked for either.
Next-word distributions are smoothed towards the parent's by the number of different next
words (Witten-Bell), and a word is scored in the longest suffix state of its history.

Counts live in hash buckets.  At each depth a chunk sends its distinct pairs of context and
next word, with local sums, to the buckets of the contexts, which count, test and reply.  So a
context or pair that fills a third of the corpus sends one entry per chunk and next word, and
a context with ``HOT`` occurrences or more is split over buckets by its next words; the parts'
sums, at most two for every HOT training tokens, come back through the driver.

Words are known by 64-bit hashes, contexts by 48 bits within their bucket, next words by 32
bits within their context.  Between depths a chunk keeps, for tokens with a longer context to
test, their probability (single precision) and counts, and of its texts only the words of those
contexts; so the texts' snapshot goes after the first round, and what is read gets less with
each depth.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import attach, bucketed, buckets, discard, each_chunk, materialise, mix, powers, reduce_buckets, scatter, snapshot, split_sorted

CHUNK = 4 << 20
#: Words of the longest context; rounds end earlier where longer contexts tell nothing new.
DEPTH = 8
#: Weight of the parent in the divergence test, and the gain (natural log) that makes a state.
PRIOR, GAIN = 4.0, 3.0
#: Occurrences from which a context is split over buckets.
HOT = 1 << 21
#: Steps of a natural log of a probability in messages.
LOG_STEP = 2048
WORDS = (1 << 63).to_bytes(8, "little")  # begins a tree before any contexts; others begin with how many tokens ask
TREE = -1  # stands for a bucket where a chunk's tree is among its messages
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # not a word
_PART = np.uint64(0xA24BAED4963EE407)


def in_training(doc_id: int | None) -> bool:
    """crc32 of the id as text mod 5 is not 1; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value of an array of uint64, in ascending order; and where each element's value is among them."""
    order = _ascending(key)
    x = key[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(fresh) - 1
    return order[fresh], at


def _ascending(key: np.ndarray) -> np.ndarray:
    """argsort of uint64, not stable: numbers with their places as low bits sort faster than places by number; where leading bits don't tell, it is one."""
    bits = np.uint64(len(key).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(len(key), dtype=np.uint64)
    small = len(key) > 0 and int(key.max()) < 1 << 64 - int(bits)
    place |= key << bits if small else key & ~low
    place.sort()
    order = (place & low).astype(np.int64)
    if not small and (x := key[order]).size and (x[1:] < x[:-1]).any():
        return np.argsort(key)
    return order


# ---------------------------------------------------------------- words


def _word_messages(key: np.ndarray, count: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Sorted distinct words and their training occurrences, by bucket."""
    bounds = [0, *split_sorted(key, n_buckets).tolist(), len(key)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if b > a:
            yield k, (b - a).to_bytes(8, "little") + key[a:b].tobytes() + _press(count[a:b].astype(np.uint32).tobytes())


def _word_totals(key: np.ndarray, n_buckets: int, replies: dict[int, bytes]) -> np.ndarray:
    bounds = np.concatenate([[0], split_sorted(key, n_buckets), [len(key)]])
    out = np.zeros(len(key), np.int64)
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        out[bounds[k] : bounds[k + 1]] = np.frombuffer(_open(replies[k]), np.int64)
    return out


def _count_words(bucket: int, chunks: list, payloads: list) -> pa.Table:
    """Totals of each word; and a row for chunk -1: their sum, and how many occur in training."""
    keys, counts = [], []
    for x in payloads:
        n = int.from_bytes(x[:8], "little")
        keys.append(np.frombuffer(x, np.uint64, n, 8))
        counts.append(np.frombuffer(_open(x[8 + 8 * n :]), np.uint32))
    row, at = distinct(np.concatenate(keys))
    total = np.bincount(at, np.concatenate(counts), len(row)).astype(np.int64)
    parts = np.split(total[at], np.cumsum([len(x) for x in keys])[:-1])
    out = [_press(x.tobytes()) for x in parts] + [np.array([total.sum(), (total > 0).sum()], "<i8").tobytes()]
    return _rows(bucket, [*chunks, -1], out)


def _rows(bucket: int, chunks: list, payloads: list) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": pa.array([bucket] * len(chunks), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _press(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _open(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of one place together, which packs better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


class Reader:
    """Arrays one after the other in a buffer."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, kind: type, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def planes(self, kind: type, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(self.take(np.uint8, n * size).reshape(size, n).T).view(kind).ravel()

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(self.take(np.uint8, (n + 7) // 8), count=n).astype(bool)


#: Bytes of words hashed at a time, and a random number for each byte, the same for A-Z as for a-z.
BLOCK = 1 << 20
LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LETTER[65:91] = LETTER[97:123]
GAP = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BASE = 0xD6E8FEB86659FD93


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins, and its hash, A-Z lower-cased; the text's bytes begin and end with white space."""
    gap = GAP[text]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    out = np.empty(len(begin), np.uint64)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + BLOCK)))  # one word at least
        at, n = begin[a], int(end[b - 1] - begin[a])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTER[text[at : at + n]] * powers(_BASE, n), out=sums[1:])
        out[a:b] = (sums[end[a:b] - at] - sums[begin[a:b] - at]) * powers(_BASE, n, True)[begin[a:b] - at]
        a = b
    return begin, mix(out)


def tokens_packed(ids: list, texts: list) -> bytes:
    """A chunk's tokens: distinct hashes in order, and each token's place among them."""
    begin, word = word_hashes(np.frombuffer(b"\n".join([b"", *(t or b"" for t in texts), b""]), np.uint8))
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    count = np.diff(np.searchsorted(begin, ends, "right"), prepend=0) + 1
    token = np.full(int(count.sum()), END)
    body = np.ones(len(token), bool)
    body[np.cumsum(count) - 1] = False
    token[body] = word
    row, at = distinct(token)
    return _press(_tokens(ids, count, token[row], at, count), 3)


def _tokens(ids: list, count: np.ndarray, key: np.ndarray, at: np.ndarray, kept: np.ndarray) -> bytes:
    """kept: how many of each document's tokens stand in ``at``."""
    head = np.array([len(ids), len(key), len(at)], np.int64)
    null = np.array([i is None for i in ids], bool)
    parts = [head, np.array([0 if i is None else i for i in ids], np.int64), null, count, kept, key]
    return b"".join(x.tobytes() for x in [*parts, at.astype("<u2"), (at >> 16).astype("<u2")])


# ---------------------------------------------------------------- pairs of context and next word


class Pairs:
    """Distinct pairs of context and next word of some tokens, sorted by context.

    Within a context, pairs stand in the order of the chunk's words.
    """

    def __init__(self, context: np.ndarray, key: np.ndarray, at: np.ndarray, total: np.ndarray):
        """key[at]: the next words."""
        pair = lambda rows: mix(self.whole[rows] * np.uint64(0x9FB21C651E98DF25) + key[at[rows]])
        self.parts = total // HOT + 1
        hot = np.flatnonzero(self.parts > 1)
        self.whole = context
        if len(hot):
            context = context.copy()
            context[hot] = part_of(context[hot], pair(hot) % self.parts[hot].astype(np.uint64))
        order = _ascending(context)
        c = context[order]
        begins = np.ones(len(order), bool)
        begins[1:] = c[1:] != c[:-1]
        group = np.cumsum(begins) - 1
        word = (group * len(key) + at[order]).astype(np.uint64)  # of a chunk's groups and words
        inner = _ascending(word)
        order, word, group = order[inner], word[inner], group[inner]
        fresh = np.ones(len(order), bool)
        fresh[1:] = word[1:] != word[:-1]
        self.at = np.empty(len(order), np.int64)
        self.at[order] = np.cumsum(fresh) - 1
        self.row = order[fresh]  # a token of each pair
        self.context, self.pair, self.of = context[self.row], pair(self.row), group[fresh]
        self.begin = np.flatnonzero(np.diff(self.of, prepend=-1))

    def bounds(self, n_buckets: int) -> list[int]:
        """Where each bucket's pairs begin: a context's bucket is its range of the hash space."""
        return [0, *np.searchsorted(self.context >> np.uint64(24), np.arange(1, n_buckets, dtype=np.uint64) * _width(n_buckets)).tolist(), len(self.row)]

    def messages(self, count: np.ndarray, p: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
        """count: training occurrences of each pair; p: its probability under shorter contexts."""
        log = np.minimum(np.round(-np.log(p) * LOG_STEP), 65535).astype("<u2")
        bounds = self.bounds(n_buckets)
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                first, last = self.of[a], self.of[b - 1] + 1
                begin = self.begin[first:last]
                size = np.diff(np.append(begin, b)).astype("<u4")
                split = np.flatnonzero(self.parts[self.row[begin]] > 1).astype("<u4")
                head = np.array([last - first, b - a, len(split)], "<u4").tobytes()
                key = np.ascontiguousarray(self.context[begin].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                rest = _press(size.tobytes() + count[a:b].astype("<u4").tobytes() + split.tobytes() + _planes(log[a:b]))
                yield k, head + key + self.pair[a:b].astype("<u4").tobytes() + rest

    def learn(self, n_buckets: int, replies: dict[int, bytes], hot: dict[tuple[int, int], tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
        """For each pair: occurrences, and the different next words of its context, 0 if that is no state."""
        kinds, count = np.zeros(len(self.begin), np.int64), np.zeros(len(self.row), np.int64)
        bounds = self.bounds(n_buckets)
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                first, last = self.of[a], self.of[b - 1] + 1
                raw = Reader(_open(replies[k]))
                kinds[first:last], count[a:b] = raw.take(np.uint32, last - first), raw.take(np.uint32, b - a)
        known: dict[int, int] = {}
        for j in np.flatnonzero(self.parts[self.row[self.begin]] > 1).tolist():
            row = self.row[self.begin[j]]
            whole, parts = self.whole[row], int(self.parts[row])
            if int(whole) not in known:
                keys = part_of(np.full(parts, whole), np.arange(parts, dtype=np.uint64))
                got = [hot.get((int(x >> np.uint64(24)) // int(_width(n_buckets)), int(x) & ((1 << 48) - 1)), (0.0, 0.0, 0.0)) for x in keys]
                n, different, gain = (sum(x) for x in zip(*got))
                known[int(whole)] = int(different) if is_state(n, gain) else 0
            kinds[j] = known[int(whole)]
        return count, kinds[self.of]


def part_of(context: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The key of a part of a context with many occurrences."""
    return mix(context + (part + np.uint64(1)) * _PART)


def _width(n_buckets: int) -> np.uint64:
    return np.uint64(((1 << 40) + n_buckets - 1) // n_buckets)


def is_state(n, gain):  # noqa: ANN001, ANN201  of one context or of arrays
    """The divergence test: n occurrences, and the sum over them of log of (count - 1 + PRIOR p) / p."""
    return (n > 0) & (gain - n * np.log(n + PRIOR) >= GAIN)


def _count_pairs(bucket: int, chunks: list, payloads: list) -> pa.Table:
    """Replies, and a row for chunk -1 with what split contexts add up to here."""
    key, size, pair, count, log, split, width = [], [], [], [], [], [], []
    for x in payloads:
        contexts, pairs, n_split = np.frombuffer(x, "<u4", 3).tolist()
        own = np.zeros((contexts, 8), np.uint8)
        own[:, :6] = np.frombuffer(x, np.uint8, 6 * contexts, 12).reshape(contexts, 6)
        key.append(own.view("<u8").ravel())
        pair.append(np.frombuffer(x, "<u4", pairs, 12 + 6 * contexts))
        raw = Reader(_open(x[12 + 6 * contexts + 4 * pairs :]))
        size.append(raw.take(np.uint32, contexts))
        count.append(raw.take(np.uint32, pairs))
        split.append(raw.take(np.uint32, n_split).astype(np.int64) + sum(c for c, _ in width))
        log.append(raw.planes(np.uint16, pairs))
        width.append((contexts, pairs))
    contexts, sizes = np.concatenate(key), np.concatenate(size)
    spread = mix(contexts)
    row, at = distinct(np.repeat(spread, sizes) + np.concatenate(pair).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first, place = distinct(spread)
    own, of = contexts[first], np.repeat(place, sizes)[row]
    c = np.bincount(at, np.concatenate(count), len(row))
    logs = np.concatenate(log)[row] / LOG_STEP
    with np.errstate(divide="ignore"):
        gain = np.where(c > 0, c * (np.log(np.maximum(c - 1, 0) + PRIOR * np.exp(-logs)) + logs), 0.0)
    n, kinds, gain = np.bincount(of, c, len(own)), np.bincount(of, c > 0, len(own)), np.bincount(of, gain, len(own))
    verdict = np.where(is_state(n, gain), kinds, 0).astype("<u4")
    cuts = np.cumsum(width, axis=0)[:-1].T
    out = [_press(a.tobytes() + b.tobytes()) for a, b in zip(np.split(verdict[place], cuts[0]), np.split(c[at].astype("<u4"), cuts[1]))]
    k = np.unique(place[np.concatenate(split)])
    if len(k):
        return _rows(bucket, [*chunks, -1], [*out, np.stack([own[k].astype(float), n[k], kinds[k], gain[k]]).tobytes()])
    return _rows(bucket, chunks, out)


class Tree:
    """A chunk's tokens and what is known of them before contexts of ``depth`` words are asked for.

    ``rows`` are the tokens whose context of that many words has two training occurrences or
    more (``total``), ``p`` their probabilities under shorter contexts.  ``same``: the context
    occurs where its parent does, so the pair's count (``count``) is known.  Other tokens are
    settled: only the sum of their logs by document is kept.
    """

    def __init__(self, raw: Reader):
        n, k, size = raw.take(np.int64, 3).tolist()
        ids, null = raw.take(np.int64, n), raw.take(bool, n)
        self.ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
        self.count_of, kept = raw.take(np.int64, n), raw.take(np.int64, n)
        self.key = raw.take(np.uint64, k)
        low, high = raw.take(np.uint16, size), raw.take(np.uint16, size)
        self.at = low | (high.astype(np.uint32) << np.uint32(16))
        self.doc = np.repeat(np.arange(n), kept)
        self.train_doc = np.array([in_training(i) for i in self.ids], bool)

    @classmethod
    def of_tokens(cls, blob: bytes) -> Tree:
        t = cls(Reader(_open(blob)))
        t.first = np.diff(t.doc, prepend=-1) > 0  # an end is in each document
        return t

    @classmethod
    def of(cls, blob: bytes, n: int, v: int) -> Tree:
        if blob[:8] == WORDS:  # no contexts yet: totals of the chunk's words say all
            size = int.from_bytes(blob[8:16], "little")
            t = cls.of_tokens(blob[16 : 16 + size])
            t.learn_words(np.frombuffer(_open(blob[16 + size :]), np.int64), n, v)
            return t
        raw = Reader(_open(blob[8:]))
        t = cls(raw)
        n = len(t.ids)
        rows, t.depth, same = raw.take(np.int64, 3).tolist()
        t.known, t.base, t.settled = raw.take(float, 3 * n).reshape(3, n)
        t.rows, t.same = np.flatnonzero(raw.bits(len(t.at))), raw.bits(rows)
        t.p, t.total, t.count = raw.planes(np.float32, rows), raw.planes(np.uint32, rows).astype(np.int64), raw.planes(np.uint32, same).astype(np.int64)
        t.first = np.zeros(len(t.at), bool)  # a first word has no context of two, and isn't among the rows
        return t

    def by_doc(self, x: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(self.doc[rows], x, len(self.ids))

    def train_counts(self) -> np.ndarray:
        return np.bincount(self.at, self.train_doc[self.doc], len(self.key))

    def learn_words(self, total: np.ndarray, n: int, v: int) -> None:
        c, p = total[self.at], (total + 0.5) / (n + 0.5 * (v + 1))
        self.known, self.base = self.by_doc((c > 0).astype(float)), self.by_doc(np.log10(p)[self.at])
        p = p[self.at]
        self.settled, self.depth, self.rows, self.total = np.zeros(len(self.ids)), 0, np.arange(len(p)), np.full(len(p), n)
        before = np.roll(c, 1)
        before[self.first] = total[np.searchsorted(self.key, END)]  # before a first word stands the end of the text before
        self._to(p.astype(np.float32), c, before)

    def _to(self, p: np.ndarray, count: np.ndarray, before: np.ndarray) -> None:
        """To longer contexts, which occur ``before`` times."""
        go = before >= 2
        self.settled = self.settled + self.by_doc(np.log10(p[~go].astype(float)), self.rows[~go])
        self.same, self.depth = (before == self.total)[go], self.depth + 1
        self.rows, self.p, self.total, self.count = self.rows[go], p[go], before[go], count[go][self.same]

    def packed(self) -> bytes:
        """With the tokens of the rows and of their contexts; those of longer ones are among them, as the word before a row has a row itself until then."""
        kept, active, used = np.zeros(len(self.at), bool), np.zeros(len(self.at), bool), np.zeros(len(self.key), bool)
        active[self.rows] = True
        for back in range(self.depth + 1):
            kept[self.rows - back] = True  # before a chunk's first word stands its last end
        at = self.at[kept]
        used[at] = True
        tokens = _tokens(self.ids, self.count_of, self.key[used], (np.cumsum(used) - 1)[at], np.bincount(self.doc[kept], minlength=len(self.ids)))
        parts = [np.array([len(self.rows), self.depth, len(self.count)], np.int64), self.known, self.base, self.settled, np.packbits(active[kept]), np.packbits(self.same)]
        body = b"".join(x.tobytes() for x in parts) + _planes(self.p.astype("<f4")) + _planes(self.total.astype("<u4")) + _planes(self.count.astype("<u4"))
        return int((~self.same).sum()).to_bytes(8, "little") + _press(tokens + body)

    def pairs(self) -> Pairs:
        rows = self.rows[~self.same]
        hashes = self.key[self.at]
        word = lambda back: hashes[rows - back]  # noqa: E731  before a chunk's first word stands its last end
        context = word(1)
        for back in range(2, self.depth + 1):
            context = mix(context * np.uint64(0xD1342543DE82EF95) + word(back))
        return Pairs(context, self.key, self.at[rows].astype(np.int64), self.total[~self.same])

    def ask(self, n_buckets: int) -> Iterator[tuple[int, bytes]]:
        pairs = self.pairs()
        asked = ~self.same
        count = np.bincount(pairs.at, self.train_doc[self.doc[self.rows[asked]]], len(pairs.row))
        yield from pairs.messages(count, self.p[asked][pairs.row].astype(float), n_buckets)

    def learn_pairs(self, n_buckets: int, replies: dict[int, bytes], hot: dict) -> None:
        """What states of this depth say, and on to the next."""
        pairs, asked = self.pairs(), np.flatnonzero(~self.same)
        seen, kinds = pairs.learn(n_buckets, replies, hot)
        count, p = np.zeros(len(self.rows), np.int64), self.p.astype(float)
        count[self.same], count[asked] = self.count, seen[pairs.at]
        kinds = kinds[pairs.at]
        state = kinds > 0
        k, at = kinds[state], asked[state]
        p[at] = (count[at] + k * p[at]) / (self.total[at] + k)
        whole = np.zeros(len(self.at), np.int64)
        whole[self.rows] = count
        before = np.where(self.first[self.rows], 0, whole[self.rows - 1])  # the word before with its own context
        self._to(p.astype(np.float32), count, before)


def fewer(most: int, size: int, full: int) -> int:
    """Buckets of the next round, no larger than the first round's: nothing asks at a depth without a neighbour that asked before, so this round's size is a bound."""
    return max(-(-most // 16), min(most, -(-most * size // full)))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per row of docs: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Texts are lower-cased (A-Z) and cut at ASCII white space; one end follows each.  Learns
    from the rows for which ``in_training`` holds and scores all.  base_score: log10 of the
    smoothed word frequencies; score: log10 under the tree.  Null or empty text: the end
    alone.  Null and repeated ids are kept.  With nothing to learn from, N is 0 and every
    token has the probability of an unknown one.  Columns besides the two aren't read, so
    their names don't matter.
    """
    nb, most = buckets(docs.sparkSession, 1), buckets(docs.sparkSession, 2)  # of words, and of pairs in the first rounds
    chunks = snapshot(docs, id_col, text_col, CHUNK, tokens_packed)

    def words(chunk: int, blob: bytes, replies: dict):
        t = Tree.of_tokens(blob)
        yield from _word_messages(t.key, t.train_counts(), nb)

    known = materialise(reduce_buckets(scatter(chunks, words), _count_words))
    sums = [np.frombuffer(r["payload"], "<i8") for r in known.where("chunk = -1").select("payload").collect()]  # one row per bucket
    n, v = (int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0)

    def begin(chunk: int, blob: bytes, got: dict) -> dict:
        total = _word_totals(Tree.of_tokens(blob).key, nb, got)
        return _tree(chunk, WORDS + len(blob).to_bytes(8, "little") + blob + _press(total.tobytes()))

    trees = bucketed(each_chunk(attach(chunks, known.where("chunk >= 0")), begin, "chunk long, blob binary"))
    discard(known)
    discard(chunks)

    def ask(chunk: int, blob: bytes, got: dict):
        if int.from_bytes(blob[:8], "little"):
            yield from Tree.of(blob, n, v).ask(most)

    messages, now, full = None, most, 0
    for k in range(depth):
        replies = materialise(reduce_buckets(scatter(trees, ask) if messages is None else messages, _count_pairs))
        size = replies.agg(F.sum(F.length("payload"))).first()[0]
        if not size:  # longer contexts occur where their parents do, or once
            break
        hot, ahead = _split_sums(replies), 0 < k < depth - 1  # messages about two words are too many to be stored
        full = full or size
        then = fewer(most, size, full) if ahead else most

        def learn(chunk: int, blob: bytes, got: dict, hot: dict = hot, ahead: bool = ahead, now: int = now, then: int = then):
            """A chunk's tree, and what it asks next if that is stored beside it."""
            if not int.from_bytes(blob[:8], "little"):  # nor will it ask at greater depths
                yield TREE, blob
                return
            t = Tree.of(blob, n, v)
            t.learn_pairs(now, got, hot)
            yield TREE, t.packed()
            if ahead:
                yield from t.ask(then)

        longer = bucketed(scatter(attach(trees, replies.where("chunk >= 0")), learn))
        discard(replies)
        discard(trees)
        trees = longer.where(f"bucket = {TREE}").select("chunk", F.col("payload").alias("blob"))
        messages, now = longer.where("bucket >= 0") if ahead else None, then

    def score(chunk: int, blob: bytes, got: dict) -> dict:
        t = Tree.of(blob, n, v)
        return {
            "id": pa.array(t.ids, pa.int64()),
            "held_out": pa.array(~t.train_doc),
            "n_tokens": pa.array(t.count_of),
            "n_known": pa.array(t.known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(t.ids), n, np.int64)),
            "base_score": pa.array(t.base),
            "score": pa.array(t.settled + t.by_doc(np.log10(t.p.astype(float)), t.rows)),
        }

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return each_chunk(trees, score, schema).withColumnRenamed("id", id_col)


def _tree(chunk: int, blob: bytes) -> dict:
    return {"chunk": pa.array([chunk], pa.int64()), "blob": pa.array([blob], pa.binary())}


def _split_sums(replies: DataFrame) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(occurrences, different next words, gain) of each part of a split context: at most two parts for every HOT training tokens."""
    out = {}
    for r in replies.where("chunk = -1").select("bucket", "payload").collect():
        for key, *sums in np.frombuffer(r["payload"]).reshape(4, -1).T.tolist():
            out[r["bucket"], int(key)] = tuple(sums)
    return out


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_scoring": op8_scoring}
ORACLES: dict[str, str] = {}
