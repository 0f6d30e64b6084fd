"""Byte-level BPE, encoded by speculation: propose, verify, repair.

Greedy longest match proposes tokens for each word.  A proposal is the true BPE encoding
exactly if each of its tokens encodes to itself and no adjacent pair would have merged
across its border; the second is tested for all pairs of a batch at once by undoing merges
on either side of the border, latest first.  Only words that fail are merged exactly.

A word is a pretoken of the byte-level pattern.  Between two characters that aren't white
space, a single space always starts a pretoken, so texts are cut there and each distinct
piece is encoded once per task; texts with other runs of spaces take the pattern itself.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 40
#: Words of more bytes are encoded one by one.
WIDE = 40
#: Words that are encoded at once.
BLOCK = 16_384
#: Pieces that a task remembers, and characters that it encodes at once: together some 300 MB of a Python worker.
MEMO, SLICE = 800_000, 4 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Table:
    """A hash table of uint64 keys, looked up by whole arrays; values: given, or each key's place."""

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys repeat")
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)
        values = np.arange(len(keys)) if values is None else values
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.values[at[todo]] < 0
            slot, one = np.unique(at[todo[free]], return_index=True)
            put = todo[free][one]
            self.keys[slot], self.values[slot] = keys[put], values[put]
            todo = todo[self.keys[at[todo]] != keys[todo]] if len(todo) else todo
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.values[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[todo]] == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (self.values[at[todo]] >= 0)]
        return out


class Places(dict):
    """Keys with their places in a store, given out as they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = k = len(self)
        self.fresh.append(key)
        return k


class BpeCodec:
    """Encoder and decoder for one vocabulary file; memory for memos is bounded by ``memo`` entries."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: only byte-level vocabularies without normalizer or prefix space are supported")
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.ids, self.memo = vocab, memo
        self.bytes = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.decimal = [str(i).encode() for i in range(size)]
        self.longest = max(map(len, vocab))
        self.rank, self.size = {}, size
        self.order = np.full(size, -1, np.int64)  # the merge that makes a token; -1: a byte
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = bytes(letters[c] for c in a), bytes(letters[c] for c in b)
            i, j, m = vocab[a], vocab[b], vocab[a + b]
            self.rank[i, j] = (k, m)
            if self.order[m] < 0:
                self.order[m], self.left[m], self.right[m] = k, i, j
        self.pairs = Table(np.array([i * size + j for i, j in self.rank], np.uint64))
        self.merge_rank, merged = np.array(list(self.rank.values()), np.int64).T
        self.token_of = np.zeros(int(self.merge_rank.max(initial=0)) + 1, np.int64)  # by rank of the merge
        self.token_of[self.merge_rank] = merged
        self.byte_ids = np.array([vocab[bytes([k])] for k in range(256)], np.int64)
        short = [t for t in vocab if len(t) <= 8]
        eight = np.array([int.from_bytes(t, "little") for t in short], np.uint64)
        self.short = Table(self._short_key(eight, np.array([len(t) for t in short])), np.array([vocab[t] for t in short]))
        self.starts_long = Table(np.array(sorted({int.from_bytes(t[:8], "little") for t in vocab if len(t) > 8}), np.uint64))
        self.sound = np.zeros(size, bool)  # tokens whose bytes encode to themselves
        for (t, i), x in zip(vocab.items(), self.merge_all(list(vocab))):
            self.sound[i] = x == [i]
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.parts = Places()  # keys of pieces, see keys()
        self.unfit: list[int] = []  # places of keys that are no pieces
        self.flat, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.used = np.empty(0, np.int32)  # in how many calls each piece was seen; halved when the store is pruned

    def _prune(self) -> None:
        """Keep the pieces that come again and again, at most half of the memo."""
        self.used[self.unfit] = 0
        least = 2
        while (keep := self.used >= least).sum() > self.memo // 2:
            least += 1
        place, kept = np.cumsum(keep) - 1, keep.tolist()
        old, self.parts = self.parts, Places()
        self.parts.update((k, int(place[i])) for k, i in old.items() if kept[i])
        rows = np.flatnonzero(keep)
        count = self.count[rows]
        ends = np.cumsum(count, dtype=np.int64)
        self.flat = self.flat[np.repeat(self.start[rows] - (ends - count), count) + np.arange(int(count.sum()))]
        self.start, self.count, self.used, self.unfit = (ends - count).astype(np.int32), count, self.used[rows] // 2, []

    # ------------------------------------------------------------ words

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first, leftmost first."""
        out = [self.ids[word[k : k + 1]] for k in range(len(word))]
        rank = self.rank
        ranks = [rank.get(p, (NEVER, 0))[0] for p in zip(out, out[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            k = ranks.index(low)
            out[k : k + 2] = [rank[out[k], out[k + 1]][1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get((out[k - 1], out[k]), (NEVER, 0))[0]
            if k < len(ranks):
                ranks[k] = rank.get((out[k], out[k + 1]), (NEVER, 0))[0]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match of one word."""
        out, k, n, ids = [], 0, len(word), self.ids
        while k < n:
            for e in range(min(n, k + self.longest), k, -1):
                t = ids.get(word[k:e])
                if t is not None:
                    out.append(t)
                    k = e
                    break
        return out

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of all words in step: tokens as a matrix, their counts, and
        which words the matrix leaves out (long ones, and those in which a token of over
        eight bytes might match)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words) + bytes(8), np.uint8).astype(np.uint64)
        eight = text[:-8].copy()  # the eight bytes from each place on
        for k in range(1, 8):
            eight |= text[k : k - 8] << np.uint64(8 * k)
        end = np.cumsum(size)
        out, count, left = np.zeros((len(words), WIDE), np.int64), np.zeros(len(words), np.int64), size > WIDE
        row = np.flatnonzero(~left & (size > 0))
        at = (end - size)[row]
        while len(row):
            rest = end[row] - at
            open_ = np.arange(len(row))
            if (far := rest > 8).any():
                x = open_[far]
                left[row[x[self.starts_long.get(eight[at[x]]) >= 0]]] = True
            token, length = np.full(len(row), -1), np.minimum(rest, 8)
            while len(open_):
                n = length[open_]
                token[open_] = got = self.short.get(self._short_key(eight[at[open_]], n))
                open_ = open_[got < 0]
                length[open_] -= 1
            out[row, count[row]] = token
            count[row] += 1
            at = at + length
            keep = (at < end[row]) & ~left[row]
            row, at = row[keep], at[keep]
        return out, count, left

    @staticmethod
    def _short_key(eight: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A key of the first n (1 to 8) bytes; no two byte strings share one but by 2**-64 chance, which building the table rules out for tokens."""
        shift = (np.uint64(64) - np.uint64(8) * n.astype(np.uint64))
        return (((eight << shift) >> shift) + n.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) ^ n.astype(np.uint64)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words in step, long ones one by one."""
        out: list[list[int]] = [[]] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 8), (8, 16), (16, WIDE)):
            pick = np.flatnonzero((size > low) & (size <= high))
            for k in range(0, len(pick), 50_000):
                self._merge_block([words[i] for i in pick[k : k + 50_000].tolist()], pick[k : k + 50_000], high, out)
        for i in np.flatnonzero(size > WIDE).tolist():
            out[i] = self.merge(words[i])
        return out

    def _merge_block(self, words: list[bytes], place: np.ndarray, wide: int, out: list) -> None:
        """Words of up to ``wide`` bytes; pieces are chained, so that a merge touches its neighbours only."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join([w.ljust(wide, b"\0") for w in words]), np.uint8).reshape(n, wide)
        ids, col = self.byte_ids[raw], np.arange(wide)
        alive = col[None, :] < size[:, None]
        rank = np.full((n, wide), NEVER)
        rank[:, :-1] = np.where(alive[:, 1:], self._rank_of(ids[:, :-1], ids[:, 1:]), NEVER)
        after, before = np.tile(col + 1, (n, 1)), np.tile(col - 1, (n, 1))
        rows = np.arange(n)
        while len(rows):
            sub = rank[rows]
            k = sub.argmin(axis=1)
            low = sub[np.arange(len(rows)), k]
            go = low < NEVER
            rows, k, low = rows[go], k[go], low[go]
            token, r = self.token_of[low], after[rows, k]
            ids[rows, k] = token
            alive[rows, r] = False
            rank[rows, r] = NEVER
            rank[rows, k] = NEVER
            nxt = after[rows, r]
            after[rows, k] = nxt
            x = np.flatnonzero(nxt < size[rows])
            before[rows[x], nxt[x]] = k[x]
            rank[rows[x], k[x]] = self._rank_of(token[x], ids[rows[x], nxt[x]])
            prev = before[rows, k]
            x = np.flatnonzero(prev >= 0)
            rank[rows[x], prev[x]] = self._rank_of(ids[rows[x], prev[x]], token[x])
        flat, at = ids[alive].tolist(), [0, *np.cumsum(alive.sum(axis=1)).tolist()]
        for i, a, b in zip(place.tolist(), at, at[1:]):
            out[i] = flat[a:b]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.pairs.get((a * self.size + b).astype(np.uint64).ravel()).reshape(a.shape)
        return np.where(at >= 0, self.merge_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border of each pair of tokens stays when their bytes are merged together."""
        ok = np.ones(len(a), bool)
        at, x, y, limit = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64), np.full(len(a), NEVER)
        while len(at):
            joined = self._rank_of(x, y) < limit
            ok[at[joined]] = False
            ox, oy = self.order[x], self.order[y]
            undo_x = ox > oy  # of equal merges the left one came first
            keep = ~joined & (undo_x | (oy >= 0))
            limit = np.where(undo_x, ox, oy + 1)[keep]
            x, y, at = np.where(undo_x, self.right[x], x)[keep], np.where(undo_x, y, self.left[y])[keep], at[keep]
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word, in blocks that bound the arrays."""
        return [x for k in range(0, len(words), BLOCK) for x in self._encode_block(words[k : k + BLOCK])]

    def _encode_block(self, words: list[bytes]) -> list[list[int]]:
        """Propose, verify all adjacent pairs at once, merge what fails."""
        tokens, count, left = self.propose_all(words)
        col = np.arange(max(1, int(count.max(initial=0))))
        tokens = tokens[:, : len(col)]
        real = (col[None, :] < count[:, None]) & ~left[:, None]
        bad = (~self.sound[tokens] & real).any(axis=1)
        row, at = np.nonzero(real[:, 1:])
        pair, back = np.unique(tokens[row, at] * self.size + tokens[row, at + 1], return_inverse=True)
        bad[row[~self.compatible(pair // self.size, pair % self.size)[back]]] = True
        out = [x[:n] for x, n in zip(tokens.tolist(), count.tolist())]
        for k in np.flatnonzero(left).tolist():
            out[k] = x = self.propose(words[k])
            pair = np.array([x[:-1], x[1:]], np.int64)
            bad[k] = not (self.sound[x].all() and self.compatible(pair[0], pair[1]).all())
        fail = np.flatnonzero(bad).tolist()
        for k, x in zip(fail, self.merge_all([words[k] for k in fail])):
            out[k] = x
        return out

    def _learn(self) -> None:
        """Tokens of the keys that the store has no tokens of yet."""
        parts, first = self.parts, len(self.count)
        words, word_at, joined, special = [], [], [], []
        at = first
        while parts.fresh:  # pretokens of a piece are keys themselves
            fresh, parts.fresh = parts.fresh, []
            plain = [k.isalpha() for k in fresh]  # mostly words, which are one pretoken each
            words += [" " + k for k, p in zip(fresh, plain) if p]
            word_at += [at + i for i, p in enumerate(plain) if p]
            others = [(at + i, k) for i, (k, p) in enumerate(zip(fresh, plain)) if not p]
            at += len(fresh)
            for at_, k in others:
                if k[:-1].isalpha() and k[-1] in ".,":
                    joined.append((at_, (parts[k[:-1]], parts["\n" + k[-1]])))
                elif k[:1] == "\n" and k[1:] in self.special:
                    special.append((at_, self.special[k[1:]]))
                elif k[:1] != "\n" and (not k or k[0].isspace() or k[-1].isspace()):
                    self.unfit.append(at_)
                else:
                    got = self.pattern.findall(k[1:] if k[0] == "\n" else " " + k)
                    if len(got) == 1:
                        words.append(got[0])
                        word_at.append(at_)
                    else:
                        joined.append((at_, tuple(map(parts.__getitem__, map(self._key, got)))))
        tokens: list[list[int]] = [[]] * (at - first)
        for k, x in zip(word_at, self.encode_words([w.encode() for w in words])):
            tokens[k - first] = x
        for k, x in special:
            tokens[k - first] = [x]
        for k, x in joined:
            tokens[k - first] = [t for i in x for t in (tokens[i - first] if i >= first else self.flat[self.start[i] : self.start[i] + self.count[i]].tolist())]
        count = np.fromiter(map(len, tokens), np.int32, len(tokens))
        start = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(tokens), np.int32, int(count.sum()))])
        self.start, self.count = np.concatenate([self.start, start.astype(np.int32)]), np.concatenate([self.count, count])

    @staticmethod
    def _key(pretoken: str) -> str:
        fit = pretoken[0] == " " and len(pretoken) > 1 and not pretoken[1].isspace() and not pretoken[-1].isspace()
        return pretoken[1:] if fit else "\n" + pretoken

    # ------------------------------------------------------------ texts

    def keys(self, text: str) -> list[str]:
        """The text cut where a pretoken must begin, as keys of the store.

        A single space or line break between characters that aren't white space always
        begins a pretoken, and after the line break another begins.  A key is the piece
        after its space, or a line break and the piece.
        """
        out: list[str] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if not first or first[0].isspace() or first[-1].isspace():
                return self._exact(text)
            out += ("\n\n", "\n" + first)
            out += rest
        return out[1:]

    def _exact(self, text: str) -> list[str]:
        return ["\n" + w for w in self.pattern.findall(text)]

    def _keys(self, text: str, cut: Callable) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return cut(text) if text else []
        out: list[str] = []
        for k, x in enumerate(self.cut.split(text)):
            if k % 2:
                out.append("\n" + x)
            elif x:
                out += cut(x)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other (int32), and where each text's begin and end."""
        if len(self.parts) > self.memo:
            self._prune()
        lists = [self._keys(t, self.keys) for t in texts]
        at, n = self._places(lists)
        if self.unfit and (unfit := np.isin(at, self.unfit)).any():  # other runs of white space in these texts
            for k in np.unique(np.repeat(np.arange(len(lists)), n)[unfit]).tolist():
                lists[k] = self._keys(texts[k], self._exact)
            at, n = self._places(lists)
        count = self.count[at]
        ends = np.cumsum(count, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        step = np.ones(total, np.int32)  # places in the store, as steps from one token to the next
        some = np.flatnonzero(count)
        begin, last = self.start[at[some]], self.start[at[some]] + count[some]
        if total:
            step[(ends - count)[some]] = begin - np.concatenate([[0], last[:-1] - 1])
        flat = self.flat[np.cumsum(step, dtype=np.int32)] if total else self.flat[:0]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        return flat, bounds

    def _places(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        at = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(lists)), np.int64, int(n.sum()))
        if self.parts.fresh:
            self._learn()
            self.used = np.concatenate([self.used, np.zeros(len(self.count) - len(self.used), np.int32)])
        self.used += np.bincount(at, minlength=len(self.used)) > 0
        return at, n

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.cache
def codec(path: str, memo: int = MEMO) -> BpeCodec:
    """One codec for each Python worker."""
    return BpeCodec(path, memo)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about ``size`` characters (null: empty), with the first one's row."""
    first, held, total = 0, [], 0
    for start in range(0, batch.num_rows, 256):  # not the whole batch at once: its strings are as large as itself
        for k, t in enumerate(batch.column(column).slice(start, 256).to_pylist(), start):
            t = t or ""
            if held and total + len(t) > size:
                yield first, held
                first, held, total = k, [], 0
            held.append(t)
            total += len(t)
    if held:
        yield first, held


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>): each text's token ids; null or empty text: an empty array."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b, 1):
                ids, at = codec(path).encode(texts)
                yield pa.record_batch([b.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], [id_col, "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id_col, text): the text of each array of ids; null ids: empty."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([codec(path).decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them, one row per row of docs.

    Null or empty text: no ids, digests of the empty string.  Null and repeated ids are kept
    as they are.  One pass, no shuffle; a text of any length is encoded whole.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for first, texts in slices(b, 1):
                flat, at = c.encode(texts)
                out = []
                for k in range(len(texts)):
                    ids = flat[at[k] : at[k + 1]].tolist()
                    out.append((len(ids), hashlib.sha256(b",".join(map(c.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
                n, x, y = zip(*out)
                yield pa.record_batch([b.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(x), pa.array(y)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
