"""BPE encoding with a segment tree over adjacent pair ranks, and decoding.

For one word, the leaves of the tree are the ranks of its adjacent symbol pairs (no
merge: infinity), an inner node holds the lowest rank below it.  The root gives the
lowest rank, and going down with the left child first gives its leftmost place.  A merge
changes at most three leaves, each updated in logarithmic time, so a word of n symbols
costs O(n log n) and a very long word is no special case.

The short words of a batch are merged together: one array holds the trees of all words
of a size class, and each round makes the next merge of every word.  Longer words have a
tree each.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regionpulse.llm.common import small_batches
from regionpulse.llm.fst_tokens import byte_alphabet

NONE = 1 << 60


class PairTree:
    """Minimum segment tree over the pair ranks of one word."""

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        self.low = low = [NONE] * size + ranks + [NONE] * (size - len(ranks))
        for i in range(size - 1, 0, -1):
            a, b = low[2 * i], low[2 * i + 1]
            low[i] = a if a <= b else b

    def set(self, place: int, rank: int) -> None:
        low, i = self.low, place + self.size
        low[i] = rank
        i >>= 1
        while i:
            a, b = low[2 * i], low[2 * i + 1]
            least = a if a <= b else b
            if low[i] == least:
                break
            low[i] = least
            i >>= 1

    def leftmost(self) -> int:
        """The first place that has the root's rank."""
        low, i = self.low, 1
        least = low[1]
        while i < self.size:
            i *= 2
            if low[i] != least:
                i += 1
        return i - self.size


class PairTrees:
    """The pair trees of many words of at most ``size + 1`` symbols, merged round by round."""

    def __init__(self, size: int, ids: np.ndarray, length: np.ndarray, lookup):
        self.size, self.lookup = size, lookup
        words = len(ids)
        self.ids = ids  # [word, place], merged-away places -1
        place = np.arange(size + 1)
        self.after = np.where(place + 1 < length[:, None], place + 1, -1)
        self.before = np.broadcast_to(place - 1, ids.shape).copy()
        rank, self.result = lookup(ids[:, :-1], ids[:, 1:])
        self.low = np.full((words, 2 * size), NONE, np.int64)
        self.low[:, size:] = np.where(place[1:] < length[:, None], rank, NONE)
        k = size // 2
        while k:
            self.low[:, k:2 * k] = np.minimum(self.low[:, 2 * k:4 * k:2], self.low[:, 2 * k + 1:4 * k:2])
            k //= 2

    def put(self, word: np.ndarray, place: np.ndarray, rank: np.ndarray) -> None:
        low, i = self.low, place + self.size
        low[word, i] = rank
        i = i >> 1
        while len(i) and i[0]:
            low[word, i] = np.minimum(low[word, 2 * i], low[word, 2 * i + 1])
            i = i >> 1

    def merge(self) -> np.ndarray:
        low, ids, after, before, result = self.low, self.ids, self.after, self.before, self.result
        word = np.arange(len(ids))
        while True:
            word = word[low[word, 1] < NONE]
            if not len(word):
                return ids
            least, i = low[word, 1], np.ones(len(word), np.int64)
            for _ in range(self.size.bit_length() - 1):
                i = 2 * i
                i += low[word, i] != least
            i -= self.size
            j = after[word, i]
            k = after[word, j]
            ids[word, i] = result[word, i]
            ids[word, j] = -1
            after[word, i] = k
            inside = j < self.size  # the last place has no leaf
            self.put(word[inside], j[inside], np.full(int(inside.sum()), NONE))
            on = k >= 0
            before[word[on], k[on]] = i[on]
            rank, got = self.lookup(ids[word, i], np.where(on, ids[word, k], -1))
            # a merge at the last place of a full tree leaves no pair behind
            result[word[on], i[on]] = got[on]
            self.put(word, i, rank)
            h = before[word, i]
            left = h >= 0
            w, h, i = word[left], h[left], i[left]
            rank, got = self.lookup(ids[w, h], ids[w, i])
            result[w, h] = got
            self.put(w, h, rank)


class WordBpe:
    """Encoder and decoder of a file whose BPE has word ends, as its library gives them."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.letter = byte_alphabet()
        self.symbol = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.vocab[a], self.vocab[b]] = (k, self.vocab[a + b])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.key_base = len(self.vocab) + len(self.added) + 2
        keys = np.array([a * self.key_base + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_key = keys[order]
        self.pair_rank, self.pair_id = np.array([*self.rank.values()], np.int64)[order].T.copy()
        self.first_ids = np.array([self.vocab[x] for x in self.letter], np.int64)
        self.last_ids = np.array([self.vocab[x + self.end] for x in self.letter], np.int64)
        #: ids and tokens of words, and of what stands between spaces
        self.known: dict[str, tuple[bytes, str]] = {}
        self.units: dict[str, tuple[bytes, str]] = {}

    def merge(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        rank = self.rank
        nothing = (NONE, -1)
        found = [rank.get(p, nothing) for p in zip(ids, ids[1:])]
        tree = PairTree([f[0] for f in found])
        result = [f[1] for f in found]
        after = [*range(1, n), -1]
        before = [-1, *range(n - 1)]
        while tree.low[1] < NONE:
            i = tree.leftmost()
            j = after[i]
            ids[i] = result[i]
            k = after[i] = after[j]
            ids[j] = -1
            if j < n - 1:
                tree.set(j, NONE)
            if k >= 0:
                before[k] = i
                r, result[i] = rank.get((ids[i], ids[k]), nothing)
                tree.set(i, r)
            else:
                tree.set(i, NONE)
            h = before[i]
            if h >= 0:
                r, result[h] = rank.get((ids[h], ids[i]), nothing)
                tree.set(h, r)
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> list[int]:
        symbols = [self.letter[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] += self.end
        return self.merge([self.vocab[s] for s in symbols])

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; no merge (or no symbol, -1): NONE."""
        key = a * self.key_base + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.pair_rank[at], NONE), self.pair_id[at]

    def learn(self, words: list[str], widest: int = 32) -> None:
        """Encodings of all ``words``: size class by size class, words wider than ``widest`` one by one."""
        raw = [w.encode("utf-8", "replace") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        start = np.cumsum(length) - length
        low, size = 0, 1
        while size <= widest:
            for some in np.array_split(rows := np.flatnonzero((length > low) & (length <= size + 1)), len(rows) // 20_000 + 1):
                place = np.arange(size + 1)
                inside = place < length[some, None]
                byte = data[np.minimum(start[some, None] + place, len(data) - 1)]
                ids = np.where(inside, np.where(place == length[some, None] - 1, self.last_ids[byte], self.first_ids[byte]), -1)
                ids = PairTrees(size, ids, length[some], self.lookup).merge()
                flat = ids[ids >= 0]
                cut = np.cumsum((ids >= 0).sum(axis=1)).tolist()
                packed, listed, at = flat.astype("<u4").tobytes(), [*map(self.symbol.__getitem__, flat.tolist())], 0
                for w, to in zip(some.tolist(), cut):
                    self.known[words[w]] = packed[4 * at:4 * to], " ".join(listed[at:to])
                    at = to
            low, size = size + 1, size * 2
        for w in np.flatnonzero(length > low).tolist():
            ids = self.encode_word(words[w])
            self.known[words[w]] = struct.pack(f"<{len(ids)}I", *ids), " ".join([self.symbol[i] for i in ids])

    @staticmethod
    def lower(text: str) -> str:
        """Code point by code point, without the word-final sigma of ``str.lower``."""
        return "σ".join([x.lower() for x in text.split("Σ")]) if "Σ" in text else text.lower()

    def encode(self, texts: list[str | None], most_known: int = 500_000) -> list[tuple[bytes, str]]:
        """Of each text the ids as little-endian unsigned 32-bit integers, and the decoded text:
        with no decoder in the file, its tokens joined by single spaces.

        What is known of words stays for the next batch, up to ``most_known`` of them: far more
        than one batch of rows brings, else each batch would start anew."""
        if len(self.known) + len(self.units) > most_known:
            self.known.clear()
            self.units.clear()
        # no word crosses a space or line feed, and neither normalization looks across them
        parts = [[p if k % 2 else p.replace("\n", " ").split(" ") for k, p in enumerate(self.split(t or ""))] for t in texts]
        fresh = set().union(*[p for ps in parts for p in ps[::2]]) - self.units.keys()
        pieces = {u: self.pieces(self.lower(unicodedata.normalize("NFC", u))) for u in fresh}
        self.learn([w for w in set().union(*pieces.values()) if w not in self.known])
        for u, ws in pieces.items():
            got = [self.known[w] for w in ws]
            self.units[u] = (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))
        out = []
        for ps in parts:
            got: list[tuple[bytes, str]] = []
            for k, p in enumerate(ps):
                if k % 2:
                    got.append((struct.pack("<I", self.added[p]), p))
                else:
                    got += map(self.units.__getitem__, p)
            out.append((b"".join([x[0] for x in got]), " ".join([x[1] for x in got if x[1]])))
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join([self.symbol[i] for (i,) in struct.iter_unpack("<I", ids)])


_CODERS: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """One encoder per Python worker process and file."""
    if path not in _CODERS:
        _CODERS[path] = WordBpe(path)
    return _CODERS[path]


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``token_ids`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and
    ``decoded``; existing columns of those names are replaced, all others pass through
    (``text`` only with ``keep_text``).

    A null or empty text has no tokens and decodes to the empty string.  Rows map to rows:
    repeated rows give repeated results, an empty table an empty one."""
    small_batches(docs.sparkSession, 500)
    new = ["token_ids", "n_tokens", "decoded"]
    keep = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    wanted = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            got = c.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
            columns = [batch.column(batch.schema.get_field_index(name)) for name in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g[0] for g in got], pa.binary()), pa.array([len(g[0]) // 4 for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], names=[*keep, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name in keep)
    return wanted.mapInArrow(run, f"{fields}{', ' if fields else ''}token_ids binary, n_tokens long, decoded string")


def digest(ids: bytes) -> str:
    return hashlib.sha256(ids).hexdigest()
