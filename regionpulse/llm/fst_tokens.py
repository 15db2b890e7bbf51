"""Token counts from a compiled finite-state transducer (byte-level BPE).

The byte-level BPE of a vocabulary file is turned into a deterministic transducer over
bytes.  After a prefix, what the future can depend on is, for each open start position
(a position from which some vocabulary entry can still go on), the trie node reached
from it, the last token of the encoding that ends there, and the token count there
relative to the current one.  That tuple is the state.  Reading a byte moves the trie
nodes, finds the one token that ends the encoding of the longer prefix, and emits the
*change* in the number of tokens.  States and transitions are compiled on first use and
kept in bounded tables.

Why one last token is enough: the BPE encoding of a prefix of tokens is that prefix
(no merge ever crossed its end), and a token sequence is an encoding exactly when each
adjacent pair is the encoding of its own text.

All different pre-tokens of a batch run through the transducer in step, one byte of each
at a time: a step is a look-up in the arc table by (state, byte).

A text is cut into chunks.  A chunk is a map from the state in which it is entered to
the state in which it is left and the tokens emitted; since every state is forgotten
where white space follows other text, the map is kept as (head up to the first such
place, tokens between, tail after the last one).  Chunk maps compose associatively and
are combined by a pairwise tree, as in a parallel prefix scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regionpulse.llm.common import small_batches

#: the pre-tokenizer's pattern of byte-level BPE files (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
START = -1


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies: printable
    Latin-1 stands for itself, the others take the code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Transducer:
    """Deterministic transducer of one vocabulary; ``count`` gives the tokens of each pre-token."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], max_states: int = 1 << 18):
        self.merges, self.max_states = merges, max_states
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.formed = {x + y: k for k, (x, y) in enumerate(merges)}
        self.alone: dict[int, bool] = {}
        self.text = {i: t for t, i in vocab.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [START]
        for t, i in vocab.items():
            node = 0
            for b in t:
                nxt = self.child[node].get(b)
                if nxt is None:
                    nxt = self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(START)
                node = nxt
            self.token[node] = i
        self.reset()

    def reset(self) -> None:
        start = ((0, START, 0),)
        self.states: list[tuple] = [start]
        self.number = {start: 0}
        #: column of each byte value in the arc table, given out on first use
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        #: [state, column] -> next state << 8 | change in the token count + 128; 0: not compiled yet
        self.arcs = np.zeros((1 << 12, 64), np.int32)

    def encode_plain(self, data: bytes) -> list[bytes]:
        """BPE by repeated lowest-rank merge; used for pairs of tokens only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def whole(self, token: int) -> bool:
        """Whether the text of ``token`` is encoded as that one token."""
        got = self.alone.get(token)
        if got is None:
            got = self.alone[token] = self.encode_plain(self.text[token]) == [self.text[token]]
        return got

    def pair_ok(self, last: int, token: int) -> bool:
        """Whether the two tokens side by side are an encoding: no merge crosses their seam.

        Time runs backwards: the side formed last is undone first, and a merge across the
        seam counts only if its rank comes before the merge that took its side away (on
        equal ranks the left one is first)."""
        if not self.whole(token):
            return False
        if last == START:
            return True
        x, y, before = self.text[last], self.text[token], 1 << 60
        while True:
            if self.rank.get((x, y), before) < before:
                return False
            rx, ry = self.formed.get(x, -1), self.formed.get(y, -1)
            if rx > ry:
                x, before = self.merges[rx][1], rx
            elif ry >= 0:
                y, before = self.merges[ry][0], ry + 1
            else:
                return True

    def compile_arc(self, state: int, byte: int) -> None:
        moved, new = [], None
        for node, last, ago in self.states[state]:
            node = self.child[node].get(byte)
            if node is None:
                continue
            moved.append((node, last, ago))
            token = self.token[node]
            if new is None and token != START and self.pair_ok(last, token):
                new = (token, ago + 1)
        token, emitted = new
        target = (*[(node, last, ago - emitted) for node, last, ago in moved if self.child[node]], (0, token, 0))
        number = self.number.get(target)
        if number is None:
            number = self.number[target] = len(self.states)
            self.states.append(target)
            if number == len(self.arcs):
                self.arcs = np.concatenate([self.arcs, np.zeros_like(self.arcs)])
        self.arcs[state, self.column[byte]] = number << 8 | emitted + 128

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        if len(self.states) > self.max_states:
            self.reset()
        total = np.zeros(len(pieces), np.int64)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        for b in np.unique(data):
            if self.column[b] < 0:
                self.column[b] = self.columns
                self.columns += 1
                if self.columns > self.arcs.shape[1]:
                    self.arcs = np.concatenate([self.arcs, np.zeros_like(self.arcs)], axis=1)
        start = np.cumsum(size) - size
        live = np.argsort(-size, kind="stable")
        state = np.zeros(len(pieces), np.int64)  # in the order of live
        longest = -size[live]
        for step in range(int(size.max(initial=0))):
            n = int(np.searchsorted(longest, -step))  # the first n are longer than step
            live, state, longest = live[:n], state[:n], longest[:n]
            byte = data[start[live] + step]
            column = self.column[byte]
            arc = self.arcs[state, column]
            new = np.flatnonzero(arc == 0)
            if len(new):
                for key in np.unique(state[new] << 8 | byte[new]).tolist():
                    self.compile_arc(key >> 8, key & 255)
                arc = self.arcs[state, column]
            total[live] += (arc & 255) - 128
            state = (arc >> 8).astype(np.int64)
        return total


class TokenCounter:
    """Counts the tokens of whole texts as the file's own library does."""

    def __init__(self, path: str, chunk_chars: int = 1 << 15):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda s: bytes(byte_of[c] for c in s)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        for t in added:
            vocab.pop(t.encode(), None)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pieces = regex.compile(PATTERN).findall
        #: where every state is forgotten: white space after anything else
        self.sync = regex.compile(r"(?<=\S)\s").finditer
        self.transducer = Transducer(vocab, merges)
        #: tokens of pre-tokens, and of a space with the word after it
        self.known: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        #: white space other than single spaces and line feeds
        self.odd_space = re.compile(r"[^\S \n]|[ \n]{2}").search
        self.chunk_chars = chunk_chars

    def learn(self, pieces: set[str], spaced: set[str] = frozenset()) -> None:
        """Counts of all given pre-tokens and space-led words, in one run of the transducer."""
        split = {w: self.pieces(" " + w) for w in spaced if w not in self.spaced}
        fresh = [p for p in pieces.union(*split.values()) if p not in self.known]
        if fresh:
            self.known.update(zip(fresh, self.transducer.count([p.encode("utf-8", "replace") for p in fresh]).tolist()))
        for w, ps in split.items():
            self.spaced[w] = sum([self.known[p] for p in ps])

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """Pre-tokens and space-led words that make up ``text``: where white space is single
        spaces and line feeds only, the state is forgotten before every space."""
        if self.odd_space(text):
            return self.pieces(text), []
        first, *rest = text.split(" ")
        return self.pieces(first), rest

    def total(self, cut: tuple[list[str], list[str]]) -> int:
        return sum(map(self.known.__getitem__, cut[0])) + sum(map(self.spaced.__getitem__, cut[1]))

    def run(self, text: str) -> int:
        """Tokens of a stretch entered in the start state."""
        cut = self.cut(text)
        self.learn(set(cut[0]), set(cut[1]))
        return self.total(cut)

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, tokens between, tail); tail None: no place in the chunk forgets the state."""
        import regex

        first = next(self.sync(chunk), None)
        if first is None:
            return chunk, 0, None
        back = regex.search(r"(?r)(?<=\S)\s", chunk).start()
        return chunk[:first.start()], self.run(chunk[first.start():back]), chunk[back:]

    def compose(self, a, b):
        """The map of ``a`` followed by ``b``."""
        (head, before, tail), (head_b, after, tail_b) = a, b
        if tail is None:  # all of a is head: the place that forgets may lie on the seam
            first = self.chunk_map(head + head_b)
            if tail_b is None or first[2] is None:
                return (first[0], first[1], first[2]) if tail_b is None else (head + head_b, after, tail_b)
            return first[0], first[1] + self.run(first[2]) + after, tail_b
        if tail_b is None:  # all of b goes on from a's tail
            seam = self.chunk_map(tail + head_b)
            return (head, before, tail + head_b) if seam[2] is None else (head, before + self.run(seam[0]) + seam[1], seam[2])
        return head, before + self.run(tail + head_b) + after, tail_b

    def count_stretch(self, text: str) -> int:
        n = self.chunk_chars
        if len(text) <= n:
            return self.run(text)
        maps = [self.chunk_map(text[i:i + n]) for i in range(0, len(text), n)]
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, between, tail = maps[0]
        return self.run(head) + between + (self.run(tail) if tail else 0)

    def stretches(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and their number."""
        if self.added is None:
            return [text], 0
        parts = self.added.split(text)
        return parts, len(parts) - 1

    def count(self, texts: list[str | None], most_known: int = 400_000) -> list[int]:
        """The token count of each text; what is known of pre-tokens stays for the next batch,
        up to ``most_known`` of them."""
        if len(self.known) + len(self.spaced) > most_known:
            self.known.clear()
            self.spaced.clear()
        parts = [self.stretches(t or "") for t in texts]
        cuts = [[self.cut(p) for p in ps if len(p) <= self.chunk_chars] for ps, _ in parts]
        self.learn({p for cs in cuts for c in cs for p in c[0]}, set().union(*[c[1] for cs in cuts for c in cs]))
        return [n + sum(map(self.total, cs)) + sum(self.count_stretch(p) for p in ps if len(p) > self.chunk_chars)
                for (ps, n), cs in zip(parts, cuts)]


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One compiled transducer per Python worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null text counts as empty (0 bytes, 0 tokens).  Rows map to rows, so repeated rows,
    ties and empty tables need no care; other columns pass through, and ``prefix`` keeps the
    three new names from clashing with existing ones.  Only names of ``docs`` other than the
    three are kept."""
    small_batches(docs.sparkSession)
    names = [f"{prefix}n_bytes", f"{prefix}n_tokens", f"{prefix}over_limit"]
    rest = [c for c in docs.columns if c not in names]
    out = docs.select(*[f"`{c}`" for c in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            n = c.count(texts)
            size = [len(t.encode()) if t else 0 for t in texts]
            columns = [x for x, name in zip(batch.columns, batch.schema.names) if name in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[*keep, *names])

    keep = [c for c in rest if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name in keep)
    return out.mapInArrow(run, f"{fields}{', ' if fields else ''}`{names[0]}` long, `{names[1]}` long, `{names[2]}` boolean")
