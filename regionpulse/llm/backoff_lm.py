"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model over words and an end token, with Dirichlet smoothing:

    P(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))
    P(w | h) = (c(h w) + mu P(w)) / (c(h) + mu)

It is read as an automaton.  Every history seen in training is a state, and so are the
start of a text and the empty history.  A seen bigram is an arc h -> w with weight
log P(w | h).  From every other word the state's failure arc, weight log(mu / (c(h) + mu)),
leads to the empty history, whose arcs weigh log P(w).  A text is scored in one
left-to-right traversal that carries the state; the texts of a block go in step.

Neither counts nor automaton are ever in one place.  Documents are dealt into blocks of a
bounded number of rows.  A block finds its distinct n-grams (64-bit hashes, sorted) and
sends them with its training counts to shards of the hash range; a shard adds up the
counts of all blocks and answers each block with the totals of just the n-grams it asked
for, in the order asked.  From the answers a block compiles its part of the automaton.
Frequent words are added up inside each block first, and shards cut the hash range, so no
key is hot.  ``rows_per_block`` should grow with the executors' memory: the fewer the
blocks, the fewer and larger the messages between blocks and shards.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpulse.llm.common import materialize, small_batches

ODD = np.uint64(0x9E3779B97F4A7C15)
END, START = np.uint64(1), np.uint64(2)


@dataclass(frozen=True)
class BackoffModel:
    add: float = 0.1
    mu: float = 20.0
    rows_per_block: int = 2000


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept out of training: crc32 of its id as text, mod 10, is 0 (no id: of the empty text)."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Tokens:
    """The tokens of a block of texts, one after the other, every text closed by the end token."""

    start: np.ndarray  # first token of each text
    length: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray]]  # order -> (sorted distinct hashes, their index at each token)


def tokenized(texts: list[str | None]) -> Tokens:
    known: dict[bytes, int] = {}
    parts, length = [], []
    for t in texts:
        ws = (t or "").encode("utf-8", "replace").lower().split()
        for w in set(ws).difference(known):
            known[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        parts.append(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)))
        parts.append(np.array([END]))
        length.append(len(ws) + 1)
    length = np.array(length, np.int64)
    start = np.cumsum(length) - length
    token = np.concatenate(parts)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[start] = START
    grams = {1: np.unique(_mixed(token), return_inverse=True), 2: np.unique(_mixed(_mixed(before) * ODD + token), return_inverse=True)}
    return Tokens(start, length, grams)


def _packed(values: np.ndarray) -> bytes:
    """Integers as byte planes, so that unused high bytes compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def block_counts(block: int, ids: list, texts: list, shards: int) -> pa.Table:
    """The rows (shard, block, gram, hashes, counts) that a block sends."""
    t = tokenized(texts)
    train = np.repeat(np.array([not held_out(i) for i in ids], bool), t.length)
    rows = []
    for gram, (keys, at) in t.grams.items():
        counts = np.bincount(at[train], minlength=len(keys)).astype(np.uint32)
        shard = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(shard, np.arange(shards + 1))
        for s in np.unique(shard).tolist():
            x = slice(cut[s], cut[s + 1])
            rows.append((s, block, gram, _packed(np.diff(keys[x], prepend=np.uint64(0))), _packed(counts[x])))
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(COUNT_TYPES)], names=COUNT_NAMES)


COUNT_NAMES, COUNT_TYPES = ["shard", "block", "gram", "hashes", "counts"], [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
ANSWER_NAMES, ANSWER_TYPES = ["block", "gram", "shard", "counts", "tokens", "kinds"], [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]


def shard_answers(table: pa.Table) -> pa.Table:
    """Answers (block, gram, shard, counts) to all blocks, and the shard's sums (null block:
    tokens, kinds of tokens in training)."""
    rows, out = table.to_pylist(), []
    for gram in (1, 2):
        mine = [r for r in rows if r["gram"] == gram]
        if not mine:
            continue
        keys = [np.cumsum(_unpacked(r["hashes"], np.uint64), dtype=np.uint64) for r in mine]
        counts = np.concatenate([_unpacked(r["counts"], np.uint32) for r in mine])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.uint32 if counts.sum(dtype=np.uint64) < 1 << 32 else np.uint64)
        first = 0
        for r, k in zip(mine, keys):
            out.append((r["block"], gram, r["shard"], _packed(total[at[first:first + len(k)]].astype(np.uint64)), None, None))
            first += len(k)
        if gram == 1:
            out.append((None, 1, mine[0]["shard"], None, int(total.sum(dtype=np.uint64)), int((total > 0).sum())))
    return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(ANSWER_TYPES)], names=ANSWER_NAMES)


def block_scores(ids: list, texts: list, answers: list[dict], tokens: int, kinds: int, model: BackoffModel) -> pa.Table:
    """Scores of a block's texts, by its part of the automaton."""
    t = tokenized(texts)
    total = {}
    for gram in (1, 2):
        got = sorted((a for a in answers if a["gram"] == gram), key=lambda a: a["shard"])
        total[gram] = np.concatenate([_unpacked(a["counts"], np.uint64) for a in got]).astype(np.float64)
    word, pair = t.grams[1][1], t.grams[2][1]
    c, n_states = total[1], len(total[1])
    p = (c + model.add) / (tokens + model.add * (kinds + 1))
    log_p = np.log10(p)
    # states: each known word, the start of a text (seen as often as the end), and -1, the empty history
    end = int(np.searchsorted(t.grams[1][0], _mixed(np.array([END]))[0]))
    history = np.append(c, c[end])
    fail = np.append(np.log10(model.mu / (history + model.mu)), 0.0)  # the last stands for state -1
    target = np.where(c > 0, np.arange(n_states), -1)

    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[t.start] = n_states
    seen = total[2][pair] > 0
    arc = np.log10((total[2][pair] + model.mu * p[word]) / (history[before] + model.mu))

    order = np.argsort(-t.length, kind="stable")
    start, shorter = t.start[order], -t.length[order]
    score = np.zeros(len(order))
    state = np.full(len(order), n_states if history[n_states] > 0 else -1)
    for step in range(int(t.length.max(initial=0))):
        n = int(np.searchsorted(shorter, -step))  # texts still under way
        at = start[:n] + step
        score[:n] += np.where(seen[at] & (state[:n] >= 0), arc[at], fail[state[:n]] + log_p[word[at]])
        state[:n] = target[word[at]]
    by_text = np.empty_like(score)
    by_text[order] = score
    return pa.Table.from_arrays([
        pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(t.length),
        pa.array(np.add.reduceat((c[word] > 0).astype(np.int64), t.start)), pa.array([tokens] * len(ids), pa.int64()),
        pa.array(np.add.reduceat(log_p[word], t.start)), pa.array(by_text)],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, model: BackoffModel = BackoffModel(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Trains on the documents that are not held out and scores all.  A null or empty text is
    the end token alone; repeated rows train and are scored as often as they occur; with
    no training document every probability is that of an unknown word; an empty table
    gives an empty result; only the id and the text are read."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    blocks = max(1, math.ceil(rows.count() / model.rows_per_block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8"))), F.lit(blocks)))

    def count(table: pa.Table) -> pa.Table:
        return block_counts(table["block"][0].as_py(), table["doc_id"].to_pylist(), table["text"].to_pylist(), blocks)

    sent = dealt.groupBy("block").applyInArrow(count, "shard long, block long, gram int, hashes binary, counts binary")
    answers = materialize(sent.groupBy("shard").applyInArrow(shard_answers, "block long, gram int, shard long, counts binary, tokens long, kinds long"), "lm-answers")
    tokens, kinds = (int(x or 0) for x in answers.filter("block is null").agg(F.sum("tokens"), F.sum("kinds")).first())

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_scores(left["doc_id"].to_pylist(), left["text"].to_pylist(), right.select(["gram", "shard", "counts"]).to_pylist(), tokens, kinds, model)

    own = answers.filter("block is not null").select("block", "gram", "shard", "counts")
    return (dealt.groupBy("block").cogroup(own.groupBy("block"))
            .applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
