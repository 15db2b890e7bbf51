"""Best-two-fit packing of token sequences.

Every document becomes its token ids and an end id.  A longer one than a sequence is cut
into full pieces behind a first piece that holds the remainder, so only that first piece
needs company.

A bin is filled greedily: the longest piece left, then again and again the longest that
fits the gap.  Then the bin's smallest piece is taken out for the two unpacked pieces that
fit the expanded gap more tightly, as long as that narrows the gap.

What a bin looks like depends on the lengths alone, and there are at most ``size`` of them:
the whole corpus is one histogram of that many counts.  ``patterns`` packs the histogram,
filling as many equal bins at a time as its counts allow, so its work is bounded by the
number of lengths, not of documents, and no part of the corpus is packed apart from the
rest.  Pieces then take the places of their length in order of their rank, which comes from
counts per (length, bucket) and row numbers inside a bucket: no length, however common, is
ranked in one task.

Defined cases: a null or empty text is its end id alone; a very long text is cut as above;
pieces of equal length are placed in the order of a hash of (document, piece, checksum);
repeated rows are packed as often as they stand, a null id packs like any other; an empty
table gives an empty result.  Only the id and the text are read, so other columns,
whatever their names, do not matter.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpulse.llm.common import materialize, small_batches
from regionpulse.llm.fst_tokens import PATTERN, byte_alphabet
from regionpulse.llm.interleave import numbered

SIZE = 2048

_ENCODINGS: dict = {}


def encoding(path: str):
    """Byte-level BPE of a vocabulary file, with its special strings; one per worker process.

    tiktoken runs the file's own vocabulary: ids in order of merge rank are all it needs, and
    it gives the ids of the file's library several times faster."""
    if path not in _ENCODINGS:
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODINGS[path]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and with ``keep_ids`` the piece's
    ``token_ids`` (binary, little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_to_numpy
        for batch in batches:
            row, piece, start, data = [], [], [], []
            for k, t in enumerate(batch.column(1)):
                ids = np.append(encode(t.as_py() or "", allowed_special="all"), end_id).astype("<u4")
                first = (len(ids) - 1) % size + 1
                cuts = [0, *range(first, len(ids), size)]
                for i, at in enumerate(cuts):
                    row.append(k)
                    piece.append(i)
                    start.append(at)
                    data.append(ids[at:first if i == 0 else at + size].tobytes())
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array([len(d) // 4 for d in data], pa.int64()), pa.array([zlib.crc32(d) for d in data], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(data, pa.binary())] if keep_ids else []), names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["token_ids"] if keep_ids else [])
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", token_ids binary" if keep_ids else ""))


def patterns(histogram: Mapping[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(bins, lengths in a bin, longest first) that hold all of ``histogram`` (length: count)."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n

    def fitting() -> np.ndarray:
        """For each gap the longest length left that fits; 0: none."""
        some = np.where(left > 0, np.arange(size + 1), 0)
        some[0] = 0
        return np.maximum.accumulate(some)

    out = []
    longest = fitting()
    while longest[size]:
        bin_, gap = [], size
        while length := int(longest[gap]):
            fit = min(gap // length, int(left[length]))
            bin_ += [length] * fit
            gap -= fit * length
            left[length] -= fit
            if not left[length]:
                longest = fitting()
        while gap and len(bin_) > 1:
            room = gap + bin_[-1]
            first = np.arange(1, room // 2 + 1)  # the shorter of the two
            second = longest[room - first]
            able = (left[first] > 0) & (second > 0) & ((first != second) | (left[first] > 1))
            total = np.where(able, first + second, 0)
            # the longer one is the longest that fits; a pair of the same length needs two of it
            pair = int(total.argmax()) if len(total) else 0
            if not len(total) or total[pair] <= bin_[-1]:
                break
            a, b = int(first[pair]), int(second[pair])
            left[bin_[-1]] += 1
            left[a] -= 1
            left[b] -= 1
            bin_[-1:] = [a, b]
            bin_.sort(reverse=True)
            gap = size - sum(bin_)
            longest = fitting()
        used, times = np.unique(bin_, return_counts=True)
        more = int((left[used] // times).min())
        left[used] -= more * times
        longest = fitting()
        out.append((1 + more, bin_))
    return out


def _runs(packed: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """The places of every length as runs: (length << 40 | first rank, uses in a bin, first
    bin, offset in the bin), sorted."""
    taken: dict[int, int] = {}
    rows, first_bin = [], 0
    for bins, lengths in packed:
        at = 0
        used, uses = np.unique(lengths, return_counts=True)
        for length, n in zip(used[::-1].tolist(), uses[::-1].tolist()):
            rank = taken.get(length, 0)
            rows.append((length << 40 | rank, n, first_bin, at))
            taken[length] = rank + bins * n
            at += n * length
        first_bin += bins
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (pieces, written to a table) with ``sequence_id`` and ``offset``."""
    names = [f.name for f in cut.schema]
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    start, uses, first_bin, offset = _runs(patterns(counts, size))
    buckets = max(1, math.isqrt(sum(counts.values())))
    order = ["_key", "doc_id", "piece", "start", "ids_crc32"]
    keyed = cut.withColumn("_key", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("_b", F.pmod("_key", F.lit(buckets)))
    ranked = numbered(keyed, "_b", order, ["length"], "_rank").select(*names, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            at = np.searchsorted(start, length << 40 | rank, side="right") - 1
            turn = rank - (start[at] & (1 << 40) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(first_bin[at] + turn // uses[at]), pa.array(offset[at] + turn % uses[at] * length)],
                                             names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, size: int = SIZE, **options) -> DataFrame:
    """Every piece of every document with its place: (doc_id, piece, start, length,
    ids_crc32[, token_ids], sequence_id, offset)."""
    return place(materialize(pieces(docs, path, size, **options), "two-fit-pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, token_ids, doc_ids, offsets) of pieces packed with
    ``keep_ids``; a sequence's rows are bounded by its size."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "token_ids")))
    rows = packed.groupBy("sequence_id").agg(inside.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda ids, x: F.concat(ids, x["token_ids"]))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("n_tokens"), joined.alias("token_ids"),
                       F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("offsets"))
