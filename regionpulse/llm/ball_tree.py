"""Ranked lexical search: exact inner products over sparse ball trees.

The score of a document for a query is the inner product of two sparse vectors over the
query set's terms: whole-number term weights in the query, saturated term frequencies in
the document.  Documents are arranged in ball trees.  A node keeps the centroid of its
documents and two radii: one for the whole vector, the largest Euclidean distance from the
centroid, and one for each term, the largest excess over it.  For a query q no document
below has more than

    q . c  +  |q restricted to the node's terms| * r        nor more than   sum of q_t * (c_t + r_t).

The bounds are taken in doubles, and each is widened by more than its rounding error, so
none is too small.  Nodes are opened best bound first; a search ends when the best bound
left is below the score of the k-th document found.  Leaves are scored in 64-bit integers,
so the results are exact and equal scores are kept apart only by the document's id.

On the cluster: the query set is taken in blocks of bounded size.  One pass over the texts
writes each document's length and its terms among the block's, and their frequencies; the
corpus numbers come from that table.  Then each task arranges its documents in trees of a bounded
number of entries, one after the other, searches each for all queries of the block, and
carries the best found to the next tree, so later trees are pruned from the start.  A task
gives at most k rows for a query; only those are shuffled and ranked.

Defined cases: a null, empty or termless text is not among the documents, a null, empty or
termless query has no results; a very long text is one vector like any other; repeated rows
of documents are ranked each, in the order of their (equal) id; repeated queries have their
results each; a null id comes before all others; an empty table on either side gives an
empty result.  Only ids and texts are read, so other columns, whatever their names, do not
matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regionpulse.llm.common import materialize, small_batches

#: byte table: letters A-Z to lower case, what no term holds to a space
TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: more than the relative rounding error of any sum of fewer than 10^6 non-negative doubles
SAFE = 1e-9


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(TERM_BYTES).split()


class Ball:
    """One node: a centroid over the terms that occur, two kinds of radius, and either
    children or the documents from ``low`` to ``high``."""

    __slots__ = ("terms", "centroid", "most", "radius", "low", "high", "children")


class BallTree:
    """Ball tree of sparse whole-number vectors given as rows (start, terms, values)."""

    def __init__(self, start: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int, leaf_rows: int = 32):
        self.leaf_rows, self.n_terms = leaf_rows, n_terms
        rows = len(start) - 1
        self.order = np.arange(rows)
        size = np.diff(start)
        x = values.astype(np.float64)
        norm = np.zeros(rows)
        np.add.at(norm, np.repeat(np.arange(rows), size), x * x)
        self.scratch = np.zeros(n_terms)
        self.root = self._build(start, size, terms, x, norm, np.arange(rows), 0) if rows else None
        # the rows in leaf order
        size = size[self.order]
        self.start = np.concatenate([[0], np.cumsum(size)])
        entry = np.repeat(start[self.order] - self.start[:-1], size) + np.arange(self.start[-1])
        self.terms, self.values = terms[entry], values[entry]

    def _entries(self, start: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all entries of ``rows``, and the row of each (0, 1, ...)."""
        n = size[rows]
        first = np.cumsum(n) - n
        return np.repeat(start[rows] - first, n) + np.arange(int(n.sum())), np.repeat(np.arange(len(rows)), n)

    def _build(self, start, size, terms, x, norm, rows, low) -> Ball:
        at, row = self._entries(start, size, rows)
        used, place = np.unique(terms[at], return_inverse=True)
        ball = Ball()
        ball.terms, ball.low, ball.high, ball.children = used, low, low + len(rows), ()
        ball.centroid = np.bincount(place, x[at], len(used)) / len(rows)
        ball.most = np.zeros(len(used))
        np.maximum.at(ball.most, place, x[at])
        cross = np.bincount(row, x[at] * ball.centroid[place], len(rows))
        own = float(ball.centroid @ ball.centroid)
        square = norm[rows] - 2 * cross + own + 8 * SAFE * (norm[rows] + own)  # cancels: widened by its terms
        ball.radius = math.sqrt(float(square.max()))
        if len(rows) <= self.leaf_rows:
            self.order[low:low + len(rows)] = rows
            return ball
        # two far documents: the farthest from the centroid, and the farthest from that one
        one = int(square.argmax())

        def along(k: int) -> np.ndarray:
            mine = slice(start[rows[k]], start[rows[k] + 1])
            self.scratch[terms[mine]] = x[mine]
            dot = np.bincount(row, x[at] * self.scratch[terms[at]], len(rows))
            self.scratch[terms[mine]] = 0
            return dot

        dot_one = along(one)
        two = int((norm[rows] - 2 * dot_one).argmax())
        side = (norm[rows[two]] - 2 * along(two)) - (norm[rows[one]] - 2 * dot_one)  # negative: nearer to the second
        half = side.argsort(kind="stable")
        cut = int((side < 0).sum())
        # no side is smaller than an eighth, so the depth stays logarithmic also among equal rows
        least = max(1, len(rows) // 8)
        cut = min(max(cut, least), len(rows) - least)
        left = self._build(start, size, terms, x, norm, rows[half[:cut]], low)
        ball.children = (left, self._build(start, size, terms, x, norm, rows[half[cut:]], low + cut))
        return ball

    @staticmethod
    def bound(ball: Ball, terms: np.ndarray, weights: np.ndarray) -> float:
        """At least the inner product of the query with any document below."""
        at = np.minimum(ball.terms.searchsorted(terms), len(ball.terms) - 1)
        q = np.where(ball.terms[at] == terms, weights, 0.0)
        round_ball = float(q @ ball.centroid[at]) + math.sqrt(float(q @ q)) * ball.radius
        return min(round_ball, float(q @ ball.most[at])) * (1 + 4 * SAFE)

    def search(self, terms: np.ndarray, weights: np.ndarray, ids: list, best: list, k: int, dense: np.ndarray) -> None:
        """Puts documents with a positive score into ``best``, a heap of the k best
        (score, reversed id, id); ``dense`` is a zeroed whole-number array over all terms."""
        if self.root is None or not len(terms):
            return
        q = weights.astype(np.float64)
        dense[terms] = weights
        heap = [(-self.bound(self.root, terms, q), 0, self.root)]
        ticket = 0
        while heap:
            bound, _, ball = heapq.heappop(heap)
            if -bound < (best[0][0] if len(best) == k else 1):
                break
            if ball.children:
                for child in ball.children:
                    ticket += 1
                    heapq.heappush(heap, (-self.bound(child, terms, q), ticket, child))
                continue
            low, high = self.start[ball.low], self.start[ball.high]
            begin = self.start[ball.low:ball.high] - low
            score = np.add.reduceat(dense[self.terms[low:high]] * self.values[low:high], begin)
            for i in np.flatnonzero(score >= (best[0][0] if len(best) == k else 1)).tolist():
                doc = ids[self.order[ball.low + i]]
                found = (int(score[i]), math.inf if doc is None else -doc, doc)
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found[:2] > best[0][:2]:
                    heapq.heapreplace(best, found)
        dense[terms] = 0


def vectors(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf) of each document with a term: all its terms counted in ``n``,
    those of the vocabulary listed by number, with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary)}
        for batch in batches:
            row, n, start, flat, tf = [], [], [0], [], []
            for k, t in enumerate(batch.column(1)):
                found = terms_of(t.as_py())
                if not found:
                    continue
                used, times = np.unique(np.array([number[w] for w in found if w in number], np.int32), return_counts=True)
                row.append(k)
                n.append(len(found))
                flat.append(used)
                tf.append(times)
                start.append(start[-1] + len(used))
            lists = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *v]).astype(np.int32))) for v in (flat, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, queries: list[tuple], k: int = 10, doc_id: str = "doc_id", text: str = "text", tree_entries: int = 400_000, leaf_rows: int = 32) -> DataFrame:
    """(query, rank, doc_id, score) for a bounded list of (id, {term: times}) queries;
    ``query`` is the place in the list."""
    vocabulary = sorted(set().union(*[q for _, q in queries]))
    table = materialize(vectors(docs, vocabulary, doc_id, text), "ball-vectors")
    total = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = total["n"], max(1, total["l"])
    df = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
        df[r["t"]] = r["count"]
    number = {t: i for i, t in enumerate(vocabulary)}
    wanted = []
    for _, q in queries:
        terms = np.array(sorted(number[t] for t in q), np.int64)
        wanted.append((terms, np.array([q[vocabulary[t]] * term_weight(n_docs, int(df[t])) for t in terms], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in wanted]
        dense = np.zeros(len(vocabulary), np.int64)

        def search(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists, n = rows.column("terms").combine_chunks(), rows.column("n").to_numpy()
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms, tf = lists.flatten().to_numpy().astype(np.int64), rows.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            values = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size))
            some = size > 0  # documents with no term of the block score nothing
            ids = [i for i, s in zip(rows.column("doc_id").to_pylist(), some.tolist()) if s]
            tree = BallTree(np.concatenate([[0], np.cumsum(size[some])]), terms, values, len(vocabulary), leaf_rows)
            for (t, w), b in zip(wanted, best):
                tree.search(t, w, ids, b, k, dense)

        held, entries = [], 0
        for batch in batches:
            held.append(batch)
            entries += len(batch.column(batch.schema.get_field_index("terms")).flatten())
            if entries >= tree_entries:
                search(held)
                held, entries = [], 0
        if held:
            search(held)
        out = [(i, doc, score) for i, b in enumerate(best) for score, _, doc in b]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], names=["query", "doc_id", "score"])

    found = table.mapInArrow(run, "query int, doc_id long, score long")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text", block_terms: int = 200_000, **options) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a positive
    score, equal scores by ascending id.

    Items come in blocks of about ``block_terms`` distinct (item, term) entries, one pass
    over the documents for each; the driver holds one block at a time."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = items.schema[item_id].dataType
    results = []

    def finish(block: list[tuple]) -> None:
        names = spark.createDataFrame([(i, q[0]) for i, q in enumerate(block)], f"query int, item_id {id_type.simpleString()}")
        ranked = search_block(docs, block, k, **options)
        results.append(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))

    block: list[tuple] = []
    entries = 0
    for r in items.select(items[item_id].alias("i"), items[item_text].alias("t")).toLocalIterator():
        q: dict[bytes, int] = {}
        for t in terms_of(r["t"]):
            q[t] = q.get(t, 0) + 1
        if q:
            block.append((r["i"], q))
            entries += len(q)
        if entries >= block_terms:
            finish(block)
            block, entries = [], 0
    if block:
        finish(block)
    if not results:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out
