"""Merkle-tree fingerprints of documents.

A text is a tree: paragraphs (split at line feeds) under sections under a root.  A
section ends after a paragraph whose own digest says so, so an inserted paragraph does
not move the sections behind it.  A paragraph's digest covers its exact text, a section's
its paragraphs' digests, the root its sections'; equal roots mean equal texts.  Beneath a
paragraph stand leaves: short stretches of its sentences, four words at most.

The fingerprint writes the tree out, so two fingerprints can be compared without the
texts: equal roots end the comparison, equal sections and paragraphs match whole, and
only differing branches are followed down to leaves.  ``likeness`` is the Dice coefficient
of the leaf multisets (1 for equal texts), ``changed`` lists the differing paragraphs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regionpulse.llm.common import small_batches

LEAF_WORDS = 4


@dataclass(frozen=True)
class Paragraph:
    digest: str
    leaves: tuple[int, ...]


@dataclass(frozen=True)
class Tree:
    root: str
    sections: tuple[tuple[str, tuple[Paragraph, ...]], ...]

    def paragraphs(self) -> list[Paragraph]:
        return [p for _, ps in self.sections for p in ps]

    def __str__(self) -> str:
        return self.root + "".join("/" + digest + "".join(f";{p.digest}:" + "".join([f"{x:08x}" for x in p.leaves]) for p in ps) for digest, ps in self.sections)


def parse(fingerprint: str) -> Tree:
    root, *sections = fingerprint.split("/")
    out = []
    for s in sections:
        digest, *ps = s.split(";")
        out.append((digest, tuple(Paragraph(d, tuple(int(leaves[i:i + 8], 16) for i in range(0, len(leaves), 8))) for d, leaves in (p.split(":") for p in ps))))
    return Tree(root, tuple(out))


def paragraph(text: str) -> Paragraph:
    data = text.encode("utf-8", "replace")
    leaves = []
    for sentence in data.split(b". "):
        ws = sentence.split(b" ")
        if len(ws) <= LEAF_WORDS:
            leaves.append(zlib.crc32(sentence))
        else:
            leaves += [zlib.crc32(b" ".join(ws[i:i + LEAF_WORDS])) for i in range(0, len(ws), LEAF_WORDS)]
    return Paragraph(sha256(data).hexdigest()[:32], tuple(leaves))


def tree(text: str | None, known: dict[str, Paragraph] | None = None) -> Tree:
    """The tree of a text; null counts as empty.  ``known`` keeps paragraphs already made."""
    known = {} if known is None else known
    sections, open_section = [], []
    for line in (text or "").split("\n"):
        p = known.get(line)
        if p is None:
            p = known[line] = paragraph(line)
        open_section.append(p)
        if p.digest[0] in "01":  # one paragraph in eight ends a section
            sections.append(open_section)
            open_section = []
    if open_section:
        sections.append(open_section)
    named = tuple((sha256("".join([p.digest for p in ps]).encode()).hexdigest()[:32], tuple(ps)) for ps in sections)
    # the number of paragraphs per section makes the digests' concatenation unambiguous
    return Tree(sha256("".join([f"{d}{len(ps)}," for d, ps in named]).encode()).hexdigest(), named)


def _unmatched(a: Tree, b: Tree) -> tuple[list[tuple[int, Paragraph]], list[tuple[int, Paragraph]], int]:
    """Numbered paragraphs of differing branches on each side, and leaves of the matched ones."""
    sections = Counter(d for d, _ in a.sections) & Counter(d for d, _ in b.sections)
    sides, same = [], 0
    for k, t in enumerate((a, b)):
        left, rest, at = Counter(sections), [], 0
        for d, ps in t.sections:
            if left[d] > 0:
                left[d] -= 1
                same += 0 if k else sum([len(p.leaves) for p in ps])
            else:
                rest += enumerate(ps, at)
            at += len(ps)
        sides.append(rest)
    shared = Counter(p.digest for _, p in sides[0]) & Counter(p.digest for _, p in sides[1])
    for k, ps in enumerate(sides):
        left, rest = Counter(shared), []
        for i, p in ps:
            if left[p.digest] > 0:
                left[p.digest] -= 1
                same += 0 if k else len(p.leaves)
            else:
                rest.append((i, p))
        sides[k] = rest
    return sides[0], sides[1], same


def likeness(a: Tree | str, b: Tree | str) -> float:
    """Share of leaves that both trees have, 0 to 1."""
    a, b = (parse(t) if isinstance(t, str) else t for t in (a, b))
    if a.root == b.root:
        return 1.0
    only_a, only_b, same = _unmatched(a, b)
    total = 2 * same + sum([len(p.leaves) for _, p in only_a + only_b])
    if only_a and only_b:
        other = Counter([x for _, p in only_b for x in p.leaves])
        mine = Counter([x for _, p in only_a for x in p.leaves])
        same += sum([min(n, other[x]) for x, n in mine.items() if x in other])
    return 2 * same / total


def changed(a: Tree | str, b: Tree | str) -> tuple[list[int], list[int]]:
    """Numbers of the paragraphs of ``a`` and of ``b`` that have no equal on the other side."""
    a, b = (parse(t) if isinstance(t, str) else t for t in (a, b))
    if a.root == b.root:
        return [], []
    only_a, only_b, _ = _unmatched(a, b)
    return [i for i, _ in only_a], [i for i, _ in only_b]


def edited_text(text: str, following: str) -> str:
    """``text`` with its last floor(n / 4) code points replaced by the first as many of ``following``."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut] if cut else text


def with_following(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_run: int = 1000, most_runs: int = 100_000) -> DataFrame:
    """(run, ahead, doc_id, text), partitioned by run and sorted: the rows of a run in
    ascending (id, text), and after them (``ahead`` = 1) the first of the next run, the
    first run following the last.

    Runs are ranges between quantiles of the ids (a list of at most ``most_runs`` numbers),
    so no task sees more than its runs and texts move once.  Null ids come first."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    n = min(most_runs, math.ceil(rows.count() / rows_per_run))
    cuts = rows.approxQuantile("doc_id", [k / n for k in range(n)], 0.2 / n) if n else []
    # each cut is a present id; the first run starts before all of them
    cuts = np.unique(np.array(cuts, np.float64))[1:]
    least = rows.agg({"doc_id": "min"}).first()[0] if n else None
    has_null = rows.filter("doc_id is null").limit(1).count() > 0 if n else False

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            missing = column.is_null().to_numpy(zero_copy_only=False)
            ids = column.fill_null(least if least is not None else 0).to_numpy(zero_copy_only=False).astype(np.float64)
            run = np.where(missing, 0, np.searchsorted(cuts, ids, side="right"))
            first = np.where(missing, True, (ids == least) & (not has_null)) if least is not None else missing
            at = np.flatnonzero(first | (~missing & (run > 0) & (ids == cuts[np.maximum(run, 1) - 1] if len(cuts) else np.zeros(len(ids), bool))))
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(np.zeros(len(ids), np.int32)), batch.column(0), batch.column(1)], names=["run", "ahead", "doc_id", "text"])
            if len(at):
                heads = pa.Table.from_batches([batch]).take(pa.array(at)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.where(run[at] > 0, run[at] - 1, len(cuts)), pa.int64()), pa.array(np.ones(len(at), np.int32)), heads.column(0), heads.column(1)], names=["run", "ahead", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "run long, ahead int, doc_id long, text string")
    return dealt.repartition(max(1, math.ceil(n / 4)), "run").sortWithinPartitions("run", "ahead", "doc_id", "text")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one after this in ascending (id, text), the first after the
    last; a table of one row is followed by itself.  A null text counts as empty; repeated
    rows and rows that share an id follow each other; an empty table gives an empty result;
    only the id and the text are read, so other columns cannot clash."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, known = None, None, {}
        for batch in batches:
            out = []
            for part, ahead, i, t in zip(*[c.to_pylist() for c in batch.columns]):
                t = t or ""
                known_next: dict[str, Paragraph] = {}
                made_next = tree(t, known_next)
                if now is not None and now[0] == part and not now[1]:
                    edited = edited_text(now[3], t)
                    made_edited = tree(edited, known)
                    out.append((now[2], len(now[3]), sha256(edited.encode("utf-8", "replace")).hexdigest(), str(made), str(made_edited), likeness(made, made_edited), likeness(made, made_next)))
                now, made, known = (part, ahead, i, t), made_next, known_next
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], types[k]) for k in range(len(names))], names=names)

    return with_following(docs, doc_id, text).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
