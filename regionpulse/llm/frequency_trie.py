"""Spelling variants: words one edit apart, found in a trie over letter-group counts.

The letters fall into ``GROUPS`` groups; a word's path is its length and then the number of
its letters in each group, and the trie arranges words by these counts.  One edit changes
the group counts by one surplus (a letter more), one deficit (a letter less) or one of each, in
the same group or in two.  So a depth-first search that may spend one surplus and one deficit
reaches every word one edit away, and the few words at a leaf are verified.  As nearness
has no direction, a search looks for words one letter longer (a surplus to spend) and for
words of its own length (a surplus and after it a deficit): of two words only one finds the
other.

The vocabulary is dealt to tasks by subtrees.  A subtree is cut, at one of a few ``DEPTHS``,
where it holds at most ``most_words``; a search is sent to each cut that its first steps can reach, with the budget
that is left.  A leaf with more words than that, or a subtree that more searches reach, is
dealt in blocks (some words x some searches), so no task holds an unbounded group; at a
leaf of many words only those with an equal half are looked at, as one edit leaves one half
of a word as it is.

Defined cases: a null, empty or wordless text has no words; a very long text or word is one
as any other; a repeated row counts again (the document's id decides, not the row, which
letter a word loses; a null id reads as empty); ties between near words go to the
smallest in code-point order; an empty table gives an empty result.  Only the id and the
text are read, so other columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionpulse.llm.common import materialize, text_or_empty

GROUPS = 13
#: levels at which subtrees can be cut; the last is a leaf
DEPTHS = (1, 3, 5, 7, 9, 1 + GROUPS)
#: what a search has spent: with its own length nothing, the surplus, both; with one letter more nothing, the surplus
NONE, SURPLUS, BOTH, LONGER, INSERTED = range(5)
#: letters from frequent to rare: the first levels of the trie tell words apart best
ORDER = "etaoinsrhldcumfpgwybvkxjqz"
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 6, least_count: int = 5, lost: int = 199) -> DataFrame:
    """(word, n): words of at least ``least_chars`` letters with at least ``least_count``
    occurrences over all texts.  A word whose checksum together with the document's id is
    divisible by ``lost`` stands without one of its letters."""
    runs = F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))
    each = docs.select(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":")).alias("at"), F.explode(runs).alias("run"))
    hashed = each.select("run", F.crc32(F.encode(F.concat("at", "run"), "UTF-8")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), cut), F.col("run").substr(cut + 2, F.length("run")))
    word = F.when(F.col("h") % lost == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


class GroupOf(dict):
    """The group of each letter: its place in ``ORDER``, of others the code point, modulo ``GROUPS``."""

    def __missing__(self, letter: str) -> int:
        self[letter] = group = (ORDER.find(letter) if letter in ORDER else ord(letter)) % GROUPS
        return group


_GROUP = GroupOf()


def path_of(word: str) -> tuple[int, ...]:
    counts = [0] * GROUPS
    for c in word:
        counts[_GROUP[c]] += 1
    return (len(word), *counts)


def spend(spent: int, level: int, difference: int) -> int:
    """What is spent after a level whose count differs by that much; -1: out of reach."""
    if not difference:
        return spent
    if level == 0:
        return LONGER if difference == 1 else -1
    if difference == 1 and spent in (NONE, LONGER):
        return spent + 1
    return BOTH if difference == -1 and spent == SURPLUS else -1


def reachable(path: tuple[int, ...], depth: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(first ``depth`` >= 1 counts, spent) of all subtrees that a search can enter."""
    top = path[:depth]
    longer = (top[0] + 1,) + top[1:]
    yield top, NONE
    yield longer, LONGER
    for i in range(1, depth):
        yield longer[:i] + (top[i] + 1,) + top[i + 1:], INSERTED
        more = top[:i] + (top[i] + 1,) + top[i + 1:]
        yield more, SURPLUS
        for j in range(i + 1, depth):
            if top[j]:
                yield more[:j] + (top[j] - 1,) + more[j + 1:], BOTH


def name_of(top: tuple[int, ...]) -> str:
    return f"{len(top)}:" + ",".join(map(str, top))


def one_edit(word: str, other: str) -> bool:
    """Whether ``other``, as long as ``word`` or one letter longer, is exactly one edit away."""
    n, extra = len(word), len(other) - len(word)
    half = n // 2
    if word[:half] != other[:half] and word[half:] != other[half + extra:]:
        return False
    i = 0
    while i < n and word[i] == other[i]:
        i += 1
    if extra:
        return word[i:] == other[i + 1:]
    return i < n and word[i + 1:] == other[i + 1:]


class Leaf:
    """The words of one path."""

    def __init__(self, path: tuple[int, ...], words: list[str]):
        self.path, self.words = path, words
        self.halves: dict[int, dict[tuple[bool, str], list[str]]] = {}

    def candidates(self, word: str, few: int = 8) -> list[str]:
        """Words that can be one edit from ``word``: all of a few, of many those with an equal half."""
        if len(self.words) <= few:
            return self.words
        half, rest = len(word) // 2, len(word) - len(word) // 2
        index = self.halves.get(len(word))
        if index is None:
            index = self.halves[len(word)] = {}
            for w in self.words:
                index.setdefault((True, w[:half]), []).append(w)
                index.setdefault((False, w[-rest:]), []).append(w)
        first = index.get((True, word[:half]), [])
        return first + [w for w in index.get((False, word[half:]), []) if w[:half] != word[:half]]


class Trie:
    """Words arranged by their counts from level ``depth`` on; a path without a fork is one leaf."""

    def __init__(self, words: list[str], depth: int = 0):
        self.depth = depth
        by_path: dict[tuple[int, ...], list[str]] = {}
        for w in words:
            by_path.setdefault(path_of(w), []).append(w)
        leaves = [Leaf(p, ws) for p, ws in by_path.items()]
        self.root = self._node(leaves, depth) if leaves else {}

    def _node(self, leaves: list[Leaf], level: int):
        if len(leaves) == 1:
            return leaves[0]
        children: dict[int, list[Leaf]] = {}
        for leaf in leaves:
            children.setdefault(leaf.path[level], []).append(leaf)
        return {count: self._node(some, level + 1) for count, some in children.items()}

    def near(self, word: str, spent: int = NONE) -> Iterator[str]:
        """Words one edit from ``word`` that a search finds with the budget that is left."""
        path = path_of(word)
        levels = len(path)
        stack = [(self.root, self.depth, spent)]
        while stack:
            node, level, spent = stack.pop()
            if isinstance(node, Leaf):
                other = node.path
                while level < levels and spent >= 0:
                    if other[level] != path[level]:
                        spent = spend(spent, level, other[level] - path[level])
                    level += 1
                if spent in (NONE, BOTH, INSERTED):
                    for w in node.candidates(word):
                        # with nothing spent both words find each other: the smaller one counts
                        if (spent or word < w) and one_edit(word, w):
                            yield w
                continue
            count = path[level]
            if (child := node.get(count)) is not None:
                stack.append((child, level + 1, spent))
            if level == 0:
                if (child := node.get(count + 1)) is not None:
                    stack.append((child, 1, LONGER))
            elif spent == NONE or spent == LONGER:
                if (child := node.get(count + 1)) is not None:
                    stack.append((child, level + 1, spent + 1))
            elif spent == SURPLUS and (child := node.get(count - 1)) is not None:
                stack.append((child, level + 1, BOTH))


def near_pairs(vocabulary: DataFrame, cut_depths: tuple[int, ...] = DEPTHS, most_words: int = 20_000, searches_per_task: int = 25_000, most_cuts: int = 1_000_000) -> DataFrame:
    """(a, n_a, b, n_b): every two words of ``vocabulary`` (word, n; a written table of
    distinct words) that are one edit apart, once."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            paths = [path_of(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(p[:d]) for p in paths for d in cut_depths], pa.string()),
                                              pa.array([d for _ in paths for d in cut_depths], pa.int32()),
                                              pa.array([w for w in words for _ in cut_depths], pa.string())], names=["top", "depth", "word"])

    tops = vocabulary.select("word").mapInArrow(prefixes, "top string, depth int, word string")
    sizes = tops.groupBy("top", "depth").agg(F.count(F.lit(1)).alias("size"))
    # the first subtree on a word's path that is small enough, or its leaf
    able = materialize(sizes.filter((F.col("size") <= most_words) | (F.col("depth") == cut_depths[-1])), "trie-sizes")
    home = tops.join(able, ["top", "depth"]).groupBy("word").agg(F.min(F.struct("depth", "top", "size")).alias("home"))
    homes = materialize(home.select("word", "home.*").join(vocabulary, "word"), "trie-homes")
    cuts = materialize(homes.select("top", "depth", "size").distinct(), "trie-cuts")
    # the names of the cuts, where they are few enough to be known to every task; beyond that
    # the join below alone finds the cuts among all that a search could enter
    known = {r["top"] for r in cuts.select("top").collect()} if cuts.count() <= most_cuts else None
    tuples = None if known is None else {tuple(map(int, top.split(":")[1].split(","))) for top in known}
    depths = sorted(r["depth"] for r in cuts.select("depth").distinct().collect())  # some of ``cut_depths``

    def searches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                top, row, spent = [], [], []
                for k, w in enumerate(some.column(0).to_pylist()):
                    path = path_of(w)
                    for depth in depths:
                        for at, s in reachable(path, depth):
                            if tuples is None or at in tuples:
                                top.append(name_of(at))
                                row.append(k)
                                spent.append(s)
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), some.column(0).take(rows), some.column(1).take(rows), pa.array(spent, pa.int32())], names=["top", "word", "n", "spent"])

    sent = materialize(vocabulary.select("word", "n").mapInArrow(searches, "top string, word string, n long, spent int").join(cuts, "top"), "trie-searches")
    blocks = sent.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / most_words).cast("int").alias("of_searches")).join(cuts, "top")
    blocks = blocks.select("top", "depth", "of_searches", F.ceil(F.col("size") / most_words).cast("int").alias("of_words"))
    part = lambda n: F.pmod(F.xxhash64("word", F.lit("block")), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    targets = (homes.select("top", "word", "n").join(blocks, "top").withColumn("block", part("of_words"))
               .withColumn("part", every("of_searches")).select("top", "depth", "block", "part", "word", "n", F.lit(-1).alias("spent")))
    queries = (sent.select("top", "word", "n", "spent").join(blocks, "top").withColumn("part", part("of_searches"))
               .withColumn("block", every("of_words")).select("top", "depth", "block", "part", "word", "n", "spent"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts, trie = None, {}, None  # of the words of the block at hand, which come before its searches
        for batch in batches:
            a, b = [], []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:4] != key:
                    key, counts, trie = row[:4], {}, None
                _, depth, _, _, spent, word, n = row
                if spent < 0:
                    counts[word] = n
                    continue
                if trie is None:
                    trie = Trie(list(counts), depth) if counts else ()
                if counts:
                    for other in trie.near(word, spent):
                        a.append((word, n))
                        b.append((other, counts[other]))
            columns = [pa.array([x[i] for x in side], t) for side in (a, b) for i, t in ((0, pa.string()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "n_a", "b", "n_b"])

    keys = ["top", "depth", "block", "part"]
    tasks = max(1, sent.count() // searches_per_task)  # by work: Spark would go by bytes, which are few
    dealt = targets.union(queries).select(*keys, "spent", "word", "n").repartition(tasks, *keys).sortWithinPartitions(*keys, "spent")
    return dealt.mapInArrow(search, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, by doubling the steps.

    A form is more frequent than its word by a factor, so a chain has no loop and its
    length is logarithmic in the counts."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "trie-roots")
    for _ in range(most_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "trie-roots")
        now = further.select("word", "root")
        if not further.filter("moved").limit(1).count():
            return now
    raise RuntimeError(f"forms did not end in {most_rounds} rounds")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dominance: int = 5, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every counted word: its most frequent near
    word if that is at least ``dominance`` times as frequent, and the end of that chain."""
    vocabulary = materialize(word_counts(docs, doc_id, text), "trie-words")
    pairs = materialize(near_pairs(vocabulary, **options), "trie-pairs")
    both = pairs.union(pairs.select("b", "n_b", "a", "n_a")).toDF("word", "n", "other", "other_n")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    wins = -F.col("best.less") >= dominance * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(wins, F.col("best.other")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n")), "trie-near")
    ends = roots(near.filter("form is not null"))
    return (vocabulary.join(near, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
