"""Spelling variants of the words of a corpus, found in a trie of letter counts.

Letters fall into ``GROUPS`` groups; a word's vector counts its letters by group. One
inserted, deleted or replaced letter adds at most one to one count (the surplus) and takes
at most one from another (the deficit). Arranged as a trie by successive counts, the words
near a given one are reached by a depth-first search that may spend one surplus and one
deficit on its way; the words of the leaves it ends in are verified letter by letter.

The upper levels of the trie are the partitioning. Words are cut into *units*, nodes of the
trie with at most ``UNIT_WORDS`` words: nodes of level ``START``, or deeper ones below a
node that holds more. Leaves that hold more are cut into chunks. A word visits the units
that its budget reaches in the upper levels, but only deeper ones than its own and later
ones of the same depth, so each pair is met once. As no unit holds more words than allowed,
and a budget of one each reaches a unit from few others, its visitors are bounded too,
however many words its neighbours' parents hold. A task holds one unit (or chunk) as a trie
and searches it for all visitors at a time, blocks of search states being taken depth
first. Only words on their visits, and pairs that are near, are shuffled.

Words: runs of letters, A-Z lower-cased, from whole texts, of which some lose a letter by a
rule on the document and the run. Null texts have no words and a null id counts as empty
text in that rule; repeated rows count as often as they occur. Ties for the form go to the
word that comes first by code points. Without words the result is empty.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.llm.common import ragged_ranges
from stationcast.session import durable

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least this many times as often as the word.
RATIO = 5
#: A run whose checksum this number divides loses a letter.
DROPPED = 199
GROUPS = 16
#: Levels of the trie that every unit has, and the most words of a unit.
START = 4
UNIT_WORDS = 4096
#: Heavy nodes up to this number are broadcast.
BROADCAST_NODES = 100_000
#: Search states, and letters compared, at a time.
BLOCK = 1 << 20


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All runs of letters, lower-cased, some with a letter dropped: column ``word``, one row each."""
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS + "{%d,}" % LEAST_LENGTH), F.lit(0))
    lower = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), F.explode(found).alias("run")).select("key", lower.alias("run"))
    sums = rows.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("crc"))
    at = (F.col("crc") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr(F.col("run"), at + 2))
    return sums.select(F.when(F.col("crc") % DROPPED == 0, shorter).otherwise(F.col("run")).alias("word"))


def count_words(found: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Distinct words and their number ``n``, leaving out short and rare ones."""
    counted = found.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def letter_counts(word: Column, groups: int = GROUPS) -> Column:
    """Letters by group: a letter's group is its code point modulo ``groups``."""
    group = F.transform(F.split(word, ""), lambda c: F.ascii(c) % groups)
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.size(F.filter(group, lambda x: x == g)))


def heavy_nodes(words: DataFrame, most: int, groups: int = GROUPS, start: int = START) -> DataFrame:
    """Nodes of the trie with more than ``most`` words: path (counts from the root) and n."""
    leaves = words.groupBy("vector").agg(F.count(F.lit(1)).alias("n"))
    depth = F.explode(F.sequence(F.lit(start), F.lit(groups))).alias("depth")
    nodes = leaves.select("vector", "n", depth).groupBy(F.slice("vector", F.lit(1), F.col("depth")).alias("path")).agg(F.sum("n").alias("n"))
    return nodes.filter(F.col("n") > most)


STATE = "array<struct<path: array<int>, surplus: int, deficit: int>>"


def one_deeper(state: Column, vector: Column) -> Column:
    """The states one level below: the word's own count, one more, or one less, as the budget allows."""
    own = F.get(vector, F.size(state.path))
    same = F.struct(F.concat(state.path, F.array(own)).alias("path"), state.surplus, state.deficit)
    more = F.struct(F.concat(state.path, F.array(own + 1)).alias("path"), F.lit(1).alias("surplus"), state.deficit)
    less = F.struct(F.concat(state.path, F.array(own - 1)).alias("path"), state.surplus, F.lit(1).alias("deficit"))
    reached = F.array(same, F.when(state.surplus == 0, more), F.when((state.deficit == 0) & (own > 0), less))
    return F.array_compact(reached).cast(STATE)


def routed(words: DataFrame, heavy: DataFrame, n_heavy: int, deepest: int, most: int, start: int = START) -> DataFrame:
    """Each word once in its own unit (kind 0) and once in every later unit that it may have to visit (kind 1)."""
    vector = F.col("vector")
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.lit(0).alias("surplus"), F.lit(0).alias("deficit"))).cast(STATE)
    down = lambda states, _: F.flatten(F.transform(states, lambda s: one_deeper(s, vector)))
    marks = F.broadcast(heavy) if n_heavy <= BROADCAST_NODES else heavy
    nodes = {d: marks.filter(F.size("path") == d).select(F.col("path").alias("heavy"), F.col("n").alias("held")) for d in range(start, deepest + 1)}
    rows = words.withColumn("depth", F.lit(start))  # of the word's own unit: below all heavy nodes on its way
    for depth in range(start, min(deepest, GROUPS - 1) + 1):
        met = rows.join(nodes[depth], F.slice(vector, F.lit(1), F.lit(depth)) == F.col("heavy"), "left")
        rows = met.withColumn("depth", F.col("depth") + F.col("heavy").isNotNull().cast("int")).drop("heavy", "held")
    rows = rows.withColumn("at", F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(start)), root, down)))
    for depth in range(start, deepest + 1):
        met = rows.join(nodes[depth], F.col("at.path") == F.col("heavy"), "left")
        if depth < GROUPS:  # go on below a heavy node
            below = F.when(F.col("heavy").isNotNull(), one_deeper(F.col("at"), vector)).otherwise(F.array("at").cast(STATE))
            rows = met.withColumn("at", F.explode(below)).drop("heavy", "held")
        else:
            rows = met.withColumnRenamed("held", "in_leaf").drop("heavy")
    own_path, reach = F.slice(vector, F.lit(1), F.col("depth")), F.size("at.path")
    rows = rows.filter((reach > F.col("depth")) | ((reach == F.col("depth")) & (F.col("at.path") >= own_path)))
    n_chunks = F.ceil(F.coalesce("in_leaf", F.lit(1)) / most).cast("int") if "in_leaf" in rows.columns else F.lit(1)
    own_chunk = F.pmod(F.xxhash64("word"), n_chunks).cast("int")
    at_home = F.col("at.path") == own_path
    chunks = F.when(at_home, F.sequence(own_chunk, n_chunks - 1)).otherwise(F.sequence(F.lit(0), n_chunks - 1))
    rows = rows.select("*", at_home.alias("home"), own_chunk.alias("own"), F.explode(chunks).alias("chunk"))
    return rows.select(
        F.col("at.path").alias("path"),
        "chunk",
        F.when(F.col("home") & (F.col("chunk") == F.col("own")), 0).otherwise(1).alias("kind"),
        "word",
        "n",
        "vector",
        F.col("at.surplus").alias("surplus"),
        F.col("at.deficit").alias("deficit"),
    )


class Letters:
    """Code points of words, one after the other, with hashes of their halves."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.cumsum(self.length) - self.length
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")


def near(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Which pairs of words a[i], b[j] differ by exactly one inserted, deleted or replaced letter."""
    gap = a.length[i] - b.length[j]
    found = np.zeros(len(i), bool)
    at = np.flatnonzero(gap == 0)
    found[at] = unequal(a, a.begin[i[at]], b, b.begin[j[at]], a.length[i[at]]) == 1
    for x, xi, y, yj, at in ((a, i, b, j, np.flatnonzero(gap == -1)), (b, j, a, i, np.flatnonzero(gap == 1))):
        # x is the shorter: equal up to some letter, and equal from there on with y moved by one
        start, other, n = x.begin[xi[at]], y.begin[yj[at]], x.length[xi[at]]
        head = equal_head(x, start, y, other, n)
        found[at] = unequal(x, start + head, y, other + head + 1, n - head) == 0
    return found


def unequal(a: Letters, start: np.ndarray, b: Letters, other: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unequal letters of the runs of ``n`` letters at ``start`` and ``other``."""
    pair, step = ragged_ranges(n)
    differ = a.codes[start[pair] + step] != b.codes[other[pair] + step]
    return np.bincount(pair[differ], minlength=len(n))


def equal_head(a: Letters, start: np.ndarray, b: Letters, other: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Letters before the first unequal one."""
    pair, step = ragged_ranges(n)
    differ = np.flatnonzero(a.codes[start[pair] + step] != b.codes[other[pair] + step])
    first = n.copy()
    first[pair[differ[::-1]]] = step[differ[::-1]]  # the earliest is written last
    return first


class Trie:
    """The words of a unit by their counts from level ``top`` on: each level's nodes, sorted by (parent, count)."""

    def __init__(self, words: list[str], vectors: np.ndarray, top: int):
        rest = vectors[:, top:].astype(np.int64)
        self.top, self.order = top, np.lexsort(rest.T[::-1]) if rest.shape[1] else np.arange(len(words))
        self.words = words
        self.letters = Letters(words)
        rest = rest[self.order]
        self.width = int(rest.max(initial=0)) + 1
        self.keys, node = [], np.zeros(len(words), np.int64)
        for level in range(rest.shape[1]):
            keys, node = np.unique(node * self.width + rest[:, level], return_inverse=True)
            self.keys.append(keys)
        n_leaves = len(self.keys[-1]) if self.keys else 1
        self.first = np.searchsorted(node, np.arange(n_leaves + 1))  # words of each leaf, by place in ``order``

    def search(self, vectors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word) whose counts differ by no more than the budget left, depth first."""
        rest = vectors[:, self.top :].astype(np.int64)
        zero = np.zeros(len(vectors), np.int64)
        stack = [(0, np.arange(len(vectors)), zero, surplus.astype(bool), deficit.astype(bool))]
        while stack:
            level, query, node, up, down = stack.pop()
            if len(query) > BLOCK:
                half = len(query) // 2
                stack += [(level, *(x[half:] for x in (query, node, up, down))), (level, *(x[:half] for x in (query, node, up, down)))]
                continue
            if level == len(self.keys):
                yield from self.leaves(query, node)
                continue
            count = rest[query, level]
            found = []
            for change, may in ((0, None), (1, ~up), (-1, ~down)):
                at = np.arange(len(query)) if may is None else np.flatnonzero(may)
                wanted = count[at] + change
                key = node[at] * self.width + wanted
                place = np.minimum(np.searchsorted(self.keys[level], key), len(self.keys[level]) - 1)
                hit = (self.keys[level][place] == key) & (wanted >= 0) & (wanted < self.width)
                at, place = at[hit], place[hit]
                found.append((query[at], place, up[at] | (change > 0), down[at] | (change < 0)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))

    def leaves(self, query: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All words of the leaves, at most about ``BLOCK`` pairs at a time."""
        size = self.first[leaf + 1] - self.first[leaf]
        total = np.cumsum(size)
        start = 0
        while start < len(query):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + BLOCK, "right")))
            pair, step = ragged_ranges(size[start:stop])
            yield query[start:stop][pair], self.order[self.first[leaf[start:stop][pair]] + step]
            start = stop

    def near(self, words: list[str], vectors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Verified pairs (query, word); with ``own`` the queries are the trie's words, each pair once."""
        letters = self.letters if own else Letters(words)
        for query, word in self.search(vectors, surplus, deficit):
            may = np.abs(letters.length[query] - self.letters.length[word]) <= 1
            if own:
                may &= query < word
            query, word = query[may], word[may]
            total = np.cumsum(letters.length[query])
            start = 0
            while start < len(query):  # the letters of a run of pairs are compared at once
                stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + 4 * BLOCK, "right")))
                q, w = query[start:stop], word[start:stop]
                good = near(letters, q, self.letters, w)
                yield q[good], w[good]
                start = stop


PAIRS = "a string, a_n long, b string, b_n long"


def near_pairs(words: DataFrame, most: int = UNIT_WORDS) -> DataFrame:
    """All pairs of ``words`` (written; word, n, vector) that differ by one letter, each once."""
    heavy = durable(heavy_nodes(words, most), "heavy")
    known = heavy.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("path")).alias("deepest")).first()
    rows = routed(words, heavy, known["n"], known["deepest"] or 0, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, trie = None, [], None

        def lists(part: pa.RecordBatch) -> tuple:
            vectors = np.array(part.column(5).flatten().to_numpy()).reshape(part.num_rows, -1)
            return part.column(3).to_pylist(), part.column(4).to_numpy(), vectors

        def pairs(words, n, found) -> Iterator[pa.RecordBatch]:
            for q, w in found:
                if len(q):
                    columns = [pa.array([words[x] for x in q.tolist()], pa.string()), pa.array(n[q])]
                    columns += [pa.array([residents[0][x] for x in w.tolist()], pa.string()), pa.array(residents[1][w])]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "a_n", "b", "b_n"])

        def build() -> Iterator[pa.RecordBatch]:
            nonlocal trie, residents
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            residents = lists(whole)
            trie = Trie(residents[0], residents[2], len(whole.column(0)[0]))
            none = np.zeros(whole.num_rows, bool)
            yield from pairs(residents[0], residents[1], trie.near(*residents[::2], none, none, own=True))

        residents = None
        for batch in batches:
            path, chunk, kind = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            own = [(tuple(p), c, k) for p, c, k in zip(path.to_pylist(), chunk.tolist(), kind.tolist(), strict=True)]
            edges = [i for i in range(1, len(own)) if own[i] != own[i - 1]]
            for start, stop in zip([0, *edges], [*edges, len(own)], strict=True):
                part = batch.slice(start, stop - start)
                if own[start][:2] != unit:
                    if held and trie is None:
                        yield from build()
                    unit, held, trie = own[start][:2], [], None
                if own[start][2] == 0:
                    held.append(part)
                elif held:
                    if trie is None:
                        yield from build()
                    words, n, vectors = lists(part)
                    spent = (part.column(c).to_numpy() > 0 for c in (6, 7))
                    yield from pairs(words, n, trie.near(words, vectors, *spent))
        if held and trie is None:
            yield from build()

    placed = rows.repartition("path", "chunk").sortWithinPartitions("path", "chunk", "kind", "word")
    return placed.mapInArrow(run, PAIRS)


def roots(forms: DataFrame, most: int, least: int, ratio: int = RATIO) -> DataFrame:
    """The last word that is reached from each ``word`` by its ``form``, doubling the steps in each round.

    Each step multiplies the number of occurrences by ``ratio`` at least, which bounds the steps.
    """
    steps = int(math.log(max(most, 1) / max(least, 1), ratio)) + 1
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(steps, 1).bit_length()):
        at = durable(at, "roots")
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return at


def variants(words: DataFrame, most_in_unit: int = UNIT_WORDS, ratio: int = RATIO) -> DataFrame:
    """For each of ``words`` (distinct word, n): its form, root, number of near words and the form's n."""
    known = durable(words.withColumn("vector", letter_counts(F.col("word"))), "words")
    pairs = near_pairs(known, most_in_unit)
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")),
    )
    links = pairs.select(F.explode(both).alias("l")).select("l.*")
    best = F.min(F.struct((-F.col("other_n")).alias("back"), "other")).alias("best")
    by_word = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = known.drop("vector").join(by_word, "word", "left")
    is_form = -F.col("best.back") >= F.col("n") * ratio
    found = durable(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"),
            F.when(is_form, -F.col("best.back")).alias("form_n"),
        ),
        "variants",
    )
    bounds = found.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    ends = roots(found.filter("form is not null"), bounds["most"] or 1, bounds["least"] or 1, ratio)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_in_unit: int = UNIT_WORDS) -> DataFrame:
    """Word, form, root, n, n_near and form_n of the words of all texts."""
    return variants(count_words(runs(docs, id_col, text_col)), most_in_unit)
