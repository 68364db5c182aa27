"""Toxicity by compression distance between two zstandard dictionaries.

Both dictionaries hold the same ordinary prose. The toxic one also holds the passages
that toxic training texts use in far more contexts than ordinary ones; the ordinary one
has blanks in their place. A window of text that uses such passages is shorter with the
toxic dictionary, any other window is about as long with both. Matches below five bytes
are not used, so that chance syllables don't count. The passages stand once before the
prose and once after it, where they cost fewer bits to point to, which makes two pairs
of dictionaries.

A document's windows give the largest differences and how many windows exceed each
difference; a logistic model fitted on training documents turns these into a score, so
its threshold of 0.5 is calibrated on labels.

The fit uses at most ``TOXIC`` and ``ORDINARY`` labelled documents, those with the
smallest hash of their id, of at most ``MOST_CHARS`` characters. All labels are counted by
class, and the intercept is shifted from the odds of the sample to the odds of the labels, so
that the threshold doesn't depend on the size of the table. Scores cover whole texts. Null and empty texts have no windows and get the score of that. Without training
texts of both kinds every score is the share of toxic ones (0 without any). Equal texts
get equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.llm.common import annotate, codes_of, id_crc, keep_rows, mix, split_words

TOXIC, ORDINARY, MOST_CHARS = 1500, 3000, 20_000
PROSE_BYTES = 32_768
PASSAGE_BYTES = 8_192
WINDOW, STEP = 128, 64
LEAST_MATCH = 5
#: A passage has at least this many contexts in toxic texts and is this many times as frequent as in ordinary ones.
CONTEXTS, TIMES = 8, 5
PREFIXES = range(3, 13)
EDGES = b".,;:!?()\"'"


def plain(text: str) -> bytes:
    """Lower case, single spaces, a space at either end."""
    return (" " + " ".join(text.lower().split()) + " ").encode()


def contexts(texts: list[bytes]) -> tuple[Counter, int]:
    """For each word, its distinct contexts (the words beside it); copies of a text add none."""
    words, rows = split_words(pa.array(texts, pa.binary()).cast(pa.string()))
    distinct, code = codes_of(words)
    if not len(code):
        return Counter(), 0
    before = np.where(np.append([True], rows[1:] != rows[:-1]), -1, np.roll(code, 1))
    after = np.where(np.append(rows[1:] != rows[:-1], [True]), -1, np.roll(code, -1))
    with np.errstate(over="ignore"):
        key = mix(mix(mix(code + 1) + (before + 2).astype(np.uint64)) + (after + 2).astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    count = np.bincount(code[first], minlength=len(distinct))
    found: Counter = Counter()
    for word, n in zip(distinct.to_pylist(), count.tolist(), strict=True):
        found[word.encode().strip(EDGES)] += n
    return found, len(first)


def passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Word beginnings that mark toxic texts, rarest first."""
    (own, n_own), (other, n_other) = contexts(toxic), contexts(ordinary)
    count: Counter = Counter()
    for word, n in own.items():
        for k in PREFIXES:
            if len(word) >= k:
                count[word[:k]] += n
    count = Counter({p: n for p, n in count.items() if n >= CONTEXTS})
    against: Counter = Counter()
    for word, n in other.items():
        for k in PREFIXES:
            if len(word) >= k and word[:k] in count:
                against[word[:k]] += n
    marked = {}
    for p, n in count.items():
        low = max(n - 2 * math.sqrt(n), 0) / n_own
        high = (against[p] + 2 * math.sqrt(against[p]) + 3) / max(n_other, 1)
        if low >= TIMES * high:
            marked[p] = n
    starts = {p: [q for q in (p[:k] for k in PREFIXES if k < len(p)) if q in marked] for p in marked}
    out = set(marked)
    for p, shorter in starts.items():
        for q in shorter:  # of a passage and its beginning, the longer one if nearly all uses go on so
            out.discard(q if marked[p] >= 0.7 * marked[q] else p)
    return sorted(out, key=lambda p: (marked[p], p))


@dataclass
class Model:
    prose: bytes = b""
    marks: bytes = b""
    share: float = 0.0
    weights: np.ndarray | None = None
    center: np.ndarray | None = None
    spread: np.ndarray | None = None
    pairs: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"pairs": []}

    def prepare(self) -> list[tuple]:
        """Ordinary and toxic compressors, made once in each process."""
        if not self.pairs:
            rules = zstandard.ZstdCompressionParameters(
                window_log=18, chain_log=17, hash_log=17, search_log=5, min_match=LEAST_MATCH, target_length=1,
                strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            blank = b"\0" * len(self.marks)
            for without, with_marks in (
                (blank + self.prose, self.marks + self.prose), (self.prose + blank, self.prose + self.marks),
            ):
                pair = []
                for content in (without, with_marks):
                    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    own.precompute_compress(compression_params=rules)
                    pair.append(zstandard.ZstdCompressor(compression_params=rules, dict_data=own).compress)
                self.pairs.append(tuple(pair))
        return self.pairs

    def features(self, text: str) -> list[float]:
        data = plain(text)
        windows = [data[i : i + WINDOW] for i in range(0, max(len(data) - STEP, 1), STEP)] if len(data) > 2 else []
        out = [math.log1p(len(windows))]
        for ordinary, toxic in self.prepare():
            gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], float)
            top = [*np.sort(gain)[::-1][:3].clip(-8, 8), 0, 0, 0][:3]
            over = [int((gain >= k).sum()) for k in (1, 2, 3, 4)]
            out += [*top, *map(math.log1p, over), *(n / max(len(windows), 1) for n in over[:3])]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), -1) - self.center) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -50, 50)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 30) -> np.ndarray:
    """Weights of a logistic model, intercept first, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        bend = a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + penalty * np.eye(len(w))
        w += np.linalg.solve(bend, a.T @ (y - p) - penalty * w)
    return w


def train(texts: list[str], toxic: list[int], each: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model of labelled texts, where an ordinary and a toxic one stand for ``each`` of their class."""
    y = np.array(toxic, float)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model(share=share)
    data = [plain(t) for t in texts]
    ordinary = [d for d, t in zip(data, toxic, strict=True) if not t]
    marks = passages([d for d, t in zip(data, toxic, strict=True) if t], ordinary)
    written = b"\n " + b"\n ".join(marks)[-PASSAGE_BYTES:] + b"\n"
    prose = b""
    for d in ordinary:
        if len(prose) < PROSE_BYTES:
            prose += d
    model = Model(prose[:PROSE_BYTES], written, share)
    x = np.array([model.features(t) for t in texts])
    model.center, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = logistic((x - model.center) / model.spread, y)
    model.weights[0] += math.log(each[1] / each[0])
    return model


def usable(labels: DataFrame, use: Column) -> DataFrame:
    """The labels (``key``, ``toxic``) that ``use`` accepts."""
    return labels.filter(use & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("key"), "toxic")


def stands_for(labels: DataFrame, use: Column) -> tuple[float, float]:
    """The labels for each one taken into the sample, of ordinary and of toxic texts."""
    count = {r["toxic"]: r["count"] for r in usable(labels, use).groupBy("toxic").count().collect()}
    return max(count.get(0, 0) / ORDINARY, 1.0), max(count.get(1, 0) / TOXIC, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``TOXIC`` and ``ORDINARY`` labelled texts (``text``, ``toxic``) out of the rows that ``use`` accepts."""
    named = usable(labels, use)
    order = F.xxhash64("key"), "key"
    chosen = [named.filter(F.col("toxic") == t).orderBy(*order).limit(n) for t, n in ((1, TOXIC), (0, ORDINARY))]
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).filter(F.length("text") <= MOST_CHARS)
    both = F.broadcast(chosen[0].unionByName(chosen[1]))  # TOXIC + ORDINARY rows at most
    return texts.join(both, "key").orderBy(*order, "text").limit(TOXIC + ORDINARY).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = training_rows(docs, labels, use, id_col, text_col).collect()
    return train([r.text for r in rows], [r.toxic for r in rows], stands_for(labels, use))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``score`` and ``predicted``. No shuffle."""

    def run(texts: pa.Array) -> dict:
        score = model.scores(texts.to_pylist())
        return {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return annotate(docs, run, pa.schema([("score", pa.float64()), ("predicted", pa.int32())]), id_col, text_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    return keep_rows(docs, lambda texts: model.scores(texts.to_pylist()) < 0.5, text_col)


def in_training(id_col: str = "doc_id") -> Column:
    """Labels may be learned from rows whose crc32 of the id is not a multiple of five."""
    return id_crc(id_col, 5) != 0
