"""Language of texts by a linear-chain conditional random field over their words.

Each word (a run of letters) gets scores from its features: the word itself and the
lexicons it is in, its beginnings and endings, and its letter pairs and triples. Learned
transitions say how likely the next word stays in a language. Forward-backward gives
every word's distribution over languages in its context, so texts that switch between
languages are labelled word by word; a text's language is the one with the largest sum.

Training texts carry one language each. Training sequences are spliced from runs of
their words, switching between languages as mixed texts do, which is what transitions
are learned from. The fit uses at most ``PER_LANGUAGE`` texts, of at most ``MOST_CHARS``
characters, of each of the ``LANGUAGES`` most frequent languages, chosen by a hash of
their id. Whole texts are labelled: they are cut into blocks whose transfer matrices are
multiplied along the text, so a long text costs no more per word than a short one and
the result is that of one pass from end to end.

A null text and a text without letters is ``und`` with score 0. Without any training
text everything is ``und``. Ties go to the language first in the alphabet. Equal texts
get equal results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationcast.llm.common import annotate, codes_of, id_crc

PER_LANGUAGE, LANGUAGES, MOST_CHARS = 300, 64, 20_000
UNKNOWN = "und"
BUCKETS = 1 << 16
#: Words in a training sequence and, on average, in a run of one language.
SEQUENCE, RUN = 48, 10
SEQUENCES, BATCH, EPOCHS, RATE, DECAY = 3000, 50, 3, 0.3, 1e-5
#: A word is in a language's lexicon if it is among so many of its most frequent words.
LEXICON = 2000
BLOCK = 64
#: Words remembered by a worker.
REMEMBERED = 300_000


def letters(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in lower case, and each word's row."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), rows.filter(full).to_numpy()


def features(word: str, lexicons: dict[str, list[int]]) -> list[int]:
    """The feature buckets of a word."""
    n, edged = len(word), f"^{word}$"
    own = [f"w{word}", *(f"l{i}" for i in lexicons.get(word, ()))]
    own += [f"p{word[:k]}" for k in (1, 2, 3, 4) if k < n] + [f"s{word[-k:]}" for k in (1, 2, 3, 4) if k < n]
    own += [edged[i : i + 2] for i in range(n + 1)] + [edged[i : i + 3] for i in range(n)]
    return [zlib.crc32(f.encode()) % BUCKETS for f in own]


@dataclass
class Model:
    languages: list[str]
    lexicons: dict[str, list[int]] = field(default_factory=dict)
    weights: np.ndarray | None = None
    start: np.ndarray | None = None
    moves: np.ndarray | None = None
    known: dict[str, int] = field(default_factory=dict, repr=False)
    scores: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scores": []}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words for each language (logarithms up to a constant)."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.scores.clear()
        new = [w for w in words if w not in self.known]
        if new:
            found = [features(w, self.lexicons) for w in new]
            starts = np.cumsum([0, *map(len, found)])[:-1]
            values = np.add.reduceat(self.weights[np.concatenate(found)], starts, axis=0)
            self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores.extend(values)
        return np.array([self.scores[self.known[w]] for w in words])

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text, its words and the sums of their distributions over languages."""
        words, rows = letters(texts)
        n = len(texts)
        if not len(words) or self.weights is None:
            return np.zeros(n, np.int64), np.zeros((n, max(len(self.languages), 1)))
        distinct, code = codes_of(words)
        scores = self.emissions(distinct.to_pylist())
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))[code]
        posterior = forward_backward(scores, rows, np.exp(self.start), np.exp(self.moves))
        sums = np.column_stack([np.bincount(rows, weights=p, minlength=n) for p in posterior.T])
        return np.bincount(rows, minlength=n), sums


def forward_backward(scores: np.ndarray, rows: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Each word's distribution, for sequences given one after the other (``rows``: the sequence of each word)."""
    n, width = scores.shape
    first = np.append([True], rows[1:] != rows[:-1])
    place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    heads = np.flatnonzero(place % BLOCK == 0)  # the first word of each block
    size = np.diff(np.append(heads, n))
    blocks = len(heads)
    steps = np.full((blocks, BLOCK, width), 1.0)
    real = np.arange(BLOCK) < size[:, None]
    steps[real] = scores
    opens = first[heads]
    entry = np.tile(start / start.sum(), (width, 1))

    def move(t: int) -> np.ndarray:
        """What leads into word ``t`` of each block: a transition, or the start of a sequence."""
        return np.where(opens[:, None, None], entry, moves) if t == 0 else moves

    passed = np.tile(np.eye(width), (blocks, 1, 1))  # transfer matrices of the blocks
    for t in range(BLOCK):
        on = real[:, t]
        into = (passed @ move(t)) * steps[:, None, t]
        passed[on] = into[on] / into[on].max(axis=(1, 2), keepdims=True)
    ahead = np.full((blocks, width), 1.0 / width)  # forward message into each block
    behind = np.full((blocks, width), 1.0)  # backward message at the end of each block
    chunk = place[heads] // BLOCK
    order = np.argsort(chunk, kind="stable")
    bounds = np.searchsorted(chunk[order], np.arange(chunk.max() + 2))
    for k in range(1, chunk.max() + 1):
        now = order[bounds[k] : bounds[k + 1]]
        message = np.einsum("bi,bij->bj", ahead[now - 1], passed[now - 1])
        ahead[now] = message / message.sum(axis=1, keepdims=True)
    for k in range(chunk.max(), 0, -1):
        now = order[bounds[k] : bounds[k + 1]]
        message = np.einsum("bij,bj->bi", passed[now], behind[now])
        behind[now - 1] = message / message.sum(axis=1, keepdims=True)
    forward = np.empty((BLOCK, blocks, width))
    message = ahead
    for t in range(BLOCK):
        into = (np.einsum("bi,bij->bj", message, move(0)) if t == 0 else message @ moves) * steps[:, t]
        into /= into.sum(axis=1, keepdims=True)
        message = np.where(real[:, t, None], into, message)
        forward[t] = message
    posterior = np.empty((blocks, BLOCK, width))
    message = behind
    for t in range(BLOCK - 1, -1, -1):
        both = forward[t] * message
        posterior[:, t] = both / both.sum(axis=1, keepdims=True)
        if t:
            back = (steps[:, t] * message) @ moves.T
            message = np.where(real[:, t, None], back / back.sum(axis=1, keepdims=True), message)
    return posterior[real]


def gradient(scores: np.ndarray, gold: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Derivatives of the log-likelihood of ``gold`` by word scores, start and transitions; all [batch, time]."""
    batch, length, width = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    into, first = np.exp(moves), np.exp(start)
    forward, back = np.empty_like(e), np.empty_like(e)
    forward[:, 0] = first * e[:, 0]
    forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        forward[:, t] = (forward[:, t - 1] @ into) * e[:, t]
        forward[:, t] /= forward[:, t].sum(axis=1, keepdims=True)
    back[:, -1] = 1
    for t in range(length - 2, -1, -1):
        back[:, t] = (e[:, t + 1] * back[:, t + 1]) @ into.T
        back[:, t] /= back[:, t].sum(axis=1, keepdims=True)
    posterior = forward * back
    posterior /= posterior.sum(axis=2, keepdims=True)
    right = np.eye(width)[gold]
    pairs = forward[:, :-1, :, None] * into * (e[:, 1:] * back[:, 1:])[:, :, None, :]
    pairs /= pairs.sum(axis=(2, 3), keepdims=True)
    real_pairs = right[:, :-1, :, None] * right[:, 1:, None, :]
    return right - posterior, (right - posterior)[:, 0].sum(axis=0), (real_pairs - pairs).sum(axis=(0, 1))


def train(texts: list[str], languages: list[str], seed: int = 0) -> Model:
    """A model of texts with a language each."""
    names = sorted(set(languages))
    model = Model(names)
    words, rows = letters(pa.array(texts, pa.string()))
    words = words.to_pylist()
    label = np.array([names.index(x) for x in languages], np.int64)
    lang = label[rows] if len(words) else np.array([], np.int64)
    for i in range(len(names)):
        own = Counter(words[j] for j in np.flatnonzero(lang == i))
        for word, n in own.most_common(LEXICON):
            if n > 1:
                model.lexicons.setdefault(word, []).append(i)
    present = [i for i in range(len(names)) if (lang == i).any()]
    if not present:
        return Model(names)
    rng = np.random.default_rng(seed)
    pool = {i: np.flatnonzero(lang == i) for i in present}
    width = len(names)
    model.weights = np.zeros((BUCKETS, width))
    model.start, model.moves = np.zeros(width), np.zeros((width, width))
    pieces = np.empty((SEQUENCES, SEQUENCE), np.int64)
    for s in range(SEQUENCES):
        at = 0
        while at < SEQUENCE:
            run = min(int(rng.geometric(1 / RUN)), SEQUENCE - at)
            own = pool[present[rng.integers(len(present))]]
            begin = int(rng.integers(len(own)))
            pieces[s, at : at + run] = own[(begin + np.arange(run)) % len(own)]
            at += run
    found = {}
    for w in {words[j] for j in np.unique(pieces)}:
        found[w] = np.array(features(w, model.lexicons))
    speed = [np.full_like(x, 1e-8) for x in (model.weights, model.start, model.moves)]
    for _ in range(EPOCHS):
        for batch in np.split(rng.permutation(SEQUENCES), SEQUENCES // BATCH):
            own = [found[words[j]] for j in pieces[batch].ravel()]
            count = np.array([len(f) for f in own])
            index = np.concatenate(own)
            scores = np.add.reduceat(model.weights[index], np.cumsum(count) - count, axis=0).reshape(BATCH, SEQUENCE, width)
            by_word, by_start, by_move = gradient(scores, lang[pieces[batch]], model.start, model.moves)
            touched, where = np.unique(index, return_inverse=True)
            total = np.zeros((len(touched), width))
            np.add.at(total, where, np.repeat(by_word.reshape(-1, width), count, axis=0))
            total -= DECAY * model.weights[touched]
            speed[0][touched] += total**2
            model.weights[touched] += RATE * total / np.sqrt(speed[0][touched])
            for value, step, pace in ((model.start, by_start, speed[1]), (model.moves, by_move, speed[2])):
                pace += step**2
                value += RATE * step / np.sqrt(pace)
    model.weights = model.weights.astype(np.float32)
    return model


def training_rows(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The bounded sample of (text, lang) that a model is fitted on."""
    named = docs.filter(use & F.col(lang_col).isNotNull() & (F.length(text_col) <= MOST_CHARS))
    common = named.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES).select(F.col(lang_col).alias("l"))
    known = named.join(F.broadcast(common), F.col(lang_col) == F.col("l"), "left_semi")
    hashed = known.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"))
    # ranked without their texts; then at most LANGUAGES * PER_LANGUAGE hashes find them
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = hashed.select("lang", "h").withColumn("place", place).filter(F.col("place") <= PER_LANGUAGE)
    chosen = F.broadcast(chosen.select("lang", "h").distinct())
    return hashed.join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("text", "lang")


def fit(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = sorted((r.lang, r.text) for r in training_rows(docs, use, id_col, text_col, lang_col).collect())
    return train([t for _, t in rows], [x for x, _ in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (mean share of that language over the words). No shuffle."""

    def run(texts: pa.Array) -> dict:
        count, sums = model.label(texts)
        best = sums.argmax(axis=1)
        share = sums.max(axis=1) / np.maximum(count, 1)
        known = (count > 0) & (share > 0)
        return {
            "lang_pred": [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
            "score": np.clip(share, 0, 1),
        }

    return annotate(docs, run, pa.schema([("lang_pred", pa.string()), ("score", pa.float64())]), id_col, text_col)


def spans(text: str, model: Model) -> list[tuple[str, str, float]]:
    """Each word of a text with its language and the probability of that."""
    words, rows = letters(pa.array([text]))
    if not len(words) or model.weights is None:
        return []
    scores = model.emissions(words.to_pylist())
    p = forward_backward(np.exp(scores - scores.max(axis=1, keepdims=True)), rows, np.exp(model.start), np.exp(model.moves))
    return [(w, model.languages[i], float(q)) for w, i, q in zip(words.to_pylist(), p.argmax(axis=1), p.max(axis=1), strict=True)]


def in_training(id_col: str = "doc_id") -> Column:
    """Languages may be learned from rows whose crc32 of the id leaves another remainder than 2 by four."""
    return id_crc(id_col, 4) != 2
