"""Language-model scores of whole texts by a gated recurrent network.

Tokens are words (A-Z in lower case) and one end per document. Each token belongs to one
symbol of the network (:mod:`gru`): a frequent word is a symbol of its own, other words
share the symbol of their last two characters, or that of all further endings. The
probability of a token is that of its symbol given all tokens before it, times the
token's smoothed share of the symbol's counts; each shared symbol keeps a share for
unknown words, so probabilities add up to one.

Counts cover all training documents. The network too learns from every training
document: the documents are dealt into ``ROUNDS`` rounds by a hash; in each round every
task goes on from the common parameters over its own documents, and the results are
averaged by the number of symbols seen. Only parameters travel, summed in ``SLOTS``
groups before the driver adds those up.

Counts of the most frequent words, ``COMMON`` at most, go to the tasks as a list; all other words meet their counts in a join. Texts are scored whole, with the
state carried from the first token to the last.

Null and empty texts are the end alone. Without training documents every probability is
one part in one, as in the formula of the base score. Rows equal in id and text get
equal scores; rows with one id and several texts are scored one by one. Ties among
frequent words are broken by the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stationcast.llm import gru
from stationcast.llm.common import codes_of, id_crc, slices, split_words, texts_of
from stationcast.session import durable

#: At most so many words are known to all tasks, with all words of the same frequency or none.
COMMON = 100_000
ENDINGS = 63
ROUNDS = 4
SLOTS = 32
#: The symbol of the end of a document, and that of words with a rare ending.
END, OTHER = 0, 1
HEAD = gru.SYMBOLS - ENDINGS - 2
#: Text bytes worked on at once; the arrays around them are many times larger.
RUN_BYTES = 2 << 20
#: Symbols that wait for each other: documents of any length step through the network side by side.
SCORED_TOGETHER = 4 << 20
LN10 = float(np.log(10))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a run of texts, the code of each word in order, and its row."""
    words, rows = split_words(pc.ascii_lower(texts))
    distinct, code = codes_of(words)
    return distinct, code, rows


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` and its count ``c`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=RUN_BYTES):
                distinct, code, _ = words_of(texts_of(part))
                n = np.bincount(code, minlength=len(distinct))
                yield pa.RecordBatch.from_arrays([distinct, pa.array(n, pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """What tasks need to know of the counts; all of bounded size."""

    head: pa.Array
    endings: pa.Array
    common: pa.Array
    common_counts: np.ndarray
    symbol_counts: np.ndarray  # N of each symbol
    symbol_words: np.ndarray  # distinct words of each symbol
    train_tokens: int
    distinct: int
    end_count: int

    @property
    def base_total(self) -> float:
        return float(np.log10(self.train_tokens + 0.1 * (self.distinct + 1)))

    def share_totals(self) -> np.ndarray:
        """log10 of what a shared symbol's counts are divided by; 0 for a word of its own and the end."""
        total = np.log10(self.symbol_counts + 0.1 * (self.symbol_words + 1))
        return np.where((np.arange(gru.SYMBOLS) == OTHER) | (np.arange(gru.SYMBOLS) >= 2 + len(self.head)), total, 0.0)

    def symbols(self, distinct: pa.Array) -> np.ndarray:
        """The symbol of each distinct word."""
        head = pc.index_in(distinct, self.head)
        ending = pc.index_in(pc.utf8_slice_codeunits(distinct, -2), self.endings)
        own = pc.fill_null(pc.add(head, 2), -1).to_numpy(zero_copy_only=False)
        shared = pc.fill_null(pc.add(ending, 2 + len(self.head)), OTHER).to_numpy(zero_copy_only=False)
        return np.where(own >= 0, own, shared).astype(np.int64)

    def counts(self, distinct: pa.Array) -> np.ndarray:
        """The count of each distinct common word, 0 for others."""
        at = pc.index_in(distinct, self.common).to_numpy(zero_copy_only=False)
        found = np.zeros(len(distinct), np.int64)
        known = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
        found[known] = self.common_counts[at[known].astype(np.int64)]
        return found


def vocabulary(totals: DataFrame, n_documents: int) -> Vocabulary:
    """The vocabulary of written word counts and the number of training documents."""
    # by steps of a 64th of a doubling, so that few numbers tell how low the counts may go
    step = F.floor(F.log2("c") * 64)
    left, least = COMMON, None
    for row in totals.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        left -= row.n
        if left < 0:
            break
        least = row.step
    frequent = totals.filter(step >= least) if least is not None else totals.limit(0)
    common = frequent.select("word", "c").toPandas().sort_values(["c", "word"], ascending=[False, True])
    head = common["word"].tolist()[:HEAD]
    rest = totals.join(F.broadcast(totals.sparkSession.createDataFrame([(w,) for w in head], "word string")), "word", "left_anti")
    ending = F.substring("word", -2, 2)
    by_ending = rest.groupBy(ending.alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    most = by_ending.orderBy(F.desc("n"), "e").limit(ENDINGS).collect()
    whole = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = np.zeros(gru.SYMBOLS), np.zeros(gru.SYMBOLS)
    n[END] = n_documents
    n[2 : 2 + len(head)] = common["c"].to_numpy()[: len(head)]
    for i, row in enumerate(most):
        n[2 + len(head) + i], v[2 + len(head) + i] = row.n, row.v
    n[OTHER] = whole[0] - n[2:].sum()
    v[OTHER] = whole[1] - len(head) - v.sum()
    return Vocabulary(
        *(pa.array(x, pa.string()) for x in (head, [r.e for r in most], common["word"].tolist())), common["c"].to_numpy(np.int64), n, v,
        int(whole[0]) + n_documents, int(whole[1]) + (n_documents > 0), n_documents,
    )


def documents_of(code: np.ndarray, rows: np.ndarray, symbol: np.ndarray, n: int) -> list[np.ndarray]:
    """The symbols of each text, the end last."""
    count = np.bincount(rows, minlength=n)
    ends = np.cumsum(count + 1) - 1
    flat = np.full(len(code) + n, END, symbol.dtype)
    keep = np.ones(len(flat), bool)
    keep[ends] = False
    flat[keep] = symbol[code]
    return np.split(flat, ends[:-1] + 1) if n else []


def train(docs: DataFrame, words: Vocabulary, text_col: str = "text", id_col: str = "doc_id") -> np.ndarray:
    """The parameters learned from all of ``docs``, as one vector."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(ROUNDS)).alias("r"))
    vector = gru.flat(gru.begin(words.symbol_counts))

    def one_round(now: DataFrame, start: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = gru.Trainer(gru.views(start), END)
            for batch in batches:
                for part in slices(batch, max_bytes=RUN_BYTES):
                    distinct, code, rows = words_of(texts_of(part))
                    own.feed(documents_of(code, rows, words.symbols(distinct), part.num_rows))
            if own.symbols:
                total = own.vector.astype(np.float64) * own.symbols
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([float(own.symbols)])], ["v", "n"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(start)), 0.0
            for batch in batches:
                for v, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total += np.frombuffer(v)
                    n += m
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([n])], ["v", "n"])

        learned = now.select("text").mapInArrow(run, "v binary, n double")
        sums = learned.repartition(SLOTS).mapInArrow(add, "v binary, n double").collect()
        n = sum(s.n for s in sums)
        return (sum(np.frombuffer(s.v) for s in sums) / n).astype(np.float32) if n else start

    for r in range(ROUNDS):
        vector = one_round(texts.filter(F.col("r") == r), vector)
    return vector


def score(docs: DataFrame, totals: DataFrame, words: Vocabulary, vector: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, base_score, score."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h"))
    kind = narrow.schema["id"].dataType
    names = ["id", "h", "word", "n", "n_tokens", "n_known", "base", "model"]
    schema = StructType().add("id", kind)
    for name, t in zip(names[1:], ("long", "string", "long", "long", "long", "double", "double"), strict=True):
        schema.add(name, t)
    end_log, share = float(np.log10(words.end_count + 0.1)), words.share_totals()

    def rows_of(key: pa.Array, h: pa.Array, word: pa.Array, n: np.ndarray, numbers: list[np.ndarray | None]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = [pa.nulls(len(n), t) if x is None else pa.array(x).cast(t) for x, t in zip(numbers, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([key, h, word, pa.array(n, pa.int64()), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gru.views(vector)

        def scored(held: list[tuple]) -> pa.RecordBatch:
            """The rows of documents whose symbols wait to be scored together."""
            key, h = (pa.concat_arrays([x[i] for x in held]) for i in (0, 1))
            tokens, known, base, model = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4, 5))
            if words.train_tokens:
                model = model + gru.score(p, [d for x in held for d in x[6]], END) / LN10
            return rows_of(key, h, pa.nulls(len(key), pa.string()), np.ones(len(key)), [tokens, known, base, model])

        for batch in batches:
            held: list[tuple] = []
            for part in slices(batch, max_bytes=RUN_BYTES):
                n = part.num_rows
                distinct, code, rows = words_of(texts_of(part))
                symbol, count = words.symbols(distinct), words.counts(distinct)
                tokens = np.bincount(rows, minlength=n) + 1
                logs = np.where(count > 0, np.log10(count + 0.1), 0.0)  # the others' follow from the join
                tail = (symbol == OTHER) | (symbol >= 2 + len(words.head))
                known = np.bincount(rows, weights=(count > 0)[code], minlength=n) + (words.end_count > 0)
                base = np.bincount(rows, weights=logs[code], minlength=n) + end_log - tokens * words.base_total
                shared = np.bincount(rows, weights=np.where(tail, logs - share[symbol], 0.0)[code], minlength=n)
                documents = documents_of(code, rows, symbol.astype(np.int16), n)
                held.append((part.column(0), part.column(2), tokens, known.astype(np.int64), base, shared, documents))
                rare = (count == 0)[code]
                place, times = np.unique(rows[rare] * max(len(distinct), 1) + code[rare], return_counts=True)
                row, word = pa.array(place // max(len(distinct), 1)), pa.array(place % max(len(distinct), 1))
                yield rows_of(part.column(0).take(row), part.column(2).take(row), distinct.take(word), times, [None] * 4)
                if sum(int(x[2].sum()) for x in held) > SCORED_TOGETHER:
                    yield scored(held)
                    held = []
            if held:
                yield scored(held)

    found = durable(narrow.mapInArrow(run, schema), "scores")
    own = found.filter("word IS NULL")
    logs = F.log10(F.coalesce("c", F.lit(0)) + 0.1)
    rare = found.filter("word IS NOT NULL").select("id", "h", "word", "n").join(totals, "word", "left")
    rare = rare.groupBy("id", "h").agg(
        F.sum(logs * F.col("n")).alias("more"), F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0)).alias("more_known")
    )
    copies = own.groupBy("id", "h").agg(
        F.count("*").alias("copies"), *[F.first(x).alias(x) for x in ("n_tokens", "n_known", "base", "model")]
    )
    joined = copies.alias("d").join(rare.alias("r"), F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.h") == F.col("r.h")), "left")
    each = F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))
    return joined.select(
        F.col("d.id").alias(id_col), "n_tokens",
        (F.col("n_known") + F.coalesce((F.col("more_known") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        (F.col("base") + each).alias("base_score"), (F.col("model") + each).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def score_documents(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows that ``use`` accepts and score all: id, n_tokens, n_known, train_tokens, base_score, score."""
    own = docs.filter(F.coalesce(use, F.lit(True)))
    totals = durable(word_counts(own, text_col), "words")
    words = vocabulary(totals, own.count())
    vector = train(own, words, text_col, id_col)
    found = score(docs, totals, words, vector, id_col, text_col)
    return found.withColumn("train_tokens", F.lit(words.train_tokens).cast("long"))


def in_training(id_col: str = "doc_id") -> Column:
    """Rows whose crc32 of the id is no multiple of ten, and rows without an id."""
    return id_crc(id_col, 10) != 0
