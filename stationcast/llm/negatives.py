"""Hard-negative mining by slots of the positives' scores.

Each anchor has its ``positives`` nearest rows of the same label. For a positive of score
``p``, rows of other labels with a score from ``low * p`` to ``p`` (in percent) are hard
negatives; the first ``negatives`` of them are wanted. The windows of an anchor's
positives overlap. Their upper limits, in descending order, cut the scores into disjoint
slots: slot j reaches from the limit of positive j down to that of positive j + 1. Every
task keeps the first rows of each slot for each anchor (a combiner), the same is done for
all tasks' rows, and the slots are then merged from the lowest up: the first rows of slots
j and below are the first rows under the limit of positive j, of which those above its
lower limit are returned. So every row is looked at once for all windows.

Scores are inner products of whole numbers: each component x becomes floor(scale * x).
Anchors meet all rows in blocks: rows are dealt out into blocks of bounded size by a hash
of their id, anchors visit every block, and a task holds one block and a batch of anchors.
Nothing is collected and no pair is written but those kept.

Rows with a null id, a null label, a null vector or a component that is null or not finite
take no part. Of rows with the same id, the one with the smallest label and vector
counts. A shorter vector is filled up with zeros. Scores must fit in 63 bits. Without
anchors or rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.session import durable

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW = 80
#: Values of the vectors of one block of rows, and of one run of scores.
BLOCK_VALUES = 1 << 24
RUN_VALUES = 1 << 24
#: Rows below which a block is not cut further for the sake of more tasks.
LEAST_ROWS = 4096


def vectors(rows: DataFrame, label: Column, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Usable rows: ``id``, ``label`` and the whole-numbered vector ``q``, one row for each id."""
    x = F.col(vector_col)
    wrong = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    used = rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & ~F.coalesce(wrong, F.lit(True)))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    narrow = used.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("q"))
    first = narrow.groupBy("id").agg(F.min(F.struct("label", "q")).alias("v"))
    return first.select("id", "v.label", "v.q")


def matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), kind)
    out[np.arange(dim) < size[:, None]] = column.flatten().to_numpy()
    return out


def first_rows(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Those of the rows ``at`` with the k highest scores; ties go to the earlier row."""
    if len(at) > k:
        own = scores[at]
        limit = np.partition(own, len(own) - k)[len(own) - k]
        above = at[own > limit]
        at = np.concatenate([above, at[own == limit][: k - len(above)]])
    return at[np.lexsort((at, -scores[at]))]


def nearest(scores: np.ndarray, own_label: np.ndarray, own_row: np.ndarray, labels: np.ndarray, k: int) -> Iterator[tuple]:
    """For each anchor the k first other rows of its label: anchor, row, slot 0."""
    for i in range(len(scores)):
        at = np.flatnonzero(labels == own_label[i])
        at = first_rows(scores[i], at[at != own_row[i]], k)
        yield np.full(len(at), i), at, np.zeros(len(at), np.int64)


def in_slots(scores: np.ndarray, own_label: np.ndarray, limits: list[np.ndarray], labels: np.ndarray, low: int, k: int) -> Iterator[tuple]:
    """For each anchor the k first rows of other labels in every slot of its descending ``limits``."""
    for i, upper in enumerate(limits):
        s = scores[i]
        least = -(-low * int(upper[-1]) // 100)
        at = np.flatnonzero((s <= upper[0]) & (s >= least) & (labels != own_label[i]))
        slot = np.searchsorted(-upper, -s[at], side="right") - 1  # the last limit that is no lower
        for j in range(len(upper)):
            found = first_rows(s, at[slot == j], k)
            yield np.full(len(found), i), found, np.full(len(found), j)


FOUND = "anchor long, slot int, id long, score long"


def _against_blocks(rows: DataFrame, anchors: DataFrame, n_blocks: int, dim: int, largest: int, k: int, low: int | None) -> DataFrame:
    """For each anchor and block of rows: the first rows of its label, or of every slot if ``anchors`` have ``limits``."""
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block")
    no_limits = F.lit(None).cast("array<bigint>")
    own = rows.select(block, F.lit(0).alias("kind"), "id", "label", "q", no_limits.alias("limits"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    visits = anchors.select(every, F.lit(1).alias("kind"), "id", "label", "q", no_limits.alias("limits") if low is None else "limits")
    total = largest * largest * dim
    kind = np.float32 if total < 1 << 24 else np.float64 if total < 1 << 53 else np.int64
    if total >= 1 << 63:
        raise ValueError("inner products of these vectors don't fit in 63 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, ready = [], None, False
        ids = labels = q = None
        for batch in batches:
            block, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                part = batch.slice(start, stop - start)
                if block[start] != at:
                    held, at, ready = [], block[start], False
                if kinds[start] == 0:
                    held.append(part)
                elif held:
                    if not ready:
                        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        ids, labels, q = whole.column(2).to_numpy(), whole.column(3).to_numpy(), matrix(whole.column(4), dim, kind).T
                        held, ready = [part], True
                    step = max(1, RUN_VALUES // len(ids))
                    for a in range(0, part.num_rows, step):
                        yield from compared(part.slice(a, step), ids, labels, q)

    def compared(part: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        anchor, own_label = part.column(2).to_numpy(), part.column(3).to_numpy()
        scores = matrix(part.column(4), dim, kind) @ q
        if low is None:
            row = np.searchsorted(ids, anchor)
            row[(row == len(ids)) | (ids[np.minimum(row, len(ids) - 1)] != anchor)] = -1
            found = list(nearest(scores, own_label, row, labels, k))
        else:
            limits = [np.array(x, np.int64) for x in part.column(5).to_pylist()]
            found = list(in_slots(scores, own_label, limits, labels, low, k))
        if found:
            i, at, slot = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
            columns = [anchor[i], slot.astype(np.int32), ids[at], scores[i, at].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "slot", "id", "score"])

    dealt = own.unionByName(visits).repartition("block").sortWithinPartitions("block", "kind", "id")
    return first_per_slot(dealt.mapInArrow(run, FOUND), k)


def first_per_slot(found: DataFrame, k: int) -> DataFrame:
    """The k first rows of each anchor's slot, with their rank."""
    ranked = found.selectExpr("*", "row_number() over (partition by anchor, slot order by score desc, id) as rank")
    return ranked.filter(F.col("rank") <= k)


def merged(slots: Column, n: Column, k: int) -> Column:
    """For positives 1 to ``n``, the k first rows of its slot and all below, from the lowest slot up."""
    begin = F.struct(F.array().cast("array<struct<back: bigint, id: bigint>>").alias("first"), F.array().cast("array<array<struct<back: bigint, id: bigint>>>").alias("out"))

    def step(done: Column, j: Column) -> Column:
        own = F.transform(F.filter(slots, lambda s: s.slot == j), lambda s: F.struct((-s.score).alias("back"), s.id.alias("id")))
        first = F.slice(F.array_sort(F.concat(own, done["first"])), 1, k)
        return F.struct(first.alias("first"), F.concat(F.array(first), done["out"]).alias("out"))

    return F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), begin, step, lambda done: done["out"])


def mine(
    rows: DataFrame, label: Column, anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, id_col: str = "vec_id", vector_col: str = "embedding", block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """One row per anchor, positive and negative: ids, rank (from 1) and both scores.

    ``label`` and ``anchor`` (of the id) are expressions over ``rows``.
    """
    known = durable(vectors(rows, label, scale, id_col, vector_col), "vectors")
    size = known.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("dim"), F.max(F.aggregate("q", F.lit(0).cast("long"), lambda a, v: F.greatest(a, F.abs(v)))).alias("largest")
    ).first()
    dim = max(size["dim"] or 0, 1)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(-(-size["n"] * dim // block_values), min(tasks, size["n"] // LEAST_ROWS), 1)
    anchors = known.withColumn(id_col, F.col("id")).filter(anchor).select("id", "label", "q")
    near = durable(_against_blocks(known, anchors, n_blocks, dim, size["largest"] or 0, positives, None), "positives")
    chosen = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive"), "score"))).alias("near"))
    limited = anchors.join(chosen, F.col("id") == F.col("anchor")).select("id", "label", "q", F.transform("near", lambda p: p.score).alias("limits"))
    slots = _against_blocks(known, limited, n_blocks, dim, size["largest"] or 0, negatives, low)
    by_anchor = slots.groupBy("anchor").agg(F.collect_list(F.struct("slot", "score", "id")).alias("slots"))
    windows = chosen.join(by_anchor, "anchor").select("anchor", F.explode(F.arrays_zip("near", merged(F.col("slots"), F.size("near"), negatives).alias("hard"))).alias("w"))
    pairs = windows.select("anchor", F.col("w.near").alias("p"), F.posexplode("w.hard").alias("at", "h"))
    return pairs.filter(F.col("p.score") * low <= F.col("h.back") * -100).select(
        F.col("anchor").alias("anchor_id"),
        F.col("p.positive").alias("positive_id"),
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("h.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        (-F.col("h.back")).alias("negative_score"),
    )
