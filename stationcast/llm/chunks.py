"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text; a chunk ends where its top bits are
zero. Chunk sizes are normalised: below ``NORMAL`` bytes more bits must be zero, above it
fewer, and no chunk is shorter than ``LEAST`` (but for the last) or longer than ``MOST``.
Boundaries depend on the bytes just before them alone, so text that moves keeps its
chunks. A fingerprint is the set of chunk digests with their lengths; two fingerprints
are compared by containment: the bytes in shared chunks over the bytes of the smaller.

Null and empty texts have the empty fingerprint, which is fully like another empty one
and unlike all else. Equal texts have equal fingerprints. Texts are read whole, whatever
their length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from stationcast.llm.common import annotate

LEAST, NORMAL, MOST = 16, 64, 256
#: Zero bits that end a chunk before and after its normal size.
HARD, EASY = 8, 4
WINDOW = 32
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the gear values of the last 32 bytes, each doubled once for every byte after it."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks end."""
    n = len(data)
    h = gear_hash(np.frombuffer(data, np.uint8))
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY)))
    hard = easy[h[easy] < (1 << (32 - HARD))]
    easy, hard = (easy + 1).tolist(), (hard + 1).tolist()
    ends, start = [], 0
    while start < n:
        end = min(start + MOST, n)
        i = bisect_left(hard, start + LEAST)
        if i < len(hard) and hard[i] < start + NORMAL:
            end = min(end, hard[i])
        elif (i := bisect_left(easy, start + NORMAL)) < len(easy):
            end = min(end, easy[i])
        ends.append(end)
        start = end
    return ends


def chunk_set(data: bytes) -> dict[int, int]:
    """Digest and length of each distinct chunk."""
    start, found = 0, {}
    for end in chunk_ends(data):
        found[xxhash.xxh64_intdigest(data[start:end])] = end - start
        start = end
    return found


def written(chunks: dict[int, int]) -> str:
    """A chunk set as text: ``digest:length`` in order of the digests."""
    return " ".join([f"{digest:016x}:{length}" for digest, length in sorted(chunks.items())])


def read(fingerprint: str) -> dict[int, int]:
    return {int(p[:16], 16): int(p[17:]) for p in fingerprint.split()}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment of the smaller chunk set in the other, by bytes."""
    least = min(sum(a.values()), sum(b.values()))
    if not least:
        return float(len(a) == len(b))
    return sum([a[d] for d in a.keys() & b.keys()]) / least


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``fingerprint``. No shuffle."""

    def run(texts: pa.Array) -> dict:
        return {"fingerprint": [written(chunk_set(t)) for t in pc.cast(texts, pa.binary()).to_pylist()]}

    return annotate(docs, run, pa.schema([("fingerprint", pa.string())]), id_col, text_col)


def compare(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of the fingerprints in columns ``a`` and ``b``; null for a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (a, b))
            found = [None if x is None or y is None else likeness(read(x), read(y)) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return pairs.mapInArrow(run, StructType(list(pairs.schema.fields)).add(name, DoubleType()))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def range_bucket(value: Column, bounds: list) -> Column:
    """The number of sorted ``bounds`` below ``value``, by a coarse and a fine search; 0 for null."""
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    if not groups:
        return F.lit(0)
    below = lambda array: F.coalesce(F.size(F.filter(array, lambda b: b < value)), F.lit(0))
    coarse = F.greatest(below(F.array(*[F.lit(g[0]) for g in groups])), F.lit(1))
    fine = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), coarse)
    return (coarse - 1) * wide + below(fine)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document by id.

    One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The id is a number. Texts are shuffled once, dealt out by
    ranges of ids that take about equally many documents; the first of each range is also
    sent to the range before, so that the sequence is followed without a global sort in
    one task. What reaches the driver is one id per range. A null id comes first; rows
    with the same id are ordered by a hash of their text, and all lie in one range.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = [i / n for i in range(1, n)]
    bounds = narrow.agg(F.percentile_approx("id", cuts, 100 * n)).first()[0] if cuts else None
    bounds = sorted(set(bounds or []))
    placed = narrow.withColumn("bucket", range_bucket(F.col("id"), bounds))
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("id")).alias("s")).orderBy("bucket").collect()
    first, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, row in enumerate(firsts):
        first[row.bucket], before[row.bucket] = row.s.id, firsts[i - 1].bucket
    kind = docs.schema[id_col].dataType
    at = F.col("bucket") + 1
    starts = F.col("id").eqNullSafe(F.element_at(F.array(*[F.lit(v).cast(kind) for v in first]), at))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.element_at(F.array(*map(F.lit, before)), at).alias("bucket"), F.lit(True).alias("guest"))
    spread = placed.withColumn("p", F.explode(F.when(starts, F.array(own, guest)).otherwise(F.array(own))))
    spread = spread.select("p.bucket", "p.guest", "id", "text")
    ordered = spread.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions(
        "bucket", "guest", F.col("id").asc_nulls_first(), F.xxhash64("text")
    )
    schema = StructType().add(id_col, kind).add("n_chars", LongType()).add("edited_sha256", StringType())
    schema = schema.add("fingerprint", StringType()).add("edited_fingerprint", StringType())
    schema = schema.add("near_edited", DoubleType()).add("near_next", DoubleType())

    def finish(last: tuple, text: str, chunks: dict[int, int]) -> tuple:
        key, own_text, own_chunks = last
        changed = edited(own_text, text).encode()
        other = chunk_set(changed)
        return (
            key, len(own_text), hashlib.sha256(changed).hexdigest(), written(own_chunks), written(other),
            likeness(own_chunks, other), likeness(own_chunks, chunks),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, None
        types = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            types = [id_type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            rows: list[tuple] = []
            for at in range(batch.num_rows):
                b, is_guest, key = (batch.column(i)[at].as_py() for i in range(3))
                if is_guest and last is None:  # a further guest: the range's last document has its follower
                    continue
                text = batch.column(3)[at].as_py()
                chunks = chunk_set(text.encode())
                if last is not None:
                    rows.append(finish(last, text, chunks))
                last = None if is_guest else (key, text, chunks)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return ordered.mapInArrow(run, schema)
