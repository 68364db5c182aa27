"""Packing by best-fit decreasing into sequences of a fixed number of tokens.

Documents longer than a sequence are first cut into full windows and a rest. Pieces are
then placed from the longest to the shortest, each into the open sequence with the least
room that still takes it. A segment tree indexed by remaining capacity finds that
sequence in ``log2(size)`` steps.

Tokenizing is a map over the documents. Only lengths are shuffled: pieces are dealt out
evenly, whatever their ids, to groups of at most about ``GROUP`` pieces, and each group
is packed on its own. A group of that size leaves one short sequence or two, so padding
does not grow with the number of groups.

Null and empty texts are the end token alone. Rows with equal or null ids are documents
of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from stationcast.llm.common import slices, texts_of
from stationcast.llm.tokens import library_memory
from stationcast.session import durable

SIZE = 2048
END = 1
GROUP = 100_000


class OpenSequences:
    """Open sequences by remaining capacity: a segment tree of the counts above a stack for each capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()  # capacities 0 to size
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, sequence: int, capacity: int) -> None:
        self.stacks[capacity].append(sequence)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns the sequence with the least capacity of at least ``length``."""
        node = self.leaves + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not self.count[node]
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.stacks[capacity].pop(), capacity


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` are from 1 to ``size``."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenSequences(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            found = opened, size
            opened += 1
        sequence[i], capacity = found
        offset[i] = size - capacity
        if capacity > length:
            tree.put(int(sequence[i]), capacity - length)
    return sequence, offset


def pieces(
    docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Full windows and rests: id, start, length, ids_crc32, doc_tokens and, if asked for, ids. No shuffle."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = library_memory(path)
        for batch in batches:
            for part in slices(batch):
                ids, counts = memory.encode_texts(texts_of(part))
                stops = np.cumsum(counts)
                row, start, length, crc, held = [], [], [], [], []
                for i, (stop, n) in enumerate(zip(stops.tolist(), counts.tolist(), strict=True)):
                    own = np.append(ids[stop - n : stop], np.uint32(end)).astype("<u4")
                    for at in range(0, n + 1, size):
                        piece = own[at : at + size]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        if with_ids:
                            held.append(piece.astype(np.int64))
                found = [start, length, crc, (counts + 1)[row].tolist()]
                columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in found)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(held, pa.list_(pa.int64()))] * with_ids], names)

    schema = StructType().add(id_col, narrow.schema["id"].dataType)
    for name in names[1:5]:
        schema.add(name, LongType())
    if with_ids:
        schema.add("ids", ArrayType(LongType()))
    return narrow.mapInArrow(run, schema)


def pack(found: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """``found`` (written pieces with a ``length``) with ``sequence_id`` and ``offset``."""
    n_groups = -(-found.count() // group) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.concat_batches(held)
            lengths = rows.column(rows.schema.get_field_index("length")).to_numpy()
            sequence, offset = best_fit(lengths, size)
            sequence += TaskContext.get().partitionId() << 32
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(sequence), pa.array(offset)], [*rows.schema.names, "sequence_id", "offset"]
            )

    schema = StructType(list(found.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    return found.repartition(n_groups).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: its document, place, checksum, sequence and offset; ``with_ids`` adds its token ids."""
    return pack(durable(pieces(docs, path, size, end, with_ids, id_col, text_col), "pieces"), size)
