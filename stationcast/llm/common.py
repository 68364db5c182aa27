"""Helpers shared by the text operators: Arrow batches of texts, words, checkpointed tables.

An operator takes the names of its id and text column and returns the id with its own
columns, so columns of the input with the same names as its results never clash.
Null texts count as empty, unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from stationcast.session import ship

__all__ = ["ship"]

#: Text bytes worked on at once inside a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def id_crc(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def slices(batch: pa.RecordBatch, text_col: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``max_bytes`` of text; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0)
    total = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(total, before + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        pa.default_memory_pool().release_unused()
        start, before = stop, int(total[stop - 1])


def texts_of(batch: pa.RecordBatch, text_col: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(batch.schema.get_field_index(text_col)), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs outside space and \\t-\\r) in order, and each word's row."""
    lists = pc.ascii_split_whitespace(texts)
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), rows.filter(full).to_numpy()


def codes_of(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and, for each value, its place among them."""
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def ragged_ranges(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges 0 to ``size[i] - 1``, one after the other: the range's number and the place in it."""
    size = np.asarray(size, np.int64)
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads small integers over all 64 bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def annotate(
    docs: DataFrame, fn: Callable[[pa.Array], dict], fields: pa.Schema, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its id and what ``fn`` finds in a run of texts."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = narrow.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = fn(texts_of(part))
                columns = [pa.array(found[f.name], f.type) for f in fields]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [id_col, *fields.names])

    schema = from_arrow_schema(fields)
    schema.fields.insert(0, narrow.schema["id"].__class__(id_col, id_type))
    schema.names.insert(0, id_col)
    return narrow.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, fn: Callable[[pa.Array], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose texts ``fn`` accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(np.asarray(fn(texts_of(part, text_col)), dtype=bool)))

    return docs.mapInArrow(run, docs.schema)
