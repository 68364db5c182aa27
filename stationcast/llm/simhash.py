"""SimHash near-duplicates: byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Fingerprints that differ in at most
``k`` bits differ in at most ``k`` bytes, so they share at least ``8 - k`` positional
bytes. The index therefore lists each distinct fingerprint under every choice of
``8 - k`` positions with their bytes. A pair is tallied where it meets, kept if the
tally reaches ``8 - k`` shared positions, reported in the list of its first shared
positions alone, and verified bit by bit.

Equal fingerprints are one entry of the index, however many documents have them. One
list holds at most ``2 ** (8 * k)`` fingerprints (16.8 million, 134 MB, at ``k`` 3), the
values its open bytes can take. Lists above ``PAIRWISE`` entries are searched from each
entry by flipping up to ``k`` open bits, which is linear in the list, and give one link
per entry to the first entry of its connected part: nothing is capped and no link
between parts is lost.

Null and empty texts have fingerprint zero and link like any other. Rows without an id
take part; a component's id is its smallest id, null if it has none. Repeated rows fall
into one component. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast.llm.common import annotate, fresh
from stationcast.session import durable

WORDS = 3
MAX_BITS = 3
SEED = 42
#: Lists up to this size compare all their pairs; longer ones are searched by bit flips or scans.
PAIRWISE = 64
#: Above this size flipping open bits is cheaper than scanning the rest of the list.
SCAN = 4096
BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The majority of each bit over the hashes of all word shingles."""
    found = text.lower().split()  # bytes: A-Z alone, and the six ASCII spaces
    if not found:
        return 0
    joined = b" ".join(found)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in found])]).tolist()
    n = max(len(found) - words + 1, 1)
    ends = starts[words:] if len(found) >= words else starts[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        stop = min(at + BLOCK, n)
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at:stop], ends[at:stop], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``fingerprint`` (the 64 bits as a signed long). No shuffle."""

    def run(texts: pa.Array) -> dict:
        values = [fingerprint(t, words) for t in pc.cast(texts, pa.binary()).to_pylist()]
        return {"fingerprint": np.array(values, np.uint64).view(np.int64)}

    return annotate(docs, run, pa.schema([("fingerprint", pa.int64())]), id_col, text_col)


def shared_positions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of fingerprints, which of the eight positional bytes agree."""
    return (a ^ b).view(np.uint8).reshape(-1, 8) == 0


def short_lists(rows: pa.RecordBatch, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of all lists in a sorted run of postings, each pair once over the whole index."""
    least = 8 - max_bits
    subset = rows.column(0).to_numpy()
    key, fp = rows.column(1).to_numpy(), rows.column(2).to_numpy().view(np.uint64)
    positions = np.array(list(itertools.combinations(range(8), least)))
    left, right = [], []
    for lag in range(1, len(fp)):
        same = np.flatnonzero((key[lag:] == key[:-lag]) & (subset[lag:] == subset[:-lag]))
        if not len(same):
            break
        a, b = fp[same], fp[same + lag]
        shared = shared_positions(a, b)
        enough = shared.sum(axis=1) >= least
        first = np.argsort(~shared, axis=1, kind="stable")[:, :least]
        mine = (first == positions[subset[same]]).all(axis=1)
        found = enough & mine & (np.bitwise_count(a ^ b) <= max_bits)
        left.append(a[found])
        right.append(b[found])
    none = np.array([], np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def long_list(fp: np.ndarray, open_bytes: list[int], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """One link from each entry of a list to the first entry of its connected part."""
    n = len(fp)
    first = np.full(n, -1, np.int64)
    if n <= SCAN:
        rest = np.arange(n)
        while len(rest):
            head, rest = rest[0], rest[1:]
            first[head] = head
            todo = [head]
            while todo and len(rest):
                near = np.bitwise_count(fp[rest] ^ fp[todo.pop()]) <= max_bits
                first[rest[near]] = head
                todo.extend(rest[near].tolist())
                rest = rest[~near]
    else:
        bits = [8 * p + i for p in open_bytes for i in range(8)]
        flips = np.array([sum(1 << b for b in c) for k in range(1, max_bits + 1) for c in itertools.combinations(bits, k)], np.uint64)
        order = np.argsort(fp)
        ranked = fp[order]
        for head in range(n):
            if first[head] >= 0:
                continue
            first[head] = head
            front = np.array([head])
            while len(front):
                reached = []
                for at in range(0, len(front), 1024):
                    wanted = (fp[front[at : at + 1024], None] ^ flips).ravel()
                    place = np.minimum(np.searchsorted(ranked, wanted), n - 1)
                    hit = np.unique(order[place[ranked[place] == wanted]])
                    hit = hit[first[hit] < 0]
                    first[hit] = head
                    reached.append(hit)
                front = np.concatenate(reached)
    own = np.flatnonzero(first != np.arange(n))
    return fp[first[own]], fp[own]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``); their connected parts are exact."""
    least = 8 - max_bits
    subsets = list(itertools.combinations(range(8), least))
    masks = [sum(255 << 8 * p for p in s) for s in subsets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = F.array(
        *[F.struct(F.lit(i).alias("subset"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]
    )
    lists = (
        fps.select("fp", F.explode(postings).alias("p"))
        .select("p.subset", "p.key", "fp")
        .repartition("subset", "key")
        .sortWithinPartitions("subset", "key")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # postings of the last list seen, which may go on

        def settle(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            subset, key = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]) | (subset[1:] != subset[:-1])) + 1
            start, stop = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            size = stop - start
            short = np.repeat((size > 1) & (size <= PAIRWISE), size)
            yield short_lists(rows.filter(pa.array(short)), max_bits)
            for i in np.flatnonzero(size > PAIRWISE):
                fp = rows.column(2).to_numpy()[start[i] : stop[i]].view(np.uint64)
                open_bytes = [p for p in range(8) if p not in subsets[subset[start[i]]]]
                yield long_list(np.unique(fp), open_bytes, max_bits)

        def batch_of(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            a, b = (x.view(np.int64) for x in pair)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        def ready(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.concat_batches(held)
            held.clear()
            cut = rows.num_rows
            if not last:
                subset, key = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                other = np.flatnonzero((key != key[-1]) | (subset != subset[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0
                held.append(rows.slice(cut))
            if cut:
                yield from (batch_of(pair) for pair in settle(rows.slice(0, cut)))

        count, wait = 0, 1 << 16
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= wait:
                yield from ready(False)
                count = held[0].num_rows
                wait = max(1 << 16, 2 * count)  # a list longer than a run is not copied again for each batch
        if held:
            yield from ready(True)

    return lists.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for all nodes of edges ``a`` < ``b``.

    Alternating large and small stars: every round hangs each node on the least
    neighbour known, until nothing changes. Rounds are written, so that a lost executor
    costs one round; only a count and a checksum of each round reach the driver.
    """
    edges = durable(edges.distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = durable(hung.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def grouped(fps: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id") -> DataFrame:
    """``fps`` (written rows of id and ``fingerprint``) with ``root`` and ``component_id``."""
    nodes = fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("least"))
    roots = components(links(nodes.select("fp"), max_bits))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = durable(named, "members")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.select("fp", "root").join(ids, "root")
    return fps.join(labels, fps["fingerprint"] == labels["fp"]).drop("fp")


def simhash(
    docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable)."""
    fps = durable(fingerprints(docs, words, id_col, text_col), "fingerprints")
    return grouped(fps, max_bits, id_col).select(
        id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each component with all its columns: that with the smallest id.

    Among rows without an id, or with the same one, the smallest hash of the text decides;
    rows equal in both are one document.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    keyed = narrow.select(F.struct(F.col("id").isNull().alias("missing"), "id", "h").alias("doc_id"), "text")
    fps = durable(fingerprints(keyed, words), "fingerprints")
    kept = grouped(fps, max_bits).groupBy("root").agg(F.min("doc_id").alias("k"))
    h = fresh(docs, "text_hash")
    found = docs.withColumn(h, F.xxhash64(text_col)).alias("d").join(
        kept.alias("kept"),
        F.col(f"d.{id_col}").eqNullSafe(F.col("kept.k.id")) & (F.col(f"d.{h}") == F.col("kept.k.h")),
        "left_semi",
    )
    return found.dropDuplicates([id_col, h]).select(*docs.columns)
