"""Quality rules: compression bands over whole documents and fixed chunks.

Repetitive text compresses far better than prose of its length, noise far worse. Each
document's zstandard ratio (compressed over plain bytes) must lie in a band that
depends on its length, and so must the ratios of its fixed chunks: a document goes if
the chunks outside their band hold more than ``CHUNK_SHARE`` of its bytes.

The bands come from the documents themselves: one aggregate counts the ratios of all
distinct texts, and of all distinct chunks, by cells of length; around the line through
the middle of the neighbouring cells a band reaches ``LOW`` spreads down and ``HIGH``
spreads up. Cells with few texts have wider bands; below ``LEAST`` texts in all, fixed
bands hold.

Null and empty texts have no words and are rejected by the base rules. Equal texts get
equal verdicts. Texts of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast.llm.common import annotate, codes_of, keep_rows, mix, slices, split_words, texts_of

CHUNK_BYTES = 2048
CHUNK_SHARE = 0.25
LEVEL = 3
#: Cells of length in an octave and steps of the ratio, in which ratios are counted.
CELLS, STEPS = 8, 1000
#: A band is set by the cells within half an octave, or by as many as hold so many texts.
LEAST = 100
#: Spreads (of the upper middle half) from the middle to the lowest and the highest accepted ratio.
LOW, HIGH = 4.0, 8.0
#: With n texts within half an octave a spread counts 1 + FEW / sqrt(n) times.
FEW = 4.0
#: Fixed bands, where there are too few texts. Lowest accepted ratio: prose of up to so many bytes stays above it.
LOWEST = ((200, 0.42), (400, 0.40), (800, 0.38), (1600, 0.35), (3200, 0.33), (6400, 0.30), (float("inf"), 0.27))
#: Highest accepted ratio: a part for noise in a printable alphabet and one for the frame of a short text.
HIGHEST, FRAME_BYTES = 0.70, 40
WINDOW = 8
FIELDS = pa.schema(
    [
        ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
        ("ratio", pa.float64()), ("bad_chunk_share", pa.float64()),
    ]
)


def fixed_band(n_bytes: int) -> tuple[float, float]:
    """The accepted compression ratios of a text of this length where no others are known."""
    return next(low for most, low in LOWEST if n_bytes <= most), HIGHEST + FRAME_BYTES / max(n_bytes, 1)


@dataclass(frozen=True)
class Band:
    """Lowest and highest accepted ratios at some lengths (log2 of bytes); fixed bands beyond them."""

    at: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def holds(self, n_bytes: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        fixed = np.array([fixed_band(n) for n in n_bytes]).reshape(-1, 2).T
        if not len(self.at):
            return (fixed[0] <= ratio) & (ratio <= fixed[1])
        x = np.log2(np.maximum(n_bytes, 1))
        known = (x >= self.at[0] - 1 / CELLS) & (x <= self.at[-1] + 1 / CELLS)
        low = np.where(known, np.interp(x, self.at, self.low), fixed[0])
        return (low <= ratio) & (ratio <= np.where(known, np.interp(x, self.at, self.high), fixed[1]))


def middle_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The line of least absolute deviations: height at 0 and slope."""
    a = np.column_stack([np.ones(len(x)), x])
    w, line = weight.astype(float), np.zeros(2)
    for _ in range(30):
        line = np.linalg.solve(a.T @ (a * w[:, None]) + 1e-6 * np.eye(2), a.T @ (w * y))
        w = weight / np.maximum(np.abs(y - a @ line), 1 / STEPS)
    return line[0], line[1]


def quantile(values: np.ndarray, weight: np.ndarray, share: float) -> float:
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weight[order])
    return values[order][np.searchsorted(total, share * total[-1])]


def band_of(counts: Iterable[tuple[int, int, int]]) -> Band:
    """The band that counts by (cell of length, step of the ratio) give."""
    cell, step, n = (np.array(x, np.int64) for x in zip(*sorted(counts), strict=True)) if counts else (np.zeros(0, np.int64),) * 3
    if n.sum() < LEAST:
        return Band(*[np.zeros(0)] * 3)
    x, ratio = (cell + 0.5) / CELLS, (step + 0.5) / STEPS
    cells = np.unique(cell)
    found = []
    for c in cells:
        far = np.abs(cell - c)
        beside = int(n[far <= CELLS // 2].sum())
        reach = CELLS // 2
        while n[far <= reach].sum() < LEAST:
            reach += 1
        near = far <= reach
        at = (c + 0.5) / CELLS
        height, slope = middle_line(x[near] - at, ratio[near], n[near])
        off = ratio[near] - height - slope * (x[near] - at)
        half = quantile(off, n[near], 0.5)
        spread = quantile(off, n[near], 0.75) - half
        found.append((at, height + half, spread, 1 + FEW / beside**0.5))
    at, middle, spread, wide = np.array(found).T
    spread = np.maximum(spread, np.median(spread) / 2) * wide  # many near copies have next to none
    return Band(at, middle - LOW * spread, middle + HIGH * spread)


@dataclass(frozen=True)
class Bands:
    whole: Band
    chunk: Band


def parts(text: bytes) -> Iterator[bytes]:
    """The whole text and, if it has two at least, its chunks; the last one takes the rest."""
    yield text
    n = len(text)
    if n >= 2 * CHUNK_BYTES:
        starts = range(0, n - CHUNK_BYTES + 1, CHUNK_BYTES)
        for start, stop in zip(starts, [*starts[1:], n], strict=True):
            yield text[start:stop]


def measured(texts: pa.Array) -> list[tuple[int, int, int, int]]:
    """Of each distinct text and chunk: 0 or 1, cell of length, step of the ratio, hash."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    found = set()
    for text in pc.cast(pc.unique(texts), pa.binary()).to_pylist():
        for k, part in enumerate(parts(text) if text else ()):
            ratio = len(squeeze.compress(part)) / len(part)
            key = xxhash.xxh3_64_intdigest(part) - (1 << 63)
            found.add((int(k > 0), int(np.floor(CELLS * np.log2(len(part)))), int(STEPS * ratio), key))
    return sorted(found)


def bands_of(counts: Iterable[tuple[int, int, int, int]]) -> Bands:
    """Bands from counts by (0 or 1, cell, step)."""
    kinds: tuple[list, list] = ([], [])
    for kind, *row in counts:
        kinds[kind].append(tuple(row))
    return Bands(*map(band_of, kinds))


def learn(docs: DataFrame, text_col: str = "text") -> Bands:
    """The bands of a table: one aggregate, whose rows are cells of length by steps of the ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = measured(texts_of(part))
                yield pa.RecordBatch.from_pydict(
                    {name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("kind", "cell", "step", "key"))}
                )

    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind long, cell long, step long, key long")
    counts = each.distinct().groupBy("kind", "cell", "step").count()
    return bands_of([tuple(r) for r in counts.collect()])


def learned(texts: pa.Array) -> Bands:
    """The bands of the texts of an array, as ``learn`` finds them."""
    rows, n = np.unique(np.array([r[:3] for r in measured(texts)], np.int64).reshape(-1, 3), axis=0, return_counts=True)
    return bands_of([(*r, k) for r, k in zip(rows.tolist(), n.tolist(), strict=True)])


def compression(texts: list[bytes], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the ratio, whether it is in its band, and the share of bytes in chunks outside theirs."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    size, packed, row, inner = [], [], [], []
    for i, text in enumerate(texts):
        for k, part in enumerate(parts(text)):
            size.append(len(part))
            packed.append(len(squeeze.compress(part)) if part else 0)
            row.append(i)
            inner.append(k > 0)
    size, row, inner = np.array(size, np.int64), np.array(row, np.int64), np.array(inner, bool)
    ratio = np.array(packed, float) / np.maximum(size, 1)
    outside = inner.copy()
    outside[inner] = ~bands.chunk.holds(size[inner], ratio[inner])
    bad = np.bincount(row[outside], weights=size[outside], minlength=len(texts))
    whole = size[~inner], ratio[~inner]
    return whole[1], bands.whole.holds(*whole), bad / np.maximum(whole[0], 1)


def repeated_words(words: pa.Array, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row, the words inside windows of ``WINDOW`` words that the row has more than once."""
    _, code = codes_of(words)
    count = len(code) - WINDOW + 1
    if count <= 0:
        return np.zeros(n_rows, np.int64)
    with np.errstate(over="ignore"):
        spread = mix(code + 1)
        key = mix(rows[:count] + 1)
        for k in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + spread[k : k + count]
    place = np.flatnonzero(rows[:count] == rows[WINDOW - 1 :])
    place = place[np.argsort(key[place], kind="stable")]
    same = key[place[1:]] == key[place[:-1]]
    found = place[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(place) else place
    edges = np.zeros(len(code) + 1, np.int64)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + WINDOW, -1)
    return np.bincount(rows[np.cumsum(edges[:-1]) > 0], minlength=n_rows)


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line of the row."""
    lists = pc.split_pattern(texts, "\n")
    lines, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    lines, rows = lines.filter(full), rows.filter(full).to_numpy()
    distinct, code = codes_of(lines)
    firsts = np.unique(rows * max(len(distinct), 1) + code) // max(len(distinct), 1)
    n = len(texts)
    return np.bincount(rows, minlength=n) - np.bincount(firsts, minlength=n)


def judge(texts: pa.Array, bands: Bands | None = None) -> dict[str, np.ndarray]:
    """Counts, base rules and verdict for each text; bands of the texts themselves if none are given."""
    n = len(texts)
    words, rows = split_words(texts)
    n_words = np.bincount(rows, minlength=n)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    n_repeat = repeated_words(words, rows, n)
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    ratio, sound, bad = compression(pc.cast(texts, pa.binary()).to_pylist(), bands or learned(texts))
    return {
        "n_words": n_words,
        "word_chars": np.bincount(rows, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False),
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & sound & (bad <= CHUNK_SHARE),
        "ratio": ratio,
        "bad_chunk_share": bad,
    }


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """One row per document: id, counts, ``base_failed``, ``kept``, ratio, share of bad chunks. No shuffle of texts."""
    bands = bands or learn(docs, text_col)
    return annotate(docs, lambda texts: judge(texts, bands), FIELDS, id_col, text_col)


def keep_good(docs: DataFrame, text_col: str = "text", bands: Bands | None = None) -> DataFrame:
    """The documents that pass, with all their columns."""
    bands = bands or learn(docs, text_col)
    return keep_rows(docs, lambda texts: judge(texts, bands)["kept"], text_col)
