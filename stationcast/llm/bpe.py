"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

The leaves of a piece's tree hold ``rank * leaves + position`` of each adjacent pair, so
the root is the leftmost pair of the lowest rank. A merge changes the pair itself, its
left neighbour and the pair that disappears on its right: three leaves, each updated
along one path to the root. A piece is done when its root holds no mergeable pair.

Pieces of similar size are worked on together, one merge of each per step, with their
trees as rows of one array; very long pieces have a tree of their own. The vocabulary
file is that of the tokenizers library (byte-level BPE); it is read where the work is
done and its path is a parameter.

Null and empty texts have no ids and decode to the empty string. Texts of any length are
encoded whole; equal texts get equal ids. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from stationcast.llm.common import annotate
from stationcast.llm.tokens import PIECES, Memory, byte_characters, ragged

#: Pieces with more symbols get a tree of their own.
TOGETHER = 64
#: Tree nodes worked on at once.
NODES = 1 << 19
NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Merge ranks, token bytes and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        ids, merges = data["model"]["vocab"], data["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.of_byte = np.array([ids[c] for c in characters], np.int64)
        self.size = max([*ids.values(), *self.special.values()]) + 1
        pair = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        # the first rule of a pair counts, as the rank of a later one is never reached
        self.pairs, self.ranks = np.unique(pair, return_index=True)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        plain = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        plain |= {i: t.encode() for t, i in self.special.items()}
        table = [plain.get(i, b"") for i in range(self.size)]
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_length = np.array([len(t) for t in table], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.cut = regex.compile(PIECES)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.rank_of = dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True))

    def leaf(self, left: np.ndarray, right: np.ndarray, position: np.ndarray, leaves: int) -> np.ndarray:
        """Leaf values of pairs; a negative symbol stands for none."""
        pair = left * self.size + right
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = (self.pairs[place] == pair) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[place] * leaves + position, NONE)

    def merge_together(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces given as rows of ``symbols`` (-1 beyond their end): flat, and how many for each."""
        n, width = symbols.shape
        leaves = 1 << max(width - 2, 0).bit_length()
        symbols = np.concatenate([symbols, np.full((n, 1), -1)], axis=1)  # column ``width``: beyond the end
        places = np.arange(width)
        following = np.tile(places + 1, (n, 1))
        following = np.where(following >= length[:, None], width, following)
        before = np.tile(np.append(places - 1, 0), (n, 1))  # -1 also indexes column ``width``
        alive = places < length[:, None]
        tree = np.full((n, 2 * leaves), NONE)
        tree[:, leaves : leaves + width - 1] = self.leaf(symbols[:, : width - 1], symbols[:, 1:width], places[:-1], leaves)
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + leaves
            tree[rows, node] = value
            for _ in range(leaves.bit_length() - 1):
                tree[rows, node >> 1] = np.minimum(tree[rows, node], tree[rows, node ^ 1])
                node = node >> 1

        active = np.flatnonzero(tree[:, 1] != NONE)
        while len(active):
            rank, at = np.divmod(tree[active, 1], leaves)
            gone = following[active, at]
            after = following[active, gone]
            symbols[active, at] = self.merged[rank]
            following[active, at] = after
            before[active, after] = at
            alive[active, gone] = False
            has_pair = gone < width - 1
            update(active[has_pair], gone[has_pair], np.full(int(has_pair.sum()), NONE))
            update(active, at, self.leaf(symbols[active, at], symbols[active, after], at, leaves))
            left = before[active, at]
            inner = left >= 0
            rows, left, at = active[inner], left[inner], at[inner]
            update(rows, left, self.leaf(symbols[rows, left], symbols[rows, at], left, leaves))
            active = active[tree[active, 1] != NONE]
        return symbols[:, :width][alive], alive.sum(axis=1)

    def merge_alone(self, symbols: list[int]) -> np.ndarray:
        """Ids of one very long piece."""
        n, rank_of, size = len(symbols), self.rank_of, self.size
        leaves = 1 << max(n - 2, 0).bit_length()
        none = 1 << 62

        def leaf(i: int, j: int) -> int:
            rank = rank_of.get(symbols[i] * size + symbols[j]) if i >= 0 and j < n else None
            return none if rank is None else rank * leaves + i

        tree = [none] * (2 * leaves)
        tree[leaves : leaves + n - 1] = [leaf(i, i + 1) for i in range(n - 1)]
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at: int, value: int) -> None:
            node = at + leaves
            tree[node] = value
            while node > 1:
                best = min(tree[node], tree[node ^ 1])
                node >>= 1
                tree[node] = best

        following, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
        while tree[1] < none:
            rank, at = divmod(tree[1], leaves)
            gone = following[at]
            after = following[gone]
            symbols[at], following[at], alive[gone] = int(self.merged[rank]), after, False
            before[after] = at  # ``before`` has one place more than there are symbols
            if gone < leaves:
                update(gone, none)
            update(at, leaf(at, after))
            if before[at] >= 0:
                update(before[at], leaf(before[at], at))
        return np.array([s for s, a in zip(symbols, alive, strict=True) if a], np.int64)

    def encode_pieces(self, found: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray] = [np.array([], np.int64)] * len(found)
        length = np.array([len(p) for p in found], np.int64)
        for i in np.flatnonzero(length > TOGETHER):
            out[i] = self.merge_alone(self.of_byte[np.frombuffer(found[i], np.uint8)].tolist())
        for low, high in ((0, 1), (1, 3), (3, 5), (5, 9), (9, 17), (17, 33), (33, TOGETHER)):
            chosen = np.flatnonzero((length > low) & (length <= high))
            for at in range(0, len(chosen), max(1, NODES // (4 * high))):
                own = chosen[at : at + max(1, NODES // (4 * high))]
                width = max(high, 2)
                symbols = np.full((len(own), width), -1, np.int64)
                filled = np.arange(width) < length[own, None]
                symbols[filled] = self.of_byte[np.frombuffer(b"".join(found[i] for i in own), np.uint8)]
                ids, counts = self.merge_together(symbols, length[own])
                for i, part in zip(own.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    out[i] = part
        return out

    def encode(self, strings: list[str]) -> list[np.ndarray]:
        """The ids of each string; special tokens written in a string are taken as such."""
        parts: list[list[int | bytes]] = []
        for s in strings:
            spans = self.cut_special.split(s) if self.cut_special and any(t in s for t in self.special) else [s]
            found: list[int | bytes] = []
            for span in spans:
                if span in self.special:
                    found.append(self.special[span])
                else:
                    found += [p.encode() for p in self.cut.findall(span)]
            parts.append(found)
        distinct = list({p: None for found in parts for p in found if isinstance(p, bytes)})
        ids = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        out = []
        for found in parts:
            own = [ids[p] if isinstance(p, bytes) else np.array([p], np.int64) for p in found]
            out.append(own[0] if len(own) == 1 else np.concatenate([np.array([], np.int64), *own]))
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids; bytes that aren't UTF-8 become U+FFFD."""
        ids = ids.astype(np.int64)
        flat = ragged(self.token_bytes, self.token_start[ids], self.token_length[ids]).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.token_length[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


FIELDS = {
    "ids": pa.list_(pa.int64()), "n_tokens": pa.int64(), "decoded": pa.string(),
    "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
}


def _memory(path: str, held: list[tuple[Vocabulary, Memory]]) -> tuple[Vocabulary, Memory]:
    if not held:  # once in each task
        vocabulary = Vocabulary(path)
        held.append((vocabulary, Memory(vocabulary.encode)))
    return held[0]


def encode(
    docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "n_tokens"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id and ``outputs`` out of ``FIELDS``; ``decoded`` is made from the ids again. No shuffle."""
    held: list[tuple[Vocabulary, Memory]] = []

    def run(texts: pa.Array) -> dict:
        vocabulary, memory = _memory(path, held)
        ids, counts = memory.encode_texts(texts)
        found: dict = {"n_tokens": counts}
        stops = np.cumsum(counts).tolist()
        spans = [ids[stop - n : stop] for stop, n in zip(stops, counts.tolist(), strict=True)]
        if "ids" in outputs:
            found["ids"] = [s.astype(np.int64) for s in spans]
        if "ids_sha256" in outputs:
            found["ids_sha256"] = [hashlib.sha256(s.astype("<u4").tobytes()).hexdigest() for s in spans]
        if "decoded" in outputs or "decoded_sha256" in outputs:
            found["decoded"] = vocabulary.decode(ids, counts)
            found["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in found["decoded"]]
        return found

    return annotate(docs, run, pa.schema([(name, FIELDS[name]) for name in outputs]), id_col, text_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: id and ``text``; null ids decode to the empty string."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType, StructType

    narrow = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<bigint>").alias("ids"))

    def run(batches):
        vocabulary = Vocabulary(path)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            texts = vocabulary.decode(np.concatenate([np.array([], np.int64), *lists]), np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return narrow.mapInArrow(run, StructType().add(id_col, narrow.schema["id"].dataType).add("text", StringType()))
