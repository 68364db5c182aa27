"""Token ids of whole texts, a run of texts at a time.

Words repeat, so a run of texts is cut into units (a word with the space before it) and
each distinct unit is encoded once. That gives the ids of the whole text as long as
every space stands alone between other characters: the pattern of byte-level tokenizers
then starts a new piece at each space. Texts with other white space next to a space are
encoded in one go.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The byte-level pattern that cuts text into pieces (fixed value of this kind of vocabulary).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than space and line feed, which sends a text the slow way.
RARE_SPACE = r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Distinct units remembered by a worker from one run of texts to the next.
REMEMBERED = 200_000

Encode = Callable[[list[str]], list[np.ndarray]]


def ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices ``values[start[i] : start[i] + length[i]]``, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - length), length) + np.arange(total)]


def unit_safe(texts: pa.Array) -> np.ndarray:
    """Which texts have single spaces only, with nothing but other white-space-free text beside them."""
    bad = pc.match_substring_regex(texts, RARE_SPACE)
    for two in ("  ", " \n", "\n "):
        bad = pc.or_(bad, pc.match_substring(texts, two))
    return ~bad.to_numpy(zero_copy_only=False)


class Memory:
    """Encodes runs of texts with ``encode`` (strings to id arrays), remembering frequent units."""

    def __init__(self, encode: Encode):
        self.encode = encode
        self.known: dict[str, bytes] = {}

    def lookup(self, units: list[str]) -> list[bytes]:
        new = [u for u in units if u not in self.known]
        found = {u: ids.astype("<u4").tobytes() for u, ids in zip(new, self.encode(new), strict=True)} if new else {}
        out = [self.known.get(u) or found.get(u, b"") for u in units]
        if len(self.known) + len(found) <= REMEMBERED:
            self.known.update(found)
        elif len(found) > len(self.known) // 4:  # the words have changed: start over
            self.known = dict(list(found.items())[:REMEMBERED])
        return out

    def encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct units one after the other, and each unit's number of ids."""
        packed = self.lookup(units.to_pylist())
        return np.frombuffer(b"".join(packed), "<u4"), np.array([len(b) >> 2 for b in packed], np.int64)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and each text's number of ids."""
        safe = unit_safe(texts)
        pieces = pc.split_pattern(texts.filter(pa.array(safe)), " ")
        rows = np.flatnonzero(safe)[pc.list_parent_indices(pieces).to_numpy()]
        flat = pieces.flatten()
        inner = np.concatenate([[False], rows[1:] == rows[:-1]]) if len(rows) else np.zeros(0, bool)
        units = pc.binary_join_element_wise(pc.if_else(pa.array(inner), " ", ""), flat, "")
        coded = units.dictionary_encode()
        flat_ids, length = self.encode_units(coded.dictionary)
        whole = np.flatnonzero(~safe)
        others = self.encode(texts.take(pa.array(whole)).to_pylist()) if len(whole) else []
        flat_ids = np.concatenate([flat_ids, *others])
        length = np.concatenate([length, np.array([len(x) for x in others], np.int64)])
        start = np.cumsum(length) - length
        codes = np.concatenate([coded.indices.to_numpy().astype(np.int64), np.arange(len(whole)) + len(coded.dictionary)])
        rows = np.concatenate([rows, whole])
        order = np.argsort(rows, kind="stable")
        codes, rows = codes[order], rows[order]
        ids = ragged(flat_ids, start[codes], length[codes])
        return ids, np.bincount(rows, weights=length[codes], minlength=len(texts)).astype(np.int64)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if visible, else one from 256 on, in order."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Joined(Memory):
    """Encodes all distinct units of a run in one string, which is faster than remembering them.

    A piece of the pattern never reaches over the space that begins a unit, so the string's
    ids are the units' ids; ``size`` (bytes of each id) tells where a unit's ids end. Units
    that don't begin with a space, hold other white space, or a special token, are encoded
    one by one.
    """

    def __init__(self, encode: Encode, encode_long: Callable[[str], np.ndarray], size: np.ndarray, special: list[str]):
        super().__init__(encode)
        self.encode_long, self.size, self.special = encode_long, size, special

    def encode_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        apart = pc.invert(pc.match_substring_regex(units, r"^ [^\s]+$"))
        for token in self.special:
            apart = pc.or_(apart, pc.match_substring(units, token))
        apart = apart.to_numpy(zero_copy_only=False)
        joined = units.filter(pa.array(~apart))
        ids = self.encode_long("".join(joined.to_pylist()))
        ends = np.cumsum(pc.binary_length(joined).to_numpy(), dtype=np.int64)
        stops = np.searchsorted(np.cumsum(self.size[ids], dtype=np.int64), ends, "left") + 1
        others = self.encode(units.filter(pa.array(apart)).to_pylist())
        length = np.zeros(len(units), np.int64)
        length[~apart] = np.diff(stops, prepend=0)
        length[apart] = [len(x) for x in others]
        start = np.zeros(len(units), np.int64)
        start[~apart] = stops - length[~apart]
        start[apart] = len(ids) + np.cumsum(length[apart]) - length[apart]
        return ragged(np.concatenate([ids, *others]), start, length), length


def _plain_pieces(data: dict) -> bool:
    """Whether a vocabulary file cuts texts by :data:`PIECES` alone and takes special tokens as they stand."""
    cut = data["pre_tokenizer"] or {}
    odd = any(t.get(k) for t in data["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not data.get("normalizer") and not odd


def library_encode(path: str) -> Encode:
    """``encode`` of the vocabulary file of the tokenizers library at ``path``, without special tokens added."""
    return library_memory(path).encode


def library_memory(path: str) -> Memory:
    """Encodes runs of texts like the vocabulary file of the tokenizers library at ``path``, without special tokens added.

    The ids are those of that library. They are found with tiktoken, which is faster; it
    needs merges in the order of the ids they make and the plain byte-level pattern, so
    any other vocabulary is left to the tokenizers library itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    ids, merges = data["model"]["vocab"], data["model"]["merges"]
    made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    if made != sorted(made) or len(made) + 256 != len(ids) or not _plain_pieces(data):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return Memory(lambda strings: [np.array(tokenizer.encode(s, add_special_tokens=False).ids, np.uint32) for s in strings])
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in ids.items()}
    ranked = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)

    def encode(strings: list[str]) -> list[np.ndarray]:
        return [
            np.array(ranked.encode(s, allowed_special="all") if any(t in s for t in special) else ranked.encode_ordinary(s), np.uint32)
            for s in strings
        ]

    size = np.zeros(max(ids.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return Joined(encode, lambda text: ranked.encode_to_numpy(text, disallowed_special=()), size, list(special))
