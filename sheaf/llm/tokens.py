"""Words and shingles as 64-bit hashes, for Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Hash of each word, remembered; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a string column the hashes of its distinct words (A-Z lower-cased, ASCII blanks split them), which of them stands
    at each place, text after text, and where texts end (from 0 on); null is empty.

    Words are split and told apart in Arrow, so only distinct ones become Python objects.
    """
    whole = pa.concat_arrays([column])  # a slice that is cast and split comes out wrong
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole, "")))
    words, ends = split.flatten(), np.asarray(split.offsets).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)  # blanks at an end leave an empty word
    coded = words.filter(full).dictionary_encode()
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    known = pa.concat_arrays([coded.dictionary.cast(pa.large_binary())])
    _, offsets, data = known.buffers()
    at, data = np.frombuffer(offsets, np.int64)[: len(known) + 1].tolist() if len(known) else [0], data.to_pybytes() if data else b""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.uint64, len(known))
    return hashes, coded.indices.to_numpy(), before[ends]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 hashes."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * STEP
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, known: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles (A-Z lower-cased, ASCII blanks split words).

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * STEP + h[i : len(h) - k + 1 + i]
    return np.unique(mix(out))
