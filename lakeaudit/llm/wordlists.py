"""Words between ASCII blanks, as Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, and the number of each text's; a null text has none.

    Blanks are space, tab, line feed, vertical tab, form feed and carriage return.
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.string()), ""))
    lengths = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    some = pc.not_equal(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(lengths)), lengths)
    return flat.filter(some), np.bincount(row[some.to_numpy(zero_copy_only=False)], minlength=len(lengths)).astype(np.int64)


def joined_words(words: pa.Array, counts: np.ndarray) -> pa.Array:
    """Texts of ``counts`` words each, joined by one space."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " ")


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``size`` of them, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
