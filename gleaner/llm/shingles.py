"""Sets of word shingles of documents, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from gleaner.llm.blocks import Block, lower_ascii, mix, span_hashes, window_hashes, word_bounds

def shingle_sets(block: Block, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's runs of `size` words, with A-Z
    in lower case; of a shorter text its whole sequence; of one without words none."""
    data = lower_ascii(block.data)
    starts, ends = word_bounds(block)
    words = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, block.offsets).tolist()
    runs = window_hashes(words, size)
    out = []
    for lo, hi in zip(first, first[1:], strict=False):
        if hi - lo >= size:
            out.append(np.unique(runs[lo : hi - size + 1]))
        elif hi > lo:
            out.append(mix(window_hashes(words[lo:hi], hi - lo) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

__all__ = ["rows_of", "shingle_sets"]
