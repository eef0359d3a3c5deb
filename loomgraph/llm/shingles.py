"""Sets of five-word shingle hashes of whole texts, vectorised over Arrow batches; a text's memory is a few times its size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from loomgraph.llm.common import LOWER_WORDS, OTHER_WORDS, buffers, mix, segment_hashes, word_spans

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(column: pa.Array, words: int = 5, budget: int = 1 << 20, other: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts of about budget bytes: all their sets, each in ascending order one after another, and their sizes.

    Words are runs of characters other than the space and U+0009 to U+000D, A-Z lowered. A text of fewer words is one shingle
    of all its words; a null text or one without words has an empty set. other: by a second hash, independent of the first.
    """
    data, at = buffers(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + budget, "right")) - 1)
        yield _sets(data, at[i : j + 1], words, OTHER_WORDS if other else LOWER_WORDS)
        i = j


def _sets(data: np.ndarray, at: np.ndarray, words: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, at)
    w = segment_hashes(data, starts, ends, table)
    n = np.diff(first)
    with np.errstate(over="ignore"):
        if len(w) >= words:
            h = w[: len(w) - words + 1].copy()
            for k in range(1, words):
                h = h * _STEP + w[k : len(w) - words + 1 + k]
            h = mix(h)
        else:
            h = np.zeros(0, np.uint64)
        parts, sizes = [], np.zeros(len(n), np.int64)
        for d, (a, m) in enumerate(zip(first.tolist(), n.tolist(), strict=False)):
            if m >= words:
                s = np.sort(h[a : a + m - words + 1])
                if m > words:
                    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif m:
                short = np.uint64(m)
                for x in w[a : a + m]:
                    short = short * _STEP + x
                s = mix(np.array([short], np.uint64))
            else:
                continue
            parts.append(s)
            sizes[d] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def set_ids(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, as signed integers; 0 for an empty set."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        begin = (np.cumsum(sizes) - sizes)[full]
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mix(flat * _STEP), begin)
            xors = np.bitwise_xor.reduceat(flat, begin)
            out[full] = mix(sums + xors * np.uint64(0x9E3779B97F4A7C15) + sizes[full].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)
