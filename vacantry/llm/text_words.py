"""Words of text columns as Arrow arrays, for the operators that score words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PUNCTUATION = ".,;:!?\"'()[]{}<>«»„“”‘’…*_-–—/\\|#%&$@^~`+="


def plain_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """``place, unique, starts``: all words as indexes into the unique words, and where each text's words begin.

    Words end at ASCII white space; they are lower-cased and their punctuation is
    trimmed, so a word may be empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = flat.filter(full).dictionary_encode()
    trimmed = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=PUNCTUATION).dictionary_encode()
    place = trimmed.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    return place, trimmed.dictionary.to_pylist(), before[offsets - offsets[0]]


def slices(texts: pa.Array, limit: int = 4 << 20) -> list[pa.Array]:
    """The texts in slices of about ``limit`` bytes, one text at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    out, at = [], 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        out.append(texts.slice(at, end - at))
        at = end
    return out
