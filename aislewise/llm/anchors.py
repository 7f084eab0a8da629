"""Anchors: places chosen by a text's content alone, so that equal passages have equal anchors.

Every start ``i`` of a string of ``length`` bytes belongs to the anchor with the least hash among the
``k``-grams inside the string, the leftmost if equal. The starts of one anchor are a run; two
equal strings have their anchors at the same offset, with equal hashes. So only starts whose anchors
have equal hashes can begin equal strings.
"""

from __future__ import annotations

import numpy as np

from aislewise.llm.shingles import _BYTE, _ROLE, U64, Powers, mix

_PLACE = 26  # bits for the place in a slice


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each window of ``w`` values, by minima from both ends of blocks of ``w``."""
    n = len(x)
    padded = np.full(-(-n // w) * w, ~U64(0), U64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def stretches(text: bytes, length: int, size: int = 1 << 20) -> list[tuple[int, bytes]]:
    """A long text in stretches, with their places. They overlap by ``length - 1`` bytes, so that each start
    with its string is in one of them; its anchor depends on its string alone, so it is the same."""
    if len(text) <= size + length:
        return [(0, text)]
    return [(at, text[at : at + size + length - 1]) for at in range(0, len(text) - length + 1, size)]


def anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all texts together (some megabytes; see ``stretches``): of each anchor the number of its text, its hash, its
    place, and the first and last start that belong to it, as places in the text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty
    if n >> _PLACE:
        raise ValueError("a slice of more than 64 MB")
    up, down = Powers.to(n)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[data] * up[:n], dtype=U64)])
    grams = mix((sums[k:] - sums[:-k]) * down[: n - k + 1] * _ROLE[61])
    packed = (grams >> U64(_PLACE) << U64(_PLACE)) | np.arange(len(grams), dtype=U64)
    least = (_window_least(packed, length - k + 1) & U64((1 << _PLACE) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    if not len(text):
        return empty, empty, empty, empty, empty
    starts = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0)) + begins[text]
    at = least[starts]
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(first[1:], len(at)) - 1
    owner = text[first]
    shift = begins[owner]
    return owner, grams[at[first]].astype(np.int64), at[first] - shift, starts[first] - shift, starts[last] - shift
