"""Word shingles of many texts as 64-bit hashes, in numpy over the bytes of a whole slice of rows."""

from __future__ import annotations

import re

import numpy as np

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240601).integers(0, 1 << 64, 256, dtype=U64)
_ROLE = np.random.default_rng(20240602).integers(0, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of the base and of its inverse, kept for the longest slice so far."""

    up = down = np.ones(1, U64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            size = 1 << n.bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                row = np.full(size + 1, base, U64)
                row[0] = 1
                setattr(cls, name, np.multiply.accumulate(row))
        return cls.up, cls.down


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts (A-Z as a-z), and for each text the place after its last."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    up, down = Powers.to(len(data))
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) and space[0]:
        ends = ends[ends > starts[0]]
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=U64)])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * _ROLE[63])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    after = np.cumsum(sizes + 1)
    return hashes, np.searchsorted(starts, after)


#: A longer text is hashed in stretches of about this size, which need some 50 bytes for each of theirs.
STRETCH = 1 << 20
_BLANKS = re.compile(rb"[\x20\x09-\x0D]")


def _long_word(word: bytes) -> np.ndarray:
    """The hash of one word of any length, as ``word_hashes`` gives it."""
    total = 0
    for at in range(0, len(word), STRETCH):
        part = _LOWER[np.frombuffer(word[at : at + STRETCH], np.uint8)]
        up, _ = Powers.to(len(part))
        total += int((_BYTE[part] * up[: len(part)]).sum(dtype=U64)) * pow(_BASE, at, 1 << 64)
    return mix(np.array([(total + len(word) * int(_ROLE[63])) & (1 << 64) - 1], U64))


def _in_stretches(text: bytes) -> np.ndarray:
    """Hashes of all words of a long text, cut at white space."""
    out, begin = [], 0
    while begin < len(text):
        cut = _BLANKS.search(text, begin + STRETCH)
        end = cut.start() if cut else len(text)
        if end - begin > 2 * STRETCH:  # the last word of the stretch is longer than one
            word = max(text.rfind(bytes([c]), begin, begin + STRETCH) for c in b"\x20\t\n\v\f\r") + 1 or begin
            out += [word_hashes([text[begin:word]])[0], _long_word(text[max(word, begin) : end])]
        else:
            out.append(word_hashes([text[begin:end]])[0])
        begin = end
    return np.concatenate(out)


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles; fewer words make one
    shingle of them all, no word makes none."""
    data = [t.encode() for t in texts]
    if any(len(t) > 2 * STRETCH for t in data):
        parts = [_in_stretches(t) if len(t) > 2 * STRETCH else word_hashes([t])[0] for t in data]
        words, stops = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    else:
        words, stops = word_hashes(data)
    n = max(0, len(words) - k + 1)
    runs = np.zeros(n, U64)
    for i in range(k):
        runs += words[i : i + n] * _ROLE[i]
    runs = mix(runs + U64(k) * _ROLE[62])
    out, begin = [], 0
    for stop in stops.tolist():
        if stop - begin >= k:
            out.append(np.unique(runs[begin : stop - k + 1]))
        elif stop > begin:
            few = words[begin:stop]
            out.append(mix((few * _ROLE[: len(few)]).sum(dtype=U64, keepdims=True) + U64(len(few)) * _ROLE[62]))
        else:
            out.append(np.empty(0, U64))
        begin = stop
    return out
