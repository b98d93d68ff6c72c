"""Word n-grams of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

# Odd multipliers of the hash functions, and of the finaliser of MurmurHash3.
BASE = 0x9E3779B97F4A7C15
STEP = 0xC2B2AE3D27D4EB4F
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

_BLANK = np.zeros(128, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of a value."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(MIX[0])
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(MIX[1])
    return values ^ (values >> np.uint64(33))


def _powers(count: int) -> np.ndarray:
    powers = np.full(count, BASE, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


_POWERS = _powers(4096)


def lowered(text: str) -> str:
    """The text in lower case, character by character where that keeps its length."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the lower-cased text, and its code points.

    Words are what is between white space; offsets hold for the text itself.
    """
    points = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _BLANK[np.minimum(points, 127)] & (points < 127)
    solid = np.flatnonzero(~blank)
    if not len(solid):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, points
    starts_word = np.empty(len(solid), bool)
    starts_word[0] = True
    np.not_equal(solid[1:], solid[:-1] + 1, out=starts_word[1:])
    starts = np.flatnonzero(starts_word)
    lengths = np.diff(np.append(starts, len(solid)))
    place = np.arange(len(solid)) - np.repeat(starts, lengths)
    powers = _POWERS if lengths.max() <= len(_POWERS) else _powers(int(lengths.max()))
    terms = (points[solid].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = mixed(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))
    return hashes, solid[starts], solid[starts] + lengths, points


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of all runs of ``size`` words, sorted.

    A text with fewer words has one n-gram, all of them; one without words has none.
    """
    words = words_of(text or "")[0]
    if not len(words):
        return words
    count = max(1, len(words) - size + 1)
    total = np.zeros(count, np.uint64)
    for i in range(min(size, len(words))):
        total = (total + words[i : i + count]) * np.uint64(STEP)
    return np.unique(mixed(total))
