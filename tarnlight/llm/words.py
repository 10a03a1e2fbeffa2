"""Words of texts as hashes, made for whole blocks of texts at once; n-gram hashes and MinHash."""

from __future__ import annotations

import ctypes
import re
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SPACE = re.compile(r"\s")
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
INVERSE = np.uint64(pow(int(MULT), -1, 2**64))
ENDS, TITLE, LINE = 1, 2, 4
BLOCK_CHARS = 1 << 17


def worker_state(key, build):
    """build() once per Python worker and key; workers are reused, pickled functions are not."""
    held = sys.modules.setdefault("_tarnlight_worker", types.ModuleType("_tarnlight_worker")).__dict__
    if key not in held:
        held[key] = build()
    return held[key]


def trimmed(run):
    """run for mapInArrow, after which the worker gives back what memory it has freed: workers are reused, and idle ones keep theirs."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def normal(word: str) -> str:
    """Lower case without punctuation at its ends; a word of punctuation alone stays as it is."""
    low = word.lower()
    return EDGES.sub("", low) or low


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    return x ^ (x >> np.uint64(27))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def long_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULT and of its inverse; those of a block are kept, longer ones are made again."""
    up, down = worker_state("powers", lambda: (powers(MULT, BLOCK_CHARS + 1), powers(INVERSE, BLOCK_CHARS + 1)))
    return (up[:n], down[:n]) if n <= len(up) else (powers(MULT, n), powers(INVERSE, n))


@dataclass
class Chars:
    """What each code point is: bits of kind, and a random number that all cases of a letter share."""

    kind: np.ndarray
    number: np.ndarray


IS_SPACE, IS_WORD, IS_UPPER, IS_LOWER, IS_END = 1, 2, 4, 8, 16


def characters() -> Chars:
    every = "".join(map(chr, range(0x110000)))
    kind = np.zeros(len(every), np.uint8)
    for bit, pattern in ((IS_SPACE, r"\s+"), (IS_WORD, r"[^\W_]+"), (IS_END, "[.!?…。！？]")):
        for m in re.finditer(pattern, every):
            kind[m.start() : m.end()] |= bit
    low = np.arange(len(every), dtype=np.uint32)
    for i, c in enumerate(every):
        if c.isupper():
            kind[i] |= IS_UPPER
        elif c.islower():
            kind[i] |= IS_LOWER
        if len(other := c.lower()) == 1:
            low[i] = ord(other)
    return Chars(kind, mixed(low.astype(np.uint64) * MULT + MIX))


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, 64-bit hashes and flags of the words (split at white space) of a text.

    Hashes are those of the normal forms: each character in lower case, without
    punctuation at the ends unless there is nothing else. Flags: ENDS a
    sentence, TITLE (a capital with a small letter next, or alone), first of a
    LINE but the first.
    """
    chars: Chars = worker_state("characters", characters)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(c)
    kind = chars.kind[c]
    space = np.ones(n + 2, np.int8)
    space[1:-1] = kind & IS_SPACE
    turn = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turn[::2], turn[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    wordy = kind & IS_WORD > 0
    at = np.flatnonzero(wordy)
    before = np.zeros(n + 1, np.int64)
    np.cumsum(wordy, out=before[1:])
    i, j = before[starts], before[ends]
    first, last = starts.copy(), ends - 1
    bare = j > i
    first[bare], last[bare] = at[i[bare]], at[j[bare] - 1]
    up, down = long_powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(chars.number[c] * up, out=sums[1:])
    hashes = mixed((sums[last + 1] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    flags = (kind[ends - 1] & IS_END > 0).astype(np.uint8)
    flags |= ((kind[first] & IS_UPPER > 0) & ((last == first) | (kind[np.minimum(first + 1, n - 1)] & IS_LOWER > 0))).astype(np.uint8) * np.uint8(TITLE)
    line = np.searchsorted(np.flatnonzero(c == 10), starts)
    flags[1:] |= (line[1:] != line[:-1]).astype(np.uint8) * np.uint8(LINE)
    return starts, hashes, flags


def slices(text: str, size: int) -> Iterator[str]:
    """Parts of a long text that end before white space."""
    at = 0
    while at < len(text):
        m = SPACE.search(text, min(at + size, len(text)))
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def word_blocks(texts: list[str | None], size: int = BLOCK_CHARS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, bounds, hashes, flags) of blocks of texts in a row: text first + k has the words bounds[k] : bounds[k + 1].

    Blocks hold size characters about; a longer text is a block of its own, made
    in parts. Null texts have no words.
    """
    i = 0
    while i < len(texts):
        if texts[i] and len(texts[i]) > size:
            parts = [words_of(p)[1:] if not k else _continued(p) for k, p in enumerate(slices(texts[i], size))]
            hashes, flags = (np.concatenate(x) for x in zip(*parts))
            yield i, np.array([0, len(hashes)]), hashes, flags
            i += 1
            continue
        j, held, ends, total = i, [], [], 0
        while j < len(texts) and (total := total + len(texts[j] or "") + 1) <= size + 1 or j == i:
            held.append(texts[j] or "")
            ends.append(total)
            j += 1
        starts, hashes, flags = words_of("\n".join(held))
        yield i, np.r_[0, np.searchsorted(starts, ends)], hashes, flags
        i = j


def _continued(part: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and flags of a part that begins with white space, or with the end of a text."""
    starts, hashes, flags = words_of(part)
    if len(starts) and "\n" in part[: starts[0]]:
        flags[0] |= LINE
    return hashes, flags


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order; one for the whole where there are fewer than n, none for no words."""
    size = len(hashes)
    if not size:
        return hashes
    n = min(n, size)
    g = hashes[: size - n + 1].copy()
    for k in range(1, n):
        g = g * MULT + hashes[k : size - n + 1 + k]
    return mixed(g * MULT + np.uint64(n))


def block_grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """grams() of each text of a block, one after the other, and where each begins and the last ends."""
    sizes = np.diff(bounds)
    counts = np.where(sizes >= n, sizes - n + 1, sizes > 0)
    places = np.r_[0, np.cumsum(counts)]
    out = np.empty(places[-1], np.uint64)
    whole = sizes >= n
    if whole.any():
        g = grams(hashes, n)
        owner = np.repeat(np.arange(len(sizes)), np.where(whole, counts, 0))
        at = np.arange(len(owner)) - np.repeat(np.cumsum(np.where(whole, counts, 0))[whole] - counts[whole], counts[whole])
        out[places[owner] + at] = g[bounds[owner] + at]
    for k in np.flatnonzero(~whole & (sizes > 0)):
        out[places[k]] = grams(hashes[bounds[k] : bounds[k + 1]], n)[0]
    return out, places


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(x)
    return s if len(s) < 2 else s[np.r_[True, s[1:] != s[:-1]]]


def multipliers(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def bands_of(g: np.ndarray, cuts: np.ndarray, step: int, bands: int, rows: int, seed: int) -> np.ndarray:
    """(items, bands) hashes of bands of rows MinHash values each, over g[cuts[i] : cuts[i + 1]] for each step-th i.

    The permutations are of the high halves of g, which take half the time of
    the whole: two items have an equal value by chance once in 2**32.
    """
    a, b = multipliers(bands * rows, seed)
    high = (g >> np.uint64(32)).astype(np.uint32)
    x = np.empty_like(high)
    out = np.empty((len(cuts[::step]), bands), np.uint64)
    for j in range(bands):
        h = np.full(len(out), j + 1, np.uint64)
        for r in range(j * rows, j * rows + rows):
            np.bitwise_xor(high, b[r], out=x)
            np.multiply(x, a[r], out=x)
            h = mixed(h * MULT + np.minimum.reduceat(x, cuts)[::step].astype(np.uint64))
        out[:, j] = h
    return out


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The fewest bands of so many rows that find a pair of this Jaccard similarity with this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
