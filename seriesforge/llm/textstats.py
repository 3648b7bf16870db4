"""Vectorised text statistics: words, lines, repeated windows and hashes of many texts in one numpy pass."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() takes the hash of any span of `values`."""
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, equal for equal content wherever it stands."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Texts:
    """Many texts in one buffer, a space after each: byte spans of documents and of their words."""

    buffer: np.ndarray
    space: np.ndarray
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Texts:
        buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        last = np.cumsum(sizes + 1) - 1
        first = last - sizes
        space = SPACE[buffer]
        turn = np.diff(space.view(np.int8), prepend=np.int8(1))
        start, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        return cls(buffer, space, first, last, start, end, np.searchsorted(first, start, "right") - 1)

    def __len__(self) -> int:
        return len(self.first)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Number of bytes of each text where `mask` holds."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.last] - total[self.first]

    def words_per_doc(self, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc, weights, len(self))

    def word_hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.buffer), self.start, self.end)


def counts(t: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text.

    word_chars: code points outside white space. n_dup_lines: lines with a word that equal an earlier line of the text.
    n_repeat_words: words in 8-word windows that occur twice or more in the text.
    """
    n = len(t)
    letter = ~t.space & ((t.buffer & 0xC0) != 0x80)
    prefix = prefix_hash(t.buffer)
    breaks = t.buffer == 10
    breaks[t.last] = True
    end = np.flatnonzero(breaks)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    words_before = np.concatenate([[0], np.cumsum(~t.space)])
    full = words_before[end] > words_before[start]
    start, end = start[full], end[full]
    doc = np.searchsorted(t.first, start, "right") - 1
    key = mix(span_hash(prefix, start, end) ^ mix(doc.astype(np.uint64)))
    _, one = np.unique(key, return_index=True)
    n_dup_lines = np.bincount(doc, minlength=n) - np.bincount(doc[one], minlength=n)
    hashes = span_hash(prefix, t.start, t.end)
    return {
        "n_words": np.bincount(t.doc, minlength=n),
        "word_chars": t.per_doc(letter),
        "n_symbols": t.per_doc(SYMBOL[t.buffer]),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": np.bincount(t.doc[repeated_words(hashes, t.doc)], minlength=n),
    }


def repeated_words(hashes: np.ndarray, doc: np.ndarray, width: int = 8) -> np.ndarray:
    """Which words lie in a window of `width` words that occurs twice or more in their document."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= width:
        at = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :])
        key = mix(span_hash(prefix_hash(hashes), at, at + width) ^ mix(doc[at].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(at) else at
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + width, -1)
    return np.cumsum(covered)[:-1] > 0
