"""Suffix sorting of one shard by external induced sorting, with common-prefix values.

The text is an array of symbols; 0 separates its segments. Suffixes are of type S (smaller than their successor) or L;
leftmost S suffixes (after an L) are the sample. The sample is ordered by naming its substrings and sorting the string
of names; then two sweeps induce all L and all S suffixes from it. A sweep is a priority queue over symbols: extracting the
smallest symbol's suffixes in bulk sends their predecessors, in order, to the queues of their own symbols. What waits in
queues beyond `memory` bytes goes to a scratch file of the running task, which has no name and vanishes with the task. Every queued suffix carries its
common prefix with the one queued before it, from range minima over the prefixes of what was extracted in between.

Prefixes are followed to `depth` symbols: suffixes that agree that far are in no defined order, and their common prefix
is given as `depth`.

Memory: text, order and common prefixes are held whole, with seven symbols packed for each place: about 16 bytes a symbol.
Places are of 4 bytes, and what is computed on the way takes AT_ONCE of them at a time, apart from naming the sample.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from .common import trim


#: Places that a step takes at once: its temporary arrays stay small beside the text.
AT_ONCE = 1 << 18


def types(text: np.ndarray) -> np.ndarray:
    """True for S. The end of the text is smaller than any symbol."""
    out = np.zeros(len(text), bool)
    np.less(text[:-1], text[1:], out=out[:-1])
    same = np.flatnonzero(text[:-1] == text[1:])
    if len(same):  # as the symbol behind the run of equal ones
        last = np.append(np.flatnonzero(np.diff(same) != 1), len(same) - 1)
        out[same] = np.repeat(out[same[last] + 1], np.diff(last, prepend=-1))
    return out


#: Symbols in one whole number: 7 of 9 bits.
PACK, BITS = 7, 9


class Packed:
    """A text of symbols below 512, PACK of them from each place in one number: common prefixes in few steps."""

    def __init__(self, text: np.ndarray) -> None:
        self.n = len(text)
        whole = np.zeros(self.n + PACK, np.uint16)
        whole[: self.n] = text
        whole[: self.n] += 1  # the end is no symbol
        self.words = np.zeros(self.n + 1, np.int64)
        for k in range(PACK):
            self.words <<= BITS
            self.words |= whole[k : k + self.n + 1]

    def common_prefix(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Of the suffixes at a and b, to `depth` at most."""
        parts = [self._common_prefix(a[i : i + AT_ONCE], b[i : i + AT_ONCE], depth) for i in range(0, len(a), AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _common_prefix(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        out = np.full(len(a), depth, np.int64)
        left = np.arange(len(a))
        for k in range(0, depth, PACK):
            x = self.words[np.minimum(a[left] + k, self.n)]
            x ^= self.words[np.minimum(b[left] + k, self.n)]
            # both ending is no common symbol
            differs = (x != 0) | (np.maximum(a[left], b[left]) + k + PACK > self.n)
            at = left[differs]
            if len(at):
                same = np.zeros(len(at), np.int64)
                for j in range(1, PACK + 1):
                    same += (x[differs] >> (BITS * (PACK - j)) == 0) & (np.maximum(a[at], b[at]) + k + j <= self.n)
                out[at] = np.minimum(k + same, depth)
                left = left[~differs]
            if not len(left):
                break
        return out


def names(text: np.ndarray, s: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Ranks of the sample's substrings, each up to the next sample suffix; symbols with types, six in a column."""
    n, kind = len(text), sample.dtype
    ends = np.append(sample[1:], kind.type(n - 1))
    symbols = np.zeros(n + 6, np.int16)
    symbols[:n] = text
    symbols[:n] *= 2
    symbols[:n] += s
    symbols[:n] += 1
    rank = np.zeros(len(sample), kind)
    left = np.arange(len(sample), dtype=kind)
    column = 0
    while len(left):
        key = np.zeros(len(left), np.int64)
        for i in range(0, len(left), AT_ONCE):
            some, part = left[i : i + AT_ONCE], key[i : i + AT_ONCE]
            first, last = sample[some] + column, ends[some]
            for k in range(6):
                at = first + k
                part <<= 10
                part |= np.where(at <= last, symbols[np.minimum(at, n)], np.int16(0))
        r = rank[left]
        order = np.lexsort((key, r))
        left, r, key = left[order], r[order], key[order]
        del order
        group = np.concatenate([[True], r[1:] != r[:-1]])
        fresh = group | np.concatenate([[True], key[1:] != key[:-1]])
        del key
        # a rank is the number of substrings before its group, so refining one group leaves all others as they are
        places = np.arange(len(r), dtype=kind)
        r += np.maximum.accumulate(places * fresh)
        r -= np.maximum.accumulate(places * group)
        rank[left] = r
        del places, group, r
        column += 6
        left = np.sort(left[~(fresh & np.append(fresh[1:], True))])  # the tied ones
        left = left[sample[left] + column <= ends[left]]
    return rank


def _dense(key: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Numbers from 0 on, in the order of the keys and equal for equal ones."""
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(key), kind)
    out[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])[: len(key)], dtype=kind)
    return out


def ordered_names(rank: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling until they differ or agree in `depth` names."""
    kind = rank.dtype
    rank = _dense(rank, kind)
    n, step = len(rank), 1
    while step < depth and n:
        key = rank.astype(np.int64)
        key *= n + 1
        if step < n:
            key[:-step] += rank[step:]
            key[:-step] += 1
        rank = _dense(key, kind)
        if rank.max(initial=0) == n - 1:
            break
        step *= 2
    return np.argsort(rank, kind="stable")


class Minima:
    """Range minima of small numbers."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of values[a..b], both included."""
        out = np.empty(len(a), self.rows[0].dtype)
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        for k, row in enumerate(self.rows):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(row[a[at]], row[b[at] - (1 << k) + 1])
        return out


class Queues:
    """A first-in first-out queue per symbol, of (suffix, common prefix with the one before it)."""

    def __init__(self, symbols: int, memory: int, kind: np.dtype) -> None:
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.memory, self.kind, self.held, self.file = memory, np.dtype(kind), 0, None

    def put(self, symbol: int, at: np.ndarray, prefix: np.ndarray) -> None:
        self.parts[symbol].append((at, prefix))
        self.held += at.nbytes + prefix.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            for i, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    where = self.file.tell()
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    parts[i] = (where, len(part[0]))
        self.held = 0

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What waits there, and what is put there meanwhile."""
        parts = self.parts[symbol]
        while parts:
            a, b = parts.pop(0)
            if isinstance(a, int):
                self.file.seek(a)
                a, b = np.frombuffer(self.file.read(self.kind.itemsize * b), self.kind), np.frombuffer(self.file.read(b), np.uint8)
            else:
                self.held -= a.nbytes + b.nbytes
            yield a, b


class Sweep:
    """Sends predecessors to their queues, with common prefixes; symbols rise in the L sweep and fall in the S sweep."""

    def __init__(self, text: np.ndarray, queues: Queues, depth: int) -> None:
        self.text, self.queues, self.depth = text, queues, depth
        self.least = np.zeros(len(queues.parts), np.uint8)  # since a symbol's queue got its last suffix

    def extract(self, at: np.ndarray, prefix: np.ndarray, low: int, high: int) -> None:
        """`at` in sweep order, with common prefixes with those before; predecessors with symbols in low..high follow."""
        for i in range(0, len(at), AT_ONCE):
            self._extract(at[i : i + AT_ONCE], prefix[i : i + AT_ONCE], low, high)

    def _extract(self, at: np.ndarray, prefix: np.ndarray, low: int, high: int) -> None:
        source = np.flatnonzero(at > 0)
        symbol = self.text[at[source] - 1]
        fits = (symbol >= low) & (symbol <= high)
        source, symbol = source[fits], symbol[fits]
        order = np.argsort(symbol, kind="stable")
        source, symbol = source[order], symbol[order]
        if not len(source):
            np.minimum(self.least, prefix.min(initial=255), out=self.least)
            return
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        minima = Minima(prefix)
        least = minima.of(np.where(first, 0, np.concatenate([[0], source[:-1] + 1])), source)
        least[first] = np.minimum(least[first], self.least[symbol[first]])
        np.minimum(self.least, prefix.min(), out=self.least)
        heads = np.flatnonzero(first)
        tails = np.append(heads[1:], len(source)) - 1
        rest = np.full(len(heads), 255, np.uint8)
        some = source[tails] + 1 < len(at)
        rest[some] = minima.of(source[tails][some] + 1, np.full(some.sum(), len(at) - 1))
        self.least[symbol[heads]] = rest
        value = np.minimum(least.astype(np.int64) + 1, self.depth).astype(np.uint8)
        for a, b in zip(heads.tolist(), (tails + 1).tolist(), strict=True):
            self.queues.put(int(symbol[a]), at[source[a:b]] - 1, value[a:b])


def suffix_order(text: np.ndarray, depth: int = 100, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order (to `depth` symbols), and each one's common prefix with the one before it."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    if text.max() >= (1 << BITS) - 1:
        raise ValueError("symbols must stay below 511")
    text = np.asarray(text, np.uint16)  # numbers of 16 bits are sorted by radix
    kind = np.int32 if n < 1 << 30 else np.int64
    s = types(text)
    sample = np.flatnonzero(s & np.concatenate([[False], ~s[:-1]])).astype(kind)
    sample = sample[ordered_names(names(text, s, sample), depth)] if len(sample) else sample
    del s
    trim()
    packed = Packed(text)
    sampled = np.zeros(len(sample), np.uint8)
    sampled[1:] = packed.common_prefix(sample[:-1], sample[1:], depth)
    symbols = int(text.max()) + 1
    cut = np.searchsorted(text[sample], np.arange(symbols + 1, dtype=np.uint16))
    begin = np.zeros(symbols + 1, np.int64)
    for i in range(0, n, AT_ONCE):
        begin[1:] += np.bincount(text[i : i + AT_ONCE], minlength=symbols)
    begin = np.cumsum(begin)
    # of each symbol first the L suffixes, rising, then the S suffixes, which are found falling
    suffix, shared = np.zeros(n, kind), np.zeros(n + 1, np.uint8)
    larger = begin[:-1].copy()  # where a symbol's L suffixes end
    queues = Queues(symbols, memory, kind)
    sweep = Sweep(text, queues, depth)
    # the last suffix is of type L and smaller than all others with its symbol
    queues.put(int(text[-1]), np.array([n - 1], kind), np.zeros(1, np.uint8))
    pair = lambda a, b: packed.common_prefix(np.array([a]), np.array([b]), depth).astype(np.uint8)

    for c in range(symbols):
        last = -1
        for at, prefix in queues.take(c):
            if last < 0:
                prefix = prefix.copy()
                prefix[0] = 0
            elif at[0] != n - 1 and last == n - 1:
                prefix = prefix.copy()
                prefix[:1] = pair(last, at[0])
            last = int(at[-1])
            a, b = larger[c], larger[c] + len(at)
            suffix[a:b], shared[a:b], larger[c] = at, prefix, b
            sweep.extract(at, prefix, c, symbols)
        at, prefix = sample[cut[c] : cut[c + 1]], sampled[cut[c] : cut[c + 1]]
        if len(at):
            prefix[0] = pair(last, at[0])[0] if last >= 0 else 0
            sweep.extract(at, prefix, c + 1, symbols)
    del sample, sampled
    queues = Queues(symbols, memory, kind)
    sweep = Sweep(text, queues, depth)
    for c in range(symbols - 1, -1, -1):
        last, b = -1, begin[c + 1]
        for at, prefix in queues.take(c):  # from the largest S suffix on
            if last < 0:
                prefix = prefix.copy()
                prefix[0] = 0
            last = int(at[-1])
            a = b - len(at)
            # each one's prefix is that with the one above it, where it belongs
            suffix[a:b], shared[a + 1 : b + 1], b = at[::-1], prefix[::-1], a
            sweep.extract(at, prefix, 0, c)
        at, rising = suffix[begin[c] : larger[c]], shared[begin[c] : larger[c]]
        link = pair(last, at[-1])[0] if last >= 0 and len(at) else 0
        if last >= 0:
            shared[b] = link
        if len(at):  # falling: each one's prefix with the one above it
            sweep.extract(at[::-1], np.concatenate([[link], rising[:0:-1]]).astype(np.uint8), 0, c - 1)
    return suffix, shared[:-1]
