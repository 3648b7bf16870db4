"""Encoding with a tokenizers file, fast for long texts: words are encoded once and then looked up.

The ids are those of the library's encode(text, add_special_tokens=False): special strings such as <|endoftext|> inside a
text become their own ids, and texts that hold one are encoded whole. Two kinds of file are split into independent
units first: byte-level BPE with the usual pattern, where a space belongs to the word behind it, and lower-casing BPE
that drops white space. Every other file is handed whole texts. The cache starts anew beyond `most` entries, and
the one before it is asked first.

Texts of byte-level files are cut by arrays, at places where the pattern ends a unit whatever stands around them, and each
different chunk of a call is looked up once. A chunk of one unit that the cache does not know is merged by tiktoken. It joins
any neighbours that make an entry of the vocabulary, and the library only those listed; they agree on every text if each
entry's own bytes are merged to it: inside the bytes of two neighbours all merges so far are then the first ones of that
entry's own, whose last is the listed one. So the entries are tried first, and the library does it all if one fails.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN as SPACED_PATTERN

# The pre-tokenizer pattern of plain files, and the characters that both kinds call white space.
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE = "\t-\r \x85\xa0  -     　"

_PLAIN_UNIT = re.compile(rf"[^{WHITE}]+")
#: A whole run of marks, none of them ' or _, anywhere.
_MARKS = re.compile(r"(?<![^\w\s])(?<!_)[^\w\s'_]++(?!['_])")
#: Bytes that begin, or are, white space or controls other than the space and the line feed, or that begin letters whose
#: lower case or composition is not theirs alone.
_ODD_PLAIN = np.zeros(256, bool)
_ODD_PLAIN[[0, 9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xC4, *range(0xCA, 256)]] = True
#: Longer chunks of spaced files are not kept in the cache.
LONGEST = 64
#: Classes of bytes: others (not ASCII, controls), letters, digits, marks, the apostrophe, white space.
_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE = range(6)
_CLASS = bytes(_LETTER if x < 128 and chr(x).isalpha() else _DIGIT if 48 <= x < 58 else _QUOTE if x == 39 else _MARK if 32 < x < 127 else _SPACE if x == 32 or 9 <= x < 14 else _OTHER for x in range(256))
#: By class before * 8 + class: 1 where every unit ends, 2 where that depends on the character before, which is not ASCII.
_CUT = bytearray(256)
for _before, _classes in {_OTHER: (), _LETTER: (_DIGIT, _MARK, _QUOTE, _SPACE), _DIGIT: (_LETTER, _MARK, _QUOTE, _SPACE), _MARK: (_LETTER, _DIGIT, _SPACE), _QUOTE: (_DIGIT, _SPACE)}.items():
    for _class in _classes:
        _CUT[_before * 8 + _class] = 1
for _class in (_DIGIT, _MARK, _QUOTE, _SPACE):
    _CUT[_OTHER * 8 + _class] = 2
#: Bytes that surely begin a character other than white space.
_SOLID = np.array([_LETTER <= x <= _QUOTE for x in _CLASS])
_SOLID[0xC3:0xF5] = True
_SOLID[0xE1:0xE4] = False
#: Runs of these, none the apostrophe, are one unit.
_PLAIN_MARKS = bytes(x for x in range(128) if _CLASS[x] == _MARK)
#: White space of three bytes.
_WIDE_WHITE = [int.from_bytes(chr(x).encode()) for x in (0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_encoders: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """ids of texts as little-endian bytes of type `dtype`."""

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.most = most
        #: By chunk: UTF-8 with the space before it in spaced files, lower-cased text in plain ones.
        self.known: dict[bytes | str, bytes] = {}
        self.old: dict[bytes | str, bytes] = {}
        if hasattr(self.tokenizer.model, "_resize_cache"):  # its own cache of words only costs time here
            self.tokenizer.model._resize_cache(0)
        with open(path) as f:
            kind = json.load(f)
        self.special = [x["content"].encode().lower() for x in kind["added_tokens"]]
        before, norm = kind["pre_tokenizer"] or {}, kind["normalizer"]
        self.kind = "whole"
        if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self.kind, self.merge = "spaced", self._merger(kind["model"])
        elif norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and before.get("type") == "Sequence" and before["pretokenizers"][0].get("pattern", {}).get("Regex") == PLAIN_PATTERN:
            self.kind, self.pattern = "plain", regex.compile(PLAIN_PATTERN)

    @classmethod
    def of(cls, path: str, most: int = 400_000) -> Encoder:
        """One encoder a process."""
        if (path, most) not in _encoders:
            _encoders[path, most] = cls(path, most)
        return _encoders[path, most]

    def _merger(self, model: dict) -> Callable[[bytes], list[int]] | None:
        """tiktoken's merges of one unit where they are the library's own, else nothing."""
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        try:
            from tiktoken._tiktoken import CoreBPE
        except ImportError:
            return None
        from tokenizers import Tokenizer, models

        single = [x for x in range(256) if 32 < x < 127 or 160 < x and x != 173]  # the file's characters for bytes
        letters = {chr(x): x for x in single} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)).difference(single)))}
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        made, vocabulary = ["".join(x) for x in merges], model["vocab"]
        numbers = [vocabulary[x] for x in made]
        tried = [*letters, *made]
        if len(set(tried)) < len(tried) or not vocabulary.keys() >= letters.keys() or numbers != sorted(numbers):
            return None
        bare = Tokenizer(models.BPE(vocab=vocabulary, merges=[tuple(x) for x in merges], cache_capacity=0))
        if any(e.ids != [vocabulary[x]] for x, e in zip(tried, bare.encode_batch_fast(tried, add_special_tokens=False), strict=True)):
            return None
        table = {c: bytes([x]) for c, x in letters.items()}
        return CoreBPE({b"".join([table[c] for c in x]): vocabulary[x] for x in tried}, {}, SPACED_PATTERN).encode_single_piece

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ids of each UTF-8 text."""
        collecting = gc.isenabled()
        gc.disable()  # many small strings and no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        if self.kind == "spaced":
            return self._encode_spaced(texts)
        decoded = [x.decode("utf-8", "replace") for x in texts]
        if self.kind == "whole":
            return self._whole(decoded)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = b"".join(texts)
        odd = np.concatenate([[0], np.cumsum(_ODD_PLAIN[np.frombuffer(joined, np.uint8)])])
        ends = np.cumsum(sizes)
        odd = (odd[ends] > odd[ends - sizes]).tolist()
        lowered = joined.lower()  # special strings may be found in lowered text; to look for more than there are does no harm
        special = [x for x in self.special if x in lowered]
        del joined, lowered
        # NUL marks chunks
        marked = [i for i, (x, o) in enumerate(zip(decoded, odd, strict=True)) if (o and "\0" in x) or (special and any(y in texts[i].lower() for y in special))]
        alone = set(marked)
        chunks = [[] if i in alone else self._split_plain(x, o) for i, (x, o) in enumerate(zip(decoded, odd, strict=True))]
        missing = set().union(*chunks).difference(self.known)
        if self.old:
            again = {x: self.old[x] for x in missing if x in self.old}
            self.known.update(again)
            missing.difference_update(again)
        self._learn(missing)
        known = self.known.__getitem__
        out = [b"".join(map(known, c)) for c in chunks]
        for i, x in zip(marked, self._whole([decoded[i] for i in marked]), strict=True):
            out[i] = x
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        return out

    def _encode_spaced(self, texts: list[bytes]) -> list[bytes]:
        joined = b"".join(texts)
        if not joined:
            return [b""] * len(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        starts = np.concatenate([[0], ends[:-1]])
        first = self._cuts(joined, starts)
        offsets = np.append(first, len(joined)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        _, cut, data = chunks.dictionary.buffers()
        data, cut = data.to_pybytes(), np.frombuffer(cut, np.int32, len(chunks.dictionary) + 1).tolist()
        words = [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        found = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(missing, self._learn_spaced([words[i] for i in missing]), strict=True):
            found[i] = x
        wide = self.dtype.itemsize
        number = np.fromiter(map(len, found), np.int64, len(found)) // wide
        begin = np.cumsum(number) - number
        index = chunks.indices.to_numpy()
        counts = number[index]
        stop = np.concatenate([[0], np.cumsum(counts)])
        ids = np.frombuffer(b"".join(found), self.dtype)[np.repeat(begin[index] - stop[:-1], counts) + np.arange(stop[-1])].tobytes()
        cut = (wide * stop[np.searchsorted(first, np.append(starts, len(joined)))]).tolist()
        out = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        lowered = joined.lower()  # special strings may be found in lowered text; to look for more than there are does no harm
        special = [x for x in self.special if x in lowered]
        marked = [i for i, x in enumerate(texts) if any(y in x.lower() for y in special)] if special else []
        for i, x in zip(marked, self._whole([texts[i].decode("utf-8", "replace") for i in marked]), strict=True):
            out[i] = x
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        return out

    def _cuts(self, joined: bytes, starts: np.ndarray) -> np.ndarray:
        """Where chunks begin: at every text, and where a unit ends whatever follows or went before.

        White space ends what is not; letters, digits and marks end each other, but for what the apostrophe may take. A line
        feed alone is a unit of its own. So chunks with longer white space, or letters and marks beyond Latin ones, stay whole.
        """
        b = np.frombuffer(joined, np.uint8)
        kinds = np.frombuffer(joined.translate(_CLASS), np.uint8)
        cut = np.empty(len(b) + 1, np.uint8)
        cut[1:-1] = np.frombuffer(((kinds[:-1] << 3) | kinds[1:]).tobytes().translate(_CUT), np.uint8)
        cut[0] = cut[-1] = 0
        doubt = np.flatnonzero(cut == 2)
        if len(doubt):
            x = b[doubt - 1].astype(np.int32)
            y = np.where(doubt > 1, b[doubt - 2], 0).astype(np.int32) << 8 | x
            z = np.where(doubt > 2, b[doubt - 3], 0).astype(np.int32) << 16 | y
            white = (x < 128) | (y == 0xC285) | (y == 0xC2A0) | np.isin(z, _WIDE_WHITE)
            letter = (y >= 0xC380) & (y < 0xCA00) & (y != 0xC397) & (y != 0xC3B7)
            cut[doubt] = np.where(kinds[doubt] == _SPACE, ~white, letter)
        cut[starts[starts < len(b)]] = 1
        line = np.flatnonzero(b[:-1] == 10)
        line = line[(cut[line] == 1) & _SOLID[b[line + 1]]]
        cut[line + 1] = 1
        return np.flatnonzero(cut)

    def _split_plain(self, text: str, odd: bool) -> list[str]:
        return _PLAIN_UNIT.findall(text) if odd else _MARKS.sub(r" \g<0> ", text.lower()).split()

    def _learn_spaced(self, missing: list[bytes]) -> list[bytes]:
        """ids of chunks that are not known; short ones are kept."""
        out = list(map(self.old.get, missing)) if self.old else [None] * len(missing)
        units, rest = [], []
        for i, x in enumerate(missing):
            if out[i] is None:
                y = x[1:] if x[:1] == b" " else x
                if self.merge and (y.isalpha() or y.decode("utf-8", "replace").isalpha() or y.isdigit() or (y and not y.translate(None, _PLAIN_MARKS))):
                    units.append(i)
                else:
                    rest.append(i)
        ids = [self.merge(missing[i]) for i in units]
        data = np.fromiter(chain.from_iterable(ids), self.dtype).tobytes()
        cut = (self.dtype.itemsize * np.cumsum([0, *map(len, ids)])).tolist()
        for i, a, b in zip(units, cut[:-1], cut[1:], strict=True):
            out[i] = data[a:b]
        for i, x in zip(rest, self._whole([missing[i].decode("utf-8", "replace") for i in rest]), strict=True):
            out[i] = x
        self.known.update((x, y) for x, y in zip(missing, out, strict=True) if len(x) <= LONGEST)
        return out

    def _learn(self, missing: set[str]) -> None:
        """Chunks of letters are one unit each, others are split into units first."""
        plain = [x for x in missing if x.isalpha() and (x.isascii() or (max(x) < "ɐ" and "İ" not in x and x == x.lower()))]
        self._learn_units(plain)
        rest = missing.difference(plain)
        if not rest:
            return
        lowered = {x: x.lower() for x in rest if x.isascii() or (max(x) < "ɐ" and "İ" not in x)}
        split = {x: self.pattern.findall(y) for x, y in lowered.items()}
        whole = list(rest.difference(lowered))
        self.known.update(zip(whole, self._whole(whole), strict=True))
        new = set().union(*split.values()).difference(self.known)
        letters = [u for u in new if u[-1].isalpha() and u[0] != "'"]
        self._learn_units(letters)
        others = list(new.difference(letters))
        self.known.update(zip(others, self._whole(others), strict=True))
        known = self.known
        for x, units in split.items():
            if x not in known:
                known[x] = b"".join([known[u] for u in units])

    def _learn_units(self, units: list[str]) -> None:
        """Runs of letters: they stay apart when many are encoded as one text."""
        wide = self.dtype.itemsize
        for i in range(0, len(units), 128):
            some = units[i : i + 128]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, word = np.array(e.ids, self.dtype), np.array(e.word_ids)
            if len(word) > 0 and word[-1] == len(some) - 1:
                data, cut = ids.tobytes(), (wide * np.searchsorted(word, np.arange(len(some) + 1))).tolist()
                self.known.update(zip(some, [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True))
            else:
                self.known.update(zip(some, self._whole(some), strict=True))
