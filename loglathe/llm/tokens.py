"""Whole-text encoding with the tokenizers library, an atom of text at a time.

A text is cut where no token of the vocabularies' pre-tokenizers can reach across: before a space or line
feed that follows a character, behind a single line feed, and between a letter and a sign (but for the
apostrophe).  Cuts are found on bytes, for many texts at once; the atoms between them repeat, so each
distinct one is encoded once and kept in a bounded cache.  A text with white space outside ASCII is one
atom where white space counts.

The result is that of the library at its defaults: an added token's string (``<|endoftext|>``) in a text is that
token.  Texts that hold one are encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most atoms kept (about 170 bytes each); beyond it only those met in more than one batch stay.
CACHE_ATOMS = 500_000
#: Bytes of text encoded together.
BATCH_BYTES = 4_000_000


#: Atoms encoded in one text, and those that may be: no white space but a space in front.
FENCED = 2000
_PLAIN = re.compile(r" ?[^\s\x01\x1c-\x1f\x85]+")

#: What vocabularies do before their model, and the words that are one pre-token then as they stand: letters
#: that every version of Unicode calls letters, a space in front, and for the second, which folds case, small ones.
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORDS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    _BYTES | {"use_regex": False},
]}
_FOLDED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_FORMS = (
    (None, _BYTES, re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)")),
    (_FOLDED, _WORDS, re.compile(" ?([a-z\u00df-\u00f6\u00f8-\u00ff]+)")),
)
#: Byte-level vocabularies write each byte as a character: printable ones as they are, the others, in order, from U+0100.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_WRITTEN = {b: b for b in _KEPT} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_KEPT)))}

_SPACE_WRITTEN = chr(_WRITTEN[32])

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True
_SIGN[39] = False
#: A-Z in lower case, white space as a space: for vocabularies that do not tell these apart.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[_SPACE] = 32


def _wide_spaces(raw: np.ndarray) -> np.ndarray:
    """Places of white space outside ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
    at = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    at = at[at < len(raw) - 2] if len(raw) > 2 else at[:0]
    a, b, c = raw[at], raw[at + 1], raw[at + 2]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    e2 = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    other = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    found = at[two | e2 | other]
    if len(raw) > 1 and raw[-2] == 0xC2 and raw[-1] in (0x85, 0xA0):
        found = np.append(found, len(raw) - 2)
    return found


class _Table:
    """Strings by number, and the ids of each, end to end."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.at = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int32)

    def add(self, names: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        base = len(self.index)
        self.index.update(zip(names, range(base, base + len(names)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lens)])
        self.uses = np.concatenate([self.uses, np.zeros(len(names), np.int32)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.at[rows]
        lens = self.at[rows + 1] - starts
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(starts - (ends - lens), lens) + np.arange(total)], lens

    def shrink(self, most: int) -> None:
        """Keeps only what was used more than once, and no more than ``most``."""
        names = [w for w, i in self.index.items() if self.uses[i] > 1][:most]
        ids, lens = self.take(np.array([self.index[w] for w in names], np.int64))
        self.__init__()
        self.add(names, ids, lens)


class Encoder:
    def __init__(self, path: str, spaces: bool):
        """``spaces``: a space before a word belongs to its tokens (byte-level vocabularies); else case and
        white space do not count."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # strings that are one token wherever they stand in a text, and across which atoms are cut
        added = self.tok.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):
            raise ValueError("an added token that is looked for in the normalised text")
        self.added = [t.content for t in added]
        self.spaces = spaces
        self.atoms = _Table()
        self.fence = "\n" if spaces else " \x01 "
        steps = json.loads(self.tok.to_str())
        #: The words that the library's model may take without the steps before it, each written byte by byte.
        self.words = next((w for n, p, w in _FORMS if (steps["normalizer"], steps["pre_tokenizer"]) == (n, p) and steps["post_processor"] is None), None)
        self.model = self.tok.model
        (self.fence_id,) = self.tok.encode("\n" if spaces else "\x01", add_special_tokens=False).ids

    def _each(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [x.ids for x in self.tok.encode_batch_fast(names, add_special_tokens=False)]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(lens.sum())), lens

    def _learn_words(self, names: list[str]) -> list[str]:
        """Plain words are encoded one by one, by the model alone; returns the other atoms."""
        match, tokenize = self.words.fullmatch, self.model.tokenize
        words, lists, others = [], [], []
        for a in names:
            if m := match(a):
                words.append(a)
                word = m[1]
                written = word.replace(" ", _SPACE_WRITTEN) if word.isascii() else word.encode().decode("latin-1").translate(_WRITTEN)
                lists.append([t.id for t in tokenize(written)])
            else:
                others.append(a)
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        self.atoms.add(words, np.fromiter(chain.from_iterable(lists), np.uint32, int(lens.sum())), lens)
        return others

    def _learn(self, names: list[str]) -> None:
        """Atoms are encoded many at a time, with the fence between them, which is one token by itself."""
        if self.words is not None:
            names = self._learn_words(names)
        fenced, alone = [], []
        for a in names:
            (fenced if _PLAIN.fullmatch(a) else alone).append(a)
        for k in range(0, len(fenced), FENCED):
            part = fenced[k : k + FENCED]
            ids = np.array(self.tok.encode_batch_fast([self.fence.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.fence_id), len(ids))
            if len(ends) == len(part):
                lens = np.diff(ends, prepend=-1) - 1
                self.atoms.add(part, ids[ids != self.fence_id], lens)
            else:  # an atom that holds the fence's token
                alone += part
        if alone:
            self.atoms.add(alone, *self._each(alone))

    def _rows(self, names: list[str]) -> np.ndarray:
        """Numbers of distinct atoms in the table, after learning what it lacks."""
        found = list(map(self.atoms.index.get, names))
        if None in found:
            new = [w for w, k in zip(names, found, strict=True) if k is None]
            if len(self.atoms.index) + len(new) > CACHE_ATOMS:
                self.atoms.shrink(CACHE_ATOMS // 2)
                new = [w for w in names if w not in self.atoms.index]
            self._learn(new)
            found = list(map(self.atoms.index.__getitem__, names))
        rows = np.array(found, np.int64)
        self.atoms.uses[rows] += 1
        return rows

    def _cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of atoms, text by text."""
        cut = np.zeros(len(raw) + 1, bool)
        space, before = _SPACE[raw], np.empty(len(raw), np.uint8)
        before[:1], before[1:] = 32, raw[:-1]
        after_solid = ~_SPACE[before]
        cut[:-1] = _LETTER[before] & _SIGN[raw]
        if self.spaces:
            cut[:-1] |= after_solid & ((raw == 32) | (raw == 10))
            # behind a line feed with something on either side
            lone = np.flatnonzero((raw[:-1] == 10) & after_solid[:-1] & ~space[1:])
            cut[lone + 1] = True
            if len(wide := _wide_spaces(raw)):
                for k in np.unique(np.searchsorted(offsets, wide, "right") - 1).tolist():
                    cut[offsets[k] : offsets[k + 1]] = False
        else:
            cut[:-1] |= after_solid & space
        cut[offsets] = True
        return np.flatnonzero(cut[:-1])

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        gc.disable()  # many short-lived lists, no cycles: collections would walk them over and over
        try:
            texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
            whole = self._with_added(texts)
            if not whole.any():
                return self._encode(texts)
            lens = np.zeros(len(texts), np.int64)
            rest, lens[~whole] = self._encode(texts.filter(pa.array(~whole)))
            own, lens[whole] = self._each(texts.filter(pa.array(whole)).to_pylist())
            ids, of_whole = np.empty(int(lens.sum()), np.uint32), np.repeat(whole, lens)
            ids[of_whole], ids[~of_whole] = own, rest
            return ids, lens
        finally:
            gc.enable()

    def _with_added(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold the string of an added token."""
        out = np.zeros(len(texts), bool)
        for content in self.added:
            out |= pc.match_substring(texts, content).fill_null(False).to_numpy(zero_copy_only=False)
        return out

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        if not self.spaces:
            raw = _FOLD[raw]
        starts = self._cuts(raw, offsets)
        bounds = np.append(starts, len(raw)).astype(np.int64)
        atoms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = atoms.dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        ids, lens = self.atoms.take(rows)
        text_of = np.searchsorted(offsets, starts, "right") - 1
        return ids, np.bincount(text_of, lens, len(texts)).astype(np.int64)


def batches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, last) index pairs of runs of at most about BATCH_BYTES."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(sizes):
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + BATCH_BYTES, "right")))
        yield first, last
        first = last


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """One an executor process, kept between tasks."""
    key = path, spaces
    if key not in _encoders:
        _encoders[key] = Encoder(path, spaces)
    return _encoders[key]


def forget() -> None:
    """In a Python worker that goes on with other work: gives up the encoders that earlier tasks left."""
    _encoders.clear()
