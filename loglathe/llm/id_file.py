"""The token-id file format: patched frame-of-reference blocks.

A file is ``LLID1`` and a line feed, blocks, the document table, the index of block starts, and a footer.
Integers are little-endian.

* Block of up to ``BLOCK`` ids: u32 minimum, u16 count, u8 width, u16 exceptions; ids less the minimum,
  packed at ``width`` bits each, first id first, highest bit first; then each exception's place (u16) and
  its id less the minimum (u32).  An exception's packed bits are zero.
* The width is the bit length at one of ``PERCENTILES`` of the block's values, whichever makes the block
  smallest.
* Document table: i64 ids, u8 marks of null ids, i64 numbers of tokens, one each a document.
* Index: u64 start of each block, then u32 CRC-32 of each.  Footer: u64 documents, u64 tokens, u64 blocks, u64 start of
  the table, u32 CRC-32 of table and index, ``LLID``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC, END = b"LLID1\n", b"LLID"
#: Fixed values of the format.
BLOCK, PERCENTILES = 1024, (75, 90, 95, 99, 100)
HEAD = struct.Struct("<IHBH")
FOOT = struct.Struct("<QQQQI4s")
#: Blocks encoded or decoded together.
TOGETHER = 256


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    return np.frexp(values.astype(np.float64))[1]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """uint32 ids -> blocks; all but the last hold BLOCK ids."""
    n = len(ids)
    if not n:
        return []
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, ids[-1], np.uint32)
    grid[:n] = ids
    grid = grid.reshape(rows, BLOCK)
    low = grid.min(1)
    if n % BLOCK:  # padding must not lower the minimum of the last block: it repeats a value of it
        low[-1] = grid[-1].min()
    rest = grid - low[:, None]
    bits = _bits(rest).astype(np.uint8)
    counts = np.full(rows, BLOCK)
    counts[-1] = n - (rows - 1) * BLOCK
    ordered = np.sort(bits, 1)
    widths = np.zeros(rows, np.int64)
    cost = np.full(rows, np.iinfo(np.int64).max)
    for p in PERCENTILES:
        w = ordered[:, -(-BLOCK * p // 100) - 1].astype(np.int64)
        c = -(-BLOCK * w // 8) + 6 * (bits > w[:, None]).sum(1)
        widths, cost = np.where(c < cost, w, widths), np.minimum(c, cost)
    over = bits > widths[:, None]
    packed: list[bytes] = [b""] * rows
    kept = np.where(over, 0, rest)
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        if w:
            each = np.unpackbits(kept[own].astype(">u4").view(np.uint8).reshape(len(own), BLOCK, 4), axis=2)[:, :, 32 - w :]
            lines = np.packbits(each.reshape(len(own), BLOCK * int(w)), axis=1)
            for k, line in zip(own.tolist(), lines, strict=True):
                packed[k] = line[: -(-int(counts[k]) * int(w) // 8)].tobytes()
    out = []
    for k in range(rows):
        m = int(counts[k])
        where = np.flatnonzero(over[k, :m])
        head = HEAD.pack(int(low[k]), m, int(widths[k]), len(where))
        out.append(head + packed[k] + where.astype("<u2").tobytes() + rest[k, where].astype("<u4").tobytes())
    return out


def decode_blocks(raw: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in raw."""
    heads = [HEAD.unpack_from(raw, at) for at in starts]
    grid = np.zeros((len(starts), BLOCK), np.uint32)
    low = np.array([h[0] for h in heads], np.uint32)
    widths = np.array([h[2] for h in heads])
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        if w:
            size = -(-BLOCK * int(w) // 8)
            lines = np.zeros((len(own), size), np.uint8)
            for r, k in enumerate(own.tolist()):
                m = -(-heads[k][1] * int(w) // 8)
                lines[r, :m] = np.frombuffer(raw, np.uint8, m, starts[k] + HEAD.size)
            each = np.zeros((len(own), BLOCK, 32), np.uint8)
            each[:, :, 32 - w :] = np.unpackbits(lines, axis=1)[:, : BLOCK * int(w)].reshape(len(own), BLOCK, int(w))
            grid[own] = np.packbits(each, axis=2).view(">u4").reshape(len(own), BLOCK)
    for k, (_, m, w, n) in enumerate(heads):
        if n:
            at = starts[k] + HEAD.size + -(-m * w // 8)
            grid[k, np.frombuffer(raw, "<u2", n, at)] = np.frombuffer(raw, "<u4", n, at + 2 * n)
    grid += low[:, None]
    if heads and heads[-1][1] == BLOCK:
        return grid.reshape(-1)
    return np.concatenate([grid[k, : h[1]] for k, h in enumerate(heads)]) if heads else np.empty(0, np.uint32)


class Writer:
    """Writes to an open binary stream; holds at most some blocks of ids, and the document table."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.starts: list[int] = []
        self.crcs: list[int] = []
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.lens: list[int] = []
        self.parts: list[np.ndarray] = []
        self.waiting = self.tokens = 0
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)
        step, end = TOGETHER * BLOCK, len(ids) if whole else len(ids) - len(ids) % BLOCK
        for at in range(0, end, step):
            for raw in encode_blocks(ids[at : min(end, at + step)]):
                self.starts.append(self.at)
                self.crcs.append(zlib.crc32(raw))
                self._put(raw)
        self.parts = [ids[end:]]
        self.waiting = len(ids) - end

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lens.append(len(ids))
        self.parts.append(ids)
        self.waiting += len(ids)
        self.tokens += len(ids)
        if self.waiting >= TOGETHER * BLOCK:
            self._flush(False)

    def finish(self) -> None:
        self._flush(True)
        start = self.at
        table = np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.lens, "<i8").tobytes()
        index = np.array(self.starts, "<u8").tobytes() + np.array(self.crcs, "<u4").tobytes()
        self._put(table + index)
        self._put(FOOT.pack(len(self.docs), self.tokens, len(self.starts), start, zlib.crc32(table + index), END))


class Reader:
    """Reads from a seekable binary stream."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token-id file")
        file.seek(0, 2)
        size = file.tell()
        file.seek(size - FOOT.size)
        n, self.tokens, blocks, self.table, crc, end = FOOT.unpack(file.read(FOOT.size))
        file.seek(self.table)
        raw = file.read(size - FOOT.size - self.table)
        if end != END or zlib.crc32(raw) != crc:
            raise ValueError("damaged token-id file")
        self.docs = np.frombuffer(raw, "<i8", n)
        self.nulls = np.frombuffer(raw, np.uint8, n, 8 * n)
        self.lens = np.frombuffer(raw, "<i8", n, 9 * n)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks, 17 * n).astype(np.int64), self.table)
        self.crcs = np.frombuffer(raw, "<u4", blocks, 17 * n + 8 * blocks)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first ... last - 1 of the file: only their blocks are read."""
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, (last - 1) // BLOCK + 1
        base = int(self.starts[a])
        self.file.seek(base)
        raw = self.file.read(int(self.starts[b]) - base)
        cuts = (self.starts[a : b + 1] - base).tolist()
        if any(zlib.crc32(raw[x:y]) != crc for x, y, crc in zip(cuts, cuts[1:], self.crcs[a:b].tolist(), strict=False)):
            raise ValueError("damaged block of a token-id file")
        got = decode_blocks(raw, cuts[:-1])
        return got[first - a * BLOCK : last - a * BLOCK]

    def documents(self, low: int = 0, high: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, its first id's place in the file, ids) of every document that begins at one of the places low ... high - 1
        (all by default), read some blocks at a time."""
        begins = np.cumsum(self.lens) - self.lens
        some = slice(*np.searchsorted(begins, [low, self.tokens + 1 if high is None else high]))
        step, at = TOGETHER * BLOCK, int(begins[some][0]) if len(begins[some]) else 0
        held, base = np.empty(0, np.uint32), at
        for doc, null, n in zip(self.docs[some].tolist(), self.nulls[some].tolist(), self.lens[some].tolist(), strict=True):
            parts = []
            need, here = n, at
            while need:
                if here >= base + len(held):
                    base = here
                    held = self.ids(base, min(self.tokens, (base // BLOCK) * BLOCK + step))
                part = held[here - base : here - base + need]
                parts.append(part)
                need, here = need - len(part), here + len(part)
            yield None if null else doc, at, np.concatenate(parts) if parts else np.empty(0, np.uint32)
            at += n
