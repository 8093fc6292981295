"""The self-contained binary block: fixed 32-byte records and two string dictionaries, LZ4-compressed.

A block is ``u32 stored size, u32 raw size, payload``; equal sizes mean an uncompressed payload.  A payload is
records, a begin mark, the resource and the endpoint dictionary (``u32 count``, then ``u32 id, u16 length,
bytes`` each), and an end mark.  The number of records is not stored: the begin mark ends them.  Lengths of
resources include a NUL, those of endpoints do not; the decoder takes either.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa

#: Fixed values of the format.
BEGIN, END = struct.pack("<Q", 0xDEADBEEFCAFEBABE), struct.pack("<Q", 0xBEEFBABEDEADCAFE)
RECORD = np.dtype([
    ("sequence", "<u8"), ("timestamp_us", "<u8"), ("url_idx", "<u4"), ("ip_idx", "<u4"), ("http_code", "<u2"), ("duration_ms", "<u2"),
    ("response_size", "<u2"), ("http_verb", "u1"), ("flags", "u1"),
])
MOST_ENTRIES = 1 << 28
HEADER = struct.Struct("<II")
ENTRY = struct.Struct("<IH")


class Corrupt(ValueError):
    """A payload that does not parse; the message is the reason."""


def dictionary_bytes(entries: list[tuple[int, bytes]], nul: bool) -> bytes:
    out = [struct.pack("<I", len(entries))]
    for key, raw in entries:
        raw = raw + b"\0" if nul else raw
        out.append(ENTRY.pack(key, len(raw)) + raw)
    return b"".join(out)


def payload(records: np.ndarray, urls: list[tuple[int, bytes]], ips: list[tuple[int, bytes]]) -> bytes:
    return records.tobytes() + BEGIN + dictionary_bytes(urls, True) + dictionary_bytes(ips, False) + END


def frame(raw: bytes, compress: bool = True) -> bytes:
    """A block; the payload is stored as it is where compression does not make it smaller."""
    packed = pa.compress(raw, codec="lz4_raw", asbytes=True) if compress else raw
    if len(packed) >= len(raw):
        packed = raw
    return HEADER.pack(len(packed), len(raw)) + packed


def unpack(stored: bytes, size: int) -> bytes:
    if len(stored) == size:
        return stored
    try:
        raw = pa.decompress(stored, decompressed_size=size, codec="lz4_raw", asbytes=True)
    except (pa.ArrowException, ValueError, OSError) as error:
        raise Corrupt("decompression failed") from error
    if len(raw) != size:
        raise Corrupt("decompressed size differs")
    return raw


def _begin(raw: bytes) -> int:
    """The begin mark: at a multiple of 32 if there is one, else anywhere, where it must be one."""
    at = raw.find(BEGIN)
    first = at
    while at >= 0:
        if at % RECORD.itemsize == 0:
            return at
        at = raw.find(BEGIN, at + 1)
    if first < 0:
        raise Corrupt("no begin mark")
    raise Corrupt("records are no multiple of 32 bytes")


def _dictionary(raw: bytes, at: int, what: str) -> tuple[dict[int, bytes], int]:
    if at + 4 > len(raw):
        raise Corrupt(f"{what}: no count")
    (n,) = struct.unpack_from("<I", raw, at)
    if n > MOST_ENTRIES:
        raise Corrupt(f"{what}: too many entries")
    at += 4
    out: dict[int, bytes] = {}
    for _ in range(n):
        if at + ENTRY.size > len(raw):
            raise Corrupt(f"{what}: truncated entry")
        key, size = ENTRY.unpack_from(raw, at)
        at += ENTRY.size
        if at + size > len(raw):
            raise Corrupt(f"{what}: truncated value")
        out.setdefault(key, raw[at : at + size].split(b"\0", 1)[0])  # of repeated ids the first counts
        at += size
    return out, at


def parse(raw: bytes) -> tuple[np.ndarray, dict[int, bytes], dict[int, bytes]]:
    at = _begin(raw)
    records = np.frombuffer(raw, RECORD, at // RECORD.itemsize)
    urls, at = _dictionary(raw, at + 8, "resources")
    ips, at = _dictionary(raw, at, "endpoints")
    if raw[at : at + 8] != END:
        raise Corrupt("no end mark")
    return records, urls, ips


def blocks(file: BinaryIO) -> Iterator[tuple[int, bytes, int]]:
    """(number, stored payload, raw size) until the end, a zero size, or a header or payload that is cut short."""
    number = 0
    while len(head := file.read(HEADER.size)) == HEADER.size:
        stored, raw = HEADER.unpack(head)
        if not stored or not raw:
            return
        body = file.read(stored)
        if len(body) < stored:
            return
        yield number, body, raw
        number += 1


def blocks_between(file: BinaryIO, start: int, end: int) -> Iterator[tuple[int, bytes, int]]:
    """Like ``blocks``, of a seekable file: those whose header lies at start ... end - 1.  Others are stepped over, unread."""
    at = number = 0
    while at < end:
        file.seek(at)
        head = file.read(HEADER.size)
        if len(head) < HEADER.size:
            return
        stored, raw = HEADER.unpack(head)
        if not stored or not raw:
            return
        if at >= start:
            body = file.read(stored)
            if len(body) < stored:
                return
            yield number, body, raw
        at, number = at + HEADER.size + stored, number + 1


def blocks_ending(file: BinaryIO, start: int, end: int) -> Iterator[tuple[int, bytes, int]]:
    """Of a seekable file that may still grow: the blocks whose last byte is the ``start + 1``-th to the ``end``-th."""
    at = number = 0
    while at + HEADER.size <= end:
        file.seek(at)
        head = file.read(HEADER.size)
        if len(head) < HEADER.size:
            return
        stored, raw = HEADER.unpack(head)
        at += HEADER.size + stored
        if not stored or not raw or at > end:
            return
        if at > start:
            yield number, file.read(stored), raw
        number += 1


def block_at(file: BinaryIO, start: int) -> tuple[bytes, int]:
    """(stored payload, raw size) of the block that begins there."""
    file.seek(start)
    stored, raw = HEADER.unpack(file.read(HEADER.size))
    return file.read(stored), raw


def encode_batch(batch: pa.RecordBatch, compress: bool = True) -> bytes:
    """One block of a batch with the columns of a normalised event."""
    return encode_block(batch, compress)[0]


def encode_block(batch: pa.RecordBatch, compress: bool = True) -> tuple[bytes, np.ndarray, dict[str, list[str]]]:
    """The block, its records, and the distinct strings of either dictionary."""
    records = np.zeros(batch.num_rows, RECORD)
    for name in ("sequence", "timestamp_us", "http_code", "duration_ms", "response_size", "http_verb", "flags"):
        if name in batch.schema.names:
            column = batch.column(name).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            records[name] = column.astype(np.uint64).astype(RECORD[name])
    entries, strings = [], {}
    for name, idx, null in (("resource", "url_idx", "NULL"), ("endpoint", "ip_idx", "")):
        # ids by first appearance, which is what dictionary encoding gives
        coded = batch.column(name).fill_null(null).dictionary_encode()
        records[idx] = coded.indices.to_numpy(zero_copy_only=False)
        strings[name] = coded.dictionary.to_pylist()
        entries.append([(k, v.encode()) for k, v in enumerate(strings[name])])
    return frame(payload(records, *entries), compress), records, strings


def decode_block(stored: bytes, size: int, columns: set[str] | None = None) -> dict[str, object]:
    """Columns of a block by name; strings of dictionaries that are not wanted stay unread."""
    records, urls, ips = parse(unpack(stored, size))
    out: dict[str, object] = {n: records[n].astype(np.int64) for n in RECORD.names if n not in ("url_idx", "ip_idx")}
    for name, idx, entries in (("resource", "url_idx", urls), ("endpoint", "ip_idx", ips)):
        if columns is None or name in columns:
            keys = list(entries)
            place = {k: p for p, k in enumerate(keys)}
            used, inverse = np.unique(records[idx], return_inverse=True)
            where = np.array([place.get(int(u), len(keys)) for u in used], np.int32)
            values = [entries[k].decode("utf-8", "replace") for k in keys] + ["NOT_FOUND"]
            out[name] = pa.DictionaryArray.from_arrays(pa.array(where[inverse]), pa.array(values, pa.string())).cast(pa.string())
    return out
