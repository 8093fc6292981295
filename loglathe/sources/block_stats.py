"""Statistics of blocks, by which a reader leaves out those without a wanted row: ranges of numbers, Bloom filters of strings.

Those of a file lie beside it in ``<file>.idx``, a Parquet table of a row a block, with its place in the file.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

NUMBERS = ("sequence", "timestamp_us", "http_code", "http_verb", "duration_ms", "response_size", "flags")
STRINGS = ("resource", "endpoint")
#: Bits of a Bloom filter for each value; places a value sets.  Together about one block in 100 is read in vain.
BITS, PLACES = 10, 7
SUFFIX = ".idx"
SCHEMA = pa.schema([
    ("block", pa.int64()), ("start", pa.int64()), ("stored_bytes", pa.int64()), ("raw_bytes", pa.int64()), ("rows", pa.int64()),
    *((f"{end}_{c}", pa.int64()) for c in NUMBERS for end in ("min", "max")), *((f"bloom_{c}", pa.binary()) for c in STRINGS),
])


def _places(values: list[str], size: int) -> np.ndarray:
    """Bits of values in a filter of ``size`` bits: multiples of one half of a 64-bit hash, from the other."""
    h = pd.util.hash_array(np.array(values, object), categorize=False)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((first[:, None] + np.arange(PLACES, dtype=np.uint64) * step[:, None]) % np.uint64(size)).astype(np.int64)


def bloom(values: list[str]) -> bytes:
    size = max(64, -(-BITS * len(values) // 8) * 8)
    bits = np.zeros(size, bool)
    if values:
        bits[_places(values, size)] = True
    return np.packbits(bits).tobytes()


def may_hold(filter_: bytes, value: str) -> bool:
    bits = np.frombuffer(filter_, np.uint8)
    at = _places([value], 8 * len(bits))[0]
    return bool((bits[at >> 3] & (np.uint8(128) >> (at & 7).astype(np.uint8)) != 0).all())


def of_block(records: np.ndarray, strings: dict[str, list[str]]) -> dict[str, object]:
    """What is told of a block: rows, ranges and filters."""
    out: dict[str, object] = {"rows": len(records)}
    for c in NUMBERS:
        column = records[c].astype(np.int64)
        out |= {f"min_{c}": int(column.min()) if len(column) else None, f"max_{c}": int(column.max()) if len(column) else None}
    return out | {f"bloom_{c}": bloom(strings[c]) for c in STRINGS}


def ranges(blocks: Iterable[dict]) -> dict[str, list[int]]:
    """The ranges of a file, from those of its blocks."""
    seen = [b for b in blocks if b["rows"]]
    return {c: [min(b[f"min_{c}"] for b in seen), max(b[f"max_{c}"] for b in seen)] for c in NUMBERS} if seen else {}


def table_bytes(blocks: list[dict]) -> bytes:
    out = io.BytesIO()
    pq.write_table(pa.Table.from_pylist(blocks, SCHEMA), out)
    return out.getvalue()


def read(file, columns: list[str] | None = None) -> pa.Table:
    return pq.read_table(file, columns=columns, schema=SCHEMA)


def can_hold(low: int, high: int, sign: str, value: int) -> bool:
    """Whether a number from low to high may stand to value as ``sign`` says."""
    return {"=": low <= value <= high, ">": high > value, ">=": high >= value, "<": low < value, "<=": low <= value}[sign]


def file_can_hold(known: dict[str, list[int]] | None, tests: list[tuple[str, str, int]]) -> bool:
    return not known or all(can_hold(*known[c], sign, value) for c, sign, value in tests)


def wanted(table: pa.Table, tests: list[tuple[str, str, int]], equal: dict[str, str]) -> pa.Table:
    """The blocks that may hold a row for all tests."""
    keep = np.ones(table.num_rows, bool)
    for c, sign, value in tests:
        low, high = (table.column(f"{end}_{c}") for end in ("min", "max"))
        compare = {"=": pc.and_(pc.less_equal(low, value), pc.greater_equal(high, value)), ">": pc.greater(high, value), ">=": pc.greater_equal(high, value), "<": pc.less(low, value), "<=": pc.less_equal(low, value)}
        keep &= compare[sign].fill_null(False).to_numpy()
    for c, value in equal.items():
        filters = table.column(f"bloom_{c}")
        keep &= np.array([bool(keep[k]) and may_hold(filters[k].as_py(), value) for k in range(len(keep))], bool)
    return table.filter(pa.array(keep))
