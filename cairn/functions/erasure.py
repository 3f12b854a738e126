"""Systematic Reed-Solomon stripes over GF(256): any ``data`` of the chunks rebuild the rest. A Cauchy matrix makes every choice solvable."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_EXP = np.zeros(512, np.int64)
_LOG = np.zeros(256, np.int64)
_x = 1
for _i in range(255):
    _EXP[_i], _LOG[_x] = _x, _i
    _x = _x << 1 ^ (0x11D if _x & 0x80 else 0)
_EXP[255:510] = _EXP[:255]
_PRODUCTS = np.zeros((256, 256), np.uint8)
_PRODUCTS[1:, 1:] = _EXP[_LOG[1:, None] + _LOG[None, 1:]]


def _scale(c: int, row: np.ndarray) -> np.ndarray:
    return _PRODUCTS[c][row]


def _inverse(c: int) -> int:
    return int(_EXP[255 - _LOG[c]])


def chunk_length(size: int, data: int) -> int:
    """A data chunk's length: the block spread evenly, rounded up to an even number, two at least."""
    c = -(-size // data)
    return max(2, c + c % 2)


def matrix(data: int, parity: int) -> list[list[int]]:
    return [[_inverse((data + p) ^ d) for d in range(data)] for p in range(parity)]


def encode(block: bytes, data: int, parity: int) -> list[bytes]:
    """The data chunks, zeros to their length at the end, and the parity chunks."""
    c = chunk_length(len(block), data)
    rows = np.frombuffer(block.ljust(c * data, b"\0"), np.uint8).reshape(data, c)
    more = []
    for line in matrix(data, parity):
        total = np.zeros(c, np.uint8)
        for k, x in enumerate(line):
            total ^= _scale(x, rows[k])
        more.append(total)
    return [r.tobytes() for r in (*rows, *more)]


def rebuild(present: dict[int, bytes], data: int, parity: int) -> list[bytes]:
    """All chunks from any ``data`` of them, by index; ValueError with fewer."""
    if len(present) < data:
        raise ValueError(f"{len(present)} of the {data} chunks needed")
    use = sorted(present)[:data]
    whole = [[int(i == d) for d in range(data)] for i in range(data)] + matrix(data, parity)
    left = [list(whole[i]) for i in use]
    right = [np.frombuffer(present[i], np.uint8).copy() for i in use]
    for col in range(data):
        pivot = next(r for r in range(col, data) if left[r][col])
        left[col], left[pivot], right[col], right[pivot] = left[pivot], left[col], right[pivot], right[col]
        by = _inverse(left[col][col])
        left[col] = _scale(by, np.array(left[col], np.uint8)).tolist()
        right[col] = _scale(by, right[col])
        for r in range(data):
            if r != col and left[r][col]:
                f = left[r][col]
                left[r] = (np.array(left[r], np.uint8) ^ _scale(f, np.array(left[col], np.uint8))).tolist()
                right[r] = right[r] ^ _scale(f, right[col])
    return encode(b"".join(x.tobytes() for x in right), data, parity)


#: Bytes of rebuilt bodies that are handed on together.
PIECE = 4 << 20


def rebuilt(body: Column, lost: Column, data: int, parity: int) -> Column:
    """(body, chunk): bodies cut into stripes and rebuilt without the chunks of the listed indices; null body where too many are lost."""

    @F.pandas_udf("body binary, chunk long")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, indices in batches:
            rows, held = [], 0
            for b, gone in zip(bodies, indices, strict=True):
                block = bytes(b)
                chunks = encode(block, data, parity)
                present = {i: c for i, c in enumerate(chunks) if i not in set(map(int, gone))}
                whole = b"".join(rebuild(present, data, parity)[:data])[: len(block)] if len(present) >= data else None
                rows.append((whole, len(chunks[0])))
                held += len(block)
                if held >= PIECE:
                    yield pd.DataFrame(rows, columns=["body", "chunk"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["body", "chunk"])

    return of(body, lost)
