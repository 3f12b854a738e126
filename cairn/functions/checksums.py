"""Checksums that Spark has no function for, over Arrow batches, and the combination of CRCs without their data."""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reflected polynomials and widths of the CRCs.
POLYNOMIALS = {"crc32": (0xEDB88320, 32), "crc32c": (0x82F63B78, 32), "crc64nvme": (0x9A6C9329AC4BC9B5, 64)}


@functools.cache
def _table(polynomial: int) -> np.ndarray:
    row = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        row = np.where(row & np.uint64(1), (row >> np.uint64(1)) ^ np.uint64(polynomial), row >> np.uint64(1))
    return row


#: Bytes of a body that advance one after the other; a longer body is cut, and its pieces advance beside one another.
LANE = 512


def crcs(kind: str, bodies: list[bytes]) -> np.ndarray:
    """The CRC of each body, all pieces of bodies advancing together by one byte a step."""
    if kind == "crc32":
        return np.array([zlib.crc32(b) for b in bodies], np.uint64)
    polynomial, width = POLYNOMIALS[kind]
    table, ones = _table(polynomial), np.uint64((1 << width) - 1)
    whole = np.array([len(b) for b in bodies], np.int64)
    lanes = np.maximum(-(-whole // LANE), 1)
    first = np.concatenate([[0], np.cumsum(lanes)[:-1]]).astype(np.int64) if len(bodies) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(bodies)), lanes)
    before = (np.arange(len(owner)) - first[owner]) * LANE  # bytes of the body before a piece
    sizes = np.minimum(whole[owner] - before, LANE)
    starts = (np.cumsum(whole) - whole)[owner] + before
    state = np.where(before == 0, ones, np.uint64(0))
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(bodies), np.uint8)
    ordered, at, moving = sizes[order], starts[order], state[order]
    m = len(order)
    for t in range(int(ordered[0]) if m else 0):
        while m and ordered[m - 1] <= t:
            m -= 1
        s = moving[:m]
        moving[:m] = table[((s ^ data[at[:m] + t]) & np.uint64(0xFF)).astype(np.int64)] ^ (s >> np.uint64(8))
    state[order] = moving
    if len(owner) > len(bodies):
        state = np.bitwise_xor.reduceat(moved(kind, state, whole[owner] - before - sizes), first)
    return state ^ ones


def _times(columns: list[int], x: int) -> int:
    got = 0
    for k, c in enumerate(columns):
        if x >> k & 1:
            got ^= c
    return got


@functools.cache
def _step(kind: str, k: int) -> list[int]:
    """2^k zero bits, as a matrix over GF(2)."""
    polynomial, width = POLYNOMIALS[kind]
    if not k:
        return [polynomial] + [1 << i for i in range(width - 1)]
    half = _step(kind, k - 1)
    return [_times(half, c) for c in half]


@functools.cache
def _step_bytes(kind: str, k: int) -> np.ndarray:
    """What 2^k zero bytes make of each value of each byte of a CRC."""
    columns = np.array(_step(kind, k + 3), np.uint64).reshape(-1, 8)
    values = np.arange(256)
    out = np.zeros((len(columns), 256), np.uint64)
    for bit in range(8):
        out ^= np.where(values >> bit & 1 > 0, columns[:, bit : bit + 1], np.uint64(0))
    return out


def moved(kind: str, states: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRCs moved on by numbers of zero bytes, all of them together by the bits of the numbers."""
    states, k = states.copy(), 0
    while len(sizes) and (left := sizes >> k).any():
        odd = np.flatnonzero(left & 1)
        s, got = states[odd], np.zeros(len(odd), np.uint64)
        for i, row in enumerate(_step_bytes(kind, k)):
            got ^= row[(s >> np.uint64(8 * i) & np.uint64(0xFF)).astype(np.int64)]
        states[odd] = got
        k += 1
    return states


def combine(kind: str, a: int, b: int, size_b: int) -> int:
    """The CRC of two bodies one after the other, from their CRCs and the second's size: a moves on by size_b zero bytes."""
    n, k = 8 * size_b, 0
    while n >> k:
        if n >> k & 1:
            a = _times(_step(kind, k), a)
        k += 1
    return a ^ b


def crc(kind: str, body: Column) -> Column:
    """Hexadecimal digits of a CRC of a text's UTF-8 bytes."""
    digits = POLYNOMIALS[kind][1] // 4

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{int(x):0{digits}x}" for x in crcs(kind, [(t or "").encode() for t in texts])])

    return of(body)


def xxh(kind: str, body: Column) -> Column:
    """XXH64 (seed 0), XXH3-64 or XXH3-128 of a text's UTF-8 bytes, as hexadecimal digits."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        f = {"xxh64": xxhash.xxh64_hexdigest, "xxh3_64": xxhash.xxh3_64_hexdigest, "xxh3_128": xxhash.xxh3_128_hexdigest}[kind]
        return pd.Series([f((t or "").encode()) for t in texts])

    return of(body)


#: The names of checksums as requests give them, and ours.
ALGORITHMS = {"CRC32": "crc32", "CRC32C": "crc32c", "CRC64NVME": "crc64nvme", "SHA1": "sha1", "SHA256": "sha256", "SHA512": "sha512", "MD5": "md5", "XXHASH64": "xxh64", "XXHASH3": "xxh3_64", "XXHASH128": "xxh3_128"}


def digest(algorithm: Column, body: Column, only: list[str] | None = None) -> Column:
    """The hexadecimal digest of a body by the algorithm that a row names, in any case; null for an unknown one. With ``only`` no other is computed."""
    built = {"sha1": lambda: F.sha1(body), "sha256": lambda: F.sha2(body, 256), "sha512": lambda: F.sha2(body, 512), "md5": lambda: F.md5(body), "crc32": lambda: F.lpad(F.lower(F.hex(F.crc32(body))), 8, "0")}
    out = F.lit(None).cast("string")
    for name, ours in ALGORITHMS.items():
        if only is None or name in only:
            of = built[ours]() if ours in built else crc(ours, body) if ours in POLYNOMIALS else xxh(ours, body)
            out = F.when(F.upper(algorithm) == name, of).otherwise(out)
    return out


def joined(kind: str, first: Column, second: Column, size: Column) -> Column:
    """The CRC of two bodies one after the other, from their CRCs (hexadecimal) and the second's size."""
    digits = POLYNOMIALS[kind][1] // 4

    @F.pandas_udf("string")
    def of(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        first, second = (np.array([int(x, 16) for x in xs], np.uint64) for xs in (a, b))
        return pd.Series([f"{x:0{digits}x}" for x in (moved(kind, first, n.to_numpy(np.int64)) ^ second).tolist()])

    return of(first, second, size)


def fed(parts: Column) -> Column:
    """The SHA-256 of an array of bodies, fed to one hasher piece by piece."""

    @F.pandas_udf("string")
    def of(groups: pd.Series) -> pd.Series:
        def one(group) -> str:
            hasher = hashlib.sha256()
            for body in group:
                hasher.update(body.encode())
            return hasher.hexdigest()

        return groups.map(one)

    return of(parts)


def full_object(kind: str, parts: Column) -> Column:
    """The checksum of an object from its parts' (number, hexadecimal CRC, size), in order."""
    digits = POLYNOMIALS[kind][1] // 4

    @F.pandas_udf("string")
    def of(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            total = 0
            for _, value, size in sorted((p["part"], p["crc"], p["size"]) for p in group):
                total = combine(kind, total, int(value, 16), size)
            out.append(f"{total:0{digits}x}")
        return pd.Series(out)

    return of(parts)


def etag(parts: Column) -> Column:
    """A multipart ETag from an array of (part, md5 hexadecimal): md5 of the digests' bytes in order, and their count."""
    digests = F.array_join(F.transform(F.array_sort(parts), lambda p: p["md5"]), "")
    return F.concat(F.md5(F.unhex(digests)), F.lit("-"), F.size(parts).cast("string"))


def composite_sha256(parts: Column) -> Column:
    """base64 of the SHA-256 of the parts' digests in order, and their count."""
    digests = F.array_join(F.transform(F.array_sort(parts), lambda p: p["sha"]), "")
    return F.concat(F.base64(F.unhex(F.sha2(F.unhex(digests), 256))), F.lit("-"), F.size(parts).cast("string"))


def base64_of_hex(digits: str) -> str:
    return base64.b64encode(bytes.fromhex(digits)).decode()
