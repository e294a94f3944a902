"""Byte codecs of integer columns: LEB128 varints, signed ones by zigzag."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encode_varints(values: np.ndarray) -> bytes:
    """Unsigned LEB128 bytes of integers, one after another; a negative one is a ValueError."""
    x = np.asarray(values, np.int64)
    if (x < 0).any():
        raise ValueError("varint of a negative integer")
    return _encode(x.view(np.uint64))


def _encode(x: np.ndarray) -> bytes:
    size = np.ones(len(x), np.int64)
    for n in range(1, 10):
        size += x >= np.uint64(1) << np.uint64(7 * n)
    out = np.zeros(int(size.sum()), np.uint8)
    first = np.cumsum(size) - size
    for n in range(int(size.max(initial=0))):
        has = np.nonzero(size > n)[0]
        seven = (x[has] >> np.uint64(7 * n)) & np.uint64(127)
        out[first[has] + n] = seven | (np.uint64(128) * (size[has] > n + 1).astype(np.uint64))
    return out.tobytes()


def decode_varints(data: bytes, count: int) -> np.ndarray:
    """The ``count`` integers of ``encode_varints``; bytes that are cut short, left over or too long are a ValueError."""
    return _decode(data, count).view(np.int64)


def _decode(data: bytes, count: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.nonzero(b < 128)[0]
    if len(b) and (not len(ends) or ends[-1] != len(b) - 1):
        raise ValueError("varints are cut short")
    if len(ends) != count:
        raise ValueError(f"{len(ends)} varints in place of {count}")
    first = np.concatenate([[0], ends[:-1] + 1]) if count else ends
    size = ends - first + 1
    if size.max(initial=0) > 10:
        raise ValueError("a varint is too long")
    out = np.zeros(count, np.uint64)
    for n in range(int(size.max(initial=0))):
        has = np.nonzero(size > n)[0]
        out[has] |= (b[first[has] + n] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * n)
    return out


def encode_signed(values: np.ndarray) -> bytes:
    """Varints of zigzag codes, for integers of either sign."""
    x = np.asarray(values, np.int64)
    return _encode(((x << 1) ^ (x >> 63)).view(np.uint64))


def decode_signed(data: bytes, count: int) -> np.ndarray:
    u = _decode(data, count)
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)


@F.pandas_udf(T.BinaryType())
def varint_bytes(values: pd.Series, signed: pd.Series) -> pd.Series:
    """Bytes of each array of integers; null stays null."""
    return pd.Series([None if x is None else (encode_signed if s else encode_varints)(x) for x, s in zip(values, signed, strict=True)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def varint_longs(data: pd.Series, count: pd.Series, signed: pd.Series) -> pd.Series:
    """The integers of ``varint_bytes``."""
    return pd.Series([None if x is None else (decode_signed if s else decode_varints)(x, int(n)) for x, n, s in zip(data, count, signed, strict=True)])
