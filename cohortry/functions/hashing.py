"""Hash-based randomness: the same value in Spark and in any SQL engine with md5."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 15
HASH_BITS = 4 * HEX_DIGITS


def stable_hash(*parts: Column | str | int) -> Column:
    """A 60-bit number from the parts joined by ``:``.

    Strings name columns; integers are literals such as a seed. The value depends
    on the parts alone, never on partitioning or row order.
    """
    columns = [F.lit(part) if isinstance(part, int) else F.col(part) if isinstance(part, str) else part
               for part in parts]
    text = F.concat_ws(":", *[column.cast("string") for column in columns])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("bigint")


def hash_cell(hashed: Column, cells: int) -> Column:
    """Order-preserving coarse cell of a stable hash; hashes spread evenly over cells."""
    bits = max(1, (cells - 1).bit_length())
    return F.shiftright(hashed, HASH_BITS - bits)


def stable_hashes(prefix: str, start: int, stop: int) -> np.ndarray:
    """``stable_hash`` of ``prefix:n`` for n from start to stop - 1, a block of numbers at a time."""
    out = np.empty(stop - start, np.uint64)
    at = start
    while at < stop:
        # numbers of a block have the same digits, so their texts differ in these places only
        upto = min(stop, at + BLOCK, 10 ** len(str(at)))
        out[at - start : upto - start] = _hashed_block(f"{prefix}:".encode(), at, upto)
        at = upto
    return out


BLOCK = 16_384
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _hashed_block(head: bytes, start: int, stop: int) -> np.ndarray:
    digits, length = len(str(start)), len(head) + len(str(start))
    if length > 55:  # more than one block of MD5
        tails = [hashlib.md5(head + str(n).encode()).hexdigest()[:HEX_DIGITS] for n in range(start, stop)]
        return np.array([int(t, 16) for t in tails], np.uint64)
    text = np.zeros((stop - start, 64), np.uint8)
    text[:, : len(head)] = np.frombuffer(head, np.uint8)
    left = np.arange(start, stop, dtype=np.uint64)
    for place in range(length - 1, len(head) - 1, -1):
        left, text[:, place] = left // 10, left % 10 + 48
    text[:, length] = 0x80
    text[:, 56:58] = (8 * length % 256, 8 * length // 256)
    columns = text.view("<u4")
    varied = range(len(head) // 4, (length - 1) // 4 + 1)
    words = [np.ascontiguousarray(columns[:, g]) if g in varied else int(columns[0, g]) for g in range(16)]
    first, second = _md5_head(words, stop - start)
    # the first 15 of 32 hexadecimal digits
    return (first.byteswap().astype(np.uint64) << np.uint64(28)) | (second.byteswap().astype(np.uint64) >> np.uint64(4))


def _md5_head(words: list[np.ndarray | int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """First two of four state words after one block of MD5, for n texts at once."""
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            t = np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=t), b, out=t), d, out=t)
        elif i < 32:
            g = (5 * i + 1) % 16
            t = np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=t), d, out=t), c, out=t)
        elif i < 48:
            g = (3 * i + 5) % 16
            t = np.bitwise_xor(np.bitwise_xor(b, c, out=t), d, out=t)
        else:
            g = 7 * i % 16
            t = np.bitwise_xor(np.bitwise_or(np.bitwise_not(d, out=t), b, out=t), c, out=t)
        t += a
        if isinstance(words[g], int):
            t += np.uint32((_SINES[i] + words[g]) % 2**32)
        else:
            t += words[g]
            t += np.uint32(_SINES[i])
        np.left_shift(t, np.uint32(_TURNS[i]), out=u)
        np.right_shift(t, np.uint32(32 - _TURNS[i]), out=t)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])
