"""MD5 of whole columns of short strings, round by round over arrays."""

from __future__ import annotations

from hashlib import md5
from math import floor, sin

import numpy as np
import pyarrow as pa

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SUMS = [np.uint32(floor(2**32 * abs(sin(i + 1)))) for i in range(64)]
_STEPS = ((1, 0), (5, 1), (3, 5), (7, 0))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Strings that are hashed at once, so that the arrays stay in the cache; the longest that fits one block.
_AT_ONCE, _ONE_BLOCK = 8192, 55


def _rounds(w: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.full(w.shape[1], x, np.uint32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        r = i // 16
        if r == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif r == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif r == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        step, first = _STEPS[r]
        np.add(f, a, out=f)
        np.add(f, w[(step * i + first) % 16], out=f)
        np.add(f, _SUMS[i], out=f)
        s = _SHIFTS[r][i % 4]
        np.left_shift(f, np.uint32(s), out=g)
        np.right_shift(f, np.uint32(32 - s), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), _START)])


def md5_words(strings: pa.Array) -> np.ndarray:
    """The digests of strings that are not null as four rows of big-endian words: the first is what eight hexadecimal digits say."""
    n = len(strings)
    at = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8) if n and strings.buffers()[2] else np.empty(0, np.uint8)
    out = np.empty((4, n), np.uint32)
    for i in range(0, n, _AT_ONCE):
        part = at[i : i + _AT_ONCE + 1]
        size = np.diff(part)
        blocks = np.zeros((len(size), 64), np.uint8)
        one = size <= _ONE_BLOCK
        kept = np.where(one, size, 0)
        to = np.repeat(np.arange(len(size)) * 64 - part[:-1], size) + np.arange(part[0], part[-1])
        whole = data[part[0] : part[-1]]
        blocks.ravel()[to if one.all() else to[np.repeat(one, size)]] = whole if one.all() else whole[np.repeat(one, size)]
        blocks[np.arange(len(size)), kept] = 0x80
        words = blocks.view("<u4")
        words[:, 14] = kept * 8
        out[:, i : i + len(size)] = _rounds(np.ascontiguousarray(words.T).astype(np.uint32, copy=False)).byteswap()
        for j in np.flatnonzero(~one).tolist():
            out[:, i + j] = np.frombuffer(md5(data[part[j] : part[j + 1]].tobytes(), usedforsecurity=False).digest(), ">u4")
    return out
