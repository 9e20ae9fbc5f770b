"""MD5 of many short keys at once, in numpy."""

from __future__ import annotations

import math

import numpy as np

_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [np.uint32(((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4]) for i in range(64)]
_WORD_AT = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_BACK = [np.uint32(32 - int(x)) for x in _TURNS]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Keys that are hashed at once: the arrays of a round stay in a core's cache.
_AT_ONCE = 1 << 14
#: The digits of 0 to 9999 and the byte that ends a message, as they are and then filled up to four digits; how many digits.
_TAILS = np.array([int.from_bytes(f"{i:{w}d}".encode() + b"\x80", "little") for w in ("", "04") for i in range(10000)], np.uint64)
_TAIL_SIZES = np.array([len(str(i)) for i in range(10000)] + [4] * 10000, np.uint32)


def md5_first(words: np.ndarray) -> np.ndarray:
    """The first word of the MD5 of many messages of one block, as big-endian numbers. words: a row for each of a block's words, up to
    the last that isn't 0 in all messages, then their lengths in bits."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, x) for x in _START)
    t = np.empty(n, np.uint32)
    rows = {**dict(enumerate(words[:-1])), 14: words[-1]}
    for i in range(61):  # the last three steps don't change what is asked for
        if i < 16:
            np.bitwise_and(np.bitwise_xor(c, d, out=t), b, out=t)
            t ^= d
        elif i < 32:
            np.bitwise_and(np.bitwise_xor(b, c, out=t), d, out=t)
            t ^= c
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=t), d, out=t)
        else:
            np.bitwise_or(np.invert(d, out=t), b, out=t)
            t ^= c
        a += t
        if (row := rows.get(_WORD_AT[i])) is not None:
            a += row
        a += _SINES[i]
        np.left_shift(a, _TURNS[i], out=t)
        a >>= _BACK[i]
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    b += _START[0]
    return b.byteswap()


def md5_heads(prefixes: list[bytes], which: np.ndarray, number: np.ndarray) -> np.ndarray:
    """What T.hashed() gives for prefixes[which] followed by a number in digits, for many at once; such a key fits MD5's one block.

    All but a number's last four digits count to its prefix; rows of one prefix in a row share its words."""
    out = np.empty(len(which), np.uint32)
    for lo in range(0, len(which), _AT_ONCE):
        whose, high = which[lo : lo + _AT_ONCE], number[lo : lo + _AT_ONCE] // 10000
        first = np.append(0, np.flatnonzero((whose[1:] != whose[:-1]) | (high[1:] != high[:-1])) + 1)
        tails = number[lo : lo + _AT_ONCE] - 10000 * high + 10000 * (high > 0)
        heads = [prefixes[w] + (b"%d" % h if h else b"") for w, h in zip(whose[first].tolist(), high[first].tolist(), strict=True)]
        length = np.array([len(h) for h in heads], np.int64)
        width = int(length.max()) // 4 + 2
        run = np.diff(np.append(first, len(whose)))
        words = np.empty((width + 1, len(whose)), np.uint32)
        table = np.frombuffer(b"".join(h.ljust(4 * width, b"\0") for h in heads), "<u4").reshape(-1, width).T
        words[:width] = np.repeat(table, run, axis=1)
        words[width] = 8 * (np.repeat(length, run).astype(np.uint32) + _TAIL_SIZES[tails])
        sizes = np.unique(length)
        for size in sizes.tolist():
            mine = slice(None) if len(sizes) == 1 else np.flatnonzero(np.repeat(length == size, run))
            tail = _TAILS[tails[mine]] << np.uint64(8 * (size % 4))
            words[size // 4, mine] |= tail.astype(np.uint32)
            words[size // 4 + 1, mine] |= (tail >> np.uint64(32)).astype(np.uint32)
        out[lo : lo + _AT_ONCE] = md5_first(words)
    return out.astype(np.int64)
