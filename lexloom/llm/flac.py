"""FLAC streams of 8-bit mono samples, encoded and decoded many frames at a time.

The frames of a batch are rows of a matrix. The seek table of each stream says where its
frames begin, or a search for headers where a table has not all of them, so Rice codes of all
frames are read in lockstep: step t reads the t-th residual of every frame. Predictors are undone
by cumulative sums (fixed) or a step for each sample of all frames (quantised linear prediction),
and both checksums of every frame and the MD5 of every stream are verified.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_batches, spread, stored, table, text_bytes

BLOCK = 512
UNIT = 64
RATE = 8000
#: Samples encoded or decoded in one go.
GROUP = 1 << 20
MOST_ORDER = 4
#: Order of the encoder's linear predictors and bits of their coefficients.
LPC_ORDER, PRECISION = 4, 8


def _table(poly: int, width: int, bits: int) -> np.ndarray:
    """What a CRC register becomes when ``bits`` bits are shifted through it."""
    out = np.arange(1 << bits, dtype=np.uint32) << (width - bits)
    for _ in range(bits):
        out = ((out << 1) ^ np.where(out >> (width - 1) & 1, poly, 0)) & ((1 << width) - 1)
    return out


_CRC8, _CRC16 = _table(0x07, 8, 8), _table(0x8005, 16, 16)


def _right(body: np.ndarray, start: np.ndarray, length: np.ndarray, multiple: int = 2) -> np.ndarray:
    """Slices of ``body`` as rows, right-aligned behind zeros; leading zeros leave a CRC from 0 alone."""
    width = -(-int(length.max()) // multiple) * multiple
    out = np.zeros((len(start), width), np.uint8)
    inner = spread(length)
    out[np.repeat(np.arange(len(start)), length), inner + np.repeat(width - length, length)] = body[np.repeat(start, length) + inner]
    return out


def crc8(rows: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint32)
    for column in rows.T:
        crc = _CRC8[crc ^ column]
    return crc


def crc16(rows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows.view(">u2").T).astype(np.uint32)
    crc = np.zeros(len(rows), np.uint32)
    for column in words:
        crc = _CRC16[crc ^ column]
    return crc


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= (1 << (6 - len(tail))):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *tail[::-1]])


def _header(number: int, n: int) -> bytes:
    if n & (n - 1) == 0 and 256 <= n <= 32768:
        return b"\xff\xf8" + bytes([(n.bit_length() - 1) << 4 | 4, 0x02]) + _number(number)
    return b"\xff\xf8" + bytes([0x74, 0x02]) + _number(number) + (n - 1).to_bytes(2, "big")


def _predictors(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients, the newest sample's first, and shifts, for each row of samples.

    Autocorrelations are sums of whole numbers and the rest goes element by element, so a frame has
    the same predictor in whichever batch it stands.
    """
    sizes, own = np.unique(n, return_inverse=True)
    block = x.shape[1]
    t, sizes = np.arange(block), sizes[:, None]
    window = np.maximum(0, 256 * (t + 1) * (sizes - t) // (sizes + 1) ** 2).astype(np.float64)
    w = x * window[own]
    lags = [np.einsum("ij,ij->i", w[:, i:], w[:, : block - i]) for i in range(LPC_ORDER + 1)]
    error, a = lags[0] * (1 + 2.0**-20) + 1, []
    for i in range(LPC_ORDER):
        rest = lags[i + 1].copy()
        for j in range(i):
            rest -= a[j] * lags[i - j]
        k = rest / error
        a = [a[j] - k * a[i - 1 - j] for j in range(i)] + [k]
        error = np.maximum(error * (1 - k * k), 1)
    a = np.stack(a, axis=1)
    shift = np.clip(PRECISION - 1 - np.frexp(np.abs(a).max(axis=1))[1], 0, 15).astype(np.int64)
    top = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * 2.0 ** shift[:, None]), -top, top - 1).astype(np.int32), shift


def _rice(r: np.ndarray, coded: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(residuals folded to positive numbers, the best of three parameters, bits of the codes) of each row."""
    u = np.where(coded, (r << 1) ^ (r >> 31), 0)
    mean = u.sum(axis=1) / np.maximum(1, count)
    guess = np.frexp(np.maximum(1, mean * 0.7))[1].astype(np.int64) - 1
    best, k = None, guess
    for change in (-1, 0, 1):
        kk = np.clip(guess + change, 0, 14)
        bits = (u >> kk[:, None].astype(np.int32)).sum(axis=1) + count * (kk + 1)
        if best is None:
            best, k = bits, kk
        else:
            k, best = np.where(bits < best, kk, k), np.minimum(bits, best)
    return u, k, best


def encode_frames(x: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all frames, int64 offsets). ``x``: int16 rows of signed samples, ``n`` of them used.

    Each frame takes the smallest of its forms: constant, verbatim, fixed or linear prediction.
    """
    rows, block = x.shape
    used = np.arange(block) < n[:, None]
    residual, cost = [x], [np.where(used, np.abs(x), 0)[:, MOST_ORDER:].sum(axis=1, dtype=np.int64)]
    for _ in range(MOST_ORDER):
        d = residual[-1].copy()
        d[:, 1:] -= residual[-1][:, :-1]
        residual.append(d)
        cost.append(np.where(used, np.abs(d), 0)[:, MOST_ORDER:].sum(axis=1, dtype=np.int64))
    order = np.argmin(np.stack(cost), axis=0)
    fixed = np.choose(order[:, None], residual).astype(np.int32)
    u, k, bits = _rice(fixed, used & (np.arange(block) >= order[:, None]), n - order)
    sub = 8 + 8 * order + 10 + bits
    weight, shift = _predictors(x, n)
    wide = x.astype(np.int32)
    guess = sum(weight[:, j, None] * wide[:, LPC_ORDER - 1 - j : block - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None].astype(np.int32)
    wide[:, LPC_ORDER:] -= guess
    lpc_u, lpc_k, lpc_bits = _rice(wide, used & (np.arange(block) >= LPC_ORDER), n - LPC_ORDER)
    weights = 9 + PRECISION * LPC_ORDER
    lpc_sub = 8 + 8 * LPC_ORDER + weights + 10 + lpc_bits
    lpc = (n > LPC_ORDER) & (lpc_sub < sub)
    u, k, sub, order = np.where(lpc[:, None], lpc_u, u), np.where(lpc, lpc_k, k), np.where(lpc, lpc_sub, sub), np.where(lpc, LPC_ORDER, order)
    coded = used & (np.arange(block) >= order[:, None])
    held = np.where(used, x, x[:, :1])
    constant = held.max(axis=1) == held.min(axis=1)
    verbatim = ~constant & (sub > 8 + 8 * n)
    sub = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, sub))
    heads = [_header(a, b) for a, b in zip(number.tolist(), n.tolist(), strict=True)]
    head = np.fromiter(map(len, heads), np.int64, rows)
    size = head + 1 + -(-sub // 8) + 2
    offsets = np.concatenate(([0], np.cumsum(size)))
    begin = (offsets[:-1] + head + 1) * 8
    bits = np.zeros(int(offsets[-1]) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[at + j] = value >> (width - 1 - j) & 1

    rice = ~constant & ~verbatim
    lpc &= rice
    put(begin, np.where(constant, 0, np.where(verbatim, 2, np.where(lpc, 31 + order, 8 + order) << 1)), 8)
    put(begin[constant] + 8, x[constant, 0] & 0xFF, 8)
    if verbatim.any():
        plain = used & verbatim[:, None]
        at = np.where(plain, 8 * np.arange(block) + 8 + begin[:, None], 0)[plain]
        put(at, x[plain] & 0xFF, 8)
    for p in range(LPC_ORDER):
        warm = rice & (order > p)
        put(begin[warm] + 8 + 8 * p, x[warm, p] & 0xFF, 8)
    after = begin + 8 + 8 * order
    put(after[lpc], (PRECISION - 1) << 5 | shift[lpc], 9)
    for p in range(LPC_ORDER):
        put(after[lpc] + 9 + PRECISION * p, weight[lpc, p], PRECISION)
    after += np.where(lpc, weights, 0)
    put(after[rice], k[rice], 10)
    coded &= rice[:, None]
    flat, kk = u[coded], np.repeat(k, coded.sum(axis=1))
    q = flat >> kk
    size_of = q + 1 + kk
    count = coded.sum(axis=1)
    end = np.cumsum(size_of)
    row_first = np.concatenate(([0], np.cumsum(count)))[:-1]
    before = np.concatenate(([0], end))[row_first]
    stop = end - size_of + np.repeat(after + 10 - before, count) + q
    bits[stop] = 1
    for j in range(int(k.max(initial=0))):
        deep = kk > j
        bits[(stop + 1 + j)[deep]] = (flat[deep] >> (kk[deep] - 1 - j)) & 1
    out = np.packbits(bits)
    flat_heads = np.frombuffer(b"".join(heads), np.uint8)
    out[np.repeat(offsets[:-1], head) + spread(head)] = flat_heads
    out[offsets[:-1] + head] = crc8(_right(flat_heads, np.cumsum(head) - head, head, 1))
    crc = crc16(_right(out, offsets[:-1], size - 2))
    out[offsets[1:] - 2], out[offsets[1:] - 1] = crc >> 8, crc & 0xFF
    return out, offsets


def encode(body: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload, in frames of ``block`` samples (16 to 32768); each holds a positive number of samples."""
    size = np.diff(offsets)
    frames = -(-size // block)
    owner, number = np.repeat(np.arange(len(size)), frames), spread(frames)
    start = offsets[:-1][owner] + number * block
    n = np.minimum(block, offsets[1:][owner] - start)
    parts, lengths = [], []
    group = max(1, GROUP // block)
    for a in range(0, len(owner), group):
        s, m = start[a : a + group], n[a : a + group]
        at = np.minimum(s[:, None] + np.arange(block), (s + m - 1)[:, None])
        out, ends = encode_frames(body[at].astype(np.int16) - 128, m, number[a : a + group])
        parts.append(out)
        lengths.append(np.diff(ends))
    coded, length = np.concatenate(parts), np.concatenate(lengths)
    ends = np.concatenate(([0], np.cumsum(length)))
    first = np.concatenate(([0], np.cumsum(frames)))
    streams = []
    for i in range(len(size)):
        a, b = first[i], first[i + 1]
        own = length[a:b]
        table_ = np.zeros(b - a, _POINT)
        table_["sample"], table_["offset"], table_["n"] = number[a:b] * block, ends[a:b] - ends[a], n[a:b]
        digest = hashlib.md5((body[offsets[i] : offsets[i + 1]] ^ 0x80).tobytes()).digest()
        info = block.to_bytes(2, "big") * 2 + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | int(size[i])).to_bytes(8, "big") + digest
        streams.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + (18 * int(b - a)).to_bytes(3, "big") + table_.tobytes() + coded[ends[a] : ends[b]].tobytes())
    return streams


_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])


def _frames(blob: bytes, at: int, samples: int) -> np.ndarray:
    """Seek points of all frames from ``at`` on: headers with the next number and a right checksum, each behind a whole frame."""
    body = np.frombuffer(blob, np.uint8)
    places = np.flatnonzero((body[at:-1] == 0xFF) & (body[at + 1 :] == 0xF8)) + at
    begins: list[int] = []
    size: list[int] = []
    for p in places.tolist():
        head = _head(np.concatenate((body[p : p + 16], np.zeros(16, np.uint8))), np.zeros(1, np.int64))
        length = int(head[0][0])
        if int(head[1][0]) != len(begins) or p + length >= len(body) or crc8(body[None, p : p + length + 1])[0]:
            continue
        if begins and crc16(_right(body, np.array(begins[-1:]), np.array([p - begins[-1]])))[0]:
            continue
        begins.append(p)
        size.append(int(head[2][0]))
    out = np.zeros(len(begins), _POINT)
    out["sample"], out["offset"], out["n"] = np.cumsum(size) - size, np.array(begins, np.int64) - at, size
    if sum(size) != samples:
        raise ValueError("frames do not make up their stream")
    return out


def _streams(media: list[bytes]) -> list[tuple[int, bytes, np.ndarray, int]]:
    """(samples, MD5, seek points of all frames, where frames begin) of each stream."""
    out = []
    for blob in media:
        if blob[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, points, samples, digest = 4, False, None, 0, b""
        while not last:
            kind, size = blob[at] & 0x7F, int.from_bytes(blob[at + 1 : at + 4], "big")
            last, content, at = blob[at] >> 7, blob[at + 4 : at + 4 + size], at + 4 + size
            if kind == 0:
                word = int.from_bytes(content[10:18], "big")
                if word >> 41 & 7 or (word >> 36 & 31) != 7:
                    raise ValueError("only 8-bit mono streams are read")
                samples, digest = word & (1 << 36) - 1, content[18:34]
            elif kind == 3:
                points = np.frombuffer(content, _POINT)
        if points is None or samples != points["n"].sum(dtype=np.int64) or (points["sample"] != np.cumsum(points["n"], dtype=np.int64) - points["n"]).any():
            points = _frames(blob, at, samples)
        out.append((samples, digest, points, at))
    return out


def _head(body: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the header before its checksum, frame number, samples) of the frames at ``start``."""
    lead = body[start + 4]
    tail = np.where(lead < 0x80, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, np.where(lead < 0xFC, 4, 5)))))
    number = np.where(tail == 0, lead, lead & (0x3F >> tail)).astype(np.int64)
    for j in range(int(tail.max())):
        more = tail > j
        number[more] = number[more] << 6 | body[start[more] + 5 + j] & 0x3F
    code, rate = (body[start + 2] >> 4).astype(np.int64), body[start + 2] & 15
    extra = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    samples = np.where(code >= 8, 256 << np.maximum(0, code - 8), np.where(code >= 2, 576 << np.clip(code - 2, 0, 3), np.where(code == 1, 192, 0)))
    for wide in (1, 2):
        own = extra == wide
        samples[own] = 1 + sum(body[start[own] + 5 + tail[own] + j].astype(np.int64) << (8 * (wide - 1 - j)) for j in range(wide))
    return 5 + tail + extra + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0)), number, samples


def decode_frames(body: np.ndarray, start: np.ndarray, length: np.ndarray, n: np.ndarray, number: np.ndarray) -> np.ndarray:
    """int32 rows of samples; raises where a header, checksum or code is wrong."""
    rows = np.arange(len(start))
    if crc16(_right(body, start, length)).any():
        raise ValueError("a frame checksum is wrong")
    head, got, samples = _head(body, start)
    if (body[start] != 0xFF).any() or (body[start + 1] != 0xF8).any() or (body[start + 3] & 0xFD).any() or (got != number).any() or (samples != n).any():
        raise ValueError("a frame header does not agree with the seek table")
    if crc8(_right(body, start, head + 1, 1)).any():
        raise ValueError("a header checksum is wrong")
    room = np.concatenate((body, np.zeros(16, np.uint8)))
    window = np.zeros(len(body) + 8, np.uint64)
    for j in range(8):
        window |= room[j : j + len(window)].astype(np.uint64) << np.uint64(56 - 8 * j)
    read = lambda pos: window[pos >> 3] << (pos & 7).astype(np.uint64)
    field = lambda pos, width: (read(pos) >> np.uint64(64 - width)).astype(np.int64)
    pos = (start + head + 1) * 8
    kind = field(pos, 8)
    if (kind & 1).any():
        raise ValueError("wasted bits are not read")
    kind, pos = kind >> 1, pos + 8
    width = int(n.max())
    out = np.zeros((len(start), width), np.int32)
    sign = lambda v, bits: (v ^ (1 << (bits - 1))) - (1 << (bits - 1))
    lpc = kind >= 32
    fixed = (kind >= 8) & (kind <= 12)
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, 0))
    if (~lpc & ~fixed & (kind > 1)).any():
        raise ValueError("a reserved kind of subframe")
    out[kind == 0] = sign(field(pos[kind == 0], 8), 8)[:, None]
    if (plain := kind == 1).any():
        at = pos[plain, None] + 8 * np.arange(width)
        inside = np.arange(width) < n[plain, None]
        out[plain] = np.where(inside, sign(field(np.where(inside, at, 0), 8), 8), 0)
    for p in range(int(order.max(initial=0))):
        warm = order > p
        out[warm, p] = sign(field(pos[warm] + 8 * p, 8), 8)
    pos = pos + 8 * order
    linear = rows[lpc]
    reach = int(order[lpc].max(initial=0))
    weight = np.zeros((reach, len(linear)), np.int64)
    precision, shift = field(pos[lpc], 4) + 1, sign(field(pos[lpc] + 4, 5), 5)
    if (shift < 0).any():
        raise ValueError("a negative shift")
    for j in range(reach):
        own = order[lpc] > j
        width_of = precision[own]
        value = (read(pos[linear[own]] + 9 + width_of * j) >> (64 - width_of).astype(np.uint64)).astype(np.int64)
        weight[reach - 1 - j, own] = (value ^ (1 << (width_of - 1))) - (1 << (width_of - 1))
    pos[lpc] += 9 + precision * order[lpc]
    coded = rows[lpc | fixed]
    p, m, left = pos[coded], n[coded], order[coded]
    method, parts = field(p, 2), field(p + 2, 4)
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    p, param = p + 6, 4 + method
    part = m >> parts
    k, plain = np.zeros(len(coded), np.uint64), np.full(len(coded), -1, np.int64)
    codes = np.zeros((width, len(coded)), np.int64)
    one = np.uint64(1)
    for t in range(width):
        live = (t >= left) & (t < m)
        fresh = live & ((t == left) | (t % part == 0))
        if fresh.any():
            own = np.flatnonzero(fresh)
            value = (read(p[own]) >> (64 - param[own]).astype(np.uint64)).astype(np.int64)
            k[own], p[own], plain[own] = value.astype(np.uint64), p[own] + param[own], -1
            if len(own := own[value == (1 << param[own]) - 1]):  # an escape: residuals of so many bits follow as they are
                plain[own], k[own], p[own] = field(p[own], 5), 0, p[own] + 5
        w = read(p)
        top = (w >> np.uint64(32)).astype(np.float64)
        q = 32 - np.frexp(top)[1].astype(np.int64)
        as_is = live & (plain >= 0)
        if (long := live & (top == 0) & ~as_is).any():
            for i in np.flatnonzero(long).tolist():  # a quotient of 32 or more
                at = int(p[i]) + 32
                while not int(read(np.array([at]))[0]) >> 63:
                    at += 1
                q[i] = at - p[i]
        p2 = p + q + 1
        low = np.where(q + k.astype(np.int64) < 56, (w << np.minimum(q + 1, 63).astype(np.uint64)), read(np.minimum(p2, 8 * len(body)))) >> one >> (np.uint64(63) - k)
        codes[t] = np.where(live, q << k.astype(np.int64) | low.astype(np.int64), 0)
        if as_is.any():
            size = plain[as_is]
            value = np.where(size == 0, 0, (w[as_is] >> (64 - np.maximum(1, size)).astype(np.uint64)).astype(np.int64))
            value = np.where(size == 0, 0, (value ^ (1 << np.maximum(0, size - 1))) - (1 << np.maximum(0, size - 1)))
            codes[t, as_is] = (value << 1) ^ (value >> 63)
        p = np.where(as_is, p + plain, np.where(live, p2 + k.astype(np.int64), p))
    if (-(-p // 8) != start[coded] + length[coded] - 2).any():
        raise ValueError("residuals do not end where the frame does")
    residual = ((codes >> 1) ^ -(codes & 1)).T.astype(np.int32)
    t = np.arange(width)
    out[coded] = np.where(t < left[:, None], out[coded], residual)
    for o in range(1, 5):
        own = rows[fixed & (order == o)]
        if len(own):
            a = out[own]
            begin = [sum((-1) ** i * comb(j, i) * a[:, j - i] for i in range(j + 1)) for j in range(o)]
            for j in range(o - 1, -1, -1):
                a[:, j] = begin[j]
                a[:, j:] = np.cumsum(a[:, j:], axis=1)
            out[own] = a
    if reach:
        x = np.zeros((reach + width, len(linear)), np.int32)
        x[reach:] = out[linear].T
        first, until = order[linear], n[linear]
        weight, shift = weight.astype(np.int32), shift.astype(np.int32)
        for t in range(1, width):
            step = np.einsum("ij,ij->j", weight, x[t : t + reach]) >> shift
            x[reach + t] += step if first.max() <= t < until.min() else np.where((t >= first) & (t < until), step, 0)
        out[linear] = x[reach:].T
    return out


def decode(media: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload bytes, seek points) of each stream, every checksum verified."""
    heads = _streams(media)
    sizes = np.fromiter(map(len, media), np.int64, len(media))
    base = np.cumsum(sizes) - sizes
    body = np.frombuffer(b"".join(media), np.uint8)
    counts = np.array([len(h[2]) for h in heads], np.int64)
    points = np.concatenate([h[2] for h in heads])
    begin = np.repeat(base + [h[3] for h in heads], counts) + points["offset"].astype(np.int64)
    last = np.cumsum(counts) - 1
    until = np.concatenate((begin[1:], [0]))
    until[last] = base + sizes
    n, number = points["n"].astype(np.int64), spread(counts)
    pieces = []
    group = max(1, GROUP // int(n.max()))
    for a in range(0, len(begin), group):
        s, e, m = begin[a : a + group], until[a : a + group], n[a : a + group]
        view = body[s[0] : e[-1]]
        x = decode_frames(view, s - s[0], e - s, m, number[a : a + group])
        pieces.append((x[np.arange(x.shape[1]) < m[:, None]] + 128).astype(np.uint8))
    flat = np.concatenate(pieces)
    out, at = [], 0
    for samples, digest, own, _ in heads:
        payload = flat[at : at + samples]
        if hashlib.md5((payload ^ 0x80).tobytes()).digest() != digest or len(payload) != samples:
            raise ValueError("a stream's MD5 is wrong")
        out.append((payload.tobytes(), own))
        at += samples
    return out


def payloads(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, unpadded sizes): UTF-8 with zeros up to a positive multiple of UNIT."""
    body, offsets = text_bytes(texts)
    n = np.diff(offsets)
    padded = np.maximum(1, -(-n // UNIT)) * UNIT
    ends = np.concatenate(([0], np.cumsum(padded)))
    out = np.zeros(int(ends[-1]), np.uint8)
    out[np.repeat(ends[:-1], n) + spread(n)] = body
    return out, ends, n


def encode_media(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream of every text, in frames of ``block`` samples.

    Null and empty texts are one unit of zeros. Equal texts give equal streams. Repeated rows
    give a stream each, an empty table none; other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                body, ends, n = payloads(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(encode(body, ends, block), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_each(media: list[bytes]) -> list[tuple[bytes, np.ndarray] | None]:
    """As ``decode``, but a stream that is null, damaged or of another kind gives None and leaves the others alone."""
    try:
        return decode(media)
    except (ValueError, IndexError, TypeError):
        if len(media) == 1:
            return [None]
        half = len(media) // 2
        return decode_each(media[:half]) + decode_each(media[half:])


def blocks(payload: bytes, points: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(first sample, samples, PCM bytes) of each frame: where to seek to, and what is there."""
    for first, n in zip(points["sample"].tolist(), points["n"].tolist(), strict=True):
        yield first, n, payload[first : first + n]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """One row per frame of each stream: its first sample, number of samples and PCM bytes.

    A stream that is null, damaged or of another kind is one row of nulls beside its doc_id. Repeated
    rows give their frames each, and an empty table gives no rows.
    """
    bounded_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), decode_each(batch.column("media").to_pylist()), strict=True):
                rows += [(doc, i, *b) for i, b in enumerate(blocks(*found))] if found else [(doc, None, None, None, None)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "block", "first_sample", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block int, first_sample long, n_samples int, pcm binary")


def _digest(found: tuple[bytes, np.ndarray] | None) -> tuple:
    """(bytes, SHA-256, CRC-32 of the last unit, feature) over a stream's PCM blocks in order."""
    if found is None:
        return None, None, None, None
    whole, size, tail = hashlib.sha256(), 0, b""
    for first, n, pcm in blocks(*found):
        if first != size or len(pcm) != n:
            raise ValueError("PCM blocks do not join")
        whole.update(pcm)
        size, tail = size + n, (tail + pcm)[-UNIT:]
    return size, whole.hexdigest(), zlib.crc32(tail), _feature(found[0])


def _feature(payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"samples={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"


def digests(media: DataFrame) -> DataFrame:
    """What the PCM blocks of the stored streams hold when read back.

    A damaged stream has null in the columns of its payload, and a null one in those of the stream
    too. Repeated rows give a row each, and an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = batch.column("media").to_pylist()
            rows = [(*p[:3], *((None, None) if b is None else (len(b), hashlib.sha256(b).hexdigest())), p[3]) for b, p in zip(blobs, map(_digest, decode_each(blobs)), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_flac_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(stored(encode_media(table(spark, sf_dir, "documents")), "media"))
