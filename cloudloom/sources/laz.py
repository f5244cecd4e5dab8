"""Chunks of compressed LAS files: the pointwise coder of point formats 0 to 3 with extra bytes.

A file has a table of its chunks; each chunk begins with one plain record and starts all models anew, so chunks can be read anywhere and are what the
data source deals to tasks. This module turns the bytes of one chunk into plain records and back. The layered coder of formats 6 to 10 is not here: such files are refused.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# The record that describes the coder, its items and what they are called.
RECORD_USER, RECORD_NUMBER = "laszip encoded", 22204
POINTWISE_CHUNKED, VARIABLE = 2, 0xFFFFFFFF
BYTES, POINT, TIME, COLOUR = 0, 6, 7, 8
# The context of a return by number of returns and return number.
RETURN_CONTEXT = (
    (15, 14, 13, 12, 11, 10, 9, 8), (14, 0, 1, 3, 6, 10, 10, 9), (13, 1, 2, 4, 7, 11, 11, 10), (12, 3, 4, 5, 8, 12, 12, 11),
    (11, 6, 7, 8, 9, 13, 13, 12), (10, 10, 11, 12, 13, 14, 14, 13), (9, 10, 11, 12, 13, 14, 15, 14), (8, 9, 10, 11, 12, 13, 14, 15),
)
# Codes of time steps. Multiples of the last step up to this, down to that, then no change, a new start and other sequences.
MULTIPLE, LEAST_MULTIPLE = 500, -10
SAME_TIME, NEW_TIME, TIME_CODES = MULTIPLE - LEAST_MULTIPLE + 1, MULTIPLE - LEAST_MULTIPLE + 2, MULTIPLE - LEAST_MULTIPLE + 6


@dataclass
class Coding:
    """What the coder's record says."""

    chunk_size: int
    items: list[tuple[int, int]]  # kind and size in bytes


def read_coding(body: bytes) -> Coding:
    compressor, coder = struct.unpack_from("<HH", body, 0)
    chunk_size, = struct.unpack_from("<I", body, 12)
    n, = struct.unpack_from("<H", body, 32)
    items = [struct.unpack_from("<HHH", body, 34 + 6 * i) for i in range(n)]
    if compressor != POINTWISE_CHUNKED or coder != 0 or any(kind not in (BYTES, POINT, TIME, COLOUR) or version != 2 for kind, _, version in items):
        raise ValueError(f"compressed in a way that can't be read: compressor {compressor}, items {[i[0] for i in items]}")
    return Coding(chunk_size, [(kind, size) for kind, size, _ in items])


class Symbols:
    """An adaptive model: counts of symbols, and their cumulated shares of 2^15 as of the last update."""

    __slots__ = ("counts", "total", "cycle", "left", "starts", "most")

    def __init__(self, n: int):
        self.counts, self.total, self.cycle, self.most = [1] * n, 0, n, (n + 6) << 3
        self.update()
        self.cycle = self.left = (n + 6) >> 1

    def update(self) -> None:
        counts = self.counts
        self.total += self.cycle
        if self.total > 1 << 15:
            counts = self.counts = [(c + 1) >> 1 for c in counts]
            self.total = sum(counts)
        scale, at, starts = (1 << 31) // self.total, 0, []
        for c in counts:
            starts.append(scale * at >> 16)
            at += c
        self.starts = starts
        self.cycle = self.left = min(5 * self.cycle >> 2, self.most)


class Bit:
    """An adaptive model of two symbols."""

    __slots__ = ("zeros", "n", "share", "cycle", "left")

    def __init__(self):
        self.zeros, self.n, self.share, self.cycle, self.left = 1, 2, 1 << 12, 4, 4

    def update(self) -> None:
        self.n += self.cycle
        if self.n > 1 << 13:
            self.n, self.zeros = (self.n + 1) >> 1, (self.zeros + 1) >> 1
            self.n += self.zeros == self.n
        self.share = self.zeros * ((1 << 31) // self.n) >> 18
        self.cycle = self.left = min(5 * self.cycle >> 2, 64)


class Decoder:
    """A range decoder over bytes."""

    __slots__ = ("data", "at", "value", "length")

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.length = data, at + 4, 0xFFFFFFFF
        self.value = int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big")

    def _take(self, below: int, length: int) -> None:
        value, at, data = self.value - below, self.at, self.data
        while length < 1 << 24:
            value = value << 8 | (data[at] if at < len(data) else 0)
            length <<= 8
            at += 1
        self.value, self.length, self.at = value, length, at

    def symbol(self, m: Symbols) -> int:
        unit, starts = self.length >> 15, m.starts
        share = self.value // unit
        lo, hi = 0, len(starts)
        while hi - lo > 1:
            mid = lo + hi >> 1
            if starts[mid] > share:
                hi = mid
            else:
                lo = mid
        below = starts[lo] * unit
        self._take(below, (starts[hi] * unit if hi < len(starts) else self.length) - below)
        m.counts[lo] += 1
        m.left -= 1
        if not m.left:
            m.update()
        return lo

    def bit(self, m: Bit) -> int:
        edge = m.share * (self.length >> 13)
        one = self.value >= edge
        if one:
            self._take(edge, self.length - edge)
        else:
            m.zeros += 1
            self._take(0, edge)
        m.left -= 1
        if not m.left:
            m.update()
        return int(one)

    def bits(self, n: int) -> int:
        if n > 19:
            low = self.bits(16)
            return self.bits(n - 16) << 16 | low
        unit = self.length >> n
        out = self.value // unit
        self._take(out * unit, unit)
        return out

    def whole(self) -> int:
        low = self.bits(16)
        return self.bits(16) << 16 | low


class Encoder:
    """The range coder the other way."""

    __slots__ = ("out", "base", "length")

    def __init__(self):
        self.out, self.base, self.length = bytearray(), 0, 0xFFFFFFFF

    def _put(self, above: int, length: int) -> None:
        base = self.base + above
        if base >> 32:  # a carry runs back through what is written
            base, i = base & 0xFFFFFFFF, len(self.out) - 1
            while self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            self.out[i] += 1
        while length < 1 << 24:
            self.out.append(base >> 24)
            base, length = base << 8 & 0xFFFFFFFF, length << 8
        self.base, self.length = base, length

    def symbol(self, m: Symbols, s: int) -> None:
        unit, starts = self.length >> 15, m.starts
        below = starts[s] * unit
        self._put(below, (starts[s + 1] * unit if s + 1 < len(starts) else self.length) - below)
        m.counts[s] += 1
        m.left -= 1
        if not m.left:
            m.update()

    def bit(self, m: Bit, one: int) -> None:
        edge = m.share * (self.length >> 13)
        if one:
            self._put(edge, self.length - edge)
        else:
            m.zeros += 1
            self._put(0, edge)
        m.left -= 1
        if not m.left:
            m.update()

    def bits(self, n: int, v: int) -> None:
        if n > 19:
            self.bits(16, v & 0xFFFF)
            n, v = n - 16, v >> 16
        unit = self.length >> n
        self._put(v * unit, unit)

    def whole(self, v: int) -> None:
        self.bits(16, v & 0xFFFF)
        self.bits(16, v >> 16)

    def finish(self) -> bytes:
        """What is left, and as many bytes as a decoder reads ahead."""
        wide = self.length > 1 << 25
        self._put(*((1 << 24, 1 << 23) if wide else (1 << 23, 1 << 15)))
        return bytes(self.out) + bytes(3 if wide else 2)


class Integers:
    """Whole numbers as corrections of a prediction: how many bits the correction has, by context, then those bits."""

    __slots__ = ("width", "by_context", "values", "sign", "k")

    def __init__(self, width: int, contexts: int = 1):
        self.width, self.k = width, 0
        self.by_context: list[Symbols | None] = [None] * contexts
        self.values: list[Symbols | None] = [None] * (width + 1)
        self.sign = Bit()

    def length_model(self, context: int) -> Symbols:
        m = self.by_context[context]
        if m is None:
            m = self.by_context[context] = Symbols(self.width + 1)
        return m

    def value_model(self, k: int) -> Symbols:
        m = self.values[k]
        if m is None:
            m = self.values[k] = Symbols(1 << min(k, 8))
        return m

    def read(self, d: Decoder, predicted: int, context: int = 0) -> int:
        k = self.k = d.symbol(self.length_model(context))
        if k == 0:
            c = d.bit(self.sign)
        elif k == 32:
            c = -(1 << 31)
        else:
            c = d.symbol(self.value_model(k))
            if k > 8:
                c = c << (k - 8) | d.bits(k - 8)
            c = c + 1 if c >= 1 << (k - 1) else c - (1 << k) + 1
        return self.wrapped(predicted + c)

    def write(self, e: Encoder, predicted: int, v: int, context: int = 0) -> None:
        c = v - predicted
        half = 1 << (self.width - 1)
        c = (c + half & (1 << self.width) - 1) - half
        k = self.k = (-c if c <= 0 else c - 1).bit_length()
        e.symbol(self.length_model(context), k)
        if k == 0:
            e.bit(self.sign, c)
        elif k < 32:
            c = c + (1 << k) - 1 if c < 0 else c - 1
            e.symbol(self.value_model(k), c >> max(0, k - 8))
            if k > 8:
                e.bits(k - 8, c & (1 << k - 8) - 1)

    def wrapped(self, v: int) -> int:
        if self.width == 32:
            return (v + (1 << 31) & 0xFFFFFFFF) - (1 << 31)
        return v & (1 << self.width) - 1


class Median:
    """The middle of five values, the newest pushing out the largest and the smallest in turn."""

    __slots__ = ("v", "drop_high")

    def __init__(self):
        self.v, self.drop_high = [0] * 5, True

    def add(self, x: int) -> None:
        v = self.v
        middle = v[2]
        del v[4 if self.drop_high else 0]
        i = 0
        if self.drop_high:
            while i < 4 and v[i] <= x:
                i += 1
            went_left = x < middle
            v.insert(i, x)
            self.drop_high = went_left
        else:
            while i < 4 and v[i] < x:
                i += 1
            went_right = middle < x
            v.insert(i, x)
            self.drop_high = not went_right


class PointItem:
    """Position, intensity, returns, class, angle, user data and line of a point."""

    size = 20
    layout = struct.Struct("<iiiHBBbBH")

    def __init__(self, raw: bytes):
        self.last = list(self.layout.unpack(raw))
        self.last[3] = 0
        self.dx, self.dy = [Median() for _ in range(16)], [Median() for _ in range(16)]
        self.intensities, self.heights = [0] * 16, [0] * 8
        self.changed, self.angle = Symbols(64), (Symbols(256), Symbols(256))
        self.by_value: dict[tuple[int, int], Symbols] = {}
        self.intensity, self.line = Integers(16, 4), Integers(16)
        self.x, self.y, self.z = Integers(32, 2), Integers(32, 22), Integers(32, 20)

    def model(self, place: int) -> Symbols:
        """The model of a byte after the one that stands there."""
        key = (place, self.last[place])
        m = self.by_value.get(key)
        if m is None:
            m = self.by_value[key] = Symbols(256)
        return m

    def contexts(self) -> tuple[int, int, int]:
        r, n = self.last[4] & 7, self.last[4] >> 3 & 7
        return RETURN_CONTEXT[n][r], abs(n - r), int(n == 1)

    def read(self, d: Decoder) -> bytes:
        last, changed = self.last, d.symbol(self.changed)
        if changed & 32:
            last[4] = d.symbol(self.model(4))
        m, level, single = self.contexts()
        if changed:
            if changed & 16:
                self.intensities[m] = self.intensity.read(d, self.intensities[m], min(m, 3))
            last[3] = self.intensities[m]
            if changed & 8:
                last[5] = d.symbol(self.model(5))
            if changed & 4:
                turned = d.symbol(self.angle[last[4] >> 6 & 1]) + last[6] & 255
                last[6] = turned - 256 if turned > 127 else turned
            if changed & 2:
                last[7] = d.symbol(self.model(7))
            if changed & 1:
                last[8] = self.line.read(d, last[8])
        step = self.x.read(d, self.dx[m].v[2], single)
        last[0] = self.x.wrapped(last[0] + step)
        self.dx[m].add(step)
        k = self.x.k
        step = self.y.read(d, self.dy[m].v[2], single + (k & ~1 if k < 20 else 20))
        last[1] = self.y.wrapped(last[1] + step)
        self.dy[m].add(step)
        k = (k + self.y.k) // 2
        self.heights[level] = last[2] = self.z.read(d, self.heights[level], single + (k & ~1 if k < 18 else 18))
        return self.layout.pack(*last)


    def write(self, e: Encoder, raw: bytes) -> None:
        last, new = self.last, list(self.layout.unpack(raw))
        bits_before, last[4] = last[4], new[4]
        m, level, single = self.contexts()
        last[4] = bits_before
        changed = sum(int(a != b) << at for a, b, at in ((last[4], new[4], 5), (self.intensities[m], new[3], 4), (last[5], new[5], 3), (last[6], new[6], 2), (last[7], new[7], 1), (last[8], new[8], 0)))
        e.symbol(self.changed, changed)
        if changed & 32:
            e.symbol(self.model(4), new[4])
        if changed & 16:
            self.intensity.write(e, self.intensities[m], new[3], min(m, 3))
            self.intensities[m] = new[3]
        if changed & 8:
            e.symbol(self.model(5), new[5])
        if changed & 4:
            e.symbol(self.angle[new[4] >> 6 & 1], new[6] - last[6] & 255)
        if changed & 2:
            e.symbol(self.model(7), new[7])
        if changed & 1:
            self.line.write(e, last[8], new[8])
        step = self.x.wrapped(new[0] - last[0])
        self.x.write(e, self.dx[m].v[2], step, single)
        self.dx[m].add(step)
        k = self.x.k
        step = self.y.wrapped(new[1] - last[1])
        self.y.write(e, self.dy[m].v[2], step, single + (k & ~1 if k < 20 else 20))
        self.dy[m].add(step)
        k = (k + self.y.k) // 2
        self.z.write(e, self.heights[level], new[2], single + (k & ~1 if k < 18 else 18))
        self.heights[level] = new[2]
        self.last = new


class TimeItem:
    """Times as steps of up to four sequences, each a multiple of the last step of its sequence."""

    size = 8

    def __init__(self, raw: bytes):
        self.times, self.steps, self.odd = [int.from_bytes(raw, "little"), 0, 0, 0], [0] * 4, [0] * 4
        self.now = self.next = 0
        self.multiple, self.without_step, self.step = Symbols(TIME_CODES), Symbols(6), Integers(32, 9)

    def _start(self, d: Decoder) -> None:
        self.next = (self.next + 1) & 3
        high = self.step.read(d, self._signed(self.times[self.now] >> 32 & 0xFFFFFFFF), 8)
        self.times[self.next] = (high & 0xFFFFFFFF) << 32 | d.whole()
        self.now = self.next
        self.steps[self.now] = self.odd[self.now] = 0

    @staticmethod
    def _signed(v: int) -> int:
        return v - (1 << 32) if v >= 1 << 31 else v

    def read(self, d: Decoder) -> bytes:
        while True:
            i, step = self.now, self.steps[self.now]
            if step == 0:
                code = d.symbol(self.without_step)
                if code == 1:
                    self.steps[i] = self.step.read(d, 0, 0)
                    self.times[i] += self.steps[i]
                    self.odd[i] = 0
                elif code == 2:
                    self._start(d)
                elif code > 2:
                    self.now = (i + code - 2) & 3
                    continue
                break
            code = d.symbol(self.multiple)
            if code == 1:
                self.times[i] += self.step.read(d, step, 1)
                self.odd[i] = 0
            elif code < SAME_TIME:
                self.times[i] += self._multiple(d, i, step, code)
            elif code == NEW_TIME:
                self._start(d)
            elif code > NEW_TIME:
                self.now = (i + code - NEW_TIME) & 3
                continue
            break
        return (self.times[self.now] & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")

    def _multiple(self, d: Decoder, i: int, step: int, code: int) -> int:
        factor, context = time_context(code)
        out = self.step.read(d, self.step.wrapped(factor * step), context)
        if context in (4, 6, 7):  # too far off to be a multiple: after four of them the step is another one
            self.odd[i] += 1
            if self.odd[i] > 3:
                self.steps[i], self.odd[i] = out, 0
        return out


    def write(self, e: Encoder, raw: bytes) -> None:
        new, near = int.from_bytes(raw, "little"), lambda d: -(1 << 31) <= d < 1 << 31
        off = [self._signed64(new - t) for t in self.times]
        while True:
            i = self.now
            step, d = self.steps[i], off[i]
            if not near(d):
                others = [j for j in range(1, 4) if near(off[(i + j) & 3])]
                if others:
                    e.symbol(*((self.multiple, NEW_TIME + others[0]) if step else (self.without_step, 2 + others[0])))
                    self.now = (i + others[0]) & 3
                    continue
                e.symbol(*((self.multiple, NEW_TIME) if step else (self.without_step, 2)))
                self.step.write(e, self._signed(self.times[i] >> 32 & 0xFFFFFFFF), self._signed(new >> 32), 8)
                e.whole(new & 0xFFFFFFFF)
                self.now = self.next = (self.next + 1) & 3
                self.times[self.now], self.steps[self.now], self.odd[self.now] = new, 0, 0
                return
            break
        self.times[i] = new
        if not step:
            e.symbol(self.without_step, int(d != 0))
            if d:
                self.step.write(e, 0, d, 0)
                self.steps[i], self.odd[i] = d, 0
        elif d == 0:
            e.symbol(self.multiple, SAME_TIME)
        else:
            factor = min(MULTIPLE, max(LEAST_MULTIPLE, round(d / step)))
            code = factor if factor >= 0 else MULTIPLE - factor
            e.symbol(self.multiple, code)
            if code == 1:
                self.step.write(e, step, d, 1)
                self.odd[i] = 0
            else:
                _, context = time_context(code)
                self.step.write(e, self.step.wrapped(factor * step), d, context)
                if context in (4, 6, 7):
                    self.odd[i] += 1
                    if self.odd[i] > 3:
                        self.steps[i], self.odd[i] = d, 0

    @staticmethod
    def _signed64(v: int) -> int:
        return (v + (1 << 63) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def time_context(code: int) -> tuple[int, int]:
    """The multiple of the last step that a code predicts, and the context of its correction."""
    if code == 0:
        return 0, 7
    if code < MULTIPLE:
        return code, 2 if code < 10 else 3
    if code == MULTIPLE:
        return MULTIPLE, 4
    factor = MULTIPLE - code
    return (factor, 5) if factor > LEAST_MULTIPLE else (LEAST_MULTIPLE, 6)


class ColourItem:
    """Red, then green and blue from what red did, byte by byte."""

    size = 6
    layout = struct.Struct("<HHH")

    def __init__(self, raw: bytes):
        self.last, self.used, self.bytes = self.layout.unpack(raw), Symbols(128), [Symbols(256) for _ in range(6)]

    def read(self, d: Decoder) -> bytes:
        used, (r0, g0, b0) = d.symbol(self.used), self.last
        clamp = lambda v: min(255, max(0, v))
        half = lambda v: int(v / 2)  # noqa: E731  towards zero
        value = lambda i, old: (d.symbol(self.bytes[i]) + old & 255)
        low = value(0, r0 & 255) if used & 1 else r0 & 255
        high = value(1, r0 >> 8) if used & 2 else r0 >> 8
        if used & 64:
            moved = low - (r0 & 255)
            g_low = value(2, clamp(moved + (g0 & 255))) if used & 4 else g0 & 255
            b_low = value(4, clamp(half(moved + g_low - (g0 & 255)) + (b0 & 255))) if used & 16 else b0 & 255
            moved = high - (r0 >> 8)
            g_high = value(3, clamp(moved + (g0 >> 8))) if used & 8 else g0 >> 8
            b_high = value(5, clamp(half(moved + g_high - (g0 >> 8)) + (b0 >> 8))) if used & 32 else b0 >> 8
            self.last = (high << 8 | low, g_high << 8 | g_low, b_high << 8 | b_low)
        else:
            self.last = (high << 8 | low,) * 3
        return self.layout.pack(*self.last)


    def write(self, e: Encoder, raw: bytes) -> None:
        new, (r0, g0, b0) = self.layout.unpack(raw), self.last
        r, g, b = new
        clamp, half = (lambda v: min(255, max(0, v))), (lambda v: int(v / 2))
        parts = [(r & 255, r0 & 255), (r >> 8, r0 >> 8), (g & 255, g0 & 255), (g >> 8, g0 >> 8), (b & 255, b0 & 255), (b >> 8, b0 >> 8)]
        used = sum(int(x != y) << i for i, (x, y) in enumerate(parts)) & (63 if len(set(new)) > 1 else 3)
        e.symbol(self.used, used | (len(set(new)) > 1) << 6)

        def put(i: int, predicted: int) -> None:
            if used >> i & 1:
                e.symbol(self.bytes[i], parts[i][0] - predicted & 255)

        put(0, r0 & 255)
        put(1, r0 >> 8)
        for low in (0, 1):  # low bytes, then high ones
            moved = parts[low][0] - parts[low][1]
            put(2 + low, clamp(moved + parts[2 + low][1]))
            put(4 + low, clamp(half(moved + parts[2 + low][0] - parts[2 + low][1]) + parts[4 + low][1]))
        self.last = new


class BytesItem:
    """Extra bytes, each as the step from the last one."""

    def __init__(self, raw: bytes):
        self.last, self.models = list(raw), [Symbols(256) for _ in raw]

    def read(self, d: Decoder) -> bytes:
        for i, m in enumerate(self.models):
            self.last[i] = self.last[i] + d.symbol(m) & 255
        return bytes(self.last)


    def write(self, e: Encoder, raw: bytes) -> None:
        for i, m in enumerate(self.models):
            e.symbol(m, raw[i] - self.last[i] & 255)
        self.last = list(raw)


ITEMS = {BYTES: BytesItem, POINT: PointItem, TIME: TimeItem, COLOUR: ColourItem}


def read_chunk(data: bytes, n: int, coding: Coding) -> bytes:
    """The n plain records of a chunk."""
    if not n:
        return b""
    at, items = 0, []
    for kind, size in coding.items:
        items.append(ITEMS[kind](data[at : at + size]))
        at += size
    out, d = [data[:at]], Decoder(data, at)
    for _ in range(n - 1):
        for item in items:
            out.append(item.read(d))
    return b"".join(out)


def write_chunk(raw: bytes, record_length: int, coding: Coding) -> bytes:
    """The bytes of a chunk of plain records."""
    cuts, at = [], 0
    for _, size in coding.items:
        cuts.append((at, at + size))
        at += size
    items, e = [ITEMS[kind](raw[lo:hi]) for (kind, _), (lo, hi) in zip(coding.items, cuts)], Encoder()
    for first in range(record_length, len(raw), record_length):
        for item, (lo, hi) in zip(items, cuts):
            item.write(e, raw[first + lo : first + hi])
    return raw[:record_length] + e.finish()


def coding_of(point_format: int, extra_bytes: int, chunk_size: int) -> Coding:
    if point_format not in (0, 1, 2, 3):
        raise ValueError(f"point format {point_format} can't be written compressed")
    more = [(TIME, 8)] * (point_format in (1, 3)) + [(COLOUR, 6)] * (point_format in (2, 3)) + [(BYTES, extra_bytes)] * bool(extra_bytes)
    return Coding(chunk_size, [(POINT, 20), *more])


def coding_record(coding: Coding) -> bytes:
    head = struct.pack("<HHBBHIIqqH", POINTWISE_CHUNKED, 0, 2, 2, 0, 0, coding.chunk_size, -1, -1, len(coding.items))
    return head + b"".join(struct.pack("<HHH", kind, size, 2) for kind, size in coding.items)


def write_points(raw: bytes, record_length: int, coding: Coding, first: int) -> bytes:
    """Point data as they stand in a file from byte ``first`` on: the place of the table of chunks, chunks, table."""
    step = coding.chunk_size * record_length
    chunks = [write_chunk(raw[at : at + step], record_length, coding) for at in range(0, len(raw), step)]
    e, steps, size = Encoder(), Integers(32, 2), 0
    for c in chunks:
        steps.write(e, size, len(c), 1)
        size = len(c)
    return struct.pack("<q", first + 8 + sum(map(len, chunks))) + b"".join(chunks) + struct.pack("<II", 0, len(chunks)) + e.finish()


def chunk_table(read_at, first: int, file_size: int, coding: Coding, n_points: int) -> list[tuple[int, int, int]]:
    """(place, bytes, points) of each chunk. read_at(place, many) reads the file; first is where the point data begin."""
    place, = struct.unpack("<q", read_at(first, 8))
    if place == -1:
        place, = struct.unpack("<q", read_at(file_size - 8, 8))
    if not first + 8 <= place < file_size:
        raise ValueError("the table of chunks is missing")
    raw = read_at(place, file_size - place)
    _, n = struct.unpack_from("<II", raw, 0)
    d, steps, out, at, left = Decoder(raw, 8), Integers(32, 2), [], first + 8, n_points
    many = size = 0
    for _ in range(n):
        if coding.chunk_size == VARIABLE:
            many = steps.read(d, many, 0)
        size = steps.read(d, size, 1)
        own = many if coding.chunk_size == VARIABLE else min(coding.chunk_size, left)
        out.append((at, size, own))
        at, left = at + size, left - own
    if left or at > place:
        raise ValueError("the table of chunks does not fit the points")
    return out


def records(data: bytes, n: int, coding: Coding, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(read_chunk(data, n, coding), dtype=dtype, count=n)
