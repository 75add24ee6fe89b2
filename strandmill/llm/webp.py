"""Lossless WebP (VP8L) per image: a decoder for the whole format and an encoder to test and feed it.

Pixels are 32-bit ARGB values in a flat numpy array.  The decoder reads prefix codes (simple, normal and
grouped by an entropy image), back-references and the colour cache, then inverts the palette,
predictor, cross-colour and subtract-green transforms.  Streams with one code group whose red, blue and
alpha codes carry no bits take a table that yields several literals at a time.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
MAX_COPY = 4096
MAX_SIDE = 16384
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)

# Neighbours by distance code: nearest first, then by |x|, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# ---------------------------------------------------------------- prefix codes


def huffman_lengths(weights: list[float], most: int = 15) -> tuple[int, ...]:
    """Code lengths of at most ``most`` bits; symbols of weight 0 get none.  One symbol alone gets length 0 too."""
    used = [i for i, w in enumerate(weights) if w > 0]
    floor = 0.0
    while True:
        heap = [(max(weights[i], floor), k, (i,)) for k, i in enumerate(used)]
        heapq.heapify(heap)
        lengths = [0] * len(weights)
        k = len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                lengths[i] += 1
            heapq.heappush(heap, (a[0] + b[0], k := k + 1, a[2] + b[2]))
        if max(lengths, default=0) <= most:
            return tuple(lengths)
        floor = max(2 * floor, sum(weights) / 2**most)


def canonical(lengths: tuple[int, ...]) -> np.ndarray:
    """Codes of the symbols, bits reversed so that they can be written low bit first."""
    codes, code, at = np.zeros(len(lengths), np.uint64), 0, 0
    for n, i in sorted((n, i) for i, n in enumerate(lengths) if n):
        code <<= n - at
        at = n
        codes[i] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return codes


@functools.lru_cache(maxsize=256)
def lookup(lengths: tuple[int, ...], single: int) -> tuple[list[int], int]:
    """Table over the next ``bits`` bits of (symbol * 16 + length); ``single`` >= 0: the only symbol, of length 0."""
    if single >= 0:
        return [single * 16], 0
    bits = max(lengths)
    table, codes = np.zeros(1 << bits, np.int64), canonical(lengths)
    if sum(2 ** (bits - n) for n in lengths if n) != 1 << bits:
        raise ValueError("prefix code is not complete")
    for i, n in enumerate(lengths):
        if n:
            table[int(codes[i]) :: 1 << n] = i * 16 + n
    return table.tolist(), bits


def _extra(prefix: int) -> int:
    return max(0, (prefix - 2) >> 1)


@functools.lru_cache(maxsize=8)
def green_steps(lengths: tuple[int, ...], far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the next 16 bits: (symbol, code length, bits up to the next symbol); ``far`` is the only distance symbol."""
    table, bits = lookup(lengths, -1)
    entry = np.array(table)[np.arange(1 << 16) & ((1 << bits) - 1)]
    symbol, length = (entry >> 4).astype(np.int16), (entry & 15).astype(np.int32)
    more = np.array([0] * 256 + [_extra(s) + _extra(far) for s in range(len(lengths) - 256)], np.int32)
    return symbol, length, length + more[symbol]


# ---------------------------------------------------------------- reading


class Bits:
    """Reads low bits first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def window(self, byte: int, most: int) -> np.ndarray:
        """The 32 bits from each of up to ``most`` bytes on."""
        part = np.frombuffer(self.data, np.uint8, min(most + 3, len(self.data) - byte), byte).astype(np.uint32)
        n = len(part) - 3
        return part[:n] | part[1 : n + 1] << 8 | part[2 : n + 2] << 16 | part[3 : n + 3] << 24

    def slice(self, at: int, n: int) -> int:
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def peek(self) -> int:
        at = self.at >> 3
        return int.from_bytes(self.data[at : at + 4], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        now = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return now

    def symbol(self, code: tuple[list[int], int]) -> int:
        entry = code[0][self.peek() & ((1 << code[1]) - 1)]
        self.at += entry & 15
        return entry >> 4

    def number(self, prefix: int) -> int:
        """A length or distance from its prefix symbol and extra bits."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


_latest: dict[int, tuple[int, int, tuple]] = {}


def read_code(b: Bits, size: int) -> tuple[tuple[int, ...], int]:
    """(lengths, single) as ``lookup`` takes them.  Images in a row often repeat a code bit for bit, so the
    latest one of each alphabet is kept with its bits and compared first."""
    if size in _latest:
        n, bits, code = _latest[size]
        if b.at + n <= b.end and b.slice(b.at, n) == bits:
            b.at += n
            return code
    start, code = b.at, _parse_code(b, size)
    if size > 256:
        _latest[size] = (b.at - start, b.slice(start, b.at - start), code)
    return code


def _parse_code(b: Bits, size: int) -> tuple[tuple[int, ...], int]:
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        first = b.read(8 if wide else 1)
        if not two:
            return (), first
        lengths = [0] * size
        lengths[first] = lengths[b.read(8)] = 1
        return tuple(lengths), -1
    own = [0] * 19
    for i in range(4 + b.read(4)):
        own[CODE_LENGTH_ORDER[i]] = b.read(3)
    used = [i for i, n in enumerate(own) if n]
    code = lookup(tuple(own), -1) if len(used) > 1 else lookup((), used[0])
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else size
    lengths, last = [], 8
    while len(lengths) < size and left:
        left -= 1
        s = b.symbol(code)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + b.read(2))
        else:
            lengths += [0] * (3 + b.read(3) if s == 17 else 11 + b.read(7))
    lengths = (lengths + [0] * size)[:size]
    used = [i for i, n in enumerate(lengths) if n]
    return (tuple(lengths), -1) if len(used) > 1 else ((), used[0] if used else 0)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


SEGMENT = 1 << 16


def _chain(step: np.ndarray, start: int) -> np.ndarray:
    """All places reached from ``start`` by p -> p + step[p] inside the array: strides of 16 first, then what lies between."""
    end = len(step)
    one = np.append(np.minimum(np.arange(end, dtype=np.int32) + step, end), np.int32(end))
    many = one
    for _ in range(4):
        many = many[many]
    jump, at, starts = memoryview(many), start, []
    while at < end:
        starts.append(at)
        at = jump[at]
    rows = [np.array(starts, np.int32)]
    for _ in range(15):
        rows.append(one[rows[-1]])
    places = np.stack(rows, axis=1).ravel()
    return places[: np.searchsorted(places, end)]


def _grey_stream(b: Bits, group, width: int, total: int) -> np.ndarray:
    """Pixels of a stream in which only green symbols and copies from one distance carry bits.

    The step from every bit to the next symbol comes from a table, so a whole segment is decoded at once.
    """
    (green, _), red, blue, alpha, far = group[0], group[1][1], group[2][1], group[3][1], group[4][1]
    symbol_of, length_of, step_of = green_steps(green, far)
    at, n, out = b.at, 0, bytearray()
    while n < total:
        byte = at >> 3
        if at >= b.end:
            raise ValueError("the image ends early")
        words = b.window(byte, SEGMENT)
        near = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0xFFFF)).ravel()
        places = _chain(step_of[near], at & 7)
        window = near[places]
        symbols = symbol_of[window]
        at = 8 * byte + int(places[-1]) + int(step_of[window[-1]])
        copies = np.flatnonzero(symbols >= 256).tolist()
        done = 0
        for k in copies + [len(symbols)]:
            lits = symbols[done : min(k, done + total - n)].astype(np.uint8).tobytes()
            out += lits
            n += len(lits)
            end = done + len(lits) - 1  # the last symbol that belongs to the image so far
            done = k + 1
            if n >= total or k == len(symbols):
                break
            end = k
            b.at = 8 * byte + int(places[k]) + int(length_of[window[k]])
            m = b.number(int(symbols[k]) - 256)
            d = _distance(b.number(far), width)
            if d > n:
                raise ValueError("copy from before the image")
            piece = bytes(out[n - d : n - d + m] if d >= m else out[n - d :])
            out += (piece * (m // d + 1))[:m]
            n += m
        if n >= total:
            b.at = 8 * byte + int(places[end]) + int(step_of[window[end]])
    g = np.frombuffer(bytes(out[:total]), np.uint8).astype(np.uint32)
    return g << 8 | np.uint32(alpha << 24 | red << 16 | blue)


def read_image(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, without its transforms."""
    cache_bits = b.read(4) if b.read(1) else 0
    total, groups_of, block = width * height, None, 0
    if main and b.read(1):
        block = b.read(3) + 2
        across = -(-width >> block)
        groups_of = (read_image(b, across, -(-height >> block), False) >> 8 & 0xFFFF).tolist()
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(b, n) for n in sizes] for _ in range(1 + max(groups_of or [0]))]
    if len(groups) == 1 and not cache_bits and groups[0][0][1] < 0 and all(c[1] >= 0 for c in groups[0][1:]):
        return _grey_stream(b, groups[0], width, total)

    codes = [[lookup(*c) for c in g] for g in groups]
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    out, n, group = [0] * total, 0, codes[0]
    while n < total:
        if groups_of:
            group = codes[groups_of[(n // width >> block) * across + (n % width >> block)]]
        s = b.symbol(group[0])
        if s < 256:
            red, blue, alpha = b.symbol(group[1]), b.symbol(group[2]), b.symbol(group[3])
            out[n] = alpha << 24 | red << 16 | s << 8 | blue
            m = 1
        elif s < 280:
            m = min(b.number(s - 256), total - n)
            d = _distance(b.number(b.symbol(group[4])), width)
            if d > n:
                raise ValueError("copy from before the image")
            for k in range(n, n + m):
                out[k] = out[k - d]
        else:
            out[n], m = cache[s - 280], 1
        if cache_bits:
            for k in range(n, n + m):
                cache[(out[k] * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = out[k]
        n += m
        if b.at > b.end:
            raise ValueError("the image ends early")
    return np.array(out, np.uint32)


# ---------------------------------------------------------------- transforms


def _planes(argb: np.ndarray) -> np.ndarray:
    return argb.view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha


def add(a, b):
    return ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF | ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00



def _subtract(a: int, b: int) -> int:
    return sum(((a >> k) - (b >> k) & 255) << k for k in (0, 8, 16, 24))


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _each(f, *pixels: int) -> int:
    return sum(f(*(p >> k & 255 for p in pixels)) << k for k in (0, 8, 16, 24))


def _clip(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _select(left: int, top: int, corner: int) -> int:
    to_left = sum(abs((top >> k & 255) - (corner >> k & 255)) for k in (0, 8, 16, 24))
    to_top = sum(abs((left >> k & 255) - (corner >> k & 255)) for k in (0, 8, 16, 24))
    return left if to_left < to_top else top


def _half(mean: int, corner: int) -> int:
    return _each(lambda a, c: _clip(a + int((a - c) / 2)), mean, corner)


PREDICT = (
    lambda lf, t, tr, tl: 0xFF000000,
    lambda lf, t, tr, tl: lf,
    lambda lf, t, tr, tl: t,
    lambda lf, t, tr, tl: tr,
    lambda lf, t, tr, tl: tl,
    lambda lf, t, tr, tl: _mean(_mean(lf, tr), t),
    lambda lf, t, tr, tl: _mean(lf, tl),
    lambda lf, t, tr, tl: _mean(lf, t),
    lambda lf, t, tr, tl: _mean(tl, t),
    lambda lf, t, tr, tl: _mean(t, tr),
    lambda lf, t, tr, tl: _mean(_mean(lf, tl), _mean(t, tr)),
    lambda lf, t, tr, tl: _select(lf, t, tl),
    lambda lf, t, tr, tl: _each(lambda a, b, c: _clip(a + b - c), lf, t, tl),
    lambda lf, t, tr, tl: _half(_mean(lf, t), tl),
)


def _running(values: np.ndarray, width: int, left: bool) -> np.ndarray:
    """Inverse of the predictor that takes the pixel to the left (or above) everywhere: sums along rows (or columns)."""
    p = _planes(values.copy()).reshape(-1, width, 4)
    p[0, 0, 3] = (int(p[0, 0, 3]) + 255) & 255
    if left:
        p[:, 0] = np.cumsum(p[:, 0], axis=0, dtype=np.uint8)
        p = np.cumsum(p, axis=1, dtype=np.uint8)
    else:
        p[0] = np.cumsum(p[0], axis=0, dtype=np.uint8)
        p = np.cumsum(p, axis=0, dtype=np.uint8)
    return np.ascontiguousarray(p).view(np.uint32).ravel()


def predict(values: np.ndarray, width: int, bits: int, modes: np.ndarray, forward: bool) -> np.ndarray:
    """Inverse (or forward) predictor transform, pixel by pixel in raster order, or by running sums where one plain mode serves all."""
    across, kinds = -(-width >> bits), (modes >> 8 & 15).tolist()
    if not forward and set(kinds) in ({1}, {2}):
        return _running(values, width, kinds[0] == 1)
    given, pixels = values.tolist(), values.tolist()
    for n, v in enumerate(given):
        y, x = divmod(n, width)
        if not n:
            guess = 0xFF000000
        elif not y:
            guess = pixels[n - 1]
        elif not x:
            guess = pixels[n - width]
        else:
            kind = kinds[(y >> bits) * across + (x >> bits)]
            guess = PREDICT[kind if kind < 14 else 0](pixels[n - 1], pixels[n - width], pixels[n - width + 1], pixels[n - width - 1])
        if forward:
            given[n] = _subtract(v, guess)
        else:
            pixels[n] = add(v, guess)
    return np.array(given if forward else pixels, np.uint32)


def cross_colour(values: np.ndarray, width: int, bits: int, elements: np.ndarray, forward: bool) -> np.ndarray:
    n = np.arange(len(values))
    e = _planes(elements[(n // width >> bits) * -(-width >> bits) + (n % width >> bits)]).view(np.int8).astype(np.int32)
    out = values.copy()
    p = _planes(out)
    green = p[:, 1].view(np.int8) if p[:, 1].flags.c_contiguous else np.ascontiguousarray(p[:, 1]).view(np.int8)
    green = green.astype(np.int32)
    sign = -1 if forward else 1
    old_red = np.ascontiguousarray(p[:, 2]).view(np.int8).astype(np.int32)
    red = p[:, 2].astype(np.int32) + sign * (e[:, 0] * green >> 5)
    new_red = (red & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    blue = p[:, 0].astype(np.int32) + sign * ((e[:, 1] * green >> 5) + (e[:, 2] * (old_red if forward else new_red) >> 5))
    p[:, 2], p[:, 0] = red & 255, blue & 255
    return out


def subtract_green(values: np.ndarray, forward: bool) -> np.ndarray:
    out = values.copy()
    p = _planes(out)
    for k in (0, 2):
        p[:, k] = p[:, k] - p[:, 1] if forward else p[:, k] + p[:, 1]
    return out


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unpack_palette(values: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
    bits = _bundle(len(table))
    index = values >> 8 & 255
    if bits:
        across, each = -(-width >> bits), 8 >> bits
        n = np.arange(len(values) // across * width)
        index = index[n // width * across + (n % width >> bits)] >> ((n % width & (1 << bits) - 1) * each).astype(np.uint32) & ((1 << each) - 1)
    return np.append(table, np.zeros(256, np.uint32))[index]


def _lossless_chunk(data: bytes) -> bytes:
    """The VP8L chunk of a simple or extended (VP8X) file; colour profile and metadata chunks are passed over."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return data[at + 8 : min(at + 8 + size, end)]
        if kind in (b"VP8 ", b"ANIM", b"ANMF"):
            raise ValueError("a lossy or animated WebP file")
        at += 8 + size + size % 2
    raise ValueError("no lossless image in the WebP file")


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB pixels) of one WebP file.  The alpha bit of the header is a hint and not looked at."""
    stream = _lossless_chunk(data)
    if len(stream) < 5 or stream[0] != 0x2F:
        raise ValueError("not a lossless WebP file")
    b = Bits(stream[1:])
    width, height, _, version = b.read(14) + 1, b.read(14) + 1, b.read(1), b.read(3)
    if version:
        raise ValueError("unknown version")
    undo, now = [], width
    while b.read(1):
        kind = b.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = b.read(3) + 2
            undo.append((kind, now, bits, read_image(b, -(-now >> bits), -(-height >> bits), False)))
        elif kind == PALETTE:
            size = b.read(8) + 1
            table = np.cumsum(_planes(read_image(b, size, 1, False)), axis=0, dtype=np.uint8)
            undo.append((kind, now, 0, np.ascontiguousarray(table).view(np.uint32).ravel()))
            now = -(-now >> _bundle(size))
        else:
            undo.append((kind, now, 0, None))
    out = read_image(b, now, height, True)
    for kind, w, bits, extra in reversed(undo):
        if kind == PREDICTOR:
            out = predict(out, w, bits, extra, False)
        elif kind == CROSS_COLOUR:
            out = cross_colour(out, w, bits, extra, False)
        elif kind == SUBTRACT_GREEN:
            out = subtract_green(out, False)
        else:
            out = unpack_palette(out, w, extra)
    return width, height, out


# ---------------------------------------------------------------- writing


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= int(value) << self.n
        self.n += bits

    def code(self, lengths: tuple[int, ...], single: int) -> None:
        """A prefix code: simple where one symbol below 256 is used, else normal with run lengths."""
        if single >= 0:
            for v, n in ((1, 1), (0, 1), (1, 1), (single, 8)):
                self.put(v, n)
            return
        tokens, i = [], 0
        while i < len(lengths):
            run = 1
            while i + run < len(lengths) and lengths[i + run] == lengths[i]:
                run += 1
            if lengths[i] == 0 and run >= 3:
                run = min(run, 138)
                tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
            elif lengths[i] and run >= 4:
                run = min(run, 7)
                tokens += [(lengths[i], 0, 0), (16, run - 4, 2)]
            else:
                run = 1
                tokens.append((lengths[i], 0, 0))
            i += run
        counts = [0] * 19
        for s, _, _ in tokens:
            counts[s] += 1
        if sum(c > 0 for c in counts) == 1:
            counts[0 if counts[1] else 1] = 1
        own = huffman_lengths(counts, 7)
        self.put(0, 1)
        self.put(15, 4)
        for s in CODE_LENGTH_ORDER:
            self.put(own[s], 3)
        self.put(0, 1)
        codes = canonical(own)
        for s, extra, bits in tokens:
            self.put(codes[s], own[s])
            self.put(extra, bits)

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra value, extra bits) of a length or distance >= 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * (extra + 1) + (v >> extra & 1), v & ((1 << extra) - 1), extra


def write_image(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, lz77: bool = True) -> None:
    """One code group with codes fitted to the image; greedy copies by a table of the last places of three pixels."""
    px, tokens, n, seen, cache, shift = argb.tolist(), [], 0, {}, {}, 32 - cache_bits
    codes_of = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    while n < len(px):
        key, m = tuple(px[n : n + 3]), 1
        d = n - seen[key] if lz77 and key in seen else 0
        if d:
            while m < MAX_COPY and n + m < len(px) and px[n + m] == px[n + m - d]:
                m += 1
        if m >= 3:
            tokens.append((256 + prefix_of(m)[0], m, codes_of.get(d, d + 120)))
        else:
            m, p = 1, px[n]
            hit = cache_bits and cache.get((p * CACHE_FACTOR & 0xFFFFFFFF) >> shift) == p
            tokens.append((280 + ((p * CACHE_FACTOR & 0xFFFFFFFF) >> shift), p, 0) if hit else (p >> 8 & 255, p, 0))
        for k in range(n, n + m):
            seen[tuple(px[k : k + 3])] = k
            cache[(px[k] * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = px[k]
        n += m
    counts = [[0] * size for size in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    for s, v, d in tokens:
        counts[0][s] += 1
        if s < 256:
            for k, at in ((1, 16), (2, 0), (3, 24)):
                counts[k][v >> at & 255] += 1
        elif s < 280:
            counts[4][prefix_of(d)[0]] += 1
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    codes = []
    for c in counts:
        used = [i for i, x in enumerate(c) if x]
        if len(used) == 1 and used[0] > 255:
            c[0] = 1
        lengths, single = (huffman_lengths(c), -1) if len(used) > 1 or used and used[0] > 255 else ((0,) * len(c), used[0] if used else 0)
        w.code(lengths, single)
        codes.append((canonical(lengths), lengths))
    put = lambda k, s: w.put(codes[k][0][s], codes[k][1][s])
    for s, v, d in tokens:
        put(0, s)
        if s < 256:
            put(1, v >> 16 & 255)
            put(2, v & 255)
            put(3, v >> 24)
        elif s < 280:
            w.put(*prefix_of(v)[1:])
            put(4, prefix_of(d)[0])
            w.put(*prefix_of(d)[1:])


def riff(stream: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(stream) + 1) + b"\x2f" + stream + b"\0" * ((len(stream) + 1) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def _start(w: Writer, width: int, height: int) -> None:
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 4)


def encode(argb: np.ndarray, width: int, transforms: tuple[int, ...] = (), cache_bits: int = 0, lz77: bool = True, mode: int = 11, block: int = 3) -> bytes:
    """A WebP file of any pixels.  ``transforms`` are applied in the order given; ``mode`` is the predictor."""
    height, w, now = len(argb) // width, Writer(), width
    _start(w, width, height)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        blocks = -(-now >> block) * -(-height >> block)
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.put(block - 2, 3)
            if kind == PREDICTOR:
                side = ((np.arange(blocks) + mode) % 14 if mode < 0 else np.full(blocks, mode)).astype(np.uint32) << 8 | np.uint32(0xFF000000)
                argb = predict(argb, now, block, side, True)
            else:
                side = np.full(blocks, 0xFF000000 | (5 << 16) | (250 << 8) | 9, np.uint32)
                argb = cross_colour(argb, now, block, side, True)
            write_image(w, side, -(-now >> block), False)
        elif kind == PALETTE:
            table, index = np.unique(argb, return_inverse=True)
            if len(table) > 256:
                raise ValueError("more than 256 colours")
            w.put(len(table) - 1, 8)
            steps = np.diff(_planes(table), axis=0, prepend=np.zeros((1, 4), np.uint8))
            write_image(w, np.ascontiguousarray(steps.astype(np.uint8)).view(np.uint32).ravel(), len(table), False)
            bits = _bundle(len(table))
            across, each = -(-now >> bits), 8 >> bits
            packed = np.zeros((height, across << bits), np.uint32)
            packed[:, :now] = index.reshape(height, now)
            packed = packed.reshape(height, across, 1 << bits) << (np.arange(1 << bits, dtype=np.uint32) * each)
            argb, now = packed.sum(axis=2, dtype=np.uint32).ravel() << 8 | np.uint32(0xFF000000), across
        else:
            argb = subtract_green(argb, True)
    w.put(0, 1)
    write_image(w, argb, now, True, cache_bits, lz77)
    return riff(w.bytes())


def _text_weight(symbol: int) -> float:
    """Expected share of a green symbol in UTF-8 prose: letters and spaces lead, then marks and accents."""
    if symbol >= 256:
        return 4.0
    c = chr(symbol)
    if c in "etaoinsrh ":
        return 96.0
    if symbol < 128 and c.islower():
        return 32.0
    if symbol < 128 and (c.isupper() or c.isdigit() or c in "\n.,-'\"|") or 128 <= symbol < 196:
        return 4.0
    return 0.5


#: Samples from which codes are fitted to an image and repeats are looked for.
FIT, MATCH = 16_384, 4096
#: Bytes of a window that is looked up, and of a copy at least.
SEEN, COPY = 8, 24
_TEXT = huffman_lengths([_text_weight(s) for s in range(280)])


@functools.lru_cache(maxsize=256)
def _grey_codes(lengths: tuple[int, ...], alpha: int, far: int):
    """(bits after the transforms up to the pixels, their number, codes, lengths): no cache, one group, one distance symbol."""
    w = Writer()
    for v, n in ((0, 1), (0, 1), (0, 1)):  # no more transforms, no cache, one group
        w.put(v, n)
    w.code(lengths, -1)
    for single in (0, 0, alpha, far):  # red, blue, alpha, distance
        w.code((), single)
    return w.value, w.n, canonical(lengths), np.array(lengths, np.int64)


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum())


def _predicted(samples: np.ndarray, width: int, counts: np.ndarray) -> tuple[int, np.ndarray]:
    """(mode, what it leaves): the pixel to the left (1) or above (2) as a guess where that has a tenth of a bit less entropy, else 0."""
    p = samples.reshape(-1, width)
    left, above = p.copy(), p.copy()
    left[:, 1:] -= p[:, :-1]
    left[1:, 0] -= p[:-1, 0]
    above[1:] -= p[:-1]
    above[0, 1:] -= p[0, :-1]
    found = min((_entropy(np.bincount(x.ravel(), minlength=256)) + 0.1, mode) for mode, x in ((1, left), (2, above)))
    return (0, samples) if found[0] >= _entropy(counts) else (found[1], (left if found[1] == 1 else above).ravel())


def _repeats(samples: np.ndarray) -> tuple[int, list[tuple[int, int, int]]]:
    """(distance symbol, copies (start, length, distance)): of all repeats those with the symbol that saves most."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(samples, SEEN)).view(np.uint64).ravel()
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    back = np.zeros(len(words), np.int64)
    back[order[1:][same]] = order[1:][same] - order[:-1][same]
    starts = np.flatnonzero(np.diff(back, prepend=-1))
    lengths, far = np.diff(np.append(starts, len(back))) + SEEN - 1, back[starts]
    good = (far > 0) & (lengths >= COPY)
    starts, lengths, far = starts[good], lengths[good], far[good]
    if not len(starts):
        return 1, []
    v = far + 119  # the distance code less one
    extra = np.floor(np.log2(v)).astype(np.int64) - 1
    symbol = 2 * (extra + 1) + (v >> extra & 1)
    best = int(np.bincount(symbol, 4 * lengths - 40).argmax())
    copies, end = [], 0
    for at, n, d in zip(*(x[symbol == best].tolist() for x in (starts, lengths, far)), strict=True):
        n, at = n - max(0, end - at), max(at, end)
        if n >= COPY:
            copies.append((at, n, d))
            end = at + n
    return best, copies


def _runs(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """Copies from the left, without their first pixels."""
    same = np.flatnonzero(np.diff(np.concatenate(([-1], samples.astype(np.int16), [-1]))))
    runs = np.diff(same)
    long = np.flatnonzero(runs >= 8)
    return [(at + 1, run - 1, 1) for at, run in zip(same[long].tolist(), runs[long].tolist(), strict=True)]


def _packed(w: Writer, samples: np.ndarray, width: int, colours: np.ndarray) -> tuple[np.ndarray, int]:
    """Writes the palette of a few greys; (samples of several pixels each, their width)."""
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(colours) - 1, 8)
    table = np.uint32(0xFF000000) | colours.astype(np.uint32) * np.uint32(0x010101)
    steps = np.diff(_planes(table), axis=0, prepend=np.zeros((1, 4), np.uint8))
    write_image(w, np.ascontiguousarray(steps.astype(np.uint8)).view(np.uint32).ravel(), len(colours), False)
    bits = _bundle(len(colours))
    across, each = -(-width >> bits), 8 >> bits
    index = np.zeros((len(samples) // width, across << bits), np.uint8)
    index[:, :width] = np.searchsorted(colours, samples).reshape(-1, width)
    index = index.reshape(-1, across, 1 << bits) << (np.arange(1 << bits, dtype=np.uint8) * np.uint8(each))
    return index.sum(axis=2, dtype=np.uint8).ravel(), across


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A WebP file of 8-bit grey samples, written by what suits them.

    Few values: a palette with several pixels to a sample.  Else subtract-green, and a predictor where it helps.  Copies are runs from
    the left or, in larger images, repeats at any distance of one prefix symbol, whichever saves more.  Codes are fitted
    to larger or transformed images; prose of a few rows takes one fixed code, which costs no tables.
    """
    height, w = len(samples) // width, Writer()
    _start(w, width, height)
    counts = np.bincount(samples, minlength=256)
    colours, alpha, fitted = np.flatnonzero(counts), 255, len(samples) >= FIT
    if len(colours) <= 16:
        samples, _ = _packed(w, samples, width, colours)
        fitted = True
    else:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        mode, samples = _predicted(samples, width, counts)
        if mode:
            block = 9
            w.put(1, 1)
            w.put(PREDICTOR, 2)
            w.put(block - 2, 3)
            across = -(-width >> block)
            write_image(w, np.full(across * -(-height >> block), mode << 8 | 0xFF000000, np.uint32), across, False)
            alpha, fitted = 0, True
    far, copies = 1, _runs(samples)
    if len(samples) >= MATCH:
        symbol, more = _repeats(samples)
        if sum(c[1] for c in more) > sum(c[1] for c in copies):
            far, copies = symbol, more
    keep, extra_value, extra_bits = np.ones(len(samples), bool), {}, {}
    kinds = samples.astype(np.int64)
    for start, n, d in copies:
        keep[start : start + n] = False
        for k in range(start, start + n, MAX_COPY):  # each in the place of its first pixel
            s, extra, bits = prefix_of(min(MAX_COPY, start + n - k))
            _, more, far_bits = (0, 0, 0) if far == 1 else prefix_of(d + 120)
            keep[k], kinds[k] = True, 256 + s
            extra_value[k], extra_bits[k] = extra | more << bits, bits + far_bits
    places = np.flatnonzero(keep)
    kinds = kinds[places]
    lengths = _TEXT
    if fitted:
        weights = np.bincount(kinds, minlength=280)
        weights[[k for k in (256, 257) if not weights[k]]] = 1  # two symbols at least
        lengths = huffman_lengths(weights.tolist(), 12)
    head, head_bits, codes, sizes = (_grey_codes if not fitted else _grey_codes.__wrapped__)(lengths, alpha, far)
    start, start_bits = w.value | head << w.n, w.n + head_bits
    value, bits = codes[kinds], sizes[kinds]
    if extra_bits:
        at = np.searchsorted(places, np.fromiter(extra_bits, np.int64, len(extra_bits)))
        value[at] |= np.fromiter(extra_value.values(), np.uint64, len(at)) << bits[at].astype(np.uint64)
        bits = bits.copy()
        bits[at] += np.fromiter(extra_bits.values(), np.int64, len(at))
    ends = np.cumsum(bits)
    begin = ends - bits + (start_bits & 63)
    word, shift = begin >> 6, (begin & 63).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(begin[-1] + bits[-1] >> 6) + 2, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(value << shift, first)
    last = np.append(first[1:], len(word)) - 1
    over = np.flatnonzero((begin[last] & 63) + bits[last] > 64)
    at = last[over]
    out[word[at] + 1] |= value[at] >> (np.uint64(64) - shift[at])
    whole = start_bits >> 6
    tail = start >> (whole * 64)
    out[0] |= np.uint64(tail)
    total = start_bits + int(ends[-1])
    stream = (start & ((1 << whole * 64) - 1)).to_bytes(whole * 8, "little") + out.tobytes()
    return riff(stream[: -(-total // 8)])
