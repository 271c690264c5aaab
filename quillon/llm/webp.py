"""Lossless WebP (VP8L): a decoder of the whole format, and an encoder that can use each part of it.

Pixels are arrays of shape (height, width, 4) and type uint8 in the order alpha, red, green, blue.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, COLOR_INDEXING = range(4)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
MAX_SIDE, MAX_LENGTH, CACHE_HASH = 16384, 4096, 0x1E35A7BD
#: The near places, nearest first: those left in the same row and up to seven rows above.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
ALPHA, RED, GREEN, BLUE = range(4)
#: Modes of prediction: from the pixel to the left, and from the one above.
LEFT, TOP = 1, 2


class BadImage(ValueError):
    """Bytes that aren't a lossless WebP image."""


# Prefix codes


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of an optimal prefix code; counts are flattened until none is over most."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    weights = counts[used].tolist()
    while True:
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for node in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (a + b, node))
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= most:
            lengths[used] = depth[:n]
            return lengths
        weights = [w // 2 + 1 for w in weights]


@lru_cache(maxsize=16)
def mirror(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def in_code_order(lengths: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """The symbols in the order of their codes, the longest length, and the share of a table that each takes."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    most = int(lengths[used[-1]])
    return used, most, 1 << (most - lengths[used].astype(np.int64))


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol with its first bit lowest, as the format stores it."""
    codes = np.zeros(len(lengths), np.uint32)
    if lengths.any():
        used, most, shares = in_code_order(lengths)
        codes[used] = mirror(most)[np.cumsum(shares) - shares]
    return codes


class Prefix:
    """A prefix code as a table over the next `bits` bits: the symbol, and how many bits it takes."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            used = np.zeros(1, int)
        if len(used) == 1:
            self.bits, self.symbols, self.sizes = 0, used[:1].astype(np.int32), np.zeros(1, np.uint8)
            return
        used, self.bits, shares = in_code_order(lengths)
        if shares.sum() != 1 << self.bits:
            raise BadImage("a prefix code isn't complete")
        order = mirror(self.bits)
        self.symbols = np.repeat(used.astype(np.int32), shares)[order]
        self.sizes = np.repeat(lengths[used], shares)[order]


@lru_cache(maxsize=512)
def single(symbol: int) -> Prefix:
    """The code of one symbol, which takes no bits."""
    lengths = np.zeros(symbol + 1, np.uint8)
    lengths[symbol] = 1
    return Prefix(lengths)


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.padded = data + bytes(12)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.padded[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise BadImage("the image ends early")
        return v

    def symbol(self, code: Prefix) -> int:
        if not code.bits:
            return int(code.symbols[0])
        v = self.peek(code.bits)
        self.at += int(code.sizes[v])
        if self.at > 8 * len(self.data):
            raise BadImage("the image ends early")
        return int(code.symbols[v])


class BitWriter:
    """Fields of bits, lowest first, in order."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.held: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.held.append((value, n))

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.values.append(values)
        self.sizes.append(sizes)

    def _flush(self) -> None:
        if self.held:
            v, n = zip(*self.held, strict=True)
            self.values.append(np.array(v, np.uint32))
            self.sizes.append(np.array(n, np.uint8))
            self.held = []

    def done(self) -> bytes:
        self._flush()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        shifted = values.astype(np.int64) << (starts & 7)
        first, n = starts >> 3, (int(ends[-1]) + 7 >> 3) + 4
        sums = np.zeros(n)
        for i in range(-(-(int(sizes.max()) + 7) // 8)):  # no bit is set twice, so sums are unions
            sums += np.bincount(first + i, shifted >> 8 * i & 255, n)
        return sums[: n - 4].astype(np.uint8).tobytes()


def read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        second = bits.read(8) if two else first
        if max(first, second) >= size:
            raise BadImage("a symbol outside its alphabet")
        if first == second:
            return single(first)
        lengths[[first, second]] = 1
        return Prefix(lengths)
    inner = np.zeros(19, np.uint8)
    for i in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        inner[i] = bits.read(3)
    code = Prefix(inner)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    start = bits.at >> 3
    ahead, place = int.from_bytes(bits.padded[start : start + 4 * size], "little"), bits.at & 7
    symbols, sizes, mask = code.symbols.tolist(), code.sizes.tolist(), (1 << code.bits) - 1
    values: list[int] = []
    while at < size and most:
        most -= 1
        v = ahead >> place
        s, n = symbols[v & mask], sizes[v & mask]
        place += n
        if s < 16:
            values.append(s)
            at, before = at + 1, s or before
            continue
        v >>= n
        k, more, of = ((v & 3) + 3, 2, before) if s == 16 else ((v & 7) + 3, 3, 0) if s == 17 else ((v & 127) + 11, 7, 0)
        place += more
        at += k
        values += [of] * k
    bits.at = 8 * start + place
    if at > size or bits.at > 8 * len(bits.data):
        raise BadImage("code lengths past the alphabet or the image")
    lengths[: len(values)] = values
    return Prefix(lengths)


def write_single(out: BitWriter, symbol: int) -> None:
    out.put(1, 1)
    out.put(0, 1)
    out.put(int(symbol > 1), 1)
    out.put(symbol, 8 if symbol > 1 else 1)


def write_prefix(out: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        return write_single(out, int(used[0]) if len(used) else 0)
    if len(used) == 2 and used[1] < 256:
        out.put(3 + 4 * int(used[0] > 1), 3)
        out.put(int(used[0]), 8 if used[0] > 1 else 1)
        out.put(int(used[1]), 8)
        return None
    tokens: list[tuple[int, int, int]] = []
    values = lengths[: used[-1] + 1]
    first, last = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])), None
    before = 8
    for v, n in zip(values[first].tolist(), np.diff(np.append(first, len(values))).tolist(), strict=True):
        if v and v != before:
            tokens.append((v, 0, 0))
            n, before = n - 1, v
        while n:
            if v:
                k = min(n, 6) if n >= 3 else 1
                tokens.append((16, k - 3, 2) if k >= 3 else (v, 0, 0))
            else:
                k = min(n, 138) if n >= 3 else 1
                tokens.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3) if k >= 3 else (0, 0, 0))
            n -= k
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    inner = code_lengths(counts, 7)
    codes = reversed_codes(inner).tolist()
    single = int((inner > 0).sum()) == 1
    shown = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if inner[s]) + 1
    shown = max(4, shown)
    out.put(0, 1)
    out.put(shown - 4, 4)
    for s in CODE_LENGTH_ORDER[:shown]:
        out.put(int(inner[s]), 3)
    n = len(tokens)
    out.put(1, 1)
    wide = max(2, (max(0, n - 2)).bit_length() + (max(0, n - 2)).bit_length() % 2)
    out.put((wide - 2) // 2, 3)
    if n < 2:  # at least two are counted: a zero behind the last symbol does no harm
        raise BadImage("a code of one length")
    out.put(n - 2, wide)
    inner = inner.tolist()
    for s, extra, k in tokens:
        if not single:
            out.put(codes[s], inner[s])
        if k:
            out.put(extra, k)


def prefix_of(value: int) -> tuple[int, int, int]:
    """The prefix symbol of a length or distance value, its further bits, and how many they are."""
    if value < 5:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    k = high - 1
    return 2 * high + second, v & ((1 << k) - 1), k


def read_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    k = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << k) + bits.read(k) + 1


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


@lru_cache(maxsize=64)
def distance_codes(width: int) -> dict[int, int]:
    """The smallest code of each near distance."""
    out: dict[int, int] = {}
    for i in range(120, 0, -1):
        out[distance_of(i, width)] = i
    return out


# Decoding


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25 or data[20] != 0x2F:
        raise BadImage("no lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("another version")
    transforms, seen, w = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform twice")
        seen.add(kind)
        if kind == COLOR_INDEXING:
            n = bits.read(8) + 1
            palette = np.cumsum(_image(bits, n, 1, False), axis=0, dtype=np.uint8)
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, w, packed, palette))
            w = -(-w >> packed)
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, w, 0, None))
        else:
            block = bits.read(3) + 2
            across, down = -(-w >> block), -(-height >> block)
            transforms.append((kind, w, block, _image(bits, across, down, False).reshape(down, across, 4)))
    pixels = _image(bits, w, height, True).reshape(height, w, 4)
    for kind, w, block, more in reversed(transforms):
        pixels = (undo_predictor, undo_cross_color, lambda p, *_: undo_subtract_green(p), undo_color_indexing)[kind](pixels, w, block, more)
    return pixels


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The pixels of an entropy-coded image in reading order, shape (n, 4)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("too large a colour cache")
    groups, block, meta = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        codes = _image(bits, across, -(-height >> block), False)
        meta = (codes[:, RED].astype(int) << 8 | codes[:, GREEN]).reshape(-1, across)
        groups = int(meta.max()) + 1
    cache = 1 << cache_bits if cache_bits else 0
    prefixes = [[read_prefix(bits, n + (cache if i == 0 else 0)) for i, n in enumerate(ALPHABETS)] for _ in range(groups)]
    n = width * height
    if groups == 1 and not cache and not any(p.bits for p in prefixes[0][1:4]):
        return _green_only(bits, prefixes[0], width, n)
    return _any_image(bits, prefixes, width, n, cache_bits, meta, block)


def _green_only(bits: Bits, codes: list[Prefix], width: int, n: int) -> np.ndarray:
    """An image whose other channels are constant: the sizes of the codes at every bit at once, then from code to code."""
    green, rest = codes[0], codes[4]
    out = np.empty((n, 4), np.uint8)
    out[:, RED], out[:, BLUE], out[:, ALPHA] = (int(c.symbols[0]) for c in codes[1:4])
    if not green.bits:
        if green.symbols[0] >= 256:
            raise BadImage("an image of copies only")
        out[:, GREEN] = green.symbols[0]
        return out
    values = np.empty(n, np.uint8)
    base = bits.at
    raw = np.frombuffer(bits.padded, np.uint8)[base >> 3 :].astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    index = (words[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32((1 << green.bits) - 1)).ravel().view(np.int32)
    # from each bit to the next code, to the 2nd, 4th and 8th; what isn't a literal leads to itself
    last = len(index)
    step = np.where(green.symbols < 256, green.sizes, 0).astype(np.int32)
    first = np.arange(last + 1, dtype=np.int32)
    first[:-1] += step[index]
    jumps = [np.minimum(first, last, out=first)]
    for _ in range(3):
        jumps.append(jumps[-1].take(jumps[-1]))
    far = memoryview(jumps[3])
    at, done, offset = base & 7, 0, base & ~7
    limit = 8 * len(bits.data) - offset
    while done < n:
        places, left = [at], (n - done) >> 3
        while left and (after := far[at]) != at:
            places.append(after)
            at = after
            left -= 1
        path = np.array(places)
        for jump in jumps[2::-1]:
            path = np.stack([path, jump[path]], 1).ravel()
        stop = np.flatnonzero(path[1:] == path[:-1])
        path = path[: min(n - done, stop[0] if len(stop) else len(path))]
        values[done : done + len(path)] = green.symbols[index[path]]
        done += len(path)
        at = int(jumps[0][path[-1]]) if len(path) else at
        if at > limit:
            raise BadImage("the image ends early")
        if done < n:
            bits.at = at + offset
            length = read_value(bits, bits.symbol(green) - 256)
            distance = distance_of(read_value(bits, bits.symbol(rest)), width)
            if distance > done or done + length > n:
                raise BadImage("a copy from outside")
            if distance >= length:
                values[done : done + length] = values[done - distance : done - distance + length]
            else:
                values[done : done + length] = np.tile(values[done - distance : done], -(-length // distance))[:length]
            done += length
            at = bits.at - offset
    bits.at = at + offset
    out[:, GREEN] = values
    return out


def _any_image(bits: Bits, prefixes: list[list[Prefix]], width: int, n: int, cache_bits: int, meta: np.ndarray | None, block: int) -> np.ndarray:
    pixels = [0] * n
    cache = [0] * (1 << cache_bits)
    cached = at = 0
    codes = prefixes[0]

    def remember(upto: int) -> None:
        nonlocal cached
        while cache_bits and cached < upto:
            p = pixels[cached]
            cache[(p * CACHE_HASH & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached += 1

    while at < n:
        if meta is not None:
            codes = prefixes[meta[at // width >> block, at % width >> block]]
        s = bits.symbol(codes[0])
        if s < 256:
            red, blue, alpha = (bits.symbol(c) for c in codes[1:4])
            pixels[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = read_value(bits, s - 256)
            distance = distance_of(read_value(bits, bits.symbol(codes[4])), width)
            if distance > at or at + length > n:
                raise BadImage("a copy from outside")
            for i in range(at, at + length):
                pixels[i] = pixels[i - distance]
            at += length
        else:
            remember(at)
            pixels[at] = cache[s - 280]
            at += 1
    return np.array(pixels, ">u4").view(np.uint8).reshape(n, 4)


# Transforms


def _average(a, b):
    return (a + b) >> 1


def _predicted(mode: int, left, top, corner, right):
    """The prediction of a pixel from its neighbours, int arrays of shape (..., 4)."""
    if mode == 0 or mode > 13:
        out = np.zeros_like(top)
        out[..., ALPHA] = 255
        return out
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode < 10:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        from_left = np.abs(top - corner).sum(-1, keepdims=True)  # of the estimate left + top - corner
        from_top = np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(from_left < from_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = _average(left, top)
    return np.clip(mean + np.trunc((mean - corner) / 2).astype(mean.dtype), 0, 255)


def _row_modes(modes: np.ndarray, y: int, width: int, block: int) -> np.ndarray:
    return np.repeat(modes[y >> block, :, GREEN], 1 << block)[:width]


def undo_predictor(pixels: np.ndarray, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    out = pixels.astype(np.int32)
    height = len(out)
    out[0, 0] = (out[0, 0] + [255, 0, 0, 0]) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    if len(every := np.unique(modes[..., GREEN])) == 1 and every[0] in (LEFT, TOP):  # sums along a row or down a column
        if every[0] == TOP:
            return (np.cumsum(out, axis=0) & 255).astype(np.uint8)
        out[:, 0] = np.cumsum(out[:, 0], axis=0)
        out[1:] = np.cumsum(out[1:], axis=1)
        return (out & 255).astype(np.uint8)
    for y in range(1, height):
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        mode_of = _row_modes(modes, y, width, block).tolist()
        above, row = out[y - 1], out[y]
        for x in range(1, width):
            right = above[x + 1] if x + 1 < width else row[0]
            row[x] = (row[x] + _predicted(mode_of[x], row[x - 1], above[x], above[x - 1], right)) & 255
    return out.astype(np.uint8)


def apply_predictor(pixels: np.ndarray, block: int, modes: np.ndarray) -> np.ndarray:
    p = pixels.astype(np.int32)
    height, width = p.shape[:2]
    out = p.copy()
    out[0, 0] -= [255, 0, 0, 0]
    out[0, 1:] -= p[0, :-1]
    out[1:, 0] -= p[:-1, 0]
    for y in range(1, height):
        mode_of = _row_modes(modes, y, width, block)[1:]
        above, row = p[y - 1], p[y]
        right = np.concatenate([above[2:], row[:1]])[: width - 1]
        for m in np.unique(mode_of):
            at = np.flatnonzero(mode_of == m) + 1
            out[y, at] -= _predicted(int(m), row[at - 1], above[at], above[at - 1], right[at - 1])
    return (out & 255).astype(np.uint8)


def _cross(factors: np.ndarray, channel: np.ndarray) -> np.ndarray:
    return (factors.astype(np.int8).astype(np.int32) * channel.astype(np.int8).astype(np.int32)) >> 5


def _per_pixel(elements: np.ndarray, height: int, width: int, block: int) -> np.ndarray:
    return np.repeat(np.repeat(elements, 1 << block, 0), 1 << block, 1)[:height, :width]


def undo_cross_color(pixels: np.ndarray, width: int, block: int, elements: np.ndarray) -> np.ndarray:
    e = _per_pixel(elements, len(pixels), width, block)
    out = pixels.copy()
    red = pixels[..., RED] + _cross(e[..., BLUE], pixels[..., GREEN])
    out[..., RED] = red & 255
    out[..., BLUE] = (pixels[..., BLUE] + _cross(e[..., GREEN], pixels[..., GREEN]) + _cross(e[..., RED], out[..., RED])) & 255
    return out


def apply_cross_color(pixels: np.ndarray, block: int, elements: np.ndarray) -> np.ndarray:
    e = _per_pixel(elements, *pixels.shape[:2], block)
    out = pixels.copy()
    out[..., RED] = (pixels[..., RED] - _cross(e[..., BLUE], pixels[..., GREEN])) & 255
    out[..., BLUE] = (pixels[..., BLUE] - _cross(e[..., GREEN], pixels[..., GREEN]) - _cross(e[..., RED], pixels[..., RED])) & 255
    return out


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    out = pixels.copy()
    out[..., [RED, BLUE]] += pixels[..., GREEN : GREEN + 1]
    return out


def undo_color_indexing(pixels: np.ndarray, width: int, packed: int, palette: np.ndarray) -> np.ndarray:
    index, each = pixels[..., GREEN], 8 >> packed
    if packed:
        index = (index[..., None] >> np.arange(0, 8, each) & (1 << each) - 1).reshape(len(pixels), -1)[:, :width]
    colors = np.zeros((256, 4), np.uint8)  # an index past the palette is transparent black
    colors[: len(palette)] = palette
    return colors[index]


# Encoding


def find_copies(values: bytes, at_least: int = 16) -> list[tuple[int, int, int]]:
    """Place, length and distance of copies: whole lines that came before, and runs of one value."""
    out, seen, at = [], {}, 0
    for line in values.split(b"\n"):
        n = len(line)
        if n >= at_least:
            if line in seen:
                out.append((at, n, at - seen[line]))
            else:
                head = line.rstrip(line[-1:])
                if n - len(head) > at_least:
                    out.append((at + len(head) + 1, n - len(head) - 1, 1))
            seen[line] = at
        at += n + 1
    return [(p + s, min(MAX_LENGTH, n - s), d) for p, n, d in out for s in range(0, n, MAX_LENGTH)]


def write_green(out: BitWriter, values: np.ndarray, width: int, others: tuple[int, int, int], copies: list[tuple[int, int, int]]) -> None:
    """The main image, without colour cache and with one group of codes, whose red, blue and alpha are others."""
    near = distance_codes(width) if copies else {}
    fields, literal = [], np.ones(len(values), bool)
    counts, far = np.zeros(ALPHABETS[0], np.int64), np.zeros(ALPHABETS[4], np.int64)
    for p, n, d in copies:
        a, b = prefix_of(n), prefix_of(near.get(d, d + 120))
        counts[256 + a[0]] += 1
        far[b[0]] += 1
        literal[p : p + n] = False
        fields.append((p, a, b))
    counts[:256] += np.bincount(values[literal] if copies else values, minlength=256)
    lengths, far_lengths = code_lengths(counts), code_lengths(far)
    if (lengths > 0).sum() <= 2 and np.flatnonzero(lengths)[-1] >= 256:  # such a code has no short form
        return write_green(out, values, width, others, [])
    out.put(0, 2)  # no colour cache, one group of codes
    write_prefix(out, lengths)
    for v in others:
        write_single(out, v)
    write_prefix(out, far_lengths)
    codes, far_codes = reversed_codes(lengths), reversed_codes(far_lengths)
    if (lengths > 0).sum() == 1:
        return
    one_far = (far_lengths > 0).sum() == 1
    at = 0
    for p, (a, more_a, k_a), (b, more_b, k_b) in fields:
        if p > at:
            out.put_all(codes[values[at:p]], lengths[values[at:p]])
        out.put(int(codes[256 + a]), int(lengths[256 + a]))
        out.put(more_a, k_a)
        if not one_far:
            out.put(int(far_codes[b]), int(far_lengths[b]))
        out.put(more_b, k_b)
        at = p + (a + 1 if a < 4 else ((2 + (a & 1)) << k_a) + more_a + 1)
    if at < len(values):
        out.put_all(codes[values[at:]], lengths[values[at:]])


def write_any(out: BitWriter, pixels: np.ndarray, cache_bits: int = 0, meta: tuple[int, np.ndarray] | None = None, main: bool = False) -> None:
    """An entropy-coded image with four channels, a colour cache, and groups of codes by blocks: meta (block, group of each)."""
    height, width = pixels.shape[:2]
    words = pixels.reshape(-1, 4).astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups, group = 1, np.zeros(len(words), int)
    if main:
        out.put(int(meta is not None), 1)
        if meta is not None:
            block, of = meta
            out.put(block - 2, 3)
            image = np.zeros((*of.shape, 4), np.uint8)
            image[..., RED], image[..., GREEN] = of >> 8, of & 255
            write_any(out, image)
            groups = int(of.max()) + 1
            group = np.repeat(np.repeat(of, 1 << block, 0), 1 << block, 1)[:height, :width].ravel()
    cache, tokens = {}, []
    for g, p in zip(group.tolist(), words.tolist(), strict=True):
        slot = (p * CACHE_HASH & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else -1
        if cache_bits and cache.get(slot, 0) == p:
            tokens.append((g, (280 + slot,)))
        else:
            tokens.append((g, (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)))
            cache[slot] = p
    sizes = [ALPHABETS[0] + ((1 << cache_bits) if cache_bits else 0), *ALPHABETS[1:]]
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]
    for g, symbols in tokens:
        for c, s in zip(counts[g], symbols, strict=False):
            c[s] += 1
    for c in counts:
        if np.count_nonzero(c[0]) <= 2 and c[0][256:].any():  # such a code has no short form
            c[0][:3] += 1
    lengths = [[code_lengths(c) for c in of] for of in counts]
    codes = [[reversed_codes(n) for n in of] for of in lengths]
    for of in lengths:
        for n in of:
            write_prefix(out, n)
    for g, symbols in tokens:
        for c, n, s in zip(codes[g], lengths[g], symbols, strict=False):
            if np.count_nonzero(n) > 1:
                out.put(int(c[s]), int(n[s]))


def _file(out: BitWriter) -> bytes:
    body = b"\x2f" + out.done()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _header(width: int, height: int) -> BitWriter:
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise BadImage(f"no image is {width} x {height}")
    out = BitWriter()
    for value, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out


def _bits(flat: np.ndarray) -> float:
    """The bits that an ideal code of single values takes."""
    n = np.bincount(flat, minlength=256)
    n = n[n > 0]
    return float(n @ np.log2(n.sum() / n))


def best_prediction(values: np.ndarray, copies: list[tuple[int, int, int]] = ()) -> tuple[int, np.ndarray] | None:
    """The mode that leaves the least bits and the green residuals; None where single values beside the copies take less."""
    plain = values.ravel()
    literal = np.ones(len(plain), bool)
    for p, n, _ in copies:
        literal[p : p + n] = False
    least, best = 0.9 * _bits(plain[literal]), None
    for mode in (LEFT, TOP):
        left = values.copy()
        left[0, 1:] -= values[0, :-1]
        left[1:, 0] -= values[:-1, 0]
        left[1:, 1:] -= values[1:, :-1] if mode == LEFT else values[:-1, 1:]
        if (size := _bits(left.ravel())) < least:
            least, best = size, (mode, left)
    return best


def encode_gray(values: np.ndarray) -> bytes:
    """A file whose green is values (height, width), red and blue 0, alpha 255.

    Up to 16 different values become a palette with 2 to 8 pixels in each stored one; else copies stand for lines that came
    before and for runs, or all values are predicted from the left or from above where that takes less.
    """
    height, width = values.shape
    out, colors, copies = _header(width, height), np.flatnonzero(np.bincount(values.ravel(), minlength=256)), None
    flat = values.ravel()
    if len(colors) <= 16:
        packed = 3 if len(colors) <= 2 else 2 if len(colors) <= 4 else 1
        index, each, per = np.searchsorted(colors, values), 8 >> packed, 1 << packed
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        flat = (index << np.arange(0, 8, each)).sum(-1).astype(np.uint8)
        width = flat.shape[1]
        flat = flat.ravel()
        out.put(1 | COLOR_INDEXING << 1, 3)
        out.put(len(colors) - 1, 8)
        table = np.zeros((1, len(colors), 4), np.uint8)
        table[0, :, GREEN], table[0, 0, ALPHA] = np.diff(colors, prepend=0), 255
        write_any(out, table)
        others = (0, 0, 0)
    elif best := best_prediction(values, copies := find_copies(flat.tobytes())):
        mode, values = best
        flat, others, copies = values.ravel(), (0, 0, 0), None
        block = min(9, max(2, max(height, width).bit_length()))
        elements = np.zeros((-(-height >> block), -(-width >> block), 4), np.uint8)
        elements[..., GREEN], elements[..., ALPHA] = mode, 255
        out.put(1 | PREDICTOR << 1, 3)
        out.put(block - 2, 3)
        write_any(out, elements)
    else:
        others = (0, 0, 255)
    out.put(0, 1)  # no further transform
    write_green(out, flat, width, others, find_copies(flat.tobytes()) if copies is None else copies)
    return _file(out)


def encode(pixels: np.ndarray, predictor: tuple[int, np.ndarray] | None = None, cross: tuple[int, np.ndarray] | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, meta: tuple[int, np.ndarray] | None = None) -> bytes:
    """A file of the pixels with the transforms asked for; predictor and cross: block bits and an element for each block."""
    height, width = pixels.shape[:2]
    out = _header(width, height)
    if palette:
        words = pixels.reshape(-1, 4).astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)
        colors, index = np.unique(words, return_inverse=True)
        n, index = len(colors), index.reshape(height, width)
        packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        per = 1 << packed
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        colors = colors.astype(">u4").view(np.uint8).reshape(1, n, 4)
        out.put(1 | COLOR_INDEXING << 1, 3)
        out.put(n - 1, 8)
        write_any(out, np.diff(colors, axis=1, prepend=np.zeros((1, 1, 4), np.uint8)))
        pixels = np.zeros((height, index.shape[1], 4), np.uint8)
        pixels[..., GREEN] = (index << np.arange(0, 8, 8 >> packed)).sum(-1)
        width = pixels.shape[1]
    if subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        pixels = pixels.copy()
        pixels[..., [RED, BLUE]] -= pixels[..., GREEN : GREEN + 1]
    for kind, given, apply in ((CROSS_COLOR, cross, apply_cross_color), (PREDICTOR, predictor, apply_predictor)):
        if given is not None:
            block, elements = given
            out.put(1 | kind << 1, 3)
            out.put(block - 2, 3)
            write_any(out, elements)
            pixels = apply(pixels, block, elements)
    out.put(0, 1)
    write_any(out, pixels, cache_bits, meta, main=True)
    return _file(out)
