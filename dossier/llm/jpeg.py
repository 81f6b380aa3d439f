"""Baseline JPEG in numpy: a decoder of the DC coefficients of the luminance, and an encoder that stores bytes as such images.

The decoder follows the format: it parses the markers, cuts the scan at its restart markers and Huffman-decodes all segments of
all given images side by side, one symbol of each at a time; the AC symbols are decoded and passed over. A block's
DC coefficient times its quantiser, over 8, plus 128, is its mean: one pixel of the thumbnail.

The encoder writes each byte as one 8x8 block of that grey: quantiser 8, DC the byte less 128, no AC. So the thumbnail of a stored
image is the stored bytes, exactly."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Blocks in a row of a stored image; payloads come in squares of it.
ROW = 24
UNIT = ROW * ROW
#: Blocks between restart markers, a part of UNIT.
RESTART = 72
#: A stored image has at most so many bytes: the format's sides end at 65535 pixels. Longer payloads are several images in a row.
MOST = 65535 // 8 // ROW * UNIT
#: Code lengths of the DC table (fixed values of the standard's example for luminance), for the categories 0 to 11.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = bytes(range(12))
#: The only AC symbol is the end of the block.
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = b"\0"


def codes(counts: tuple[int, ...], symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table as the format stores it."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(64)
def lookup(counts: tuple[int, ...], symbols: bytes) -> np.ndarray:
    """For each 16 bits, symbol * 32 + length of the code that they begin with; 0 if none."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, code, length in codes(counts, symbols):
        out[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
    return out


def marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


@lru_cache(1024)
def header(rows: int) -> bytes:
    """All that comes before the scan of a stored image of so many rows of blocks."""
    return b"".join([
        b"\xff\xd8",
        marker(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        marker(0xDB, bytes([0] + [8] * 64)),
        marker(0xC0, struct.pack(">BHHB3B", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)),
        marker(0xC4, bytes([0x00, *DC_COUNTS]) + DC_SYMBOLS),
        marker(0xC4, bytes([0x10, *AC_COUNTS]) + AC_SYMBOLS),
        marker(0xDD, struct.pack(">H", RESTART)),
        marker(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


_CODE = np.zeros(12, np.int64)
_BITS = np.zeros(12, np.int64)
for _symbol, _code, _length in codes(DC_COUNTS, DC_SYMBOLS):
    _CODE[_symbol], _BITS[_symbol] = _code, _length


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """Each payload (bytes, a positive multiple of UNIT) as JPEG images."""
    frames = [p[i : i + MOST] for p in payloads for i in range(0, len(p), MOST)]
    data = np.concatenate(frames).astype(np.int64) - 128
    before = np.empty_like(data)
    before[1:] = data[:-1]
    before[::RESTART] = 0
    diff = data - before
    size = np.frexp(np.abs(diff).astype(np.float32))[1].astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    # The code, the bits of the difference, and a 0 that ends the block.
    bits = _BITS[size] + size + 1
    value = ((_CODE[size] << size) + extra) << 1
    each = bits.reshape(-1, RESTART)
    ends = np.cumsum(each, axis=1)
    bytes_of = (ends[:, -1] + 7) // 8
    first = np.cumsum(bytes_of) - bytes_of
    at = (first[:, None] * 8 + ends - each).ravel()
    pad = bytes_of * 8 - ends[:, -1]
    at, bits, value = np.concatenate([at, first * 8 + ends[:, -1]]), np.concatenate([bits, pad]), np.concatenate([value, (1 << pad) - 1])
    value <<= 32 - (at & 7) - bits
    total = int(bytes_of.sum())
    packed = np.zeros(total + 4)
    for k in range(4):
        packed += np.bincount((at >> 3) + k, (value >> (24 - 8 * k)) & 255, total + 4)
    packed = packed[:total].astype(np.uint8)
    # A zero goes behind each 255, a marker behind each segment.
    full = packed == 255
    room = full.astype(np.int64)
    last = first + bytes_of - 1
    room[last] += 2
    place = np.arange(total) + np.cumsum(room) - room
    out = np.zeros(total + int(room.sum()), np.uint8)
    out[place] = packed
    mark = place[last] + 1 + full[last]
    segments = np.array([len(f) // RESTART for f in frames])
    stop = np.cumsum(segments)
    number = np.arange(len(last)) - np.repeat(stop - segments, segments)
    out[mark] = 255
    out[mark + 1] = 0xD0 + number % 8
    out[mark[stop - 1] + 1] = 0xD9
    done, start = [], 0
    for f, end in zip(frames, mark[stop - 1] + 2, strict=True):
        done.append(header(len(f) // ROW) + out[start:end].tobytes())
        start = end
    it = iter(done)
    return [b"".join(next(it) for _ in range(0, len(p), MOST)) for p in payloads]


@dataclass
class Frame:
    """What the markers of one image say."""

    width: int
    height: int
    components: tuple[tuple[int, int, int, int, int, int], ...]  # id, horizontal and vertical sampling, quantiser, DC and AC table
    quantisers: dict[int, int]
    tables: dict[int, tuple[tuple[int, ...], bytes]]
    restart: int
    scan: int
    end: int = 0


def parse(data: bytes, at: int = 0) -> Frame:
    """Reads the markers from SOI to SOS. ValueError if it is no baseline JPEG with one scan of all components."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, q, tables, restart, sof = at + 2, {}, {}, 0, None
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 255:
            raise ValueError("a marker is missing")
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("cut off")
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                q[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                counts = tuple(body[1:17])
                tables[body[0]] = (counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not 8-bit")
            sof = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])})
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("not baseline")
        elif kind == 0xDA:
            if sof is None or body[0] != len(sof[2]) or not sof[0] or not sof[1]:
                raise ValueError("not one scan of all components")
            parts = tuple((body[1 + 2 * i], *sof[2][body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
            return Frame(sof[0], sof[1], parts, q, tables, restart, at)


def blocks(f: Frame) -> tuple[list[int], int, int]:
    """The component of each block of an MCU, and the MCUs across and down."""
    if len(f.components) == 1:
        return [0], -(-f.width // 8), -(-f.height // 8)
    h, v = max(c[1] for c in f.components), max(c[2] for c in f.components)
    return [i for i, c in enumerate(f.components) for _ in range(c[1] * c[2])], -(-f.width // (8 * h)), -(-f.height // (8 * v))


def _scans(buffers: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All scans without stuffing and markers: the bytes, where each segment begins, the segments of each scan, and where each scan ends in its own buffer."""
    raw = np.concatenate([np.frombuffer(b, np.uint8, offset=at) for b, at in buffers])
    starts = np.cumsum([0] + [len(b) - at for b, at in buffers])
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    restart = full[(after >= 0xD0) & (after <= 0xD7)]
    other = full[(after != 0) & (after != 255) & ~((after >= 0xD0) & (after <= 0xD7))]
    keep = np.ones(len(raw), bool)
    keep[full[after == 0] + 1] = False
    keep[restart] = keep[restart + 1] = False
    begins, counts, ends = [], [], []
    for i in range(len(buffers)):
        k = np.searchsorted(other, starts[i])
        if k == len(other) or other[k] >= starts[i + 1]:
            raise ValueError("no end of the image")
        end = other[k]
        keep[end : starts[i + 1]] = False
        own = restart[np.searchsorted(restart, starts[i]) : np.searchsorted(restart, end)]
        begins.append(np.append(starts[i], own + 2))
        counts.append(len(own) + 1)
        ends.append(int(end - starts[i]) + buffers[i][1])
    place = np.cumsum(keep) - keep
    return np.append(raw[keep], np.full(16, 255, np.uint8)), place[np.concatenate(begins)], np.array(counts), ends


def luminance(buffers: list[tuple[bytes, Frame]]) -> list[np.ndarray]:
    """The thumbnail (rows, columns) of each image, one pixel for each luminance block. All frames have equal tables, components and restart intervals; .end is set."""
    f = buffers[0][1]
    order, _, _ = blocks(f)
    data, begins, counts, ends = _scans([(b, x.scan) for b, x in buffers])
    wide = np.ascontiguousarray(np.ndarray(len(data) - 8, ">u8", data.tobytes(), 0, (1,))).astype(np.uint64)
    mcus = np.array([np.prod(blocks(x)[1:]) for _, x in buffers])
    per = f.restart or int(mcus.max())
    if (counts != -(-mcus // per)).any():
        raise ValueError("restart markers are missing")
    which = np.repeat(np.arange(len(buffers)), counts)
    index = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    todo = np.minimum(per, mcus[which] - index * per)
    lanes = np.argsort(-todo, kind="stable")
    todo, bit = todo[lanes], begins[lanes].astype(np.int64) * 8
    most = len(wide) * 8 - 1
    tables = [(lookup(*f.tables[c[4]]), lookup(*f.tables[16 + c[5]])) for c in f.components]
    first = f.components[0]
    per_mcu = first[1] * first[2] if len(f.components) > 1 else 1
    out = np.zeros((len(lanes), int(todo[0]), per_mcu), np.int32)
    pred = np.zeros((len(f.components), len(lanes)), np.int64)
    six = np.uint64(48)

    def take(at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols at these bits, the 64 bits from there on, and the length of the codes."""
        if at.max() > most:
            raise ValueError("the scan is cut off")
        w = wide[at >> 3] << (at & 7).astype(np.uint64)
        e = table[w >> six]
        length = (e & 31).astype(np.int64)
        if not length.all():
            raise ValueError("no such code")
        return (e >> 5).astype(np.int64), w, length

    for m in range(int(todo[0])):
        n = int(np.searchsorted(-todo, -m, "left"))
        seen = 0
        for comp in order:
            dc, ac = tables[comp]
            size, w, length = take(bit[:n], dc)
            extra = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
            pred[comp, :n] += np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
            bit[:n] += length + size
            if comp == 0:
                out[:n, m, seen] = pred[0, :n]
                seen += 1
            symbol, _, length = take(bit[:n], ac)
            bit[:n] += length
            if symbol.any():
                active, k = np.arange(n), np.ones(n, np.int64)
                while True:
                    size = symbol & 15
                    bit[active] += size
                    k = np.where(symbol == 0, 64, k + (symbol >> 4) + 1)
                    more = k < 64
                    active, k = active[more], k[more]
                    if not len(active):
                        break
                    symbol, _, length = take(bit[active], ac)
                    bit[active] += length
    back = np.empty_like(out)
    back[lanes] = out
    done = []
    stop = np.cumsum(counts)
    for i, (_, x) in enumerate(buffers):
        _, across, down = blocks(x)
        dc = back[stop[i] - counts[i] : stop[i]].reshape(-1, per_mcu)[: across * down]
        h, v = (first[1], first[2]) if len(f.components) > 1 else (1, 1)
        plane = dc.reshape(down, across, v, h).swapaxes(1, 2).reshape(down * v, across * h)
        rows, columns = -(-x.height * v // (8 * max(c[2] for c in f.components))) if len(f.components) > 1 else down, -(-x.width * h // (8 * max(c[1] for c in f.components))) if len(f.components) > 1 else across
        x.end = ends[i]
        done.append(np.clip((plane[:rows, :columns] * f.quantisers[first[3]] + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return done


def decode(media: list[bytes]) -> list[list[tuple[Frame, np.ndarray]]]:
    """The images of each buffer, which may hold several in a row, with their thumbnails. Images with equal tables are decoded side by side."""
    out: list[list[tuple[Frame, np.ndarray]]] = [[] for _ in media]
    waiting = [(i, 0) for i in range(len(media))]
    while waiting:
        groups: dict[tuple, list[tuple[int, Frame]]] = {}
        for i, at in waiting:
            f = parse(media[i], at)
            groups.setdefault((f.components, tuple(sorted(f.tables.items())), tuple(sorted(f.quantisers.items())), f.restart), []).append((i, f))
        waiting = []
        for group in groups.values():
            for (i, f), thumb in zip(group, luminance([(media[i], f) for i, f in group]), strict=True):
                out[i].append((f, thumb))
                if media[i][f.end : f.end + 2] != b"\xff\xd9":
                    raise ValueError("no end of the image")
                if f.end + 2 < len(media[i]):
                    waiting.append((i, f.end + 2))
    return out
