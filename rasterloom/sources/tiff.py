"""A TIFF and GeoTIFF codec in numpy: what the sources and sinks need, and loud refusal of the rest.

Reads classic and BigTIFF, either byte order, strips and tiles, chunky and planar, uncompressed,
LZW, deflate and PackBits, with the horizontal predictor; writes tiled one-band files.
"""

from __future__ import annotations

import struct
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}


def opener(path: str) -> Callable[[int, int], bytes]:
    """``read(offset, length)`` for a local file or, by ranged requests, for an http(s) URL."""
    if path.startswith(("http://", "https://")):

        def remote(offset: int, length: int) -> bytes:
            ask = urllib.request.Request(path, headers={"Range": f"bytes={offset}-{offset + length - 1}"})
            with urllib.request.urlopen(ask) as answer:
                return answer.read() if answer.status == 206 else answer.read()[offset : offset + length]

        return remote
    local = path.removeprefix("file://")

    def read(offset: int, length: int) -> bytes:
        with open(local, "rb") as f:
            f.seek(offset)
            return f.read(length)

    return read


@dataclass
class Tiff:
    """The first image of a file: its shape, layout, georeference and where its blocks are."""

    path: str
    width: int
    height: int
    count: int
    dtype: str
    block: tuple[int, int]
    compression: int
    predictor: int
    planar: int
    offsets: tuple[int, ...] = field(repr=False)
    sizes: tuple[int, ...] = field(repr=False)
    transform: tuple[float, ...] | None = None
    crs: str | None = None
    nodata: float | None = None

    @property
    def grid(self) -> tuple[int, int]:
        """Rows and columns of blocks."""
        return -(-self.height // self.block[0]), -(-self.width // self.block[1])

    def read_block(self, band: int, row: int, col: int, read: Callable[[int, int], bytes] | None = None) -> np.ndarray:
        """Band ``band`` (from 1) of a block, cut to the image."""
        read = read or opener(self.path)
        rows, cols = self.grid
        k = row * cols + col + ((band - 1) * rows * cols if self.planar == 2 else 0)
        h, w = self.block
        h = h if self.tiled else min(h, self.height - row * h)
        n = 1 if self.planar == 2 else self.count
        kind = np.dtype(self.dtype)
        if self.sizes[k] == 0:
            return np.zeros((min(self.block[0], self.height - row * self.block[0]), min(w, self.width - col * w)), kind)
        data = _unpack(read(self.offsets[k], self.sizes[k]), self.compression, h * w * n * kind.itemsize)
        cube = np.frombuffer(data, kind, h * w * n).reshape(h, w, n)
        if self.predictor == 2:
            cube = np.cumsum(cube, axis=1, dtype=kind.newbyteorder("="))
        out = cube[:, :, 0 if self.planar == 2 else band - 1]
        return out[: self.height - row * self.block[0], : self.width - col * w].astype(kind.newbyteorder("="))

    tiled: bool = True


def _lzw(data: bytes) -> bytes:
    out, at, bits, held = [], 0, 9, 0
    have = 0
    table: list[bytes] = []
    previous = b""
    while True:
        while have < bits:
            if at >= len(data):
                return b"".join(out)
            held, have, at = (held << 8 | data[at]) & 0xFFFFFFFF, have + 8, at + 1
        code = held >> (have - bits) & ((1 << bits) - 1)
        have -= bits
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, bits, previous = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else previous + previous[:1]
        out.append(entry)
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        size = len(table) + 1
        bits = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 5:
        return _lzw(data)
    if compression == 32773:
        return _packbits(data)
    raise ValueError(f"TIFF compression {compression} isn't supported")


def open_tiff(path: str) -> Tiff:
    """The header of a file; ValueError for what isn't a TIFF or can't be read here."""
    read = opener(path)
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise ValueError(f"{path} is no TIFF")
    version = struct.unpack(order + "H", head[2:4])[0]
    if version not in (42, 43):
        raise ValueError(f"{path} is no TIFF (version {version})")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    n = struct.unpack(order + ("Q" if big else "H"), read(at, 8 if big else 2))[0]
    size, start = (20, at + 8) if big else (12, at + 2)
    raw = read(start, n * size)
    tags: dict[int, tuple] = {}
    for k in range(n):
        entry = raw[k * size : (k + 1) * size]
        tag, kind, many = struct.unpack(order + ("HHQ" if big else "HHI"), entry[: 12 if big else 8])
        if kind not in _TYPES:
            continue
        form = _TYPES[kind]
        length = many * struct.calcsize(order + form)
        value = entry[12 if big else 8 :]
        if length > len(value):
            value = read(struct.unpack(order + ("Q" if big else "I"), value)[0], length)
        value = value[:length]
        tags[tag] = (value.split(b"\0")[0].decode("latin-1"),) if kind == 2 else struct.unpack(order + f"{many * len(form)}{form[0]}", value)
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, count = one(256), one(257), one(277, 1)
    bits, fmt = set(tags.get(258, (1,))), set(tags.get(339, (1,)))
    if len(bits) > 1 or len(fmt) > 1 or bits.pop() not in (8, 16, 32, 64) or next(iter(fmt)) not in _KINDS:
        raise ValueError(f"{path} has samples of a kind that isn't supported")
    predictor = one(317, 1)
    dtype = f"{order}{_KINDS[fmt.pop()]}{tags.get(258, (8,))[0] // 8}"
    if predictor not in (1, 2) or predictor == 2 and "f" in dtype:
        raise ValueError(f"TIFF predictor {predictor} isn't supported")
    tiled = 322 in tags
    block = (one(323), one(322)) if tiled else (min(one(278, height), height), width)
    transform = None
    if 34264 in tags:
        m = tags[34264]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in tags and 33922 in tags:
        (sx, sy), (i, j, _, x, y) = tags[33550][:2], tags[33922][:5]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    crs = None
    keys = tags.get(34735, ())
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (2048, 3072) and keys[k + 1] == 0 and keys[k + 3] not in (0, 32767):
            crs = f"EPSG:{keys[k + 3]}"
    text = one(42113)
    nodata = float(text) if text is not None and text.strip() else None
    return Tiff(path, width, height, count, dtype, block, one(259, 1), predictor, one(284, 1), tags.get(324 if tiled else 273), tags.get(325 if tiled else 279), transform, crs, nodata, tiled)


def write_tiff(path: str, blocks: Iterator[tuple[int, int, np.ndarray]], width: int, height: int, dtype: str = "u1", tile: int = 256, transform: tuple[float, ...] | None = None, crs: str | None = None, nodata: float | None = None) -> None:
    """A tiled one-band deflate BigTIFF from (tile row, tile column, array) in any order; tiles that don't come are empty."""
    kind = np.dtype(dtype).newbyteorder("<")
    rows, cols = -(-height // tile), -(-width // tile)
    offsets, sizes = [0] * (rows * cols), [0] * (rows * cols)
    with open(path, "wb") as out:
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        for r, c, data in blocks:
            full = np.zeros((tile, tile), kind)
            full[: data.shape[0], : data.shape[1]] = data
            packed = zlib.compress(full.tobytes(), 6)
            k = r * cols + c
            offsets[k], sizes[k] = out.tell(), len(packed)
            out.write(packed)
        tags: list[tuple[int, int, int, bytes]] = []

        def tag(number: int, form: int, *values) -> None:
            data = values[0] if form == 2 else struct.pack(f"<{len(values)}{_TYPES[form]}", *values)
            tags.append((number, form, len(data) if form == 2 else len(values), data))

        tag(256, 4, width)
        tag(257, 4, height)
        tag(258, 3, kind.itemsize * 8)
        tag(259, 3, 8)
        tag(262, 3, 1)
        tag(277, 3, 1)
        tag(284, 3, 1)
        tag(322, 3, tile)
        tag(323, 3, tile)
        tag(324, 16, *offsets)
        tag(325, 16, *sizes)
        tag(339, 3, {"u": 1, "i": 2, "f": 3}[kind.kind])
        if transform:
            a, b, c, d, e, f = transform
            tag(34264, 12, a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
        if crs and crs.upper().startswith("EPSG:"):
            code = int(crs[5:])
            geographic = 4000 <= code < 5000
            tag(34735, 3, 1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code)
        if nodata is not None:
            tag(42113, 2, f"{nodata:g}".encode() + b"\0")
        at = out.tell()
        extra, where = b"", at + 8 + 20 * len(tags) + 8
        out.write(struct.pack("<Q", len(tags)))
        for number, form, n, data in tags:
            out.write(struct.pack("<HHQ", number, form, n))
            if len(data) <= 8:
                out.write(data.ljust(8, b"\0"))
            else:
                out.write(struct.pack("<Q", where + len(extra)))
                extra += data
        out.write(struct.pack("<Q", 0) + extra)
        out.seek(8)
        out.write(struct.pack("<Q", at))
