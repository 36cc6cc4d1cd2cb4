"""Baseline JPEG: a lossless intra coding of bytes as flat blocks, and a decoder of baseline streams.

A byte becomes an 8 x 8 block whose only coefficient is its DC value: with a quantiser of 8 the decoded samples
are all that byte. The DC code lengths are chosen as 9 less the size category, so that each difference takes 9
bits, and the end of block takes one more: the scan has 10 bits for each byte and needs no padding.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCKS_WIDE = 16
#: Fixed values of the format: the order of coefficients in a scan.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])


def _code(difference: int) -> int:
    """The 10 bits of a DC difference (-255 to 255) and the end of block."""
    size = abs(difference).bit_length()
    extra = difference if difference > 0 else difference + (1 << size) - 1
    prefix = (1 << (9 - size)) - 2  # the canonical code of its length
    return ((prefix << size | extra) << 1) & 0x3FF


CODES = np.array([_code(d) for d in range(-255, 256)], np.uint64)
DIFFERENCES = np.zeros(1024, np.int16)
DIFFERENCES[CODES.astype(int)] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


TABLES = (
    _segment(0xDB, b"\0" + bytes([8] * 64))
    + _segment(0xC4, b"\0" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
)
SCAN = _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def encode(data: bytes) -> bytes:
    """A grey frame of 16 blocks a row that holds the bytes, of which there are a multiple of 16."""
    values = np.frombuffer(data, np.uint8).astype(np.int16) - 128
    code = CODES[np.diff(values, prepend=np.int16(0)) + 255].reshape(-1, 4)
    packed = code[:, 0] << np.uint64(30) | code[:, 1] << np.uint64(20) | code[:, 2] << np.uint64(10) | code[:, 3]
    scan = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().replace(b"\xff", b"\xff\0")
    frame = _segment(0xC0, struct.pack(">BHHB", 8, len(data) // BLOCKS_WIDE * 8, BLOCKS_WIDE * 8, 1) + b"\x01\x11\0")
    return b"\xff\xd8" + TABLES + frame + SCAN + scan + b"\xff\xd9"


class Frame:
    """The segments of a baseline stream: tables, components (id, h, v, quantiser), scan order and bits."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        self.quant, self.huffman, self.restart, at = {}, {}, 0, 2
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    counts = body[1:17]
                    self.huffman[body[0]] = counts, body[17 : 17 + sum(counts)]
                    body = body[17 + sum(counts) :]
            elif marker in (0xC0, 0xC1):
                _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                end = data.rfind(b"\xff\xd9")
                self.bits = data[at : end if end >= at else len(data)]
                return
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline streams can be decoded")

    def flat(self) -> bool:
        """Whether this is what encode makes."""
        return len(self.components) == 1 and self.huffman.get(0) == (bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))) and self.huffman.get(16) == (bytes([1] + [0] * 15), b"\0") and not self.restart


def blocks(data: bytes) -> np.ndarray:
    """Of a frame that encode made: the sample of each block."""
    frame = Frame(data)
    if not frame.flat():
        raise ValueError("not a frame of flat blocks")
    groups = np.frombuffer(frame.bits.replace(b"\xff\0", b"\xff"), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(groups), 8), np.uint8)
    wide[:, 3:] = groups
    packed = wide.view(">u8").astype(np.uint64).ravel()
    code = np.stack([packed >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).ravel()
    return (np.cumsum(DIFFERENCES[code.astype(np.int64)], dtype=np.int32) + 128).astype(np.uint8)


def _lookup(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    counts, symbols = table
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n]:
            out = out << 1 | b
        self.at += n
        return out

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (length, code) in table:
                return table[length, code]
        raise ValueError("bad code")

    def value(self, size: int) -> int:
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _cosines() -> np.ndarray:
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


COSINES = _cosines()


def decode(data: bytes) -> list[np.ndarray]:
    """The planes of a baseline frame, at their own resolution (luma first)."""
    frame = Frame(data)
    most_h, most_v = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    wide, high = -(-frame.width // (8 * most_h)), -(-frame.height // (8 * most_v))
    single = len(frame.components) == 1
    planes, shape = [], []
    for _, h, v, _ in frame.components:
        w, t = -(-frame.width * h // most_h), -(-frame.height * v // most_v)
        bw, bh = (-(-w // 8), -(-t // 8)) if single else (wide * h, high * v)
        planes.append(np.zeros((bh, bw, 64), np.int32))
        shape.append((t, w))
    if frame.flat() and frame.bits:
        planes[0][:, :, 0] = blocks(data).reshape(planes[0].shape[:2]).astype(np.int32) - 128
    else:
        tables = {k: _lookup(v) for k, v in frame.huffman.items()}
        parts = _split_restarts(frame.bits) if frame.restart else [frame.bits]
        units = planes[0].shape[0] * planes[0].shape[1] if single else wide * high
        for k, part in enumerate(parts):
            bits, last = _Bits(part), [0] * len(planes)
            for unit in range(k * frame.restart, min(units, (k + 1) * frame.restart) if frame.restart else units):
                for i, (name, h, v, _) in enumerate(frame.components):
                    dc, ac = (tables[frame.scan[name][0]], tables[16 + frame.scan[name][1]])
                    for y in range(1 if single else v):
                        for x in range(1 if single else h):
                            bw = planes[i].shape[1]
                            by, bx = divmod(unit, bw) if single else (unit // wide * v + y, unit % wide * h + x)
                            block = planes[i][by, bx]
                            last[i] += bits.value(bits.symbol(dc))
                            block[0], at = last[i], 1
                            while at < 64:
                                s = bits.symbol(ac)
                                if not s & 15:
                                    if s != 0xF0:
                                        break
                                    at += 16
                                    continue
                                at += s >> 4
                                block[ZIGZAG[at]] = bits.value(s & 15)
                                at += 1
    out = []
    for plane, (_, _, _, q), (t, w) in zip(planes, frame.components, shape, strict=True):
        scale = np.zeros(64)
        scale[ZIGZAG] = frame.quant[q]
        samples = np.einsum("kx,bckl,ly->bcxy", COSINES, (plane * scale).reshape(*plane.shape[:2], 8, 8), COSINES)
        samples = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3)
        out.append(samples.reshape(plane.shape[0] * 8, plane.shape[1] * 8)[:t, :w])
    return out


def _split_restarts(bits: bytes) -> list[bytes]:
    out, start, at = [], 0, bits.find(b"\xff")
    while at >= 0:
        if at + 1 < len(bits) and 0xD0 <= bits[at + 1] <= 0xD7:
            out.append(bits[start:at])
            start = at + 2
        at = bits.find(b"\xff", at + 2)
    return [*out, bits[start:]]
