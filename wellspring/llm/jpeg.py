"""Baseline JPEG in numpy: a decoder for any sequential Huffman-coded 8-bit image, and a writer of grey images from coefficients.

Scans are decoded many at a time: every restart interval of every image is a lane, and each step decodes the next symbol of all lanes. An image
without restart markers is one lane.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

# The writer's Huffman code for both classes: how many codes of each length 1 to 16, and the symbols in order. Fixed values.
BITS = [1, 1, 0, 3, 0, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0]
SYMBOLS = [7, 6, 5, 8, 1, 2, 3, 4, 0]


@dataclass
class Image:
    """What the markers say. Of each component: sampling (h, v), DC and AC table; ``lanes`` are the restart intervals' bytes without stuffing."""

    width: int = 0
    height: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)
    components: list[list[int]] = field(default_factory=list)
    interval: int = 0
    comment: bytes = b""
    scan: bytes = b""

    @property
    def mcu(self) -> list[int]:
        """The component of each block of a minimum coded unit."""
        return [0] if len(self.components) == 1 else [k for k, c in enumerate(self.components) for _ in range(c[1] * c[2])]

    @property
    def units(self) -> tuple[int, int]:
        """Minimum coded units down and across."""
        h, v = (1, 1) if len(self.components) == 1 else (max(c[1] for c in self.components), max(c[2] for c in self.components))
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))


def parse(data: bytes) -> Image:
    """The markers of one image. Fails on images that are not baseline."""
    image, at = Image(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    while True:
        while data[at] == 255 and data[at + 1] == 255:
            at += 1
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                image.quant[n] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k], 0, 0] for k in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            image.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            for k in range(body[0]):
                for c in image.components:
                    if c[0] == body[1 + 2 * k]:
                        c[4], c[5] = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            image.scan = data[at:]
            return image


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: code length times 256 plus symbol, 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, dtype=np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _intervals(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All scans' bytes without stuffing and markers; where each restart interval starts in them; how many each scan has."""
    data = np.frombuffer(b"".join(scans) + b"\0", dtype=np.uint8)
    ends = np.cumsum([len(s) for s in scans])
    mark = np.flatnonzero(data[:-1] == 255)
    after = data[mark + 1]
    restart, close = mark[(after >= 0xD0) & (after <= 0xD7)], mark[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    drop = np.zeros(len(data), dtype=bool)
    drop[mark[after == 0] + 1] = True
    drop[restart] = drop[restart + 1] = True
    first_close = close[np.searchsorted(close, ends - [len(s) for s in scans])] if len(close) else ends
    keep = ~drop
    new = np.cumsum(keep) - keep
    begin = ends - [len(s) for s in scans]
    restart = restart[restart < first_close[np.searchsorted(ends, restart, side="right")]]
    starts = np.sort(np.concatenate((begin, restart + 2)))
    return np.concatenate((data[keep], np.zeros(8, dtype=np.uint8))), new[starts], np.diff(np.searchsorted(starts, np.append(begin, len(data))))


def decode(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients of each image as (blocks, 64), in scan order and zigzag order."""
    out: list[np.ndarray] = [None] * len(images)
    alike: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        alike.setdefault((tuple(map(tuple, image.components)), tuple(sorted(image.tables.items()))), []).append(k)
    for own in alike.values():
        for k, blocks in zip(own, _decode_alike([images[k] for k in own]), strict=True):
            out[k] = blocks
    return out


def _decode_alike(images: list[Image]) -> list[np.ndarray]:
    first, mcu = images[0], images[0].mcu
    lookups = np.stack([_lookup(first.tables[kind, c[4 + kind]]) for c in first.components for kind in (0, 1)])
    of_block = np.array(mcu)
    data, starts, lanes = _intervals([i.scan for i in images])
    units = np.array([i.units[0] * i.units[1] for i in images])
    window = data[:-3].astype(np.int64) << 24 | data[1:-2].astype(np.int64) << 16 | data[2:-1].astype(np.int64) << 8 | data[3:]
    per_lane = np.concatenate([_shares(u, i.interval, n) for u, i, n in zip(units, images, lanes, strict=True)]) * len(mcu)
    base = np.concatenate(([0], np.cumsum(per_lane)))
    out = np.zeros((base[-1], 64), dtype=np.int32)
    pos, block, k = starts * 8, np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
    lane = np.flatnonzero(per_lane > 0)
    last = len(window) - 1
    while len(lane):
        p, b, z = pos[lane], block[lane], k[lane]
        component = of_block[b % len(mcu)] if len(mcu) > 1 else 0
        ac = z > 0
        found = lookups[2 * component + ac, window[np.minimum(p >> 3, last)] >> (16 - (p & 7)) & 0xFFFF]
        if not found.all():
            raise ValueError("a scan has no such code")
        symbol = found & 255
        p = p + (found >> 8)
        size = symbol & 15
        extra = window[np.minimum(p >> 3, last)] >> (32 - (p & 7) - size) & ((1 << size) - 1)
        value = np.where(extra >> np.maximum(size - 1, 0), extra, extra - (1 << size) + 1)
        z = z + np.where(ac, symbol >> 4, 0)
        real = size > 0
        out[(base[lane] + b)[real], np.minimum(z, 63)[real]] = value[real]
        z = np.where(ac & (symbol == 0), 64, z + 1)
        done = z >= 64
        pos[lane], block[lane], k[lane] = p + size, b + done, np.where(done, 0, z)
        if done.any():
            lane = lane[(b + done) < per_lane[lane]]
    _undo_differences(out, base, of_block, per_lane)
    return np.split(out, np.cumsum(units * len(mcu))[:-1])


def _shares(units: int, interval: int, lanes: int) -> np.ndarray:
    """Units in each restart interval of an image."""
    if not interval:
        return np.append([units], np.zeros(lanes - 1, dtype=np.int64)).astype(np.int64)
    return np.clip(units - interval * np.arange(lanes), 0, interval)


def _undo_differences(out: np.ndarray, base: np.ndarray, of_block: np.ndarray, per_lane: np.ndarray) -> None:
    """DC values from their differences, which start anew in each restart interval."""
    if per_lane.max(initial=0) <= 1:
        return
    lane = np.repeat(np.arange(len(per_lane)), per_lane)
    component = of_block[(np.arange(len(out)) - base[lane]) % len(of_block)]
    for c in np.unique(component):
        rows = np.flatnonzero(component == c)
        total = np.cumsum(out[rows, 0])
        new = np.flatnonzero(np.diff(lane[rows], prepend=-1))
        before = np.where(new > 0, total[new - 1], 0)
        out[rows, 0] = total - np.repeat(before, np.diff(np.append(new, len(rows))))


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """The luminance of each block from its DC coefficient alone, as rows of 8-bit pixels."""
    c, (down, across) = image.components[0], image.units
    dc = blocks[:, 0].astype(np.int64) * int(image.quant[c[3]][0])
    if len(image.components) > 1:
        h, v = c[1], c[2]
        dc = dc.reshape(-1, len(image.mcu))[:, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        scale = [max(x[k] for x in image.components) for k in (1, 2)]
        dc = dc[: -(-image.height * v // (8 * scale[1])), : -(-image.width * h // (8 * scale[0]))]
    else:
        dc = dc.reshape(down, across)
    return np.clip((dc + 4) // 8 + 128, 0, 255).astype(np.uint8)


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    codes, lengths = np.zeros(9, dtype=np.int64), np.zeros(9, dtype=np.int64)
    found = _lookup(bytes(BITS + SYMBOLS))
    for symbol in SYMBOLS:
        at = np.flatnonzero((found & 255 == symbol) & (found > 0))
        lengths[symbol] = found[at[0]] >> 8
        codes[symbol] = at[0] >> (16 - lengths[symbol])
    return codes, lengths


_CODE, _LENGTH = _codes()


def encode_grey(groups: list[np.ndarray], comments: list[bytes]) -> list[bytes]:
    """A grey image of each (blocks, 64) group of coefficients from -255 to 255 without zeros; every block is a restart interval.

    Blocks fill rows of equal width; what the last row lacks is blocks of zeros.
    """
    counts = np.array([len(g) for g in groups])
    across = np.ceil(np.sqrt(counts)).astype(np.int64)
    down = -(-counts // across)
    padded = across * down
    values = np.concatenate(groups).astype(np.int64)
    place = np.arange(len(values)) + np.repeat(np.cumsum(padded - counts) - (padded - counts), counts)
    total = int(padded.sum())
    size = np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)
    code = (_CODE[size] << size) | np.where(values > 0, values, values + (1 << size) - 1)
    n_bits = _LENGTH[size] + size
    off = np.cumsum(n_bits, axis=1)
    block_bits = np.full(total, 2 * _LENGTH[0])
    block_bits[place] = off[:, -1]
    n_bytes = (block_bits + 7) // 8
    base = np.cumsum(n_bytes) - n_bytes
    off = (off - n_bits) + 8 * base[place][:, None]
    at, shifted = (off >> 3).ravel(), (code << (24 - n_bits - (off & 7))).ravel()
    length = int(n_bytes.sum())
    data = sum(np.bincount(at + k, weights=shifted >> (16 - 8 * k) & 255, minlength=length + 2) for k in range(3))[: length + 2].astype(np.int64)
    blank = np.ones(total, dtype=bool)
    blank[place] = False
    for k, byte in enumerate(((int(_CODE[0]) << 9 | int(_CODE[0]) << 2) >> 8 & 255, (int(_CODE[0]) << 9 | int(_CODE[0]) << 2) & 255)):
        data[base[blank] + k] = byte
    spare = 8 * n_bytes - block_bits
    data[base + n_bytes - 1] |= (1 << spare) - 1
    data = data[:length].astype(np.uint8)
    image_of = np.repeat(np.arange(len(groups)), padded)
    within = np.arange(total) - np.repeat(np.cumsum(padded) - padded, padded)
    final = within == padded[image_of] - 1
    room = (data == 255).astype(np.int64)
    ends = base + n_bytes - 1
    room[ends[~final]] += 2
    where = np.arange(length) + np.cumsum(room) - room
    stuffed = np.zeros(int(where[-1] + 1 + room[-1]), dtype=np.uint8)
    stuffed[where] = data
    marker = where[ends[~final]] + (data[ends[~final]] == 255) + 1
    stuffed[marker], stuffed[marker + 1] = 255, 0xD0 + within[~final] % 8
    stops = where[ends[final]] + room[ends[final]] + 1
    starts = np.concatenate(([0], stops[:-1]))
    return [_head(int(w), int(h), comment) + stuffed[a:b].tobytes() + b"\xff\xd9" for w, h, comment, a, b in zip(across, down, comments, starts, stops, strict=True)]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((255, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _head(across: int, down: int, comment: bytes) -> bytes:
    table = bytes(BITS + SYMBOLS)
    return b"".join((
        b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, b"\0" + bytes([8] * 64)),
        _segment(0xC0, b"\x08" + (8 * down).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + b"\x01\x01\x11\0"),
        _segment(0xC4, b"\0" + table + b"\x10" + table), _segment(0xDD, b"\0\x01"), _segment(0xDA, b"\x01\x01\0\0\x3f\0"),
    ))
