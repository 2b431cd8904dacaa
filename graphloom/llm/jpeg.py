"""Media columns: baseline JPEG headers and DC-only thumbnails in numpy.

Markers are parsed per image; scans are Huffman-decoded in lockstep, one lane
per restart segment of each image of a batch, so that a numpy step advances
all of them by one symbol. AC coefficients are skipped, DC coefficients of the
first component become a luminance thumbnail of one pixel per 8 x 8 block:
clip(round(DC * Q / 8 + 128)). Stored are status, dimensions, the thumbnail,
its MD5 and a 64-bit difference hash (9 x 8 block means, left < right).

Covered: sequential Huffman coding with 8-bit samples (SOF0, SOF1), 1 to 4
components, sampling factors 1 to 4, several scans, restart intervals, fill
bytes, application segments and comments.

Defined results: null media gives status null; empty or broken data and
truncated scans "corrupt", progressive, arithmetic or 12-bit coding
"unsupported"; both keep the dimensions that were read and have no thumbnail.
A picture whose data is too short for its dimensions is corrupt before anything
is allocated for it. Null keys and repeated rows pass; other columns are
ignored; an empty table gives no rows; ties don't arise; very large pictures
are decoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import _shared

SCHEMA = "{key} bigint, status string, width int, height int, components int, thumb_width int, thumb_height int, thumbnail binary, thumb_md5 string, difference_hash bigint"
#: Bytes of pictures decoded, and of pages rendered, at a time.
DECODED = 8 << 20
RENDERED = 1 << 20
#: Distinct Huffman tables held at a time; each takes half a megabyte.
TABLES = 48
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
DC_CODES = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
AC_CODES = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
    bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
        "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
        "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)


class Broken(ValueError):
    """The data isn't a whole baseline JPEG."""


@dataclass
class Image:
    status: str = "corrupt"
    width: int | None = None
    height: int | None = None
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    step: int = 1  # DC quantiser of the first component
    tables: list[tuple[tuple[bytes, bytes], tuple[bytes, bytes]]] = field(default_factory=list)  # of each block of an MCU
    owner: list[int] = field(default_factory=list)  # component of each block of an MCU
    units: int = 0
    interval: int = 0
    segments: list[bytes] = field(default_factory=list)
    across: int = 0  # MCUs in a row
    alone: bool = True


def parse(data: bytes) -> Image:
    """Markers of one image up to the scan of the first component, and its entropy-coded segments without stuffing."""
    image = Image()
    if data[:2] != b"\xff\xd8":
        return image
    at, interval = 2, 0
    quantisers: dict[int, int] = {}
    codes: dict[int, tuple[bytes, bytes]] = {}
    try:
        while True:
            if data[at] != 0xFF:
                raise Broken
            while data[at] == 0xFF:
                at += 1
            marker = data[at]
            at += 1
            if marker == 0xD9:
                raise Broken
            if 0xD0 <= marker <= 0xD7 or marker == 1:
                continue
            size = int.from_bytes(data[at : at + 2], "big")
            body = data[at + 2 : at + size]
            if size < 2 or len(body) != size - 2:
                raise Broken
            at += size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    codes[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                if marker > 0xC1 or body[0] != 8:
                    image.status = "unsupported"
                    return image
                if not image.width or not image.height or not image.parts or any(not 1 <= f <= 4 for p in image.parts for f in p[1:3]):
                    raise Broken
            elif marker == 0xDA:
                order = [p[0] for p in image.parts]
                chosen = [(order.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
                end = at
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        end = len(data)
                        break
                    if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7 and data[end + 1] != 0xFF:
                        break
                    end += 1 if data[end + 1] == 0xFF else 2
                if not any(c == 0 for c, _ in chosen):
                    at = end
                    continue
                most_h, most_v = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
                image.alone = len(chosen) == 1
                _, h, v, q = image.parts[0]
                image.step = quantisers[q]
                if image.alone:
                    wide, high = -(-image.width * h // (8 * most_h)), -(-image.height * v // (8 * most_v))
                else:
                    wide, high = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
                image.across, image.units, image.interval = wide, wide * high, interval
                for c, t in chosen:
                    n = 1 if image.alone else image.parts[c][1] * image.parts[c][2]
                    image.owner += [c] * n
                    image.tables += [(codes[t >> 4], codes[16 | (t & 15)])] * n
                scan = data[at:end]
                cuts, k = [], 0
                while interval and (k := scan.find(b"\xff", k)) >= 0 and k + 1 < len(scan):
                    if 0xD0 <= scan[k + 1] <= 0xD7:
                        cuts.append(k)
                    k += 2
                edges = [-2, *cuts, len(scan)]
                image.segments = [scan[a + 2 : b].replace(b"\xff\x00", b"\xff") for a, b in zip(edges, edges[1:], strict=False)]
                want = -(-image.units // interval) if interval else 1
                if len(image.segments) != want:
                    raise Broken
                for k, segment in enumerate(image.segments):  # a block takes two bits at least
                    if 4 * len(segment) < len(image.owner) * min(interval or image.units, image.units - k * interval):
                        raise Broken
                image.status = "ok"
                return image
    except (Broken, IndexError, KeyError, ValueError):
        image.status = "corrupt"
        return image


@lru_cache(maxsize=64)
def lookup(codes: tuple[bytes, bytes]) -> np.ndarray:
    """By the next 16 bits: length of the code << 8 | symbol; 0 if there is none."""
    table, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, count in enumerate(codes[0], 1):
        for _ in range(count):
            low = code << (16 - length)
            table[low : low + (1 << (16 - length))] = length << 8 | codes[1][k]
            code += 1
            k += 1
        code <<= 1
    return table


@lru_cache(maxsize=64)
def strides(codes: tuple[bytes, bytes]) -> np.ndarray:
    """By the next 16 bits: bits << 16 | coefficients << 8 | end of block, over all AC symbols that lie in them whole; 0 if there is none."""
    table = lookup(codes)
    window = np.arange(1 << 16)
    used, ahead = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    ended, live = np.zeros(1 << 16, bool), np.arange(1 << 16)
    while len(live):
        found = table[(window[live] << used[live]) & 0xFFFF]
        symbol = found & 255
        need = (found >> 8) + (symbol & 15)
        step = np.where(symbol == 0, 0, np.where(symbol == 0xF0, 16, (symbol >> 4) + 1))
        ok = (found > 0) & (used[live] + need <= 16) & (ahead[live] + step <= 63)
        live, need, step, symbol = live[ok], need[ok], step[ok], symbol[ok]
        used[live] += need
        ahead[live] += step
        ended[live] = symbol == 0
        live = live[symbol != 0]
    return (used << 16 | ahead << 8 | ended).astype(np.int32)


def _peek(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 16 bits at a bit position."""
    byte = at >> 3
    word = data[byte].astype(np.uint32) << np.uint32(24) | data[byte + 1].astype(np.uint32) << np.uint32(16) | data[byte + 2].astype(np.uint32) << np.uint32(8)
    return (word << (at & 7).astype(np.uint32) >> np.uint32(16)).astype(np.int64)


def decode(images: list[Image]) -> list[np.ndarray | None]:
    """Luminance DC thumbnails; images that turn out broken become corrupt. As many at a time as ``TABLES`` allows."""
    out, some, known = [], [], set()
    for image in images:
        own = {t for pair in image.tables for t in pair}
        if some and len(known | own) > TABLES:
            out += _decode(some)
            some, known = [], set()
        some.append(image)
        known |= own
    return out + _decode(some)


def _decode(images: list[Image]) -> list[np.ndarray | None]:
    used = [i for i, x in enumerate(images) if x.status == "ok"]
    if not used:
        return [None] * len(images)
    names = sorted({t for i in used for pair in images[i].tables for t in pair})
    number = {t: k for k, t in enumerate(names)}
    luts = np.stack([lookup(t) for t in names])
    leaps = np.stack([strides(t) for t in names])
    widest = max(len(images[i].owner) for i in used)
    lane_image, lane_data, lane_units, lane_first = [], [], [], []
    for i in used:
        x = images[i]
        for s, segment in enumerate(x.segments):
            first = s * x.interval if x.interval else 0
            lane_image.append(i)
            lane_data.append(segment)
            lane_first.append(first)
            lane_units.append(min(x.interval or x.units, x.units - first))
    owner = np.zeros((len(images), widest), np.int64)
    table = np.zeros((len(images), widest, 2), np.int64)
    per = np.ones(len(images), np.int64)
    luma = np.zeros((len(images), widest), np.int64)
    base = np.zeros(len(images), np.int64)
    total = 0
    for i in used:
        x = images[i]
        per[i] = len(x.owner)
        owner[i, : per[i]] = x.owner
        table[i, : per[i]] = [[number[a], number[b]] for a, b in x.tables]
        luma[i, : per[i]] = np.cumsum(np.array(x.owner) == 0) - 1
        base[i] = total
        total += x.units * x.owner.count(0)
    perimage = np.array([x.owner.count(0) for x in images])
    out = np.zeros(total, np.int64)
    size = np.array([len(s) for s in lane_data])
    start = np.r_[0, np.cumsum(size + 4)]
    data = np.frombuffer(b"".join(s + b"\0\0\0\0" for s in lane_data) + b"\0" * 8, np.uint8)
    image = np.array(lane_image)
    pos, stop = start[:-1] * 8, (start[:-1] + size) * 8
    first = np.array(lane_first)
    left = np.array(lane_units) * per[image]  # blocks still to come
    block, k = np.zeros(len(image), np.int64), np.zeros(len(image), np.int64)
    last = np.zeros((len(image), 4), np.int64)
    broken = np.zeros(len(images), bool)
    live = np.flatnonzero(left > 0)
    while len(live):
        of = image[live]
        within = block[live] % per[of]
        dc = k[live] == 0
        at = pos[live]
        window = _peek(data, at)
        found = luts[table[of, within, np.where(dc, 0, 1)], window]
        length, symbol = found >> 8, found & 255
        bits = np.where(dc, symbol, symbol & 15)
        leap = leaps[table[of, within, 1], window]
        ahead = k[live] + (leap >> 8 & 255)
        many = ~dc & (leap > 0) & (ahead <= 63)  # several AC symbols at once, if the block doesn't end without a sign
        bad = ~many & ((length == 0) | (dc & (symbol > 11)))
        after = at + np.where(many, leap >> 16, length + bits)
        bad |= after > stop[live]
        step = np.where(dc, 1, np.where(symbol == 0, 64, k[live] + np.where(symbol == 0xF0, 16, (symbol >> 4) + 1)))
        step = np.where(many, np.where(leap & 1, 64, ahead), step)
        bad |= step > 64
        d = np.flatnonzero(dc & ~bad)
        if len(d):
            lane, n = live[d], bits[d]
            raw = _peek(data, at[d] + length[d]) >> (16 - n)
            value = np.where(n == 0, 0, np.where(raw < (1 << np.maximum(n - 1, 0)), raw - (1 << n) + 1, raw))
            part = owner[of[d], within[d]]
            last[lane, part] += value
            y = part == 0
            ly, iy = lane[y], of[d][y]
            out[base[iy] + (first[ly] + block[ly] // per[iy]) * perimage[iy] + luma[iy, within[d][y]]] = last[ly, 0]
        pos[live], k[live] = after, step
        over = step >= 64
        done = live[over]
        k[done] = 0
        block[done] += 1
        left[done] -= 1
        broken[of[bad]] = True
        if bad.any():
            live = live[~broken[of]]
        if over.any():
            live = live[left[live] > 0]
    result: list[np.ndarray | None] = [None] * len(images)
    for i in used:
        x = images[i]
        if broken[i]:
            x.status = "corrupt"
            continue
        values = out[base[i] : base[i] + x.units * perimage[i]]
        most_h, most_v = max(p[1] for p in x.parts), max(p[2] for p in x.parts)
        h, v = (1, 1) if x.alone else x.parts[0][1:3]
        rows = x.units // x.across
        grid = values.reshape(rows, x.across, v, h).transpose(0, 2, 1, 3).reshape(rows * v, x.across * h)
        _, own_h, own_v, _ = x.parts[0]
        grid = grid[: -(-x.height * own_v // (8 * most_v)), : -(-x.width * own_h // (8 * most_h))]
        result[i] = np.clip(np.floor(grid * x.step / 8 + 128.5), 0, 255).astype(np.uint8)
    return result


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 means is smaller than the one to its right."""
    rows, columns = thumb.shape
    r = np.arange(9) * rows // 8
    c = np.arange(10) * columns // 9
    table = np.zeros((rows + 1, columns + 1))
    table[1:, 1:] = thumb.cumsum(0).cumsum(1)
    a, b = r[:-1], np.maximum(r[1:], r[:-1] + 1).clip(max=rows)
    a = np.minimum(a, rows - 1)
    e, f = c[:-1], np.maximum(c[1:], c[:-1] + 1).clip(max=columns)
    e = np.minimum(e, columns - 1)
    mean = (table[b][:, f] - table[a][:, f] - table[b][:, e] + table[a][:, e]) / ((b - a)[:, None] * (f - e))
    bits = (mean[:, :-1] < mean[:, 1:]).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def by_bytes(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes in its second column, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def describe(media: DataFrame, key: str = "media_id", column: str = "media", batch_bytes: int = DECODED) -> DataFrame:
    """Status, dimensions, thumbnail and hashes of every row."""
    _shared.require(media, key, column)
    rows = media.select(F.col(key).cast("bigint").alias(key), F.col(column).cast("binary").alias(column))

    def described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, batch_bytes):
                data = some.column(1).to_pylist()
                images = [parse(x or b"") for x in data]
                thumbs = decode(images)
                null = [x is None for x in data]
                of = lambda f: [None if n or t is None else f(t) for n, t in zip(null, thumbs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([None if n else x.status for n, x in zip(null, images, strict=True)], pa.string()),
                        pa.array([x.width for x in images], pa.int32()),
                        pa.array([x.height for x in images], pa.int32()),
                        pa.array([len(x.parts) or None for x in images], pa.int32()),
                        pa.array(of(lambda t: t.shape[1]), pa.int32()),
                        pa.array(of(lambda t: t.shape[0]), pa.int32()),
                        pa.array(of(lambda t: t.tobytes()), pa.binary()),
                        pa.array(of(lambda t: hashlib.md5(t.tobytes()).hexdigest()), pa.string()),
                        pa.array(of(difference_hash), pa.int64()),
                    ],
                    [key, "status", "width", "height", "components", "thumb_width", "thumb_height", "thumbnail", "thumb_md5", "difference_hash"],
                )

    return rows.mapInArrow(described, SCHEMA.format(key=key))


@lru_cache(maxsize=4)
def _canonical(codes: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    now, k = 0, 0
    for size, count in enumerate(codes[0], 1):
        for _ in range(count):
            code[codes[1][k]], length[codes[1][k]] = now, size
            now += 1
            k += 1
        now <<= 1
    return code, length


_COSINE = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _blocks(plane: np.ndarray, h: int, v: int, rows: int, across: int) -> np.ndarray:
    """(MCU, block, 64) zigzag coefficients before quantising."""
    high, wide = rows * v * 8, across * h * 8
    y, x = plane.shape
    padded = np.empty((high, wide))
    padded[:y, :x] = plane
    padded[y:, :x] = padded[y - 1, :x]
    padded[:, x:] = padded[:, x - 1 : x]
    padded -= 128
    tiles = padded.reshape(rows, v, 8, across, h, 8).transpose(0, 3, 1, 4, 2, 5).reshape(rows * across, v * h, 8, 8)
    return (_COSINE @ tiles @ _COSINE.T).reshape(rows * across, v * h, 64)[:, :, ZIGZAG]


def encode(planes: list[np.ndarray], width: int, height: int, factors: list[tuple[int, int]], dc_step: int = 8, ac_step: int = 100, interval: int = 0) -> bytes:
    """A small baseline encoder: planes of pixels at their own resolution, with sampling factors."""
    return encode_all([(planes, width, height)], factors, dc_step, ac_step, interval)[0]


def encode_all(images: list[tuple[list[np.ndarray], int, int]], factors: list[tuple[int, int]], dc_step: int = 8, ac_step: int = 100, interval: int = 0, codes: list[tuple[bytes, bytes]] | None = None) -> list[bytes]:
    """Encode (planes, width, height) with the same factors: their blocks go through each step together."""
    dc_codes, ac_codes = codes or (DC_CODES, AC_CODES)
    if len(factors) == 1:
        factors = [(1, 1)]
    most_h, most_v = max(f[0] for f in factors), max(f[1] for f in factors)
    step = np.r_[dc_step, np.full(63, ac_step)]
    every, units = [], []
    for planes, width, height in images:
        across, rows = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        every.append(np.concatenate([_blocks(p, h, v, rows, across) for p, (h, v) in zip(planes, factors, strict=True)], 1))
        units.append(rows * across)
    units = np.array(units)
    coefficients = np.rint(np.concatenate(every).reshape(-1, 64) / step).astype(np.int64)
    per = [h * v for h, v in factors]
    owner = np.tile(np.repeat(np.arange(len(per)), per), int(units.sum()))
    pieces = -(-units // interval) if interval else np.ones_like(units)  # segments of each image
    first = np.cumsum(pieces) - pieces
    mcu = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    segment = np.repeat(np.repeat(first, units) + (mcu // interval if interval else 0), sum(per))
    diff = coefficients[:, 0].copy()
    for c in range(len(per)):
        at = np.flatnonzero(owner == c)
        same = segment[at[1:]] == segment[at[:-1]]
        diff[at[1:][same]] -= coefficients[at[:-1][same], 0]
    dc, ac = _canonical(dc_codes), _canonical(ac_codes)
    size = np.frexp(np.abs(diff).astype(np.float64))[1]
    code = [dc[0][size] << size | np.where(diff < 0, diff + (1 << size) - 1, diff)]
    length, key = [dc[1][size] + size], [np.arange(len(diff)) * 256]
    block, k = np.nonzero(coefficients[:, 1:])
    value = coefficients[block, k + 1]
    before = np.full(len(k), -1)
    before[1:] = np.where(block[1:] == block[:-1], k[:-1], -1)
    run = k - before - 1
    size = np.frexp(np.abs(value).astype(np.float64))[1]
    symbol = (run & 15) << 4 | size
    code.append(ac[0][symbol] << size | np.where(value < 0, value + (1 << size) - 1, value))
    length.append(ac[1][symbol] + size)
    key.append(block * 256 + (k + 1) * 4 - 1 + 1)
    for z in range(1, 4):  # runs of sixteen zeros
        some = run >= 16 * z
        code.append(np.full(int(some.sum()), ac[0][0xF0]))
        length.append(np.full(int(some.sum()), ac[1][0xF0]))
        key.append(block[some] * 256 + (k[some] + 1) * 4 - z)
    short = np.ones(len(diff), bool)
    short[block[k == 62]] = False
    code.append(np.full(int(short.sum()), ac[0][0]))
    length.append(np.full(int(short.sum()), ac[1][0]))
    key.append(np.flatnonzero(short) * 256 + 255)
    order = np.argsort(np.concatenate(key), kind="stable")
    code, length = np.concatenate(code)[order], np.concatenate(length)[order]
    of = segment[np.concatenate(key)[order] // 256]
    own = np.bincount(of, length)
    whole = -(-own // 8)
    shift = (8 * (np.cumsum(whole) - whole) - (np.cumsum(own) - own)).astype(np.int64)
    end = np.cumsum(length)
    flat = (np.repeat(code, length) >> (np.repeat(end, length) - 1 - np.arange(end[-1]))) & 1
    bits = np.ones(8 * int(whole.sum()), np.uint8)
    bits[np.arange(end[-1]) + np.repeat(shift[of], length)] = flat
    packed, edge = np.packbits(bits).tobytes(), np.cumsum(whole).astype(np.int64).tolist()
    stream = [packed[i:j].replace(b"\xff", b"\xff\x00") for i, j in zip([0, *edge], edge, strict=False)]
    head = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    shape = bytes([len(per)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    tables = head(0xC4, b"\x00" + dc_codes[0] + dc_codes[1]) + head(0xC4, b"\x10" + ac_codes[0] + ac_codes[1])
    tables += head(0xDD, interval.to_bytes(2, "big")) if interval else b""
    tables += head(0xDA, bytes([len(per)]) + b"".join(bytes([i + 1, 0]) for i in range(len(per))) + b"\x00\x3f\x00")
    start, out = b"\xff\xd8" + head(0xDB, b"\0" + bytes(step.tolist())), []
    for (_, width, height), a, n in zip(images, first.tolist(), pieces.tolist(), strict=True):
        scan = stream[a] + b"".join(bytes([0xFF, 0xD0 + (i % 8)]) + s for i, s in enumerate(stream[a + 1 : a + n]))
        out.append(start + head(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + shape) + tables + scan + b"\xff\xd9")
    return out


def render(pages: list[bytes], kind: int) -> list[bytes]:
    """Pages as pictures: each byte of a whole text is a pixel, 64 in a row; grey, colour, or subsampled colour with restarts."""
    images = []
    for data in pages:
        flat = np.frombuffer(data or b" ", np.uint8)
        height = min(65_535, -(-len(flat) // 64))
        width = max(64, -(-len(flat) // height))
        y = np.full(width * height, 32, np.uint8)
        y[: len(flat)] = flat
        y = y.reshape(height, width)
        images.append(([[y], [y, 255 - y, y // 2], [y, y[::2, ::2], 255 - y[::2, ::2]]][kind], width, height))
    factors = [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)]][kind]
    return encode_all(images, factors, interval=4 if kind == 2 else 0) if images else []


def pages_media(pages: DataFrame) -> DataFrame:
    """(page_id, media): the tables hold no pictures, so each page is rendered as one."""
    _shared.require(pages, "page_id", "html")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.encode(F.col("html").cast("string"), "utf-8").alias("html"))

    def rendered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, RENDERED):
                ids, html = some.column(0).to_pylist(), some.column(1).to_pylist()
                media: list[bytes | None] = [None] * len(ids)
                for kind in range(3):
                    at = [k for k, (i, x) in enumerate(zip(ids, html, strict=True)) if x is not None and (i or 0) % 3 == kind]
                    for k, picture in zip(at, render([html[k] for k in at], kind), strict=True):
                        media[k] = picture
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(media, pa.binary())], ["page_id", "media"])

    return rows.mapInArrow(rendered, "page_id bigint, media binary")
