"""Media columns in baseline JPEG.

`parse` reads the markers of a baseline stream (SOF0, DQT, DHT, DRI, SOS, RSTn); `dc_planes` decodes the Huffman scans
and gives each component's DC coefficients, all restart intervals of many images side by side in numpy; `thumbnail` is
the luminance at one eighth: a pixel is the block's mean, DC x step / 8 + 128.

A payload of bytes is stored losslessly as grey samples: each byte is one 8 x 8 block of that value, whose only
coefficient is its DC. With a quantiser step of 8 that coefficient is the byte less 128, so the thumbnail of the stored
image is the payload. A row of blocks is one restart interval. Rows are 64 blocks wide; where that would be more rows
than JPEG's 65,535 lines, they are wider, and where no image is wide enough the payload continues in a further image.

Cases: a null text counts as empty, whose payload is 64 zero bytes. Streams that are not baseline JPEG raise ValueError;
`columns_of` gives nulls for them. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Blocks of a row, the most rows of blocks in an image and the most blocks in a row.
WIDTH, MOST_ROWS, MOST_BLOCKS = 64, 8191, 8128
#: Restart intervals that are decoded side by side; bytes of payload that are encoded at once.
LANES, CHUNK = 1 << 14, 1 << 20
#: Rows of a batch that are held as Python objects at once.
SLICE = 256

# Code lengths of our two Huffman tables. DC: categories 0 to 8, AC: the end of a block alone.
DC_BITS = (0, 1, 5, 1, 1, 1)
DC_SYMBOLS = (5, 0, 3, 4, 6, 7, 2, 1, 8)
AC_BITS = (1,)
AC_SYMBOLS = (0,)


def canonical(bits, symbols) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def lookup(bits, symbols) -> np.ndarray:
    """For each 16-bit look-ahead: symbol << 5 | length; 0 where no code matches."""
    table = np.zeros(1 << 16, np.int32)
    for s, (code, length) in canonical(bits, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = s << 5 | length
    return table


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(width: int, height: int, interval: int) -> bytes:
    def huffman(kind: int, bits, symbols) -> bytes:
        return bytes([kind, *bits, *[0] * (16 - len(bits)), *symbols])

    return (b"\xff\xd8" + segment(0xDB, bytes([0] + [8] * 64))
            + segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
            + segment(0xC4, huffman(0x00, DC_BITS, DC_SYMBOLS)) + segment(0xC4, huffman(0x10, AC_BITS, AC_SYMBOLS))
            + segment(0xDD, interval.to_bytes(2, "big")) + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])))


_DC = canonical(DC_BITS, DC_SYMBOLS)
_DC_CODE = np.array([_DC[s][0] for s in range(9)], np.uint64)
_DC_LENGTH = np.array([_DC[s][1] for s in range(9)], np.int64)


def scans(samples: np.ndarray, interval: int) -> list[bytes]:
    """Entropy-coded data of rows of blocks (one sample a block), each row a restart interval, stuffed, without markers."""
    value = samples.reshape(-1, interval).astype(np.int64) - 128
    diff = np.diff(value, axis=1, prepend=0).ravel()
    size = np.zeros(len(diff), np.int64)
    for k in range(9):
        size[np.abs(diff) >= 1 << k] = k + 1
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff).astype(np.uint64)
    length = _DC_LENGTH[size] + size + 1  # the one bit after the difference ends the block
    code = ((_DC_CODE[size] << size.astype(np.uint64)) | extra) << np.uint64(1)
    bits = length.reshape(-1, interval).sum(axis=1)
    rows = len(bits)
    row_bytes = (bits + 7) // 8
    row_from = np.cumsum(row_bytes) - row_bytes
    # Where a row's last byte is not full, the rest is ones.
    start = (np.cumsum(length.reshape(-1, interval), axis=1) - length.reshape(-1, interval) + 8 * row_from[:, None]).ravel()
    fill = 8 * row_bytes - bits
    start = np.concatenate([start, 8 * row_from + bits])
    length = np.concatenate([length, fill])
    code = np.concatenate([code, (np.uint64(1) << fill.astype(np.uint64)) - np.uint64(1)])
    shifted = code << (np.uint64(64) - length.astype(np.uint64) - (start % 32).astype(np.uint64)) % np.uint64(64)
    shifted[length == 0] = 0
    words = int(row_bytes.sum()) // 4 + 3
    total = np.bincount(start // 32, (shifted >> np.uint64(32)).astype(np.float64), words)
    total += np.bincount(start // 32 + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    raw = total.astype(np.uint64).astype(">u4").tobytes()
    return [raw[a : a + n].replace(b"\xff", b"\xff\x00") for a, n in zip(row_from.tolist(), row_bytes.tolist(), strict=True)] if rows else []


def store(payloads: list[bytes]) -> list[bytes]:
    """A JPEG stream (or several in a row) for each payload; payloads are whole multiples of WIDTH bytes."""
    plans, narrow = [], []
    for i, p in enumerate(payloads):
        rows = len(p) // WIDTH
        if rows <= MOST_ROWS:
            narrow.append(i)
        plans.append(rows)
    out: list[bytes] = [b""] * len(payloads)
    at = 0
    while at < len(narrow):
        to, size = at, 0
        while to < len(narrow) and (to == at or size + len(payloads[narrow[to]]) <= CHUNK):
            size += len(payloads[narrow[to]])
            to += 1
        group = narrow[at:to]
        rows = scans(np.frombuffer(b"".join(payloads[i] for i in group), np.uint8), WIDTH)
        k = 0
        for i in group:
            out[i] = stream(rows[k : k + plans[i]], WIDTH)
            k += plans[i]
        at = to
    for i in set(range(len(payloads))) - set(narrow):
        p, parts = payloads[i], []
        while p:
            width = min(MOST_BLOCKS, WIDTH * -(-len(p) // (WIDTH * MOST_ROWS)))
            n = min(len(p) // width, MOST_ROWS) * width
            if n == 0:
                width, n = WIDTH, len(p)
            parts.append(stream(scans(np.frombuffer(p[:n], np.uint8), width), width))
            p = p[n:]
        out[i] = b"".join(parts)
    return out


def stream(rows: list[bytes], width: int) -> bytes:
    parts = [header(8 * width, 8 * len(rows), width)]
    for k, r in enumerate(rows):
        parts.append(r)
        if k < len(rows) - 1:
            parts.append(bytes([0xFF, 0xD0 + k % 8]))
    return b"".join(parts) + b"\xff\xd9"


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # the DC step of each
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    interval: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    data: list[bytes] = field(default_factory=list)  # each restart interval, without stuffing
    end: int = 0


def parse(raw: bytes, at: int = 0) -> Image:
    """The image that starts at byte `at`; its end is where the next one may start."""
    if raw[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    out, at = Image(), at + 2
    while True:
        while raw[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("no marker")
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out.tables[body[0]] = lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or not out.width or not out.height:
                raise ValueError("not 8-bit baseline")
            out.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            out.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            ids = {c[0]: k for k, c in enumerate(out.components)}
            out.scan = [(ids[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            if len(out.scan) != len(out.components):
                raise ValueError("components in several scans")
            break
    while True:  # to the next marker that is neither a stuffed byte nor a restart
        stop = raw.find(b"\xff", at)
        first = at
        while stop >= 0 and raw[stop + 1 : stop + 2] == b"\x00":
            stop = raw.find(b"\xff", stop + 2)
        if stop < 0 or stop + 1 >= len(raw):
            raise ValueError("no end of image")
        out.data.append(raw[first:stop].replace(b"\xff\x00", b"\xff"))
        at = stop + 2
        if not 0xD0 <= raw[stop + 1] <= 0xD7:
            break
    out.end = at
    if raw[at - 1] != 0xD9:
        raise ValueError("no end of image")
    return out


def layout(image: Image) -> tuple[list[tuple[int, int]], int, int]:
    """The (component, table slot) of each block of a unit, units in a row, units in all."""
    if len(image.components) == 1:
        return [(0, 0)], -(-image.width // 8), -(-image.width // 8) * -(-image.height // 8)
    h = max(c[1] for c in image.components)
    v = max(c[2] for c in image.components)
    unit = [(c, k) for k, (c, _, _) in enumerate(image.scan) for _ in range(image.components[c][1] * image.components[c][2])]
    wide, high = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    return unit, wide, wide * high


def dc_values(images: list[Image]) -> list[np.ndarray]:
    """For each image the DC coefficients of its blocks in the order of the stream, before prediction is undone per
    component: here it is undone. Lanes are restart intervals of images that share tables and unit layout."""
    out: list = [None] * len(images)
    groups: dict = {}
    for i, im in enumerate(images):
        unit, _, units = layout(im)
        key = (tuple(unit), tuple((im.tables[d].tobytes(), im.tables[16 + a].tobytes()) for _, d, a in im.scan))
        groups.setdefault(key, []).append((i, units, len(unit)))
    for (unit, _), members in groups.items():
        tables = [(images[members[0][0]].tables[d], images[members[0][0]].tables[16 + a]) for _, d, a in images[members[0][0]].scan]
        lanes, where = [], []
        for i, units, n in members:
            step = images[i].interval or units
            if len(images[i].data) != -(-units // step):
                raise ValueError("restart intervals are missing")
            out[i] = np.zeros(units * n, np.int32)
            for k, d in enumerate(images[i].data):
                lanes.append(d)
                where.append((i, k * step * n, min(step, units - k * step) * n))
        for lo in range(0, len(lanes), LANES):
            blocks = np.array([w[2] for w in where[lo : lo + LANES]])
            got = lane_dcs(lanes[lo : lo + LANES], blocks, unit, tables)
            for (i, at, n), row in zip(where[lo : lo + LANES], got, strict=True):
                out[i][at : at + n] = row[:n]
    return out


def lane_dcs(lanes: list[bytes], blocks: np.ndarray, unit, tables) -> np.ndarray:
    """DC coefficients of each lane's blocks; each lane advances by one Huffman symbol a step."""
    pad = b"\xff" * 8
    sizes = np.array([len(x) + 8 for x in lanes], np.int64)
    data = np.frombuffer(b"".join(x + pad for x in lanes) + pad, np.uint8).astype(np.uint64)
    view = (data[:-4] << np.uint64(32)) | (data[1:-3] << np.uint64(24)) | (data[2:-2] << np.uint64(16)) | (data[3:-1] << np.uint64(8)) | data[4:]
    position = 8 * (np.cumsum(sizes) - sizes)
    stop = position + 8 * (sizes - 8) + 7
    out = np.zeros((len(lanes), int(blocks.max())), np.int64)
    slots = sorted({c for c, _ in unit})
    predicted = np.zeros((len(lanes), max(slots) + 1), np.int64)
    live = np.arange(len(lanes))
    for b in range(out.shape[1]):
        if blocks[live].min() <= b:
            live = live[blocks[live] > b]
        component, slot = unit[b % len(unit)]
        dc, ac = tables[slot]
        p = position[live]
        word = view[p >> 3] << (p & 7).astype(np.uint64)
        got = dc[((word >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.int64)]
        size, length = got >> 5, got & 31
        if (length == 0).any():
            raise ValueError("no such code")
        p = p + length
        word = (view[p >> 3] << (p & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFFFF)
        extra = (word >> (np.uint64(40) - size.astype(np.uint64))).astype(np.int64)
        extra = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        predicted[live, component] += np.where(size > 0, extra, 0)
        out[live, b] = predicted[live, component]
        position[live] = p + size
        rest, k = live, np.ones(len(live), np.int64)
        while len(rest):
            p = position[rest]
            got = ac[((view[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(24) & np.uint64(0xFFFF)).astype(np.int64)]
            symbol, length = got >> 5, got & 31
            if (length == 0).any():
                raise ValueError("no such code")
            position[rest] = p + length + (symbol & 15)
            k = np.where(symbol == 0, 64, k + (symbol >> 4) + 1)
            more = k < 64
            rest, k = rest[more], k[more]
        if (position[live] > stop[live]).any():
            raise ValueError("the scan ends early")
    return out


def thumbnail(image: Image, dcs: np.ndarray) -> np.ndarray:
    """Luminance at one eighth, clipped to 0..255, height x width of the blocks that the image covers."""
    step = image.quantisers[image.components[0][3]]
    unit, wide, units = layout(image)
    if len(image.components) == 1:
        plane = dcs.reshape(-1, wide)
    else:
        h, v = image.components[0][1:3]
        own = dcs.reshape(units, len(unit))[:, [k for k, (c, _) in enumerate(unit) if c == 0]]
        plane = own.reshape(units // wide, wide, v, h).transpose(0, 2, 1, 3).reshape(units // wide * v, wide * h)
        top = [max(c[k] for c in image.components) for k in (1, 2)]
        plane = plane[: -(-image.height * v // (8 * top[1])), : -(-image.width * h // (8 * top[0]))]
    return np.clip(np.round(plane * step / 8 + 128), 0, 255).astype(np.uint8)


def thumbnails(raws: list[bytes]) -> list[list[np.ndarray]]:
    """The thumbnails of each stream's images."""
    images, owner = [], []
    for i, raw in enumerate(raws):
        at = 0
        while at < len(raw):
            images.append(parse(raw, at))
            owner.append(i)
            at = images[-1].end
    out: list[list[np.ndarray]] = [[] for _ in raws]
    for i, im, dcs in zip(owner, images, dc_values(images), strict=True):
        out[i].append(thumbnail(im, dcs))
    return out


def feature(parts: list[np.ndarray]) -> str:
    """Dimensions of the images, a CRC of the thumbnails and a difference hash: of 9 x 8 means over the first
    thumbnail's areas, whether each is above its right neighbour."""
    first = parts[0].astype(np.int64)
    high, wide = first.shape
    rows, cols = np.arange(9) * high // 8, np.arange(10) * wide // 9
    sums = np.zeros((high + 1, wide + 1), np.int64)
    sums[1:, 1:] = first.cumsum(axis=0).cumsum(axis=1)
    top, bottom = np.minimum(rows[:-1], high - 1), np.maximum(rows[1:], np.minimum(rows[:-1], high - 1) + 1)
    left, right = np.minimum(cols[:-1], wide - 1), np.maximum(cols[1:], np.minimum(cols[:-1], wide - 1) + 1)
    area = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
    mean = area / ((bottom - top)[:, None] * (right - left)[None, :])
    bits = np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()
    crc = 0
    for p in parts:
        crc = zlib.crc32(p.tobytes(), crc)
    return ",".join(f"{8 * p.shape[1]}x{8 * p.shape[0]}" for p in parts) + f";{bits};{crc:08x}"


def payload_of(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media (the stored stream)."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                raw = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                for x, y in bounded(raw):
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(x, y - x), pa.array([len(r) for r in raw[x:y]], pa.int64()), pa.array(store([payload_of(r) for r in raw[x:y]]), pa.binary())], names=["id", "n_bytes", "media"])

    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(run, f"id {read.dtypes[0][1]}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def bounded(parts: list[bytes], most: int = CHUNK):
    at = size = 0
    for i, p in enumerate(parts):
        if i > at and size + len(p) > most:
            yield at, i
            at, size = i, 0
        size += len(p)
    if at < len(parts):
        yield at, len(parts)


NAMES = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def features(ids: pa.Array, n_bytes: pa.Array, part: list[bytes]) -> pa.RecordBatch:
    """The columns of stored streams, all computed from what these decode to."""
    try:
        found = [(x, b"".join(t.tobytes() for t in x)) for x in thumbnails(part)]
    except (ValueError, KeyError, IndexError):  # one of them: find which
        found = [alone(x) for x in part]
    own = lambda f: [None if p is None else f(x, p) for x, p in found]
    return pa.RecordBatch.from_arrays([
        ids, n_bytes, pa.array(own(lambda x, p: len(p)), pa.int64()), pa.array(own(lambda x, p: hashlib.sha256(p).hexdigest()), pa.string()),
        pa.array(own(lambda x, p: zlib.crc32(p[-WIDTH:])), pa.int64()), pa.array([len(x) for x in part], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in part], pa.string()), pa.array(own(lambda x, p: feature(x)), pa.string())], names=NAMES)


def schema_of(id_type: str) -> str:
    return f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def columns_of(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From (id_col, n_bytes, media): id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                raws = part.column(2).to_pylist()
                for x, y in bounded(raws):
                    yield features(part.column(0).slice(x, y - x), part.column(1).slice(x, y - x), raws[x:y])

    return media.mapInArrow(run, schema_of(media.dtypes[0][1])).withColumnRenamed("id", id_col)


def alone(raw: bytes):
    try:
        x = thumbnails([raw])[0]
        return x, b"".join(t.tobytes() for t in x)
    except (ValueError, KeyError, IndexError):
        return [], None


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """stored and columns_of in one pass: a stream is read back in the task that stored it."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                raw = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                for x, y in bounded(raw):
                    yield features(part.column(0).slice(x, y - x), pa.array([len(r) for r in raw[x:y]], pa.int64()), store([payload_of(r) for r in raw[x:y]]))

    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(run, schema_of(read.dtypes[0][1])).withColumnRenamed("id", id_col)
