"""Media columns: TIFF files as binary values, written and read with NumPy and zlib alone.

The reader walks the chain of image directories of either byte order, decodes PackBits, LZW or deflate
strips and tiles, undoes horizontal differencing, and emits one row per page. A page that can't be
read gives a row with its error and null samples; bytes that hold no directory give one such row with
page 0. Null media give no rows. Rows are independent, so repeated rows repeat and an empty table
stays empty.

The writer stores bytes as 8-bit samples. Which compression, layout and predictor it takes depends on
the bytes alone, so equal values give equal files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, with_arrow_columns

#: Fixed values of the format: tags, compressions and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES = 256, 257, 258, 259, 262, 273, 277
ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 7: ("B", 1), 16: ("Q", 8)}
#: Bytes in a row of samples, and the sides of a tile.
ROW, TILE = 192, 64
#: Samples of one page, at most; a directory that claims more is taken for damaged.
MOST_SAMPLES = 1 << 31
PAGES = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, feature string, error string"


def pack_bits(row: bytes) -> bytes:
    out, n, i, literal = bytearray(), len(row), 0, 0
    data = np.frombuffer(row, np.uint8)
    breaks = np.flatnonzero(data[1:] != data[:-1]) + 1
    starts = np.concatenate([[0], breaks])
    sizes = np.diff(np.concatenate([starts, [n]]))

    def literals(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = row[k : min(k + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(sizes >= 3):
        i, size = int(starts[k]), int(sizes[k])
        literals(literal, i)
        for left in range(size, 0, -128):
            run = min(left, 128)
            if run == 1:
                out += bytes([0, row[i]])
            else:
                out += bytes([257 - run, row[i]])
        literal = i + size
    literals(literal, n)
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = [], 0, len(data)
    total = 0
    while total < size and i < n:
        head = data[i]
        if head < 128:
            part = data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            part = data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
            continue
        out.append(part)
        total += len(part)
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, a bit wider one code early."""
    single = [bytes([b]) for b in range(256)]
    first = {b: k for k, b in enumerate(single)}
    table, size, width = dict(first), 258, 9
    bits, held, out = 256, 9, bytearray()
    word = b""
    for byte in map(single.__getitem__, data):
        longer = word + byte
        if longer in table:
            word = longer
            continue
        bits, held = bits << width | table[word], held + width
        if held >= 512:
            out += (bits >> held % 8).to_bytes(held // 8, "big")
            bits, held = bits & (1 << held % 8) - 1, held % 8
        table[longer] = size
        size += 1
        if size == 4094:
            bits, held = bits << width | 256, held + width
            table, size, width = dict(first), 258, 9
        elif size + 1 > 1 << width:
            width += 1
        word = byte
    if word:
        bits, held = bits << width | table[word], held + width
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    bits, held = bits << width | 257, held + width
    pad = -held % 8
    return bytes(out + (bits << pad).to_bytes((held + pad) // 8, "big"))


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes([b]) for b in range(256)] + [b"", b""]
    table, width, previous, out = list(first), 9, b"", []
    bits = held = at = total = 0
    n = len(data)
    while total < size:
        if held < width:
            step = data[at : at + 64]
            if not step:
                break
            bits, held, at = bits << 8 * len(step) | int.from_bytes(step, "big"), held + 8 * len(step), at + 64
            if held < width:
                break
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, previous = list(first), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("damaged LZW data")
        if previous:
            table.append(previous + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(entry)
        total += len(entry)
        previous = entry
    return b"".join(out)


def _entries(fields: list[tuple[int, int, tuple[int, ...]]], base: int) -> tuple[bytes, bytes]:
    """The directory and the values that don't fit into it; base: the place of these values."""
    head, tail = struct.pack("<H", len(fields)), b""
    for tag, kind, values in fields:
        code, width = FIELD[kind]
        raw = struct.pack(f"<{len(values)}{code}", *values)
        if len(raw) > 4:
            raw, tail = struct.pack("<I", base + len(tail)), tail + raw + b"\0" * (len(raw) % 2)
        head += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return head + struct.pack("<I", 0), tail


def encode(payload: bytes) -> bytes:
    """A one-page file of the bytes, whose count is a positive multiple of ROW."""
    choice = zlib.crc32(payload)
    compression = {0: LZW, 1: PACKBITS, 2: NONE}.get(choice % 8, DEFLATE)
    tiled, predictor = bool(choice >> 8 & 1), 2 if choice >> 9 & 1 and compression in (LZW, DEFLATE) else 1
    samples = 1 if tiled else 3
    width, height = ROW // samples, len(payload) // ROW
    image = np.frombuffer(payload, np.uint8).reshape(height, width, samples)
    if tiled:
        down, across = -(-height // TILE), -(-width // TILE)
        full = np.zeros((down * TILE, across * TILE, samples), np.uint8)
        full[:height, :width] = image
        blocks = [full[y * TILE : (y + 1) * TILE, x * TILE : (x + 1) * TILE] for y in range(down) for x in range(across)]
    else:
        blocks = [image[y : y + TILE] for y in range(0, height, TILE)]
    stored = []
    for block in blocks:
        if predictor == 2:
            block = block.copy()
            block[:, 1:] -= block[:, :-1].copy()
        rows = np.ascontiguousarray(block).reshape(len(block), -1)
        if compression == PACKBITS:
            stored.append(b"".join(pack_bits(r.tobytes()) for r in rows))
        elif compression == LZW:
            stored.append(lzw_encode(rows.tobytes()))
        else:
            stored.append(zlib.compress(rows.tobytes(), 6) if compression == DEFLATE else rows.tobytes())
    counts = tuple(map(len, stored))
    offsets = tuple(int(x) for x in 8 + np.cumsum([0, *counts[:-1]]))
    body = b"".join(stored)
    body += b"\0" * (len(body) % 2)
    fields = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (8,) * samples), (COMPRESSION, 3, (compression,)),
        (PHOTOMETRIC, 3, (2 if samples == 3 else 1,)), (SAMPLES, 3, (samples,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,)),
    ]
    if tiled:
        fields += [(TILE_WIDTH, 3, (TILE,)), (TILE_HEIGHT, 3, (TILE,)), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
    else:
        fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 3, (TILE,)), (STRIP_COUNTS, 4, counts)]
    fields.sort()
    place = 8 + len(body)
    head, tail = _entries(fields, place + 2 + 12 * len(fields) + 4)
    return b"II*\0" + struct.pack("<I", place) + body + head + tail


def directories(data: bytes):
    """The image directories in the order of their chain: tag -> values. A loop in the chain ends it."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        found = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in FIELD:
                code, width = FIELD[kind]
                place = at + 10 + 12 * k
                if n * width > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                if place + n * width > len(data):
                    raise ValueError("a field lies outside the file")
                found[tag] = struct.unpack_from(f"{order}{n}{code}", data, place)
        yield order, found
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _block(raw: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = raw
    elif compression == PACKBITS:
        out = unpack_bits(raw, size)
    elif compression == LZW:
        out = lzw_decode(raw, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(raw, size)
    else:
        raise ValueError(f"compression {compression} is not known")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def read_page(data: bytes, order: str, tags: dict) -> tuple[np.ndarray, dict]:
    """The page's samples (height, width, samples) and what the directory says of them."""
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    bits = set(tags.get(BITS, (1,)))
    if not width or not height or bits - {8, 16} or len(bits) != 1 or predictor not in (1, 2):
        raise ValueError("only 8- and 16-bit samples, with predictors 1 and 2, are read")
    kind = np.dtype(np.uint8) if bits == {8} else np.dtype(order + "u2")
    if width * height * samples > MOST_SAMPLES:
        raise ValueError("the page is too large")
    tiled = TILE_OFFSETS in tags
    if tiled:
        w, h, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        w, h, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    planes, inner = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError("strips or tiles are missing")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k in range(across * down * planes):
        plane, (y, x) = k // (across * down), divmod(k % (across * down), across)
        rows = h if tiled else min(h, height - y * h)
        raw = _block(data[offsets[k] : offsets[k] + counts[k]], compression, rows * w * inner * kind.itemsize)
        block = np.frombuffer(raw, kind).reshape(rows, w, inner).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        part = out[y * h : y * h + rows, x * w : x * w + w, slice(plane, plane + 1) if planar == 2 else slice(None)]
        part[:] = block[: part.shape[0], : part.shape[1]]
    return out, {"width": width, "height": height, "samples": samples, "compression": compression, "predictor": predictor, "tiled": tiled}


def feature(image: np.ndarray) -> str:
    """Mean and deviation, in thousandths, and a 64-bit average hash of an 8 x 8 grid of row-major sample runs."""
    flat = image.reshape(-1).astype(np.int64)
    n, total, squares = len(flat), int(flat.sum()), int((flat * flat).sum())
    edges = np.arange(64) * n // 64
    sums = np.add.reduceat(flat, np.minimum(edges, n - 1))
    sizes = np.maximum(np.diff(np.append(edges, n)), 1)
    grid = int("".join("1" if s * n > total * c else "0" for s, c in zip(sums.tolist(), sizes.tolist())), 2)
    return f"{total * 1000 // n}:{(squares * n - total * total) * 1000 // (n * n)}:{grid:016x}"


def pages(data: bytes):
    """Rows of PAGES."""
    page = 0
    try:
        for page, (order, tags) in enumerate(directories(data)):
            try:
                image, about = read_page(data, order, tags)
                yield page, *about.values(), image.astype(image.dtype.newbyteorder("<")).tobytes(), feature(image), None
            except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error, MemoryError) as e:
                yield (page, *[None] * 8, f"{type(e).__name__}: {e}")
    except (ValueError, struct.error) as e:
        yield (page, *[None] * 8, f"{type(e).__name__}: {e}")


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """df's rows, once per page of the TIFF file in the column `media`, with the columns of PAGES."""
    from pyspark.sql import types as T

    prepare(df.sparkSession)
    added = T._parse_datatype_string(PAGES)
    taken = {f.name.lower() for f in added}
    through = [i for i, f in enumerate(df.schema) if f.name.lower() not in taken]
    schema = T.StructType([df.schema[i] for i in through] + list(added))
    at = df.columns.index(media)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added]
        for batch in batches:
            rows, out = [], []
            for k, data in enumerate(batch.column(at).to_pylist()):
                for row in pages(data) if data is not None else ():
                    rows.append(k)
                    out.append(row)
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = [kept.column(i) for i in through] + [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def texts_as_tiff(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with media: the text's UTF-8, blanks up to a positive multiple of ROW, as a TIFF file."""
    prepare(docs.sparkSession)

    def compute(batch):
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        return [pa.array([encode(x.ljust(max(-(-len(x) // ROW), 1) * ROW)) for x in raw], pa.binary())]

    return with_arrow_columns(docs, "media binary", compute)
