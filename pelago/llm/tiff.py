"""Operator 3: TIFF files in a binary column, one row per page, without an image library.

The reader walks the image directories of either byte order, decodes uncompressed, PackBits, LZW and deflate strips or
tiles, undoes horizontal differencing, and gives a page's 8-bit samples row by row.  The writer makes such files, so that
payloads can be stored in them and read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch, text_or_empty

# Fixed values of the format: tags, the sizes of field types, and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD_TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
NO_COMPRESSION, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODES = {"none": NO_COMPRESSION, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}


#: The largest page that is read: a binary column holds little more.
MOST_BYTES = 1 << 30


def unpack_bits(data: bytes, most: int = MOST_BYTES) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def unlzw(data: bytes, most: int = MOST_BYTES) -> bytes:
    """Codes from the high bit down, 9 to 12 bits, one code early; 256 clears and 257 ends."""
    out = bytearray()
    table: list[bytes] = []
    width, bits, held, last = 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257 or len(out) >= most:
            break
        if code == 256 or not table:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            if code == 256:
                continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """What :func:`unlzw` reads; the reader's table is one entry behind this one, so widths change one entry later."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table, size, word = {}, 258, b""
    put(256, 9)
    for byte in data:
        longer = word + bytes((byte,))
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        put(table[word] if len(word) > 1 else word[0], width)
        table[longer], size, word = size, size + 1, longer[-1:]
        if size >= 4094:
            put(256, 12)
            table, size = {}, 258
    if word:
        put(table[word] if len(word) > 1 else word[0], 9 + (size >= 512) + (size >= 1024) + (size >= 2048))
        size += 1
    put(257, 9 + (size >= 512) + (size >= 1024) + (size >= 2048))
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


#: Each reads about as many bytes as are asked for, however much the data would make.
_DECODERS = {NO_COMPRESSION: lambda data, most: data[:most], LZW: unlzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
_ENCODERS = {"none": bytes, "lzw": lzw, "deflate": lambda x: zlib.compress(x, 1), "packbits": pack_bits}


@dataclass
class Page:
    """One image: ``pixels`` is height x width x samples of unsigned bytes."""

    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray = field(repr=False)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in FIELD_TYPES:
            continue
        code, size = FIELD_TYPES[kind]
        place = at + 10 + 12 * i
        if size * count > len(data):
            raise ValueError("a field is longer than the file")
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        fields[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return fields, following


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directories; a chain that comes back on itself or bad data is a ValueError."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen, index = set(), 0
    try:
        while at:
            if at in seen:
                raise ValueError("the directories form a loop")
            seen.add(at)
            tags, at = _directory(data, order, at)
            yield _page(data, tags, index)
            index += 1
    except (struct.error, zlib.error, KeyError, IndexError, OverflowError) as e:
        raise ValueError(f"broken TIFF file: {e}") from e


def _page(data: bytes, tags: dict[int, list[int]], index: int) -> Page:
    """A page, after its directory has been checked: nothing is allocated for sizes that the file doesn't fill."""
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    samples = tags.get(SAMPLES, [1])[0]
    if set(tags.get(BITS, [1])) != {8} or tags.get(PLANAR, [1])[0] != 1:
        raise ValueError("only chunky 8-bit samples are read")
    compression, predictor = tags.get(COMPRESSION, [1])[0], tags.get(PREDICTOR, [1])[0]
    if compression not in _DECODERS or predictor not in (1, 2):
        raise ValueError(f"compression {compression} with predictor {predictor} is not read")
    tiled = TILE_OFFSETS in tags
    if tiled:
        across, down = tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        across, down = width, min(tags.get(ROWS_PER_STRIP, [height])[0], height)
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if not (width and height and samples and across and down):
        raise ValueError("a page, strip or tile has no pixels")
    if max(width * height, across * down) * samples > MOST_BYTES:
        raise ValueError("a page is too large")
    columns = -(-width // across)
    if len(offsets) != columns * -(-height // down) or len(counts) != len(offsets):
        raise ValueError("strips or tiles are missing, or too many")
    if any(offset + count > len(data) or not count for offset, count in zip(offsets, counts, strict=True)):
        raise ValueError("a strip or tile lies outside the file")
    blocks = []
    for i, (offset, count) in enumerate(zip(offsets, counts, strict=True)):
        top, left = i // columns * down, i % columns * across
        rows = down if tiled else min(down, height - top)
        want = rows * across * samples
        raw = _DECODERS[compression](data[offset : offset + count], want)
        if len(raw) < want:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(raw, np.uint8, want).reshape(rows, across, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        blocks.append((top, left, block[: height - top, : width - left]))
    if len(blocks) == 1:
        return Page(index, width, height, samples, compression, predictor, tiled, blocks[0][2])
    pixels = np.empty((height, width, samples), dtype=np.uint8)
    for top, left, block in blocks:
        pixels[top : top + block.shape[0], left : left + block.shape[1]] = block
    return Page(index, width, height, samples, compression, predictor, tiled, pixels)


def write_pages(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 2, strip_rows: int = 64, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of the given pages (height x width x samples of bytes), in strips or in tiles of (length, width)."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for pixels in pages:
        height, width, samples = pixels.shape
        down, across = tile or (min(strip_rows, height), width)
        offsets, counts = [], []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = pixels[top : top + down, left : left + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                raw = _ENCODERS[compression](np.ascontiguousarray(block).tobytes())
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        places = (TILE_OFFSETS, TILE_COUNTS) if tile else (STRIP_OFFSETS, STRIP_COUNTS)
        tags = {
            WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * samples), COMPRESSION: (3, [CODES[compression]]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]),
            places[0]: (4, offsets), SAMPLES: (3, [samples]), places[1]: (4, counts), PLANAR: (3, [1]), PREDICTOR: (3, [predictor]),
        } | ({TILE_WIDTH: (4, [across]), TILE_LENGTH: (4, [down])} if tile else {ROWS_PER_STRIP: (4, [down])})
        entries = []
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{FIELD_TYPES[kind][0]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                place, raw = len(out), raw
                out += raw
                raw = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + 12 * len(entries)
        out += struct.pack(order + "H", len(entries)) + b"".join(entries) + struct.pack(order + "I", 0)
    return bytes(out)


PAGES = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])


def tiff_pages(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page: ``id, page, width, height, samples, compression, predictor, tiled, pixels, error``.

    A null or broken file gives its pages up to the fault and then one row with null page and the ``error``: so do
    pages without pixels, pages of over MOST_BYTES, and strips that are missing, too short or outside the file.  A file
    without pages gives no row.  Repeated rows give their pages each.
    """

    def make(batch):
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                for p in read_pages(data or b""):
                    values = (key, p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None)
                    yield {k: [v] for k, v in zip(PAGES.names, values, strict=True)}
            except ValueError as e:
                yield {k: [v] for k, v in zip(PAGES.names, (key, *[None] * 8, str(e)), strict=True)}

    picked = media.select(media[id_col].cast("long").alias("id"), media[media_col].cast("binary").alias("media"))
    return picked.mapInArrow(per_batch(make, PAGES, 64), "id long, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string")


ROW_BYTES, PAGE_ROWS = 192, 1024  # a row is 64 pixels of 3 samples


def store_payload(payload: bytes) -> bytes:
    """A payload of whole rows as pages of at most ``PAGE_ROWS`` rows of 64 RGB pixels, deflate with differencing."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3)
    return write_pages([pixels[i : i + PAGE_ROWS] for i in range(0, len(pixels), PAGE_ROWS)])


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32())])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as a TIFF file, read the file back page by page, and describe what was read.

    The payload is the UTF-8 text with spaces up to a positive multiple of 192 bytes; null texts count as empty.  The
    feature is pages, mean and standard deviation of the samples read, and their entropy in bits.  Every row gives a
    row; equal texts give equal values.
    """

    def make(batch):
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            media = store_payload(raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES))
            sha, size, tail, counts, pages = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0
            for page in read_pages(media):
                part = page.pixels.tobytes()
                sha.update(part)
                size, tail, pages = size + len(part), part[-16:], pages + 1
                counts += np.bincount(page.pixels.ravel(), minlength=256)
            share = counts[counts > 0] / size
            mean = float(counts @ np.arange(256)) / size
            spread = max(0.0, float(counts @ np.arange(256) ** 2) / size - mean**2) ** 0.5
            feature = f"pages={pages} mean={mean:.4f} std={spread:.4f} entropy={float(-(share * np.log2(share)).sum()) + 0:.4f}"
            rows.append((key, len(raw), size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, pages))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MEDIA, strict=True)], schema=MEDIA)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return picked.mapInArrow(per_batch(make, MEDIA, 256), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")
