"""TIFF media columns.

``tiff_pages`` walks the image directories of every file in a binary column,
decodes PackBits, LZW, deflate or plain strips and tiles, undoes horizontal
and floating-point predictors and emits one row per page.  ``tiff_bytes``
writes a grey 8-bit image, for storing bytes losslessly as samples.

Only the parts of a codec that need a loop over codes are Python loops;
predictors and tile placement are array operations.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import chunks, table

# Fixed values of the TIFF 6.0 format: tags, field type sizes, codecs.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 13: "I"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

#: No codec here makes more bytes of one than this (LZW: 12 bits for at most some 4,000).
MOST_FROM_ONE = 3000


class Page(NamedTuple):
    width: int
    height: int
    samples: int
    bits: int
    codec: int
    predictor: int
    pixels: bytes


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    begin = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1])
    length = np.diff(np.concatenate([begin, [len(a)]]))
    out, at = bytearray(), 0
    for s, n in zip(begin[length > 2].tolist() + [len(data)], length[length > 2].tolist() + [0], strict=True):
        for i in range(at, s, 128):
            part = data[i : min(i + 128, s)]
            out.append(len(part) - 1)
            out += part
        for left in range(n, 0, -128):
            out += bytes(((257 - min(left, 128)) & 255, data[s])) if left > 1 else bytes((0, data[s]))
        at = s + n
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits, width raised one code early; the table is cleared before it is full."""
    codes: list[tuple[int, int]] = [(256, 9)]
    known = {bytes((i,)): i for i in range(256)}
    held, following, width = b"", 258, 9
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in known:
            held = longer
            continue
        codes.append((known[held], width))
        known[longer] = following
        following += 1
        if following > (1 << width) - 1:
            width += 1
        if following == 4094:
            codes.append((256, width))
            known = {bytes((j,)): j for j in range(256)}
            following, width = 258, 9
        held = data[i : i + 1]
    if held:
        codes.append((known[held], width))
        following += 1
        if following > (1 << width) - 1:
            width += 1
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    out: list[bytes] = []
    made, buffer, held, width, at = 0, 0, 0, 9, 0
    entries: list[bytes] = []
    before = b""
    while made < size:
        while held < width:
            if at >= len(data):
                return b"".join(out)[:size]
            buffer = (buffer << 8 | data[at]) & 0xFFFFFF
            held += 8
            at += 1
        code = buffer >> (held - width) & ((1 << width) - 1)
        held -= width
        if code == 257:
            break
        if code == 256:
            entries = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, before = 9, b""
            continue
        if not entries or code > len(entries) or code == len(entries) and not before:
            raise ValueError("broken LZW data")
        entry = entries[code] if code < len(entries) else before + before[:1]
        if before:
            entries.append(before + entry[:1])
        # Codes widen one code early, before the table reaches a power of two.
        width = min(12, max(9, (len(entries) + 1).bit_length()))
        out.append(entry)
        made += len(entry)
        before = entry
    return b"".join(out)[:size]


def _unpacked(codec: int, data: bytes, size: int) -> bytes:
    if codec == PLAIN:
        out = data[:size]
    elif codec == PACKBITS:
        out = packbits_decode(data, size)
    elif codec == LZW:
        out = lzw_decode(data, size)
    elif codec in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"unknown compression {codec}")
    if len(out) < size:
        raise ValueError(f"a strip or tile ends after {len(out)} of {size} bytes")
    return out


def _unpredicted(block: bytes, rows: int, columns: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """Rows of a strip or tile as bytes (little-endian samples), predictor undone."""
    width = bits // 8
    if predictor == 3:  # byte planes, most significant first, differenced across the row
        planes = np.frombuffer(block, np.uint8).reshape(rows, columns * samples * width)
        steps = planes.reshape(rows, -1, samples).cumsum(axis=1, dtype=np.uint8)
        return np.ascontiguousarray(steps.reshape(rows, width, columns * samples)[:, ::-1].transpose(0, 2, 1)).reshape(rows, -1)
    if bits < 8:
        return np.frombuffer(block, np.uint8).reshape(rows, -1)
    values = np.frombuffer(block, f"{order}u{width}").astype(f"<u{width}").reshape(rows, columns, samples)
    if predictor == 2:
        values = values.cumsum(axis=1, dtype=values.dtype)
    return np.ascontiguousarray(values).reshape(rows, -1).view(np.uint8)


def read_pages(data: bytes) -> Iterator[Page]:
    """Every page of a TIFF file (classic, either byte order), in directory order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, tuple] = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in FIELD:
                continue
            form = f"{order}{n}{FIELD[kind]}"
            inline = struct.calcsize(form) <= 4
            tags[tag] = struct.unpack_from(form, data, at + 10 + 12 * i if inline else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0])
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
        yield _page(data, tags, order)


def _page(data: bytes, tags: dict[int, tuple], order: str) -> Page:
    one = lambda tag, otherwise: tags.get(tag, (otherwise,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    codec, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError("bit depths other than equal powers of two")
    planes = samples if one(PLANAR, 1) == 2 else 1
    each = samples // planes
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    row_bytes = lambda columns: (columns * each * bits + 7) // 8
    if planes * height * row_bytes(width) > MOST_FROM_ONE * len(data):
        raise ValueError(f"{width} x {height} samples cannot come from {len(data)} bytes")
    whole = np.zeros((planes, height, row_bytes(width)), np.uint8)
    per_row = -(-width // across) if across else 0
    per_plane = per_row * (-(-height // down) if down else 0)
    if min(len(offsets), len(sizes)) < per_plane * planes:
        raise ValueError("strips or tiles are missing")
    if tiled and down * row_bytes(across) > MOST_FROM_ONE * len(data):
        raise ValueError(f"tiles of {across} x {down} cannot come from {len(data)} bytes")
    for i in range(per_plane * planes):
        plane, place = divmod(i, per_plane)
        top, left = place // per_row * down, place % per_row * across
        rows = down if tiled else min(down, height - top)
        block = _unpacked(codec, data[offsets[i] : offsets[i] + sizes[i]], rows * row_bytes(across))
        block = _unpredicted(block, rows, across, each, bits, predictor, order)
        x = left * each * bits // 8
        part = block[: height - top, : whole.shape[2] - x]
        whole[plane, top : top + len(part), x : x + part.shape[1]] = part
    if planes > 1 and bits >= 8:
        whole = whole.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    elif planes > 1:
        each_bit = np.unpackbits(whole, axis=2)[:, :, : width * bits].reshape(planes, height, width, bits)
        whole = np.packbits(np.ascontiguousarray(each_bit.transpose(1, 2, 0, 3)).reshape(height, -1), axis=1)
    return Page(width, height, samples, bits, codec, predictor, whole.tobytes())


def tiff_bytes(pixels: np.ndarray, codec: int = DEFLATE, predictor: int = 1, rows: int = 128, tile: tuple[int, int] | None = None) -> bytes:
    """A one-page grey 8-bit TIFF of ``pixels`` (height x width), in strips of ``rows`` or in tiles."""
    height, width = pixels.shape
    down, across = tile or (rows, width)
    pack = {PLAIN: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}[codec]
    blocks = []
    for top in range(0, height, down):
        for left in range(0, width, across):
            part = pixels[top : top + down, left : left + across]
            if tile:
                part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1])))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            blocks.append(pack(np.ascontiguousarray(part).tobytes()))
    n = len(blocks)
    starts = 8 + np.concatenate([[0], np.cumsum([len(b) + len(b) % 2 for b in blocks])])
    lists = int(starts[-1])
    directory = lists + 8 * n * (n > 1)
    offsets, sizes = (int(starts[0]), len(blocks[0])) if n == 1 else (lists, lists + 4 * n)
    fields = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, codec), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
    fields += [(TILE_WIDTH, 4, 1, across), (TILE_HEIGHT, 4, 1, down), (TILE_OFFSETS, 4, n, offsets), (TILE_COUNTS, 4, n, sizes)] if tile else [(STRIP_OFFSETS, 4, n, offsets), (ROWS_PER_STRIP, 4, 1, down), (STRIP_COUNTS, 4, n, sizes)]
    out = [struct.pack("<2sHI", b"II", 42, directory)]
    for b in blocks:
        out.append(b + b"\0" * (len(b) % 2))
    if n > 1:
        out.append(struct.pack(f"<{n}I", *map(int, starts[:-1])) + struct.pack(f"<{n}I", *map(len, blocks)))
    out.append(struct.pack("<H", len(fields)))
    for tag, kind, count, value in sorted(fields):
        out.append(struct.pack("<HHI", tag, kind, count) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value)))
    out.append(struct.pack("<I", 0))
    return b"".join(out)


PAGES = "page int, width int, height int, samples int, bits int, codec int, predictor int, pixels binary, error string"


def tiff_pages(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """One row per page: the ``keep`` columns, then page, width, height, samples, bits, codec, predictor, pixels, error.

    ``pixels`` holds the samples row by row, little-endian, interleaved.  A null
    file and a file without a directory give no row; a broken file gives the
    pages before the break and then one row that has only ``error``.  Broken are
    also strips that end early or are missing, and sizes that the file cannot
    hold.  A chain of directories may be of any length; a loop ends it.  Kept
    columns that bear a page column's name are refused.  Repeated rows give
    repeated pages, an empty table no page.
    """
    names = [f.split()[0] for f in PAGES.split(", ")]
    if clash := {*keep} & {*names}:
        raise ValueError(f"columns {sorted(clash)} would clash with those of the pages")
    source = df.select(*keep, F.col(media).alias("__media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 7 + [pa.binary(), pa.string()]
        for batch in chunks(batches, "__media", 1_000_000):
            at, rows = [], []
            for i, data in enumerate(batch.column("__media").to_pylist()):
                if data is None:
                    continue
                try:
                    for k, page in enumerate(read_pages(data)):
                        at.append(i)
                        rows.append((k, *page, None))
                except (ValueError, KeyError, IndexError, ZeroDivisionError, MemoryError, struct.error, zlib.error) as e:
                    at.append(i)
                    rows.append((*[None] * 8, f"{type(e).__name__}: {e}"))
            kept = batch.select(keep).take(pa.array(at, pa.int64())) if keep else batch.select([])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*keep, *names])

    return source.mapInArrow(pages, f"{schema}, {PAGES}" if keep else PAGES)


#: The forms that stored bytes take: codec, predictor, tile.
FORMS = ((LZW, 1, None), (PACKBITS, 1, None), (DEFLATE, 2, (32, 32)), (DEFLATE, 2, None), (DEFLATE, 1, None))


def bytes_as_tiff(df: DataFrame, data: str, out: str = "media") -> DataFrame:
    """``df`` with its binary column ``data``, padded with zero bytes to a positive multiple of 64, as a TIFF image of 64 columns.

    Nulls count as empty.  The form (one of FORMS) follows from a checksum of
    the padded bytes, so every form meets every length and equal bytes are
    stored alike.  An empty table gives an empty one; an input column called
    ``out`` is refused.
    """
    if out in df.columns:
        raise ValueError(f"the table already has a column {out}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, data):
            media = []
            for raw in batch.column(data).to_pylist():
                raw = raw or b""
                padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
                codec, predictor, tile = FORMS[zlib.crc32(padded) % len(FORMS)]
                media.append(tiff_bytes(np.frombuffer(padded, np.uint8).reshape(-1, 64), codec, predictor, tile=tile))
            yield batch.append_column(out, pa.array(media, pa.binary()))

    return df.mapInArrow(store, f"{fields}, {out} binary")


def features(pages: DataFrame) -> DataFrame:
    """``pages`` with ``feature``: mean, spread, share of zero samples and mean step between neighbouring rows of 8-bit pages, as text.

    Pages without samples (error rows) have none; an empty table gives an empty
    one; an input column called ``feature`` is refused.
    """
    if "feature" in pages.columns:
        raise ValueError("the table already has a column feature")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "pixels"):
            out = []
            for pixels, height in zip(batch.column("pixels").to_pylist(), batch.column("height").to_pylist(), strict=True):
                if not pixels:
                    out.append(None)
                    continue
                a = np.frombuffer(pixels, np.uint8)
                n, s, q = len(a), int(a.sum(dtype=np.int64)), int(np.square(a, dtype=np.uint16).sum(dtype=np.int64))
                rows = a.reshape(height, -1).astype(np.int16)
                step = int(np.abs(np.diff(rows, axis=0)).sum(dtype=np.int64))
                out.append(f"mean={s / n:.4f};sd={max(0.0, q / n - (s / n) ** 2) ** 0.5:.4f};zero={1 - np.count_nonzero(a) / n:.4f};step={step / max(1, n - rows.shape[1]):.4f}")
            yield batch.append_column("feature", pa.array(out, pa.string()))

    return pages.mapInArrow(measure, f"{fields}, feature string")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as a TIFF page, read back and measured."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    stored = bytes_as_tiff(raw, "raw").select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = features(tiff_pages(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"]))
    size = F.octet_length("pixels")
    return pages.select("doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "codec")
