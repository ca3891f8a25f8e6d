"""Media columns: TIFF pages.

``tiff_pages`` walks the image directories of a binary column, decodes the strips or tiles
(none, PackBits, LZW, deflate), undoes horizontal differencing and emits one row per page.
``encode_documents`` stores byte payloads as 8-bit grey pages; the layout (compression,
strips or tiles, predictor) depends on the payload's size alone, so that every way of
decoding runs over a table.

Samples of 1, 2 and 4 bits come as a byte each, those of 8, 16 and 32 bits as they are stored.
Not decoded, and told as an error of the page: other or mixed widths, predictors but 1 and 2,
predictor 2 below 8 bits, other compressions.

Defined cases: null media give one row with the error "null"; media that aren't a TIFF give
one row with an error; a faulty or cut-off directory gives a row with an error and no samples,
a broken or looping chain one such row after the pages before it, and the other pages are
decoded; an empty table gives no row; columns to be carried along are named by the caller.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, column_bytes, documents

#: Tags, types and codes of the TIFF 6.0 format: fixed values.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
FILL_ORDER, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 266, 317, 322, 323, 324, 325
TYPES = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257

#: Payloads are cut into rows of ROW samples and pages of PAGE_ROWS rows.
UNIT, ROW, PAGE_ROWS, STRIP_ROWS, TILE = 576, 64, 256, 64, 64
#: (compression, tiled, predictor) by payload size, in turn.
LAYOUTS = [(DEFLATE, False, 2), (PACKBITS, False, 1), (DEFLATE, True, 2), (LZW, False, 2), (DEFLATE, True, 1), (PACKBITS, True, 1), (LZW, True, 1)]
SLICE = 4 << 20
#: A directory that declares a larger page gets an error: its memory would have no bound.
MOST_SAMPLES = 1 << 28

PAGE_FIELDS = [
    ("page", pa.int32()), ("n_pages", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32()), ("samples", pa.int32()),
    ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string()),
]
PAGE_DDL = "page int, n_pages int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"

#: Every byte with its bits the other way round.
_MIRRORED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(-1, 8), axis=1, bitorder="little").tobytes()
_RUNS = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(raw: bytes, row: int) -> bytes:
    """Each row of samples by itself, as the format asks."""
    out = []
    for at in range(0, len(raw), row):
        line, done = raw[at : at + row], 0
        for m in _RUNS.finditer(line):
            while done < m.start():
                n = min(128, m.start() - done)
                out.append(bytes((n - 1,)) + line[done : done + n])
                done += n
            out.append(bytes((257 - (m.end() - m.start()), line[m.start()])))
            done = m.end()
        while done < len(line):
            n = min(128, len(line) - done)
            out.append(bytes((n - 1,)) + line[done : done + n])
            done += n
    return b"".join(out)


def packbits_decode(raw: bytes) -> bytes:
    out, at, n = [], 0, len(raw)
    while at < n:
        head = raw[at]
        if head < 128:
            out.append(raw[at + 1 : at + 2 + head])
            at += 2 + head
        elif head > 128:
            out.append(raw[at + 1 : at + 2] * (257 - head))
            at += 2
        else:
            at += 1
    return b"".join(out)


def code_widths(n: int) -> np.ndarray:
    """Bits of the n codes after a clear code: the table grows by one from the second on."""
    table = 258 + np.maximum(np.arange(n) - 1, -1) + 1
    return np.where(table < 511, 9, np.where(table < 1023, 10, np.where(table < 2047, 11, 12)))


_BYTES = [bytes((b,)) for b in range(256)]


def lzw_encode(raw: bytes) -> bytes:
    """Codes from the most significant bit on; a clear code begins every table."""
    first = {b: i for i, b in enumerate(_BYTES)}
    groups: list[list[int]] = []
    codes, table, size, word = [], dict(first), 258, b""
    for b in map(_BYTES.__getitem__, raw):
        longer = word + b
        if longer in table:
            word = longer
            continue
        codes.append(table[word])
        table[longer] = size
        size += 1
        word = b
        if size == 4094:
            codes.append(table[word])
            word = b""
            groups.append([*codes, CLEAR])
            codes, table, size = [], dict(first), 258
    if word:
        codes.append(table[word])
    groups.append([*codes, END])
    every = [np.array([CLEAR])] + [np.array(g) for g in groups]
    widths = [np.array([9])] + [code_widths(len(g)) for g in groups]
    codes_, widths_ = np.concatenate(every), np.concatenate(widths)
    bits = ((codes_[:, None] >> (widths_[:, None] - 1 - np.arange(12))) & 1)[np.arange(12) < widths_[:, None]]
    return np.packbits(bits.astype(np.uint8)).tobytes()


def lzw_decode(raw: bytes) -> bytes:
    """Each stretch between clear codes is read as one array of codes of known widths."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    out: list[bytes] = []
    at, n = 0, len(bits)
    weights = 1 << np.arange(11, -1, -1)
    while at + 9 <= n:
        most = min(4096, (n - at) // 9)
        widths = code_widths(most)
        ends = at + np.cumsum(widths)
        most = int(np.searchsorted(ends, n, "right"))
        widths, starts = widths[:most], (ends - widths)[:most]
        if not most:
            break
        padded = np.concatenate([bits, np.zeros(12, np.uint8)]) if int(starts[-1]) + 12 > n else bits
        codes = ((padded[starts[:, None] + np.arange(12)] * weights).sum(axis=1) >> (12 - widths)).tolist()
        table = [*_BYTES, b"", b""]
        push, emit = table.append, out.append
        last, done = b"", False
        used = most
        for k, code in enumerate(codes):
            if code == CLEAR or code == END:
                used, done = k + 1, code == END
                break
            if code < len(table):
                word = table[code]
                if last:
                    push(last + word[:1])
            else:
                if not last or code > len(table):
                    raise ValueError("an LZW code is out of order")
                word = last + last[:1]
                push(word)
            emit(word)
            last = word
        at = int(ends[used - 1])
        if done:
            break
    return b"".join(out)


def compress(raw: bytes, compression: int, row: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(raw, 1)
    if compression == PACKBITS:
        return packbits_encode(raw, row)
    return lzw_encode(raw) if compression == LZW else raw


def decompress(raw: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(raw, size)
    elif compression == PACKBITS:
        out = packbits_decode(raw)
    elif compression == LZW:
        out = lzw_decode(raw)
    elif compression == NONE:
        out = raw
    else:
        raise ValueError(f"compression {compression} is not known")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def difference(samples: np.ndarray) -> np.ndarray:
    out = samples.copy()
    out[:, 1:] -= samples[:, :-1]
    return out


def encode_tiff(payload: bytes) -> bytes:
    """A payload, a multiple of ``UNIT`` bytes, as a little-endian TIFF of grey pages."""
    compression, tiled, predictor = LAYOUTS[len(payload) // UNIT % len(LAYOUTS)]
    grey = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    parts, at, link = [struct.pack("<2sHI", b"II", 42, 0)], 8, 4
    links: list[tuple[int, int]] = []
    for top in range(0, len(grey), PAGE_ROWS):
        page = grey[top : top + PAGE_ROWS]
        height, high = len(page), TILE if tiled else STRIP_ROWS
        if tiled and height % TILE:
            page = np.concatenate([page, np.zeros((TILE - height % TILE, ROW), np.uint8)])
        where, sizes = [], []
        for y in range(0, len(page), high):
            block = page[y : y + high]
            data = compress((difference(block) if predictor == 2 else block).tobytes(), compression, ROW)
            where.append(at)
            sizes.append(len(data))
            parts.append(data + b"\0" * (len(data) % 2))
            at += len(data) + len(data) % 2
        n = len(where)
        lists = 0
        if n > 1:
            lists = at
            parts.append(struct.pack(f"<{2 * n}I", *where, *sizes))
            at += 8 * n
        spot = ((4, n, lists), (4, n, lists + 4 * n)) if n > 1 else ((4, 1, where[0]), (4, 1, sizes[0]))
        entries = [(WIDTH, 3, 1, ROW), (LENGTH, 3, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1)]
        if tiled:
            entries += [(TILE_WIDTH, 3, 1, TILE), (TILE_LENGTH, 3, 1, TILE), (TILE_OFFSETS, *spot[0]), (TILE_COUNTS, *spot[1])]
        else:
            entries += [(STRIP_OFFSETS, *spot[0]), (ROWS_PER_STRIP, 3, 1, STRIP_ROWS), (STRIP_COUNTS, *spot[1])]
        if predictor == 2:
            entries.append((PREDICTOR, 3, 1, 2))
        entries.sort()
        links.append((link, at))
        directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"
        link = at + len(directory) - 4
        parts.append(directory)
        at += len(directory)
    out = bytearray(b"".join(parts))
    for place, value in links:
        struct.pack_into("<I", out, place, value)
    return bytes(out)


def directories(media: bytes) -> tuple[str, list[dict[int, tuple[int, ...]] | str]]:
    """The byte order and, in order, the tags of each image directory or what is wrong with
    it; where the chain can't be followed further, that is told last."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or len(media) < 8 or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen, out = struct.unpack_from(order + "I", media, 4)[0], set(), []
    while at:
        if at in seen:
            out.append("image directories form a loop")
            break
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", media, at)
        except struct.error as e:
            out.append(str(e))
            break
        try:
            out.append(directory(media, order, at, n))
        except struct.error as e:
            out.append(str(e))
        try:
            (at,) = struct.unpack_from(order + "I", media, at + 2 + 12 * n)
        except struct.error as e:
            if not isinstance(out[-1], str):
                out.append(str(e))
            break
    return order, out


def directory(media: bytes, order: str, at: int, n: int) -> dict[int, tuple[int, ...]]:
    """The n tags of the directory at a place."""
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
        letter = TYPES.get(kind)
        if letter is None:
            continue
        place = at + 10 + 12 * k
        if count * struct.calcsize(letter) > 4:
            (place,) = struct.unpack_from(order + "I", media, place)
        tags[tag] = struct.unpack_from(f"{order}{count}{letter}", media, place)
    return tags


def decode_page(media: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> dict:
    """The samples of one directory, row by row, samples of a pixel together."""
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples = tags[WIDTH][0], tags[LENGTH][0], one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if bits not in (1, 2, 4, 8, 16, 32) or any(b != bits for b in tags.get(BITS, ())):
        raise ValueError(f"{bits} bits a sample are not supported")
    if predictor not in {8: (1, 2), 16: (1, 2, 3), 32: (1, 2, 3)}.get(bits, (1,)):
        raise ValueError(f"predictor {predictor} is not supported for {bits} bits")
    if width * height * samples > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples in a page")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    tiled = TILE_OFFSETS in tags
    wide, high = (tags[TILE_WIDTH][0], tags[TILE_LENGTH][0]) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    where, sizes = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    planes = samples if one(PLANAR, 1) == 2 else 1
    deep = 1 if planes > 1 else samples
    across, down = -(-width // wide), -(-height // high)
    out = np.zeros((height, width, samples), kind)
    if min(len(where), len(sizes)) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        y, x = rest // across * high, rest % across * wide
        rows = high if tiled else min(high, height - y)
        raw, line = media[where[k] : where[k] + sizes[k]], -(-wide * deep * bits // 8)
        if bits < 8 and one(FILL_ORDER, 1) == 2:
            raw = raw.translate(_MIRRORED)
        raw = decompress(raw, compression, rows * line)
        if bits < 8:
            # rows begin on a byte
            each = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : wide * deep * bits].reshape(rows, wide, deep, bits)
            block = each @ (1 << np.arange(bits, dtype=np.uint8)[::-1])
        elif predictor == 3:
            # bytes of a row are differenced, the most significant ones of all samples first
            planes_of = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, deep), axis=1, dtype=np.uint8).reshape(rows, bits // 8, wide * deep)
            block = np.ascontiguousarray(planes_of.transpose(0, 2, 1)).view(f">u{bits // 8}").reshape(rows, wide, deep).astype(kind)
        else:
            block = np.frombuffer(raw, kind).reshape(rows, wide, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
        block = block[: height - y, : width - x]
        target = out[y : y + block.shape[0], x : x + block.shape[1]]
        target[:, :, plane : plane + deep] = block
    return {"width": width, "height": height, "bits": bits, "samples": samples, "compression": compression, "predictor": predictor, "tiled": tiled, "pixels": out.tobytes()}


def decode_pages(media: bytes | None) -> Iterator[dict]:
    """A dict of ``PAGE_FIELDS`` for each page; errors are told, not raised."""
    empty = dict.fromkeys([name for name, _ in PAGE_FIELDS])
    if media is None:
        yield empty | {"page": 0, "n_pages": 0, "error": "null"}
        return
    try:
        order, found = directories(media)
    except (ValueError, struct.error) as e:
        yield empty | {"page": 0, "n_pages": 0, "error": str(e)}
        return
    for k, tags in enumerate(found):
        row = empty | {"page": k, "n_pages": len(found)}
        if isinstance(tags, str):
            yield row | {"error": tags}
            continue
        try:
            row |= decode_page(media, order, tags)
        except Exception as e:  # noqa: BLE001  broken media fail in many ways, and a page must not fail the job
            row["error"] = f"{type(e).__name__}: {e}"
        yield row


def tiff_pages(media: DataFrame, media_col: str = "media", keep: list[str] = ()) -> DataFrame:
    """One row per page, in order, the pages of a row together: the columns of ``keep``
    (one with the name of a page column is refused) and those of ``PAGE_DDL``."""
    clash = {"_media", *(name for name, _ in PAGE_FIELDS)}.intersection(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} have names of page columns")
    chosen = media.select(*keep, F.col(media_col).alias("_media"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "_media", SLICE):
                rows = [list(decode_pages(x.as_py())) for x in batch.column(batch.num_columns - 1)]
                take = pa.array(np.repeat(np.arange(len(rows)), [len(x) for x in rows]))
                flat = [page for x in rows for page in x]
                held = [batch.column(k).take(take) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    held + [pa.array([x[name] for x in flat], kind) for name, kind in PAGE_FIELDS],
                    [*batch.schema.names[:-1], *(name for name, _ in PAGE_FIELDS)],
                )

    return chosen.mapInArrow(pages, ", ".join(x for x in (fields, PAGE_DDL) if x))


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as UTF-8, filled up with bytes 255 to a positive
    multiple of ``UNIT``, stored as a TIFF."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                data, offs = column_bytes(batch.column(1))
                raw, media = data.tobytes(), []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    full = max(1, -(-(b - a) // UNIT)) * UNIT
                    media.append(encode_tiff(raw[a:b] + b"\xff" * (full - (b - a))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents(docs).mapInArrow(stored, "doc_id long, n_bytes long, media binary")


def feature(payload: bytes) -> str:
    """A difference hash of the 8 by 9 grid of block means, and the mean in thousandths."""
    grid = np.frombuffer(payload, np.uint8).reshape(8, 9, -1).sum(axis=2, dtype=np.int64)
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex() + f"-{1000 * int(grid.sum()) // len(payload):06d}"


DIGEST_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"


def page_digests(pages: DataFrame) -> DataFrame:
    """Joins the pages of each row of ``tiff_pages`` (kept: doc_id, n_bytes, media_bytes,
    media_sha256), which lie together in their partition, and digests the samples."""
    import hashlib

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            rows = []
            cols = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
            for k, pixels in enumerate(cols["pixels"]):
                if cols["error"][k] is not None:
                    raise ValueError(f"page {cols['page'][k]} of document {cols['doc_id'][k]}: {cols['error'][k]}")
                held.append(pixels)
                if cols["page"][k] == cols["n_pages"][k] - 1:
                    payload = b"".join(held)
                    held = []
                    rows.append((cols["doc_id"][k], cols["n_bytes"][k], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), cols["media_bytes"][k], cols["media_sha256"][k], feature(payload), cols["n_pages"][k]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGEST_DDL.split(", ")])

    wanted = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "n_pages", "pixels", "error"]
    return pages.select(*wanted).mapInArrow(digests, DIGEST_DDL)
