"""Media columns: Netpbm and BMP decoded to arrays, area-resized by integral
images, and written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.tables import bounded_batches
from tagloom.llm.textblocks import blocks, utf8

_NETPBM = {b"P1": (1, True, 1), b"P2": (1, True, 0), b"P3": (3, True, 0), b"P4": (1, False, 1), b"P5": (1, False, 0), b"P6": (3, False, 0)}


def decode(data: bytes) -> np.ndarray:
    """Height x width (x 3 for colour) samples, 8 or 16 bits. Raises ValueError."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:2] in _NETPBM:
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(data: bytes) -> np.ndarray:
    channels, plain, bitmap = _NETPBM[data[:2]]
    at, numbers = 2, []
    while len(numbers) < (2 if bitmap else 3):
        while at < len(data) and (data[at : at + 1].isspace() or data[at] == 35):
            if data[at] == 35:  # a comment, to the line's end
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        numbers.append(int(data[at:end]))
        at = end
    width, height = numbers[:2]
    top = 1 if bitmap else numbers[2]
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("bad Netpbm size")
    count = width * height * channels
    if plain:
        rest = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = np.array([c - 48 for c in rest if c in b"01"] if bitmap else [int(x) for x in rest.split()], np.uint16)[:count]
    elif bitmap:
        stride = (width + 7) // 8
        body = np.frombuffer(data, np.uint8, offset=at + 1)[: stride * height]
        if len(body) < stride * height:
            raise ValueError("Netpbm data is short")
        values = np.unpackbits(body.reshape(height, stride), axis=1)[:, :width].ravel().astype(np.uint16)
    else:
        kind = np.dtype(">u2" if top > 255 else np.uint8)
        values = np.frombuffer(data, kind, max(0, min(count, (len(data) - at - 1) // kind.itemsize)), min(at + 1, len(data)))
    if len(values) < count:
        raise ValueError("Netpbm data is short")
    if bitmap:
        values = (1 - values) * 255
    out = values.astype(np.uint16 if top > 255 else np.uint8, copy=False)
    return out.reshape((height, width) if channels == 1 else (height, width, 3))


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("BMP is short")
    offset, = struct.unpack_from("<I", data, 10)
    header, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    colours, = struct.unpack_from("<I", data, 46)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width < 1 or not height:
        raise ValueError("BMP of a kind that is not read")
    up, height = height > 0, abs(height)
    stride = (width * bits + 31) // 32 * 4
    body = np.frombuffer(data, np.uint8, offset=min(offset, len(data)))[: stride * height]
    if len(body) < stride * height:
        raise ValueError("BMP data is short")
    rows = body.reshape(height, stride)
    if up:
        rows = rows[::-1]
    if bits <= 8:
        table = np.frombuffer(data, np.uint8, offset=14 + header)[: 4 * (colours or 1 << bits)].reshape(-1, 4)[:, 2::-1]
        per = 8 // bits
        index = rows if bits == 8 else ((rows[:, :, None] >> np.arange(8 - bits, -1, -bits, dtype=np.uint8)) & ((1 << bits) - 1)).reshape(height, stride * per)
        index = index[:, :width]
        if len(index) and index.max() >= len(table):
            raise ValueError("BMP colour out of its table")
        plain = (table[:, 0] == table[:, 1]).all() and (table[:, 1] == table[:, 2]).all()
        return np.ascontiguousarray(table[:, 0])[index] if plain else table[index]
    return rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1].copy()


def encode_pgm(payload: bytes, width: int) -> bytes:
    """8-bit samples, row by row; the payload's length is a multiple of the width."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def encode_bmp(image: np.ndarray) -> bytes:
    """An 8-bit grey or 24-bit colour BMP, rows from bottom to top."""
    grey = image.ndim == 2
    height, width = image.shape[:2]
    rows = (image if grey else image[:, :, ::-1].reshape(height, width * 3)).astype(np.uint8)[::-1]
    stride = (rows.shape[1] + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : rows.shape[1]] = rows
    table = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros(0, np.uint8)
    start = 54 + table.size
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + body.size, 0, 0, start, 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 if grey else 0, 0)
    return head + table.tobytes() + body.tobytes()


def _sums_before(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The integral image along the first axis at fractional places: the sum of
    all samples before each, between two samples interpolated. Only these rows of it are
    kept, so that memory does not follow the image's size."""
    n = len(x)
    low = np.minimum(np.floor(edges).astype(np.int64), n)
    total = np.zeros(x.shape[1:], np.float64 if x.dtype.kind == "f" else np.int64)
    out = np.empty((len(edges), *x.shape[1:]))
    at = 0
    for k, (place, part) in enumerate(zip(low.tolist(), (edges - low).tolist(), strict=True)):
        if place > at:
            total = total + x[at:place].sum(axis=0, dtype=total.dtype)
            at = place
        out[k] = total if part == 0 else total + part * x[place]
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the samples under each target cell, cells cut at fractions, from
    the integral image: its values at fractional corners are interpolated. The
    axis that shrinks more goes first."""
    x = image
    sizes = {0: height, 1: width}
    for axis in sorted(sizes, key=lambda a: -x.shape[a] / sizes[a]):
        n, size = x.shape[axis], sizes[axis]
        sums = _sums_before(np.moveaxis(x, axis, 0), np.arange(size + 1) * n / size)
        x = np.moveaxis(np.diff(sums, axis=0) * (size / n), 0, axis)
    return x


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: is a cell of the 8 x 9 grey image brighter than the one to its right."""
    small = np.round(grey(area_resize(image, 8, 9)), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def _rounded(image: np.ndarray) -> np.ndarray:
    return np.rint(np.round(image, 6)).astype(np.uint8)  # sixth digit first, so that halves are halves


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def tiles(media: DataFrame, id_col: str, data_col: str, side: int = 32) -> DataFrame:
    """(id_col, height, width, channels, tile, dhash, error) of a column of Netpbm
    or BMP files: `tile` is a `side` x `side` NPY file of 8-bit samples. Null or
    unreadable data has null columns and the reason in `error`."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("data"):
                try:
                    if not x.is_valid:
                        raise ValueError("null")
                    image = decode(x.as_buffer().to_pybytes())
                    small = area_resize(image, side, side) / (257 if image.dtype == np.uint16 else 1)
                    rows.append((image.shape[0], image.shape[1], 1 if image.ndim == 2 else 3, npy(_rounded(small)), difference_hash(image), None))
                except ValueError as e:
                    rows.append((None, None, None, None, None, str(e)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["id", "height", "width", "channels", "tile", "dhash", "error"])

    return media.select(F.col(id_col).alias("id"), F.col(data_col).alias("data")).mapInArrow(run, f"id {kind}, height long, width long, channels long, tile binary, dhash string, error string").withColumnRenamed("id", id_col)


UNIT = 64


def encode_text(payload: bytes) -> bytes:
    """The payload as grey samples 64 wide: a BMP file where its checksum is a
    multiple of four, else a PGM file, so that equal texts have equal files."""
    if zlib.crc32(payload) % 4 == 0:
        return encode_bmp(np.frombuffer(payload, np.uint8).reshape(-1, UNIT))
    return encode_pgm(payload, UNIT)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = utf8(batch.column("text"))
        for i, j in blocks(off):
            sizes = np.diff(off[i : j + 1])
            media = [encode_text(raw[a : a + n].tobytes() + bytes(-n % UNIT if n else UNIT)) for a, n in zip(off[i:j].tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(sizes), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each whole text's UTF-8, padded with zeros to a
    positive multiple of 64, as a grey PGM or BMP file 64 samples wide. A null is empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_stored, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for n, x in zip(batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            media = x.as_buffer().to_pybytes()
            image = decode(media)
            payload = image.tobytes()
            tile = npy(_rounded(area_resize(image, 8, 8)))
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), tile))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["id", *names])


def read_stored(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decodes `store_texts`' files, as a written table gives them back, and digests what
    they hold; `feature` is the difference hash, `tile` an 8 x 8 NPY file."""
    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return stored.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(_read_back, schema).withColumnRenamed("id", id_col)
