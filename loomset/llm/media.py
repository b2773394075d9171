"""Media columns: Netpbm and BMP images decoded to arrays, area-resized, tiled as NPY, with difference hashes.

Images are bytes in a binary column. `media_columns` decodes them, makes a small grey image by area
averages from an integral image, a 64-bit difference hash from that, and an NPY tile of the resized pixels.
`store_payload` goes the other way: any bytes become a lossless 8-bit image.

Null or empty images, truncated files and unknown formats give null columns and an `error` text, never a
failed task. Repeated rows give repeated results. Other columns of the input are kept unless one has the name
of an output column, which then holds the output.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payloads are padded with byte 255 to a multiple of this: 24 columns of 24 samples.
BLOCK, WIDTH = 576, 24
HASH_ROWS, HASH_COLUMNS = 8, 9


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A grey 8-bit image as binary PGM (P5)."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A colour 8-bit image as binary PPM (P6)."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A colour 8-bit image (rows, columns, 3) as uncompressed 24-bit BMP."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def _fields(data: bytes, count: int) -> tuple[list[int], int]:
    """Numbers of a Netpbm header after its magic; comments run from # to the line's end."""
    out: list[int] = []
    at = 2
    while len(out) < count:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    bits = kind in b"14"
    nums, at = _fields(data, 2 if bits else 3)
    width, height, top = nums[0], nums[1], 1 if bits else nums[2]
    depth = 3 if kind in b"36" else 1
    if width < 1 or height < 1 or not 0 < top < 65536:
        raise ValueError("bad Netpbm header")
    if kind in b"123":
        body = b"\n".join(line.partition(b"#")[0] for line in data[at:].split(b"\n"))
        cells = [bytes([x]) for x in body if x in b"01"] if bits else body.split()
        flat = np.array(cells[: width * height * depth], dtype="S5").astype(np.int64)
    elif bits:
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        flat = np.unpackbits(raw, axis=1)[:, :width].reshape(-1).astype(np.int64)
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", width * height * depth, at + 1)
    if bits:
        flat = 1 - flat
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    return flat.astype(np.uint8).reshape((height, width, depth) if depth == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32) or width < 1 or not height:
        raise ValueError("unsupported BMP")
    rows, size = abs(height), bits // 8
    stride = -(-width * size // 4) * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * size].reshape(rows, width, size)
    if bits == 8:
        at = 14 + struct.unpack_from("<I", data, 14)[0]
        palette = np.frombuffer(data, np.uint8, (start - at) // 4 * 4, at).reshape(-1, 4)
        raw = palette[raw[:, :, 0]]
    out = raw[:, :, 2::-1]
    return out[::-1] if height > 0 else out


def decode(data: bytes) -> np.ndarray:
    """Pixels (rows, columns) or (rows, columns, 3) of a P1 to P6 Netpbm or an uncompressed BMP."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over the rectangles of an even grid, from an integral image; parts of pixels count by their area."""

    def along(x: np.ndarray, n: int) -> np.ndarray:
        """Sums of x over n even cells of the first axis, interpolated between the integral image's rows."""
        total = np.zeros((x.shape[0] + 1, *x.shape[1:]))
        np.cumsum(x, axis=0, out=total[1:])
        at = np.arange(n + 1) * (x.shape[0] / n)
        low = np.minimum(at.astype(np.int64), x.shape[0] - 1)
        part = (at - low).reshape(-1, *[1] * (x.ndim - 1))
        return np.diff(total[low] * (1 - part) + total[low + 1] * part, axis=0)

    down = along(np.asarray(pixels, np.float64), rows)
    out = np.swapaxes(along(np.swapaxes(down, 0, 1), columns), 0, 1)
    return out * (rows * columns / (pixels.shape[0] * pixels.shape[1]))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, as 16 hexadecimal digits: whether each cell of an 8 by 9 grey thumbnail is darker than its right neighbour."""
    grey = pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])
    small = np.rint(area_resize(grey, HASH_ROWS, HASH_COLUMNS) * 256).astype(np.int64)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int) -> bytes:
    """The image resized to side by side, as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, 255).astype(np.uint8))
    return out.getvalue()


_MEDIA = {"width": T.IntegerType(), "height": T.IntegerType(), "channels": T.IntegerType(), "dhash": T.StringType(), "npy": T.BinaryType(), "error": T.StringType()}


def media_columns(df: DataFrame, image_col: str = "content", tile: int = 32) -> DataFrame:
    """Adds width, height, channels, dhash, npy and error to rows that hold an image in a binary column."""
    kept = [f for f in df.schema.fields if f.name.lower() not in _MEDIA]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in _MEDIA.items())])
    source = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{image_col}`").alias("__image"))

    def one(data: bytes | None) -> tuple:
        if not data:
            return None, None, None, None, None, "empty"
        try:
            x = decode(data)
        except (ValueError, IndexError, OverflowError, struct.error) as e:
            return None, None, None, None, None, str(e)[:200]
        return x.shape[1], x.shape[0], 1 if x.ndim == 2 else x.shape[2], difference_hash(x), npy_tile(x, tile), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
        for b in batches:
            made = [one(x.as_py()) for x in b.column(b.num_columns - 1)]
            cols = [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], *_MEDIA])

    return source.mapInArrow(run, schema)


def store_payload(payload: bytes) -> bytes:
    """Bytes, padded with 255 to a positive multiple of 576, as a PGM image 24 samples wide."""
    padded = payload + b"\xff" * (-len(payload) % BLOCK if payload else BLOCK)
    return encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))


def stored_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = 32) -> DataFrame:
    """Every whole text stored as an image, and read back from the stored bytes; equal texts get equal values.

    Returns doc_id, n_bytes, media (the PGM file), payload (decoded from it), feature (the difference hash) and npy
    (the image resized to a tile, as an NPY file).
    A null text is empty: one block of padding. A null doc_id stays null.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                payloads = [x.as_py() for x in rows.column(1)]
                media = [store_payload(p) for p in payloads]
                pixels = [decode(m) for m in media]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(p) for p in payloads], pa.int64()), pa.array(media, pa.binary()), pa.array([p.tobytes() for p in pixels], pa.binary()), pa.array([difference_hash(p) for p in pixels], pa.string()), pa.array([npy_tile(p, tile) for p in pixels], pa.binary())],
                    ["doc_id", "n_bytes", "media", "payload", "feature", "npy"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string, npy binary")


def digests(stored: DataFrame) -> DataFrame:
    """Sizes, checksums and the feature of stored_text()'s rows; the images themselves stay out."""
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.sha2("npy", 256).alias("tile_sha256"),
    )
