"""Media columns: Netpbm and BMP images as numpy arrays, tiles and difference hashes.

Images are decoded from the bytes of a column inside Spark tasks, resized by
area through integral images and written as NPY tiles with a difference hash.
Payloads of any kind can be stored losslessly as 8-bit grey images.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shielded, table

#: Payloads are padded to a positive multiple of this, which is the width of their images.
BLOCK = 64
TILE = 32
_HEAD = re.compile(rb"P([1-6])((?:\s|#[^\n\r]*[\n\r])+)")
_NUMBER = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16 of shape (height, width) or (height, width, 3); bitmaps have 1 for black.

    Raises ValueError for other or truncated data.
    """
    m = _HEAD.match(data)
    if not m:
        raise ValueError("not Netpbm")
    kind, at, sizes = int(m[1]), m.end(), []
    for _ in range(2 if kind in (1, 4) else 3):
        n = _NUMBER.match(data, at)
        if not n or len(n[1]) > 10:
            raise ValueError("bad header")
        sizes.append(int(n[1]))
        at = n.end()
    width, height, most = sizes[0], sizes[1], sizes[2] if len(sizes) > 2 else 1
    if not 0 < most < 65536:
        raise ValueError("bad maximum")
    channels = 3 if kind in (3, 6) else 1
    count, row = width * height * channels, -(-width // 8)
    wide = most > 255
    # No sample takes less than a bit (packed), a byte, or a digit; so sizes beyond the data are refused before memory is taken.
    if (row * height if kind == 4 else count * (1 + (wide and kind > 4))) > len(data) - at:
        raise ValueError("short data")
    if kind == 1:
        digits = re.sub(rb"#[^\n\r]*|\s", b"", data[at:])
        if digits[:count].strip(b"01"):
            raise ValueError("bad sample")
        values = np.frombuffer(digits, np.uint8)[:count] - 48
    elif kind in (2, 3):
        samples = re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:count]
        if not all(x.isdigit() and len(x) <= 10 for x in samples):
            raise ValueError("bad sample")
        values = np.array(samples, dtype=np.int64)
    elif kind == 4:
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        values = np.unpackbits(packed, axis=1)[:, :width]
    else:
        values = np.frombuffer(data, ">u2" if wide else np.uint8, count, at + 1)
    if values.size != count:
        raise ValueError("short data")
    if values.size and values.max() > most:
        raise ValueError("sample beyond the maximum")
    shape = (height, width, 3) if channels == 3 else (height, width)
    return values.reshape(shape).astype(np.uint16 if wide else np.uint8)


def maximum(data: bytes) -> int:
    """The sample value that stands for full brightness."""
    m = _HEAD.match(data)
    if not m or m[1] in b"14":
        return 1 if m else 255
    at = m.end()
    for _ in range(3):
        n = _NUMBER.match(data, at)
        at = n.end()
    return int(n[1])


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as uint8: (height, width) if its palette is grey, else (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    number = lambda at, n=4, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, head, width, height = number(10), number(14), number(18, signed=True), number(22, signed=True)
    bits, packing, colours = number(28, 2), number(30), number(46)
    plain_masks = bits == 32 and data[54:66] == b"".join((255 << k).to_bytes(4, "little") for k in (16, 8, 0))
    if not (packing == 0 or packing == 3 and plain_masks) or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height or head < 40:
        raise ValueError("unsupported BMP")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    if start < 54 or len(data) < start + stride * rows or bits <= 8 and not 0 <= colours <= 1 << bits:
        raise ValueError("short data")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if bits > 8:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    if bits == 1:
        index = np.unpackbits(raw, axis=1)[:, :width]
    elif bits == 4:
        index = np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)[:, :width]
    else:
        index = raw[:, :width]
    palette = np.zeros((256, 3), np.uint8)
    listed = 4 * (colours or 1 << bits)
    if 14 + head + listed > len(data):
        raise ValueError("short palette")
    held = np.frombuffer(data, np.uint8, listed, 14 + head).reshape(-1, 4)[:, 2::-1]
    if index.size and index.max() >= len(held):
        raise ValueError("colour beyond the palette")
    palette[: len(held)] = held
    return palette[index, 0] if (held[:, 0] == held[:, 1]).all() and (held[:, 1] == held[:, 2]).all() else palette[index]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(image: np.ndarray) -> bytes:
    """An 8-bit grey image as binary PGM."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """An 8-bit grey image as BMP with a grey palette."""
    height, width = image.shape
    stride = (width + 3) // 4 * 4
    pixels = np.zeros((height, stride), np.uint8)
    pixels[:, :width] = image[::-1]
    palette = np.zeros((256, 4), np.uint8)
    palette[:, :3] = np.arange(256)[:, None]
    word = lambda *values: b"".join(v.to_bytes(4, "little") for v in values)
    start = 54 + 1024
    head = b"BM" + word(start + pixels.size, 0, start) + word(40, width, height) + (1).to_bytes(2, "little") + (8).to_bytes(2, "little")
    return head + word(0, pixels.size, 2835, 2835, 256, 0) + palette.tobytes() + pixels.tobytes()


#: Samples whose integrals are held at once; taller images are read in strips.
STRIP = 1 << 20


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the edges of m equal parts of n samples lie: whole samples before each, and the part of the next."""
    x = np.arange(m + 1) * (n / m)
    whole = np.minimum(x.astype(np.int64), n - 1)
    return whole, x - whole


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the (fractional) area under each new pixel, by an integral image; float64.

    The integral image is needed only at the edges of the new rows, so it is
    made strip by strip with the sums so far carried along.
    """
    h, w = image.shape[:2]
    whole, part = _edges(h, height)
    at_edge = np.zeros((height + 1, w, *image.shape[2:]))
    carry, step = np.zeros(at_edge.shape[1:]), max(1, STRIP // max(1, w))
    for lo in range(0, h, step):
        strip = image[lo : lo + step].astype(np.float64)
        total = np.concatenate([carry[None], carry + strip.cumsum(0)])
        for k in np.flatnonzero((whole >= lo) & (whole < lo + len(strip))):
            at_edge[k] = total[whole[k] - lo] + part[k] * strip[whole[k] - lo]
        carry = total[-1]
    rows = np.diff(at_edge, axis=0)
    total = np.concatenate([np.zeros((height, 1, *image.shape[2:])), rows.cumsum(1)], axis=1)
    whole, part = _edges(w, width)
    shape = (1, -1, *[1] * (image.ndim - 2))
    at_edge = total[:, whole] * (1 - part).reshape(shape) + total[:, whole + 1] * part.reshape(shape)
    return np.diff(at_edge, axis=1) / ((h / height) * (w / width))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Hex of side * side bits: is a pixel of the reduced grey image brighter than its left neighbour."""
    small = grey(resize_area(image, side, side + 1))
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def image_columns(df: DataFrame, column: str = "media", tile: int = TILE) -> DataFrame:
    """df with height, width, channels, tile_npy (tile x tile float32 from 0 to 1 as an NPY file) and dhash of the image in `column`.

    Null, empty, malformed or unsupported bytes give null in all of them; no
    content of a row stops a job. Equal bytes give equal values. Columns of df
    with the added names are replaced. Images are decoded one at a time.
    """
    df = df.drop(*IMAGE)
    return df.mapInArrow(_image_step(column, tile), _form(df, "height int, width int, channels int, tile_npy binary, dhash string"))


#: Columns that image_columns adds, and those that digests adds.
IMAGE = ["height", "width", "channels", "tile_npy", "dhash"]
DIGESTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]


def _form(df: DataFrame, added: str, without: tuple[str, ...] = ()) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without), added])


def _image_step(column: str, tile: int):
    def features(data: bytes):
        try:
            image = decode(data)
            if not image.size:
                raise ValueError("no pixels")
            small = resize_area(image, tile, tile)
            shade = grey(small) / maximum(data)
            return image.shape[0], image.shape[1], 1 if image.ndim == 2 else 3, npy(shade.astype(np.float32)), difference_hash(image)
        except (ValueError, OverflowError, IndexError, MemoryError):
            return (None,) * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows = [features(value.as_py() or b"") for value in batch.column(batch.schema.names.index(column))]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                extra = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *IMAGE])

    return run


def write_tiles(df: DataFrame, path: str, key: str = "doc_id") -> None:
    """The tiles of image_columns as a table (key, tile_npy, dhash) of NPY files under `path`; rows without an image have none."""
    df.where(F.col("tile_npy").isNotNull()).select(key, "tile_npy", "dhash").write.mode("overwrite").parquet(path)


@shielded("text")
def text_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """docs (text, ...) with n_bytes and media: the padded UTF-8 bytes as a grey image BLOCK wide, in PGM or BMP.

    Null text is empty; an empty payload is one row of zeros.
    """
    return docs.mapInArrow(_media_step(form), _form(docs, "n_bytes long, media binary"))


def _media_step(form: str):
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text"))
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                payloads = [(v.as_py() or "").encode() for v in texts.slice(k, 256)]
                media = []
                for p in payloads:
                    rows = max(1, -(-len(p) // BLOCK))
                    media.append(encode(np.frombuffer(p.ljust(rows * BLOCK, b"\0"), np.uint8).reshape(rows, BLOCK)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(p) for p in payloads], pa.int64()), pa.array(media, pa.binary())], [*part.schema.names, "n_bytes", "media"])

    return run


def digests(stored: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, media) with digests of the payload read back from the image and of the stored form.

    Equal media, equal digests; media are read whole, one at a time, whatever
    their length. Null media, and media that are no image, give nulls. Other
    columns stay.
    """
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    return stored.mapInArrow(_digest_step(), _form(stored, added, ("media",)))


def _digest_step():
    def digest(media: bytes | None):
        if media is None:
            return (None,) * 5
        try:
            payload = decode(media).tobytes()
            read = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        except (ValueError, OverflowError, IndexError, MemoryError):
            read = (None,) * 3
        return (*read, len(media), hashlib.sha256(media).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(value.as_py()) for value in batch.column(batch.schema.names.index("media"))]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            extra = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            kept = [c for c in batch.schema.names if c != "media"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), *extra], [*kept, *DIGESTS])

    return run


def op5(spark, sf_dir: str) -> DataFrame:
    """Texts stored as PGM, with the digests of their BMP form beside it.

    The operators' steps run one after the other on each batch, so a task has
    one Python worker.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pgm, bmp, image, digest = _media_step("pgm"), _media_step("bmp"), _image_step("media", TILE), _digest_step()
    told = ["doc_id", "n_bytes", *DIGESTS, "dhash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                first = pa.Table.from_batches(digest(image(pgm(iter([batch])))))
                second = pa.Table.from_batches(digest(bmp(iter([batch]))))
                tiles = [hashlib.sha256(x.as_py()).hexdigest() for x in first["tile_npy"]]
                columns = [*(first[c] for c in told), pa.array(tiles, pa.string()), *(second[c] for c in ("media_bytes", "media_sha256", "payload_sha256"))]
                yield from pa.Table.from_arrays(columns, names=names).to_batches()

    names = ["doc_id", "n_bytes", *DIGESTS, "feature", "tile_sha256", "bmp_bytes", "bmp_sha256", "bmp_payload_sha256"]
    form = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string, bmp_bytes long, bmp_sha256 string, bmp_payload_sha256 string"
    return docs.mapInArrow(run, _form(docs, form, ("text",)))
