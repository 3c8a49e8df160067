"""Media columns: payloads stored losslessly in baseline JPEG images, decoded again to dimensions, luminance thumbnails and their hashes.

A payload's bytes are the quantised coefficients of the image's blocks, 64 to a block: byte b is coefficient b + 1 below 128 and b - 256 above, so none is
zero. Huffman coding keeps coefficients exactly, so reading the scan back gives the payload. The thumbnail is made of DC coefficients only. See ``jpeg``.

Null texts are empty; an empty text's payload is one block of zero bytes. Long texts make large images, whole. Repeated rows have equal values. Rows
never meet each other, so nothing is shuffled. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm import jpeg
from wellspring.llm._common import byte_list, pieces, utf8

UNIT = 64


def padded(text: bytes | None) -> bytes:
    """The text's bytes and zeros up to a positive multiple of ``UNIT``."""
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def store(payloads: list[bytes]) -> list[bytes]:
    """An image of each payload."""
    groups = []
    for payload in payloads:
        values = np.frombuffer(payload, dtype=np.uint8).astype(np.int16)
        groups.append(np.where(values < 128, values + 1, values - 256).reshape(-1, UNIT))
    return jpeg.encode_grey(groups, [b"payload %d" % len(p) for p in payloads])


def load(stored: list[bytes]) -> list[tuple[jpeg.Image, np.ndarray, bytes]]:
    """Of each image: what its markers say, its coefficients, and the payload if it was made by :func:`store`."""
    images = [jpeg.parse(s) for s in stored]
    out = []
    for image, blocks in zip(images, jpeg.decode(images), strict=True):
        size = int(image.comment.removeprefix(b"payload ")) if image.comment.startswith(b"payload ") else 0
        values = blocks[: size // UNIT].ravel()
        out.append((image, blocks, np.where(values > 0, values - 1, values + 256).astype(np.uint8).tobytes()))
    return out


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits, one for each field of an 8 by 8 grid over the thumbnail: is the field lighter than the whole."""
    rows, columns = (np.arange(n) * 8 // n for n in pixels.shape)
    field = (rows[:, None] * 8 + columns).ravel()
    total, n = np.bincount(field, weights=pixels.ravel(), minlength=64), np.bincount(field, minlength=64)
    return f"{int.from_bytes(np.packbits(total * pixels.size > n * pixels.sum(dtype=float)).tobytes(), 'big'):016x}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 1 << 20):
        texts = byte_list(batch.column("text"))
        stored = store([padded(t) for t in texts])
        rows = []
        for text, media, (image, blocks, payload) in zip(texts, stored, load(stored), strict=True):
            pixels = jpeg.thumbnail(image, blocks)
            rows.append((len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), image.width, image.height, thumbnail_hash(pixels), media, pixels.tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _COLUMNS, strict=True))], names=["id", *(n for n, _ in _COLUMNS)])


_COLUMNS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("thumbnail_hash", pa.string()), ("media", pa.binary()), ("thumbnail", pa.binary())]


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id, sizes and digests of payload (as read back) and image, ``width``, ``height``, ``thumbnail_hash``, ``media`` and ``thumbnail`` (bytes)."""
    named = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    return named.mapInArrow(_features, f"id {named.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {kinds[t]}" for n, t in _COLUMNS)).withColumnRenamed("id", id_col)
