"""Media columns: texts as lossless WebP images and back, with features of the pixels.

``store`` turns a text column into WebP files of grey samples (one sample per UTF-8 byte, padded with 255 to
full rows); ``load`` decodes WebP files to pixel arrays; ``features`` summarises samples.  Images are at most
16,384 rows high, so a longer text becomes several files, one after the other in the same value.

Nulls and empty texts become one padded row; null media decodes to null.  Equal texts give equal bytes.
Repeated rows are encoded each for itself; an empty table gives an empty result; extra columns pass through, but for those that have the
name of a result (``media``; ``width``, ``height``, ``pixels`` and ``feature``), which are replaced.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm import webp

ROW = 576


def padded(text: bytes, row: int = ROW) -> bytes:
    return text + b"\xff" * (max(row, -(-len(text) // row) * row) - len(text))


def encode_samples(payload: bytes, width: int = ROW) -> bytes:
    step = width * webp.MAX_SIDE
    return b"".join(webp.encode_grey(np.frombuffer(payload, np.uint8, min(step, len(payload) - at), at), width) for at in range(0, len(payload), step))


def files_in(media: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield media[at:end]
        at = end


def decode_samples(media: bytes) -> tuple[int, int, bytes]:
    """(width, height, green samples) of the files in ``media``, one below the other."""
    width, height, out = 0, 0, []
    for file in files_in(media):
        width, h, argb = webp.decode(file)
        height += h
        out.append((argb >> 8).astype(np.uint8).tobytes())
    return width, height, b"".join(out)


def describe(width: int, height: int, samples: bytes) -> str:
    """Size, distinct values, mean, entropy in bits and mean step between neighbours in a row."""
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    p = counts[counts > 0] / len(a)
    entropy = float(-(p * np.log2(p)).sum())
    step = float(np.abs(np.diff(a.reshape(height, width).astype(np.int16), axis=1)).mean()) if width > 1 else 0.0
    return f"{width}x{height} distinct={len(p)} mean={a.mean():.4f} entropy={math.fabs(entropy):.4f} step={step:.4f}"


def store(df: DataFrame, text_col: str, media_col: str = "media", row: int = ROW) -> DataFrame:
    """``df`` with ``media_col``: the text as WebP, and without the text."""
    keep = [f for f in df.schema.fields if f.name not in (text_col, media_col)]
    schema = T.StructType([*keep, T.StructField(media_col, T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in _parts(batch, text_col):
                texts = part.column(text_col)
                media = [encode_samples(padded((t.as_py() or "").encode("utf-8", "surrogatepass"), row), row) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in keep] + [pa.array(media, pa.binary())], names=schema.names)

    return df.select(*[f.name for f in keep], text_col).mapInArrow(run, schema)


def load(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` without the media column, with width, height, pixels (one byte per pixel, the green channel) and feature."""
    more = T.StructType.fromDDL("width int, height int, pixels binary, feature string")
    keep = [f for f in df.schema.fields if f.name != media_col and f.name not in more.names]
    schema = T.StructType([*keep, *more.fields])

    def run(batches):
        for batch in batches:
            for part in _parts(batch, media_col):
                got = [(None,) * 4 if m is None else (*(d := decode_samples(m)), describe(*d)) for m in part.column(media_col).to_pylist()]
                columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in keep] + columns, names=schema.names)

    return df.select(*[f.name for f in keep], media_col).mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes in ``column``, so that memory follows bytes, not rows."""
    sizes = np.cumsum([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)])
    at = 0
    while at < len(batch):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    light = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    stored = store(light, "text").withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    back = load(stored)
    tail = F.substring(F.col("pixels"), F.octet_length("pixels") - 31, F.lit(32))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
