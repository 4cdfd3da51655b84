"""Media columns: texts stored as baseline JPEG, read back, with dimensions and thumbnail hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import per_text, table, whole_text, with_texts

#: Bytes of payload decoded side by side.
BATCH_BYTES = 2 << 20


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, padded with spaces to a positive multiple of 192."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % jpeg.UNIT if raw else jpeg.UNIT)


def features(parsed: jpeg.Parsed, blocks) -> str:
    average, difference = jpeg.thumbnail_hashes(jpeg.thumbnail(parsed, blocks))
    return f"{parsed.width}x{parsed.height}:{average:016x}:{difference:016x}"


FIELDS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]


def digests(texts: list[str]) -> pd.DataFrame:
    """What media_digests says of each text, decoded side by side."""
    stored = [jpeg.encode(payload(t)) for t in texts]
    parsed = [jpeg.parse(x) for x in stored]
    rows = []
    for text, media, p, blocks in zip(texts, stored, parsed, jpeg.decode_scans(parsed), strict=True):
        back = jpeg.payload_of(p, blocks)
        rows.append((len(text.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(p, blocks), p.width, p.height))
    return pd.DataFrame(rows, columns=FIELDS)


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text as a JPEG, read the stored bytes back, and digest what was read.

    A null text counts as empty; the empty text is one unit of spaces. Repeated rows give
    repeated results; other columns of docs are ignored; no rows give none. A row needs memory
    in proportion to its own text only.
    """
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"
    return with_texts(docs, [F.col("doc_id").cast("long")], per_text(whole_text(), schema, lambda: digests, BATCH_BYTES))


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id and the JPEG bytes themselves, for callers that keep the media column."""

    def encode(texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"media": [jpeg.encode(payload(t)) for t in texts]})

    return with_texts(docs, [F.col("doc_id").cast("long")], per_text(whole_text(), "media binary", lambda: encode, BATCH_BYTES))


def op1_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_media_jpeg": op1_media_jpeg}
ORACLES: dict[str, str] = {}
