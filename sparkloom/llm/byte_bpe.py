"""Byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Ranks, ranks_of
from .common import per_text, table, whole_text, with_texts

#: Characters of text split and encoded together, and distinct pieces remembered by a worker.
BATCH_CHARS, REMEMBERED = 4 << 20, 400_000
#: Longer pieces are encoded but not remembered.
LONGEST = 64


class Encoder:
    """Ids as decimal text and decoded bytes of each piece, remembered between batches."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.known: dict[str, tuple[str, bytes]] = {}

    def _learn(self, pieces: set[str]) -> dict[str, tuple[str, bytes]]:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(pieces)
        made = {}
        for piece, ids in zip(new, self.ranks.encode_pieces([p.encode() for p in new]), strict=True):
            ids = ids.tolist()
            made[piece] = (",".join(map(str, ids)), self.ranks.decode(ids))
        self.known |= {p: x for p, x in made.items() if len(p) <= LONGEST}
        return {p: x for p, x in made.items() if len(p) > LONGEST}

    def __call__(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """For each text: its ids joined by commas, their number, the bytes they decode to."""
        split = [self.split(t) for t in texts]
        long = self._learn(set().union(*split))
        for pieces in split:
            found = [self.known.get(p) or long[p] for p in pieces]
            ids = ",".join([x[0] for x in found])
            yield ids, ids.count(",") + bool(ids), b"".join([x[1] for x in found])


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode each match of pattern by the rank file, then decode the ids; digests of both.

    Null and empty texts have no ids. A match of any length is merged whole, in time n log n of its bytes (about
    0.14 ms a byte in one of 80,000) and memory of its segment tree. Repeated rows give repeated results; other columns are
    ignored; no rows give none. ranks_path must be readable on every worker.
    """

    def build() -> Callable[[list[str]], pd.DataFrame]:
        encoder = Encoder(ranks_of(ranks_path), pattern)

        def digests(texts: list[str]) -> pd.DataFrame:
            rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) for ids, n, raw in encoder(texts)]
            return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        return digests

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return with_texts(docs, [F.col("doc_id").cast("long")], per_text(whole_text(), schema, build, BATCH_CHARS))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
