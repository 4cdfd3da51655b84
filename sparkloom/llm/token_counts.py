"""Token counts with a whole-token shortcut for a sentencepiece BPE model."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table, whole_text, with_texts

#: Characters split together, and merged pre-tokens remembered by a worker.
BATCH_CHARS, REMEMBERED = 4 << 20, 400_000
LONGEST = 64


class Counter:
    """Counts tokens pre-token by pre-token.

    A pre-token is a run of word marks (the model writes a space so, and puts one before the text) and the
    characters up to the next one; it is named by what follows its first mark. Without marks, doubled or
    leading spaces in a text, pre-tokens are what lies between single spaces. The constructor proves on
    the vocabulary that this split is exact: no piece has a mark after another character, so no merge
    can cross a boundary. It also proves which pieces encode alone as one token; those are just counted.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        if any(mark in p.lstrip(mark) for p in pieces):
            raise ValueError("a piece spans a word boundary; the split into pre-tokens is not exact")
        probe = f"a  b {mark}c"
        if "".join(self.model.encode(probe, out_type=str)) != mark + probe.replace(" ", mark):
            raise ValueError("the model normalises its input; pre-tokens cannot be cut from the raw text")
        candidates = [p[1:] for p in pieces if p.startswith(mark) and p != mark]
        alone = self.model.encode([p.replace(mark, " ") for p in candidates], num_threads=1)
        self.single = {p: 1 for p, ids in zip(candidates, alone, strict=True) if len(ids) == 1} | {"": 1}  # a mark alone is a piece
        self.runs = re.compile(f"{mark}+[^{mark}]*").findall
        self.mark = mark
        self.known: dict[str, int] = dict(self.single)

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or self.mark in text or text[0] == " ":
            return [p[1:] for p in self.runs(self.mark + text.replace(" ", self.mark))]
        return text.split(" ")

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self._split(t) for t in texts]
        needed = set().union(*split)
        rest = list(needed.difference(self.known))
        if len(self.known) + len(rest) > REMEMBERED + len(self.single):
            self.known = dict(self.single)
            rest = list(needed.difference(self.known))
        made = dict(zip(rest, map(len, self.model.encode(rest, num_threads=1)), strict=True))
        self.known |= made
        counts = [sum(map(self.known.__getitem__, pieces)) for pieces in split]
        for p in made:
            if len(p) > LONGEST:
                del self.known[p]
        return counts


@lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """The counter of the model at path, built once a worker."""
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed limit.

    Null and empty texts have no tokens. Repeated rows give repeated results; other columns are
    ignored; no rows give none. model_path must be readable on every worker.
    """

    def build() -> Callable[[list[str]], pd.DataFrame]:
        count = counter_of(model_path)
        return lambda texts: pd.DataFrame({"n_bytes": [len(t.encode()) for t in texts], "n_tokens": count(texts)}, dtype="int64")

    counted = with_texts(docs, [F.col("doc_id").cast("long")], per_text(whole_text(), "n_bytes long, n_tokens long", build, BATCH_CHARS))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
