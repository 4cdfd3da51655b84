"""Best-fit packing of token sequences into bins of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_text, table, whole_text, written
from .token_counts import Counter

#: Pieces that one task packs together on average.
SHARD = 2048
#: Characters whose tokens are counted at once.
BATCH_CHARS = 1 << 20


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths, and what a sequence of n tokens costs: fixed + n + n * n * quadratic.

    Long sequences cost more attention, short ones more overhead a sequence; with the defaults a full sequence of 1,024
    costs least a token (1.10), then 2,048 (1.11), 512 (1.15) and 4,096 (1.18).
    """

    permitted: tuple[int, ...] = (512, 1024, 2048, 4096)
    fixed: float = 64.0
    quadratic: float = 1 / 24576

    def cost(self, n: int) -> float:
        return self.fixed + n + n * n * self.quadratic

    def opened(self, size: int, later: list[int], at: int) -> int:
        """The length whose cost for each token it comes to hold is least.

        later[at:] are the negated sizes still to be placed, the largest first; each length is
        filled with size and the largest of them that fit, one after the other.
        """
        best = None
        for c in self.permitted:
            if c >= size:
                filled, i = size, bisect_left(later, size - c, at)
                while i < len(later) and later[i]:
                    filled -= later[i]
                    i = bisect_left(later, filled - c, i + 1)
                price = (self.cost(self.downsized(filled)) / max(filled, 1), c)
                best = min(best or price, price)
        return best[1]

    def downsized(self, filled: int) -> int:
        return next(c for c in self.permitted if c >= filled)


def best_fit(sizes: Iterable[int], lengths: Lengths) -> list[tuple[int, int]]:
    """(bin, offset) of each size, in order; bins are numbered as they open.

    Sizes are placed from the largest; each goes into the open bin with the least room that
    suffices, ties to the oldest, else into a new bin of the least-cost length. Zero sizes
    fit anywhere.
    """
    sizes = list(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    later, open_, filled, out = [-sizes[i] for i in order], [], [], [(0, 0)] * len(sizes)
    for k, i in enumerate(order, 1):
        size = sizes[i]
        at = bisect_left(open_, (size, -1))
        if at < len(open_):
            room, b = open_.pop(at)
        else:
            room, b = lengths.opened(size, later, k), len(filled)
            filled.append(0)
        out[i] = (b, filled[b])
        filled[b] += size
        insort(open_, (room - size, b))
    return out


def _pack(lengths: Lengths) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc", "piece"], ascending=[False, True, True], kind="stable")
        placed = best_fit(pdf["n_tokens"].tolist(), lengths)
        bins = pd.Series([b for b, _ in placed], index=pdf.index)
        filled = pdf["n_tokens"].groupby(bins).transform("sum")
        base = int(pdf["shard"].iloc[0]) << 32
        out = pdf[["doc", "piece", "start", "n_tokens"]].assign(bin_id=bins.astype("int64") + base, offset=[o for _, o in placed], capacity=[lengths.downsized(int(n)) for n in filled], filled=filled)
        return out

    return run


def pack(docs: DataFrame, tokens: Column, lengths: Lengths = Lengths()) -> DataFrame:
    """Pack every document, cut into pieces of the largest permitted length, into bins.

    Pieces are dealt at random (by a hash of their row's number) into shards of about SHARD, each packed on its
    own, so that no task grows with the input and neither a source, copies nor repeats of a row gather in one. Inside a shard the
    permitted lengths are chosen by cost against the pieces still to be placed, and in the end every bin shrinks to the
    least permitted length that holds its contents.

    tokens counts the tokens of a row; null counts as 0, and a document of no tokens is one empty
    piece. Repeated rows are packed each; other columns are ignored; no rows give none.
    Returns doc_id, piece, start and n_tokens of the piece in its document, bin_id, offset,
    capacity (length of the bin) and filled (tokens in it).
    """
    longest = max(lengths.permitted)
    # written, so that tokens are counted once and rows keep their numbers
    counted = docs.select(F.col("doc_id").cast("long"), F.coalesce(tokens.cast("long"), F.lit(0).cast("long")).alias("total"), F.monotonically_increasing_id().alias("row"))
    sized = written(counted, "sizes")
    last = F.greatest(F.ceil(F.col("total") / longest).cast("long"), F.lit(1).cast("long")) - 1
    pieces = sized.select("doc_id", "total", "row", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    n = sized.agg(F.sum(last + 1)).first()[0] or 0
    shards = max(1, -(-n // SHARD))
    start = F.col("piece") * longest
    dealt = pieces.select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        "piece",
        start.alias("start"),
        F.least(F.col("total") - start, F.lit(longest)).alias("n_tokens"),
    )
    packed = dealt.groupBy("shard").applyInPandas(_pack(lengths), "doc string, piece long, start long, n_tokens long, bin_id long, offset long, capacity int, filled long")
    doc = F.when(F.col("doc") != "", F.col("doc").cast("long"))
    return packed.select(doc.alias("doc_id"), "piece", "start", "n_tokens", "bin_id", "offset", "capacity", "filled")


def byte_tokens() -> Column:
    """Tokens of a text at four bytes each, and one that ends the document."""
    return F.ceil(F.octet_length(whole_text()) / 4) + 1


def model_tokens(model_path: str) -> Column:
    """Tokens of a text by the sentencepiece model at model_path, and one that ends the document."""

    def build() -> Callable[[list[str]], pd.DataFrame]:
        count = Counter(model_path)  # of the task, so that its words do not stay in the worker
        return lambda texts: pd.DataFrame({"n_tokens": count(texts)}, dtype="int64")

    return per_text(whole_text(), "n_tokens long", build, BATCH_CHARS)["n_tokens"] + 1


def public_tokens() -> Column:
    import public_tokenizers

    return model_tokens(public_tokenizers.path("piece_bpe_32k.model"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokens())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
