"""Word and character error rates: counts per pair, ratios of sums over any subset."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flatten_whitespace, strip


def words(text: Column) -> Column:
    return F.filter(F.split(flatten_whitespace(text), " "), lambda w: w != "")


#: The first letter that stands for a word, and the range of surrogates, which are no letters.
_FIRST, _SURROGATES, _SKIP = 0x4E00, 0xD800, 0x800


def letters(reference: list[str], hypothesis: list[str]) -> tuple[str, str]:
    """Both word lists with one character for each distinct word."""
    code = {w: _FIRST + i for i, w in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    return tuple("".join([chr(c if c < _SURROGATES else c + _SKIP) for c in map(code.__getitem__, ws)]) for ws in (reference, hypothesis))


def _lettered(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([letters(r.split(" ") if r else [], h.split(" ") if h else []) for r, h in zip(references, hypotheses, strict=True)], columns=["r", "h"])


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Least substitutions, deletions and insertions of the words of two flattened texts; JVM edit distance of one letter a word."""
    coded = F.pandas_udf(_lettered, "r string, h string")(reference, hypothesis)
    return F.levenshtein(coded["r"], coded["h"]).cast("long")


def _rows(a: np.ndarray, b: np.ndarray, row: np.ndarray, start: int, stop: int):
    """The rows start + 1 to stop of the cost matrix, one after the other, from row start; insertions along a row are a running minimum."""
    step = np.arange(len(b) + 1, dtype=np.int32)
    for i in range(start + 1, stop + 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (b != a[i - 1]))
        row = np.minimum.accumulate(new - step) + step
        yield row


def align(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions, insertions of one best alignment; prefers diagonal steps, then deletions, from the end.

    Only every k-th row of the cost matrix is kept, k being the root of the number of rows; the rows between two of them are
    computed again on the way back. So memory grows with the hypothesis times the root of the reference.
    """
    n, m = len(reference), len(hypothesis)
    code = {w: i for i, w in enumerate(dict.fromkeys([*reference, *hypothesis]))}
    a, b = (np.array([code[w] for w in ws], np.int32) for ws in (reference, hypothesis))
    every = max(1, math.isqrt(n))
    kept = [np.arange(m + 1, dtype=np.int32)]
    for i, row in enumerate(_rows(a, b, kept[0], 0, n), 1):
        if i % every == 0:
            kept.append(row)
    s = d = ins = 0
    top, block = n + 1, []  # block holds the rows from top on
    while n or m:
        if n and n - 1 < top:
            top = (n - 1) // every * every
            block = [kept[top // every], *_rows(a, b, kept[top // every], top, n)]
        cost, above = (block[n - top], block[n - top - 1]) if n else (kept[0], None)
        if n and m and cost[m] == above[m - 1] + (a[n - 1] != b[m - 1]):
            s += a[n - 1] != b[m - 1]
            n, m = n - 1, m - 1
        elif n and cost[m] == above[m] + 1:
            d, n = d + 1, n - 1
        else:
            ins, m = ins + 1, m - 1
    return int(s), d, ins


def alignment(reference: Column, hypothesis: Column) -> Column:
    """Struct of substitutions, deletions and insertions."""

    @F.pandas_udf("substitutions long, deletions long, insertions long")
    def aligned(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([align((r or "").split(), (h or "").split()) for r, h in zip(references, hypotheses, strict=True)], columns=["substitutions", "deletions", "insertions"])

    return aligned(reference, hypothesis)


def error_counts(pairs: DataFrame) -> DataFrame:
    """Adds ref_words, word_edits, ref_chars and char_edits; all 0 where the reference is blank."""
    names = pairs.columns
    texts = pairs.select("*", strip(F.coalesce("reference", F.lit(""))).alias("_ref"), strip(F.coalesce("hypothesis", F.lit(""))).alias("_hyp"))
    flat = texts.select("*", flatten_whitespace(F.col("_ref")).alias("_rf"), flatten_whitespace(F.col("_hyp")).alias("_hf"))
    counts = {"ref_words": F.size(words(F.col("_ref"))).cast("long"), "word_edits": word_edits(F.col("_rf"), F.col("_hf")), "ref_chars": F.length("_ref").cast("long"), "char_edits": F.levenshtein("_ref", "_hyp").cast("long")}
    zero = F.lit(0).cast("long")
    return flat.select(*names, *[F.when(F.col("_ref") == "", zero).otherwise(v).alias(k) for k, v in counts.items()])


def error_rates(counted: DataFrame, *by: str) -> DataFrame:
    """wer and cer as ratios of sums; 1 where no reference has words, and for no rows at all."""
    sums = counted.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("ref_words", "word_edits", "ref_chars", "char_edits")])
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(1.0))
    return sums.withColumns({"wer": rate("word_edits", "ref_words"), "cer": rate("char_edits", "ref_chars")})


# The distribution function of a Poisson variable of mean 1 at 0, 1, 2, ..., in 65536ths.
POISSON = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)


def replicate_weights(key: Column, seed: int, replicates: int) -> list[Column]:
    """How often the row of key is drawn in each replicate: Poisson variables of mean 1.

    An md5 of seed, block and key has the 16-bit uniform numbers of eight replicates, so any engine draws alike.
    """
    blocks = [F.md5(F.concat(F.lit(f"{seed}:{i}:"), key.cast("string")).cast("binary")) for i in range(-(-replicates // 8))]
    uniform = [F.conv(F.substring(blocks[r // 8], 1 + 4 * (r % 8), 4), 16, 10).cast("int") for r in range(replicates)]
    return [sum(((u >= limit).cast("int") for limit in POISSON[1:]), (u >= POISSON[0]).cast("int")) for u in uniform]


def bootstrap(counted: DataFrame, key: str, errors: str, total: str, *by: str, replicates: int = 40, seed: int = 1) -> DataFrame:
    """(by, replicate, errors, total, rate) of resampled corpora: for each one the ratio of the sums over rows drawn with replacement.

    Every row is drawn a Poisson number of times in each replicate, by a hash of its key. All replicates are summed in one
    aggregation over the rows, which are not copied. rate is null where a replicate has no total.
    """
    weights = counted.select(*by, F.col(errors).cast("long").alias("_e"), F.col(total).cast("long").alias("_t"), F.array(*replicate_weights(F.col(key), seed, replicates)).alias("_w"))
    sums = [f(F.col("_w")[r] * F.col(c)).alias(f"{c}{r}") for c in ("_e", "_t") for r in range(replicates) for f in (F.sum,)]
    summed = weights.groupBy(*by).agg(*sums)
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("replicate"), F.col(f"_e{r}").alias("errors"), F.col(f"_t{r}").alias("total")) for r in range(replicates)])).alias("p")
    return summed.select(*by, pairs).select(*by, "p.*").withColumn("rate", F.try_divide(F.col("errors").cast("double"), F.col("total").cast("double")))


def intervals(resampled: DataFrame, *by: str, level: float = 0.95) -> DataFrame:
    """(by, low, high): the interval that holds level of the replicates' rates, by interpolated percentiles."""
    tail = (1 - level) / 2
    return resampled.groupBy(*by).agg(F.percentile("rate", F.lit(tail)).alias("low"), F.percentile("rate", F.lit(1 - tail)).alias("high"))
