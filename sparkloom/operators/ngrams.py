"""Counts of word n-grams of all orders up to one, as a language model needs them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written

# The marks of a sentence's ends.
MARKS = ("<s>", "</s>")
#: Characters of lines that are counted together before the shuffle; a task's memory grows with them.
BATCH = 1 << 21
# The rows that tasks hand back, for Spark and for Arrow.
ROWS = "n int, gram string, count long"
COUNTED = pa.schema([("n", pa.int32()), ("gram", pa.string()), ("count", pa.int64())])
# Fixed value: the largest of a gram's numbers, well inside 64 bits.
NUMBERS = 1 << 62
#: Grams of so many words or more travel as windows, dealt by so many first words.
DEALT = 2
#: Windows of more characters of lines are dealt out in ROUNDS rounds, each with its share of the first words: files of a shuffle go with its round.
ROUND, ROUNDS = 1 << 26, 4
# What parts the words of a window, and the n of a window, whose words are counted where it arrives.
PARTED, WINDOW = "\0", 0
TALLIED = pa.schema([("n", pa.int32()), ("count", pa.int64()), ("grams", pa.int64())])


def _runs(texts: Iterable[str]) -> Iterator[list[str]]:
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= BATCH:
            yield run
            run, size = [], 0
    if run:
        yield run


def _grams(lines: list[str], wanted: Collection[int], marks: bool, parted: str = " ", dealt: int = 0, share: tuple[int, int] = (0, 1), final: Collection[int] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray, Callable]]:
    """For each n wanted: n, where grams of n words begin, their numbers, and what spells out the grams at places.

    A gram of n words is a pair of the gram before it and a word, so grams are told apart by whole numbers. They are
    numbered anew where n is wanted, or where pairs would not fit 64 bits. share (k, of how many) leaves the grams whose
    first dealt words, or all if fewer, fall to it by their hash; each gram falls to one share. Of the orders in final only
    grams at the ends of lines are left.
    """
    words, sizes = [], []
    for line in lines:
        found = line.split()
        if found and marks:
            found = [MARKS[0], *found, MARKS[1]]
        words += found
        sizes.append(len(found))
    if not words:
        return
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    del words
    ids, distinct = coded.indices.to_numpy(), coded.dictionary
    ends = np.repeat(np.cumsum(sizes), sizes)
    at, gram, kinds = np.arange(len(ids)), ids.astype(np.int64), len(distinct)
    if share[1] > 1:
        hashed = pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), categorize=False)
        key = hashed[ids]
    if parted != " ":  # no character of a word sorts before what parts words, nor equals it
        distinct = pc.replace_substring(pc.replace_substring(distinct, "\1", "\1\2"), PARTED, "\1\1")

    def own() -> np.ndarray:
        return at[(key[at] >> np.uint64(33)) % np.uint64(share[1]) == share[0]] if share[1] > 1 else at

    def numbered(where: np.ndarray) -> tuple[np.ndarray, int]:
        found = pa.array(gram[where]).dictionary_encode()
        return found.indices.to_numpy(), len(found.dictionary)

    def spelled(where: np.ndarray, n: int) -> pa.Array:
        return pc.binary_join_element_wise(*[distinct.take(pa.array(ids[where + k])) for k in range(n)], pa.scalar(parted, pa.large_string()))

    for n in range(1, max(wanted) + 1):
        if n > 1:
            if kinds * len(distinct) > NUMBERS:
                gram[at], kinds = numbered(at)
            at = at[at + n <= ends[at]]
            gram[at] = gram[at] * len(distinct) + ids[at + n - 1]
            kinds *= len(distinct)
            if share[1] > 1 and n <= dealt:
                key[at] = key[at] * np.uint64(0x9E3779B97F4A7C15) + hashed[ids[at + n - 1]]
        if n == dealt:
            at = own()
        if not len(at):
            return
        if n in wanted:
            found = own() if n < dealt else at
            if n in final:
                found = found[found + n == ends[found]]
            if n == 1:
                same = ids[found]
            else:
                same, kinds_found = numbered(found)
                if len(found) == len(at):
                    gram[at], kinds = same, kinds_found
            if len(found):
                yield n, found, same, spelled


def _frame(n: int, at: np.ndarray, same: np.ndarray, spelled: Callable) -> pd.DataFrame:
    """(n, gram, count) of the grams of n words that begin at places, once each."""
    count = np.bincount(same)
    place = np.empty(len(count), np.int64)
    place[same] = at  # any of a gram's places serves
    met = np.flatnonzero(count)
    gram = pd.Series(spelled(place[met], n), dtype=pd.ArrowDtype(pa.large_string()))
    return pd.DataFrame({"n": np.int32(n), "gram": gram, "count": count[met]})


def count_lines(lines: list[str], orders: Sequence[int], marks: bool) -> Iterator[pd.DataFrame]:
    """(n, gram, count) of the lines, one frame an order; grams are spelled out once each."""
    for n, at, same, spelled in _grams(lines, orders, marks):
        yield _frame(n, at, same, spelled)


def window_lines(lines: list[str], orders: Sequence[int], marks: bool, share: tuple[int, int] = (0, 1)) -> Iterator[pd.DataFrame]:
    """(n, gram, count) of grams of fewer than DEALT words, and of windows (n is WINDOW): at each place the longest gram, shorter only at the end of a line.

    All longer grams are beginnings of windows, so a place is one row instead of one for every order. Words are parted by
    PARTED, so windows that begin with the same words stand side by side when sorted.
    """
    most = max(orders)
    dealt = min(DEALT, most)
    short = [n for n in orders if n < dealt]
    least = min(n for n in orders if n >= dealt)
    for n, at, same, spelled in _grams(lines, [*short, *range(least, most + 1)], marks, PARTED, dealt, share, range(least, most)):
        frame = _frame(n, at, same, spelled)
        yield frame if n in short else frame.assign(n=np.int32(WINDOW))


def _tally(orders: Collection[int]) -> Callable:
    """For mapInArrow: sorted rows of window_lines() become (n, count, grams); of the rows only the last one is kept for the next batch."""
    most = max(orders)
    dealt = min(DEALT, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, open_ = {n: Counter() for n in orders}, dict.fromkeys(orders, 0)
        before = []  # n and gram of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, gram = (pa.concat_arrays([*before[i : i + 1], batch.column(i)]) for i in range(2))
            count = np.concatenate([np.zeros(min(len(before), 1), np.int64), batch.column(2).to_numpy()])
            words, own = pc.split_pattern(gram, PARTED), kind.to_numpy()
            begin, size = words.offsets.to_numpy()[:-1], np.diff(words.offsets.to_numpy())
            ids = words.values.dictionary_encode().indices.to_numpy()
            new = np.append(True, own[1:] != own[:-1])
            for n in range(1, most + 1):
                word = np.where(size >= n, ids[np.minimum(begin + n - 1, len(ids) - 1)], -1)
                new[1:] |= word[1:] != word[:-1]
                at = np.flatnonzero((size >= n) & (own == (n if n < dealt else WINDOW))) if n in met else ()
                if not len(at):
                    continue
                if before:
                    count[0] = open_[n]
                sums = np.add.reduceat(count[at], np.flatnonzero(new[at]))
                goes_on = at[-1] == len(own) - 1
                open_[n] = int(sums[-1]) if goes_on else 0
                met[n].update(dict(zip(*map(np.ndarray.tolist, np.unique(sums[: len(sums) - goes_on], return_counts=True)), strict=True)))
            before = [kind[-1:], gram[-1:]]
        for n, k in open_.items():
            if k:
                met[n][k] += 1
        found = [(n, k, grams) for n, counts in met.items() for k, grams in counts.items()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), TALLIED, strict=True)], schema=TALLIED)

    return run


def _counter(count: Callable, orders: Sequence[int], marks: bool) -> Callable:
    """For mapInArrow: texts become strings one by one, not a whole batch of Spark's at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (text for batch in batches for value in batch.column(0) if (text := value.as_py()))
        for part in _runs(texts):
            for frame in count(part, orders, marks):
                yield from pa.Table.from_pandas(frame, preserve_index=False).cast(COUNTED).to_batches()

    return run


def _pandas_counter(count: Callable, orders: Sequence[int], marks: bool) -> Callable:
    """The same for mapInPandas."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _runs(text for pdf in batches for text in pdf["text"].tolist() if text):
            yield from count(part, orders, marks)

    return run


def _texts(lines: DataFrame, text: str, orders: Sequence[int]) -> DataFrame:
    if not orders or min(orders) < 1:
        raise ValueError("orders are whole numbers from 1 on")
    return lines.select(F.col(text).cast("string").alias("text"))


def ngram_counts(lines: DataFrame, text: str = "text", orders: Sequence[int] = (1, 2, 3), marks: bool = True) -> DataFrame:
    """(n, gram, count) of all n-grams of the orders; words are parted by white space and joined by one space.

    With marks a line has <s> before its first and </s> behind its last word. Null and blank lines have no words. One
    pass over the lines counts all orders; batches of lines are added up before the shuffle, so
    a frequent gram travels once a batch. Rows are dealt out as they come: most grams are rare, so adding up
    a task's batches once more before the shuffle would hold nearly all of its grams and hardly merge any.
    """
    parts = _texts(lines, text, orders).mapInArrow(_counter(count_lines, tuple(orders), marks), ROWS)
    return parts.repartition("n", "gram").groupBy("n", "gram").agg(F.sum("count").alias("count"))


def counts_of_counts(counted: DataFrame) -> DataFrame:
    """(n, count, grams): how many n-grams of each order occur count times, from which discounts are estimated."""
    return counted.groupBy("n", "count").agg(F.count("*").alias("grams"))


def ngram_counts_of_counts(lines: DataFrame, text: str = "text", orders: Sequence[int] = (1, 2, 3), marks: bool = True) -> DataFrame:
    """counts_of_counts() of ngram_counts() without sending every gram of every order.

    Rows are windows, dealt by their first DEALT words and sorted where they meet; there the grams that windows begin with
    are runs of neighbours, counted as they pass. Only the numbers of grams travel once more. Many lines are read
    in each of ROUNDS rounds, and only windows of the round's share are dealt out, so that the disk never holds all of them.
    """
    texts = _texts(lines, text, orders)
    many = (texts.agg(F.sum(F.length("text"))).first()[0] or 0) > ROUND
    rounds = ROUNDS if many else 1

    def counted(k: int) -> DataFrame:
        parts = texts.mapInPandas(_pandas_counter(partial(window_lines, share=(k, rounds)), tuple(orders), marks), ROWS)
        dealt = parts.repartition("n", F.substring_index("gram", PARTED, DEALT)).sortWithinPartitions("gram")
        return dealt.mapInArrow(_tally(frozenset(orders)), "n int, count long, grams long").groupBy("n", "count").agg(F.sum("grams").alias("grams"))

    if rounds == 1:
        return counted(0)
    return reduce(DataFrame.unionByName, [written(counted(k), "grams") for k in range(rounds)]).groupBy("n", "count").agg(F.sum("grams").alias("grams"))
