"""Metadata-driven assignment of examples to test, dev and train, and the split report."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from dataclasses import MISSING, asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, extract_key, slug_of
from ..scratch import written
from .sampling import ORDERS, VALUES, budget_cut, group_cut, sample_groups
from .selectors import matches, normalize_selector

# The names of splits, of options and of what the options may be.
ORDER = ("train", "dev", "test")
CHOICES = {"unmatched": ("error", "drop"), "test_size_unit": ("examples", "hours"), "test_remainder": ("exclude", "train"), "train_budget_unit": ("hours", "examples"), "order": ORDERS}
#: Options that change the id of a split only where they are set.
LATER = ("test_size", "test_size_unit", "test_group_by", "test_remainder", "train_budget", "train_budget_unit", "order", "units_per_hour")


@dataclass(frozen=True)
class SplitSpec:
    """What goes where.

    In selectors None and [] differ: no test split, a sampled dev and an unrestricted train, against nothing
    selected. dev_size and a test_size in examples are fractions under 1, else counts; a
    test_size in hours is an amount, also under 1. Sizes of examples are whole units, of which units_per_hour make an hour.
    """

    name: str = "split"
    metadata: str = ""
    key_column: str = "recording"
    key_from: str = "path"
    key_pattern: str = r"^(.+?)\.[^.]+$"
    multi_valued: tuple[str, ...] = ()
    multi_value_separator: str = ";"
    exclude: object = None
    test: object = None
    dev: object = None
    train: object = None
    dev_size: float = 0.1
    dev_group_by: str | None = None
    unmatched: str = "error"
    test_size: float | None = None
    test_size_unit: str = "examples"
    test_group_by: str | None = None
    test_remainder: str = "exclude"
    train_budget: object = None
    train_budget_unit: str = "hours"
    units_per_hour: int = 3600
    max_size: int | None = None
    seed: int = 1
    order: str = "hash"

    def __post_init__(self) -> None:
        for option, allowed in CHOICES.items():
            if getattr(self, option) not in allowed:
                raise ValueError(f"{option} must be one of {allowed}, not {getattr(self, option)!r}")
        if isinstance(self.train_budget, str) and self.train_budget != "matched":
            raise ValueError("train_budget must be null, 'matched' or a number")
        if self.test_size_unit == "hours" and self.test_size is not None and self.test_size <= 0:
            raise ValueError("a test_size in hours must be positive")
        if self.test_remainder == "train" and self.test_size is None:
            raise ValueError("test_remainder 'train' needs a test_size; without it nothing selected for test remains")
        for selector in (self.exclude, self.test, self.dev, self.train):
            normalize_selector(selector)

    @classmethod
    def from_config(cls, config: Mapping) -> SplitSpec:
        """The spec of a mapping of options; empty ones take their defaults, unknown ones raise."""
        known = {f.name: f.default for f in fields(cls) if f.default is not MISSING}
        given = {k: v for k, v in config.items() if k != "enabled"}
        if unknown := sorted(set(given) - set(known)):
            raise ValueError(f"unknown split options: {', '.join(unknown)}")
        filled = {k: known[k] if v is None else v for k, v in given.items()}
        return cls(**filled | {"multi_valued": tuple(filled.get("multi_valued") or ())})

    def record(self) -> dict:
        """All that decides an assignment; later options only where they are set."""
        defaults = {f.name: f.default for f in fields(self)}
        record = {k: v for k, v in asdict(self).items() if k not in LATER or (v != defaults[k] and not (k == "train_budget_unit" and self.train_budget is None))}
        del record["max_size"]
        return record | {k: normalize_selector(record[k]) for k in ("exclude", "test", "dev", "train")}

    def split_id(self, metadata_digest: str = "") -> str:
        """Slug of the name and a digest of the record and of the contents of the metadata, whatever their path."""
        record = {k: v for k, v in self.record().items() if k != "metadata"}
        digest = hashlib.sha256(json.dumps([record, metadata_digest], sort_keys=True, default=str).encode()).hexdigest()[:8]
        return f"{slug_of(self.name)}-{digest}"


def keyed(examples: DataFrame, source: str, spec: SplitSpec) -> DataFrame:
    """examples with key: group 1 of the spec's pattern in the base name of source, or in its value; null without a match.

    Two paths of one base name can't be told apart and raise.
    """
    from_path = spec.key_from == "path"
    if from_path:
        twice = duplicate_keys(examples.select(basename(F.col(source)).alias("_name")), "_name").agg(F.count("*").alias("n"), F.min("_name").alias("first")).first()
        if twice.n:
            raise ValueError(f"{twice.n} base names occur more than once, for instance {twice.first}; set key_from to a column")
    return examples.withColumn("key", extract_key(F.col(source).cast("string"), spec.key_pattern, from_path))


def looked_up(examples: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """All examples with the columns of their key's metadata row, null where there is none, and whether there is one in matched."""
    rows = metadata.withColumn("_matched", F.lit(True))
    return examples.join(rows, key, "left").withColumn("matched", F.coalesce("_matched", F.lit(False))).drop("_matched")


def unmatched(examples: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Examples whose key is null or has no metadata row."""
    return examples.join(metadata.select(key), key, "left_anti")


def attributed(examples: DataFrame, metadata: DataFrame, spec: SplitSpec, shown: str = "key") -> DataFrame:
    """examples with the attributes of their key's metadata row.

    Examples without one raise, with their number and the first three of them by the column shown, or are dropped if unmatched is 'drop'.
    """
    rows = metadata.withColumnRenamed(spec.key_column, "key") if spec.key_column in metadata.columns else metadata
    if spec.unmatched == "error":
        lost = unmatched(examples, rows, "key")
        first = [str(r[0]) for r in lost.select(shown).orderBy(shown).limit(3).collect()]
        if first:
            raise ValueError(f"{lost.count()} examples have no metadata row, for instance {', '.join(first)}; mend key_pattern or set unmatched to 'drop'")
    return examples.join(rows, "key")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def _group(df: DataFrame, name: str) -> Column:
    """The name of a row's group: the value, or all values of a multi-valued column in their order."""
    many = dict(df.dtypes)[name].startswith("array")
    return F.array_join(F.col(name), VALUES) if many else F.coalesce(F.col(name).cast("string"), F.lit(""))


def _placed(examples: DataFrame, spec: SplitSpec) -> DataFrame:
    """A row an example that is not excluded: its place (test, dev, kept, pool or none), group and size in the budget.

    Flags of selectors are written first; then the draws follow, one after the other.
    """
    test, dev, train, exclude = (normalize_selector(s) for s in (spec.test, spec.dev, spec.train, spec.exclude))
    flag = lambda s: matches(s, examples.columns, spec.multi_valued, dict(examples.dtypes)) if s is not None else F.lit(False)
    usable = F.lit(True) if spec.max_size is None else F.coalesce(F.col("size") <= spec.max_size, F.lit(True))  # an unknown size is no reason to drop
    hours = lambda u: F.when(usable, F.col("size")).otherwise(0) if u == "hours" else F.lit(1)
    dev_group = spec.dev_group_by or "key"
    rows = (examples.where(~flag(exclude)) if exclude else examples).select(
        "example_index",
        flag(test).alias("is_test"),
        flag(dev).alias("is_dev"),
        (flag(train) if train is not None else F.lit(True)).alias("is_train"),
        _group(examples, spec.test_group_by or dev_group).alias("test_group"),
        _group(examples, dev_group).alias("dev_group"),
        hours(spec.test_size_unit).cast("long").alias("test_unit"),
        F.lit(1).cast("long").alias("one"),
        F.when(usable, hours(spec.train_budget_unit)).otherwise(0).cast("long").alias("unit"),
    )
    rows = written(rows, "flags", "zstd")  # every draw reads it, and none the joins and selectors behind it
    if spec.test_size is not None:
        amount = spec.test_size_unit == "hours"
        size = spec.test_size * spec.units_per_hour if amount else spec.test_size
        rows = group_cut(rows.where("is_test"), "test_group", size, spec.seed, "test_unit", amount, spec.order).mark(rows, "drawn")
        rows = rows.withColumn("in_test", F.col("is_test") & F.col("drawn")).drop("drawn")
    else:
        rows = rows.withColumn("in_test", F.col("is_test"))
    if dev is None:
        rows = group_cut(rows.where("not is_test"), "dev_group", spec.dev_size, spec.seed, "one", order=spec.order).mark(rows, "is_dev")
    rest = F.when(F.col("is_test"), F.lit("kept" if spec.test_remainder == "train" else "none")).otherwise(F.lit("pool"))
    place = F.when(F.col("in_test"), "test").when(~F.col("is_test") & F.col("is_dev"), "dev").when(F.col("is_train"), rest).otherwise("none")
    return rows.select("example_index", place.alias("place"), "dev_group", "unit")


def assign(examples: DataFrame, spec: SplitSpec) -> DataFrame:
    """(example_index, split) of the examples that are in a split; the others are absent.

    examples has example_index, key, size (whole units) and the attributes of its key. Order of
    precedence: exclude, test, dev, train. Rows larger than max_size are assigned, but weigh nothing in hours and
    budgets. The pool is filled up to the budget by whole groups of dev_group_by, else of the key.

    examples are read once and leave a narrow table of flags, groups and sizes. Every draw is a small job over it whose result is
    one row, and so is the assignment, without a shuffle of its rows. Raises if hours are asked for and a size is missing, if the kept
    test remainder exceeds the budget, or if nothing trains.
    """
    hours = (spec.train_budget is not None and spec.train_budget_unit == "hours") or (spec.test_size is not None and spec.test_size_unit == "hours")
    if hours and not examples.where("size is null").isEmpty():
        raise ValueError("a size or budget in hours needs the size of every example")
    placed = _placed(examples, spec)
    sums = {r.place: r for r in placed.groupBy("place").agg(F.count("*").alias("n"), F.sum("unit").alias("unit")).collect()}  # a row a place
    count, size = (lambda p: sums[p].n if p in sums else 0), (lambda p: float(sums[p].unit or 0) if p in sums else 0.0)
    left = None
    if spec.train_budget is not None:
        per = spec.units_per_hour if spec.train_budget_unit == "hours" else 1
        total = size("pool") if spec.train_budget == "matched" else float(spec.train_budget) * per
        left = total - size("kept")
        if left < 0:
            raise ValueError(f"the kept test remainder ({size('kept'):g}) exceeds the train budget ({total:g}); raise the budget or test_size")
        placed = budget_cut(placed.where("place = 'pool'"), "dev_group", "example_index", left, spec.seed, "unit", spec.order).mark(placed, "filled")
        placed = placed.where("place <> 'pool' or filled")
    if not (count("kept") or (count("pool") and left != 0)):
        raise ValueError("the train split is empty")
    split = F.when(F.col("place").isin("pool", "kept"), "train").otherwise(F.col("place"))
    return placed.where("place <> 'none'").select("example_index", split.alias("split"))


def report(examples: DataFrame, assignment: DataFrame, by: list[str], max_size: int | None = None, separator: str = ";") -> DataFrame:
    """Counts and sizes of all and of usable examples for each split and value of by; several values of a cell are joined."""
    usable = F.lit(True) if max_size is None else F.col("size") <= max_size
    types = dict(examples.dtypes)
    values = [F.array_join(F.col(c), separator).alias(c) if types[c].startswith("array") else F.col(c) for c in by]
    joined = examples.select("example_index", "size", *values).join(assignment, "example_index")
    return joined.groupBy("split", *by).agg(
        F.count("*").alias("examples"),
        F.sum("size").cast("long").alias("total_size"),
        F.count_if(usable).alias("usable_examples"),
        F.sum(F.when(usable, F.col("size")).otherwise(0)).cast("long").alias("usable_size"),
    )


def split_sizes(examples: DataFrame, assignment: DataFrame, units_per_hour: int, max_size: int | None = None) -> DataFrame:
    """Examples and hours, all and usable, of train, dev and test; empty splits are listed with zeros."""
    names = examples.sparkSession.createDataFrame([(s,) for s in ORDER], "split string")
    sums = names.join(report(examples, assignment, [], max_size), "split", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    hours = lambda c, name: F.round(F.coalesce(c, F.lit(0)) / float(units_per_hour), 3).alias(name)
    return sums.select("split", count("examples"), hours("total_size", "hours"), count("usable_examples"), hours("usable_size", "usable_hours"))


def default_assignment(rows: DataFrame, dev_size: float, seed: int, order: str = "hash") -> DataFrame:
    """Without metadata: source splits stay, and dev is drawn from train.

    Any source split besides train and test, or the lack of train, leaves the splits as they are. A dev_size under 1 is
    a fraction, rounded up to whole examples, else a number of examples; if no example would train, this raises.
    """
    counts = {r.source_split: r["count"] for r in rows.groupBy("source_split").count().collect()}  # a row a split
    keep = rows.select("example_index", F.col("source_split").alias("split"))
    if not dev_size or "train" not in counts or not set(counts) <= {"train", "test"}:
        return keep
    n = counts["train"]
    if (math.ceil(dev_size * n) if dev_size < 1 else int(dev_size)) >= n:
        raise ValueError(f"a dev_size of {dev_size} leaves none of {n} train examples")
    train = rows.where("source_split = 'train'").select("example_index", F.col("example_index").cast("string").alias("g"), F.lit(1).cast("long").alias("one"))
    dev = sample_groups(train, "g", dev_size, seed, "one", order=order, rounding="up").select(F.col("g").cast("long").alias("example_index"), F.lit(True).alias("drawn"))
    return keep.join(dev, "example_index", "left").select("example_index", F.when(F.col("drawn"), "dev").otherwise(F.col("split")).alias("split"))
