import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import sampling, splits
from sparkloom.operators.selectors import matches, normalize_selector
from sparkloom.operators.splits import SplitSpec

# tapes of a village archive: (tape, collector, singers, region)
TAPES = [("north1", "ida", ["p", "q"], "coast"), ("north2", "ida", ["r"], "coast"), ("hill7", "ola", ["q", "r"], "hills"), ("hill8", "ola", [], "hills"), ("isle3", "una", ["p"], "coast"), ("isle4", "una", ["s", "p"], "isles")]


@pytest.fixture(scope="module")
def examples(spark):
    """Three cuts of every tape, of 10, 20 and 30 units."""
    rows = [(3 * i + j, f"/tapes/{t[0]}-{j}.wav", 10 * (j + 1), *t) for i, t in enumerate(TAPES) for j in range(3)]
    return spark.createDataFrame(rows, "example_index long, path string, size long, key string, collector string, singers array<string>, region string")


def spec(**options):
    return SplitSpec(**{"multi_valued": ("singers",), "dev_size": 0, "units_per_hour": 1} | options)


def by_split(df, assignment):
    found = collections.defaultdict(list)
    for r in df.join(assignment, "example_index").collect():
        found[r.split].append((r.key, r.example_index))
    return {s: sorted(v) for s, v in found.items()}


def tapes(found, split):
    return {k for k, _ in found.get(split, [])}


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ({"collector": ["ida", "una"], "region": ["coast"]}, {"north1", "north2", "isle3"}),
        ([{"collector": "ola"}, {"region": ["isles"]}], {"hill7", "hill8", "isle4"}),
        ({"singers": ["r", "s"]}, {"north2", "hill7", "isle4"}),
        ({"singers": []}, set()),
        ([], set()),
    ],
)
def test_selectors(examples, selector, want):
    got = examples.where(matches(normalize_selector(selector), examples.columns, ["singers"])).select("key").distinct().collect()
    assert {r.key for r in got} == want


def test_selector_errors_and_booleans(spark, examples):
    with pytest.raises(KeyError, match="village"):
        matches(normalize_selector({"village": ["x"], "region": ["coast"]}), examples.columns)
    for bad in ([{}], ["coast"], [[]]):
        with pytest.raises(ValueError):
            normalize_selector(bad)
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, b boolean")
    chosen = lambda v: [r.i for r in df.where(matches(normalize_selector({"b": v}), df.columns, (), dict(df.dtypes))).collect()]
    assert (chosen(True), chosen([False, "True"]), chosen("true")) == ([1], [1, 2], [])


def test_precedence(examples):
    got = by_split(examples, splits.assign(examples, spec(exclude={"region": "isles"}, test={"collector": "ida"}, dev={"singers": "r"})))
    assert {s: tapes(got, s) for s in got} == {"test": {"north1", "north2"}, "dev": {"hill7"}, "train": {"hill8", "isle3"}}
    assert sum(map(len, got.values())) == 15
    none_and_empty = by_split(examples, splits.assign(examples, spec(test=[], dev=[], dev_size=5)))
    assert {s: len(v) for s, v in none_and_empty.items()} == {"train": 18}
    only = by_split(examples, splits.assign(examples, spec(test={"region": "isles"}, train={"collector": ["ida", "una"]})))
    assert tapes(only, "train") == {"north1", "north2", "isle3"}


def plain_order(names, seed):
    return sorted(names, key=lambda g: (hashlib.md5(f"{seed}:{g}".encode()).hexdigest(), g))


def python_order(names, seed):
    order = sorted([(n,) for n in names], key=str)
    random.Random(seed).shuffle(order)
    return [n for (n,) in order]


def plain_assign(rows, s, test, dev_group="key", test_group=None, train=lambda r: True):
    """The rules over lists; rows as dicts in order of example_index."""
    order_of = plain_order if s.order == "hash" else python_order
    test_group = test_group or dev_group
    light = lambda r: s.max_size is not None and r["size"] > s.max_size

    def draw(chosen, group, size, weight, amount):
        if not size or not chosen:
            return set()
        target = size if amount else (round(size * len(chosen)) if size < 1 else int(size))
        taken, out = 0, set()
        for g in order_of({r[group] for r in chosen}, s.seed):
            if taken >= target:
                break
            out.add(g)
            taken += sum(weight(r) for r in chosen if r[group] == g)
        return out

    chosen, rest = [r for r in rows if test(r)], [r for r in rows if not test(r)]
    out, kept = {}, []
    if s.test_size is None:
        out |= {r["example_index"]: "test" for r in chosen}
    else:
        hours = s.test_size_unit == "hours"
        drawn = draw(chosen, test_group, s.test_size * (s.units_per_hour if hours else 1), (lambda r: 0 if light(r) else r["size"]) if hours else (lambda r: 1), hours)
        for r in chosen:
            if r[test_group] in drawn:
                out[r["example_index"]] = "test"
            else:
                kept.append(r)
    drawn = draw(rest, dev_group, s.dev_size, lambda r: 1, False)
    out |= {r["example_index"]: "dev" for r in rest if r[dev_group] in drawn}
    pool = [r for r in rest if r[dev_group] not in drawn and train(r)]
    kept = [r for r in kept if train(r)] if s.test_remainder == "train" else []
    weight = lambda r: 0 if light(r) else (r["size"] if s.train_budget_unit == "hours" else 1)
    if s.train_budget is not None:
        per = s.units_per_hour if s.train_budget_unit == "hours" else 1
        left = (sum(map(weight, pool)) if s.train_budget == "matched" else s.train_budget * per) - sum(map(weight, kept))
        filled, total = [], 0
        for g in order_of({r[dev_group] for r in pool}, s.seed):
            for r in pool:
                if r[dev_group] == g and total < left:
                    filled.append(r)
                    total += weight(r)
        pool = filled
    return out | {r["example_index"]: "train" for r in [*pool, *kept]}


@pytest.fixture(scope="module")
def field_notes(spark):
    """48 speakers' sessions in four districts, with three cuts each."""
    rng = random.Random(8)
    rows = []
    for i in range(144):
        session = i // 3
        rows.append({"example_index": i, "size": rng.randrange(1, 50), "key": f"s{session}", "visit": f"v{session // 4}", "district": f"d{session % 4}"})
    return rows, spark.createDataFrame(rows, "example_index long, size long, key string, visit string, district string").repartition(5)


CASES = [
    {"dev_size": 0.2},
    {"dev_size": 7, "dev_group_by": "visit"},
    {"dev_size": 0.1, "test_size": 0.5, "dev_group_by": "visit"},
    {"dev_size": 0.1, "test_size": 0.75, "test_size_unit": "hours", "units_per_hour": 100, "max_size": 30},
    {"dev_size": 0, "test_size": 2, "test_size_unit": "hours", "units_per_hour": 100, "test_group_by": "visit", "test_remainder": "train"},
    {"dev_size": 0.1, "test_size": 0.5, "test_remainder": "train", "train_budget": "matched", "dev_group_by": "visit", "units_per_hour": 100, "max_size": 40},
    {"dev_size": 0.1, "test_size": 5, "train_budget": 20.5, "train_budget_unit": "examples", "dev_group_by": "visit", "max_size": 20},
    {"dev_size": 0, "train_budget": 3.25, "units_per_hour": 100},
    {"dev_size": 0.1, "test_size": 0, "test_remainder": "train"},
]


@pytest.mark.parametrize("order", ["hash", "cpython"])
@pytest.mark.parametrize("case", range(len(CASES)))
def test_assignment_as_plain_rules(field_notes, case, order):
    rows, df = field_notes
    s = SplitSpec(test={"district": "d1"}, seed=case + 1, order=order, **CASES[case])
    got = {r.example_index: r.split for r in splits.assign(df, s).collect()}
    want = plain_assign(rows, s, lambda r: r["district"] == "d1", s.dev_group_by or "key", s.test_group_by or s.dev_group_by)
    assert got == want
    by = collections.defaultdict(set)
    for r in rows:
        if got.get(r["example_index"]) in ("test", "dev"):
            by[r[s.dev_group_by or "key"]].add(got[r["example_index"]])
    held = {g for g, x in by.items() if "dev" in x}
    assert all(got[r["example_index"]] != "train" for r in rows if r[s.dev_group_by or "key"] in held and r["district"] != "d1")


def test_both_remainders_share_test_and_dev(field_notes):
    _, df = field_notes
    one, two = (splits.assign(df, SplitSpec(test={"district": "d2"}, test_size=0.3, dev_size=0.2, test_remainder=r)).where("split <> 'train'") for r in ("exclude", "train"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_cuts_and_frames_draw_the_same(spark):
    rng = random.Random(3)
    rows = [(i, f"g{rng.randrange(7)}", rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "example_index long, grp string, unit long")
    for budget in (0, 1, 300, 10_000):
        frame = sampling.fill_to_budget(df, "grp", "example_index", spark.range(1).select(F.lit(budget).alias("budget")), 5)
        cut = sampling.budget_cut(df, "grp", "example_index", budget, 5, "unit").mark(df, "in").where("in")
        order = sorted(rows, key=lambda r: (hashlib.md5(f"5:{r[1]}".encode()).hexdigest(), r[1], r[0]))
        want, total = set(), 0
        for i, _, u in order:
            if total < budget:
                want.add(i)
            total += u
        assert {r.example_index for r in frame.collect()} == {r.example_index for r in cut.collect()} == want
    for size, amount in ((0.25, False), (0.25, True), (40, False), (400.5, True), (0, False)):
        frame = {r.grp for r in sampling.sample_groups(df, "grp", size, 2, "unit", amount).collect()}
        assert frame == {r.grp for r in sampling.group_cut(df, "grp", size, 2, "unit", amount).mark(df, "in").where("in").collect()}
        assert len(frame) == 1 if (size, amount) == (0.25, True) else True


def test_python_order_is_that_of_its_generator():
    groups = [("b c",), ("b",), ("a",), ("a", "b"), ()]
    order = sorted(groups, key=str)
    random.Random(11).shuffle(order)
    assert sorted(groups, key=sampling.shuffled_ranks(groups, 11).get) == order
    by_text = sorted(groups, key=str)
    assert by_text.index(("b c",)) < by_text.index(("b",))  # a blank sorts before a quote


def test_groups_of_several_values(examples):
    s = spec(dev_size=1, dev_group_by="singers", order="cpython")
    got = by_split(examples, splits.assign(examples, s))
    assert len(tapes(got, "dev")) == 1
    names = {tuple(t[2]) for t in TAPES}
    first = min(names, key=sampling.shuffled_ranks(sorted(names), 1).get)
    assert tapes(got, "dev") == {t[0] for t in TAPES if tuple(t[2]) == first}


@pytest.mark.parametrize(
    "options",
    [
        {"test_remainder": "maybe", "test_size": 1},
        {"test_remainder": "train"},
        {"train_budget": "all"},
        {"test_size_unit": "days"},
        {"train_budget_unit": "days"},
        {"unmatched": "ignore"},
        {"test_size": 0, "test_size_unit": "hours"},
        {"test_size": -1.5, "test_size_unit": "hours"},
        {"order": "random"},
        {"test": [{}]},
    ],
)
def test_bad_options(options):
    with pytest.raises(ValueError):
        SplitSpec(**options)


def test_errors_of_the_data(examples):
    with pytest.raises(ValueError, match="empty"):
        splits.assign(examples, spec(test={"region": ["coast", "hills", "isles"]}))
    with pytest.raises(ValueError, match="empty"):
        splits.assign(examples, spec(train=[]))
    kept = {"test": {"collector": ["ida", "ola"]}, "test_size": 3, "test_remainder": "train"}
    with pytest.raises(ValueError, match="exceeds"):
        splits.assign(examples, spec(train_budget=4, train_budget_unit="examples", **kept))
    with pytest.raises(ValueError, match="size of every example"):
        splits.assign(examples.withColumn("size", F.lit(None).cast("long")), spec(train_budget="matched"))
    assert by_split(examples, splits.assign(examples.withColumn("size", F.lit(None).cast("long")), spec(train_budget=9, train_budget_unit="examples")))


def test_keys_and_attributes(spark):
    paths = spark.createDataFrame([(0, "/a/north1_000.wav"), (1, "/a/hill7_12.wav"), (2, "/a/other.wav"), (3, None), (4, "/b/gone_1.wav")], "example_index long, path string")
    s = SplitSpec(key_pattern=r"^([a-z0-9]+)_\d+\.wav$", key_column="tape")
    rows = splits.keyed(paths, "path", s)
    assert [r.key for r in rows.orderBy("example_index").collect()] == ["north1", "hill7", None, None, "gone"]
    metadata = spark.createDataFrame([(t[0], t[1]) for t in TAPES], "tape string, collector string")
    with pytest.raises(ValueError, match="3 examples have no metadata row"):
        splits.attributed(rows, metadata, s, "path")
    kept = splits.attributed(rows, metadata, SplitSpec(key_column="tape", unmatched="drop"), "path").orderBy("example_index")
    assert [(r.example_index, r.collector) for r in kept.collect()] == [(0, "ida"), (1, "ola")]
    twice = spark.createDataFrame([(0, "/x/cut_1.wav"), (1, "/y/cut_1.wav"), (2, None), (3, None)], "example_index long, path string")
    with pytest.raises(ValueError, match="cut_1.wav"):
        splits.keyed(twice, "path", s)
    assert splits.keyed(twice, "path", SplitSpec(key_from="id", key_pattern="^(.+)$")).where("key is null").count() == 2


def test_report(examples):
    assignment = splits.assign(examples, spec(test={"collector": "ida"}))
    sizes = {r.split: tuple(r)[1:] for r in splits.split_sizes(examples, assignment, 100, 20).collect()}
    assert sizes == {"train": (12, 2.4, 8, 1.2), "dev": (0, 0.0, 0, 0.0), "test": (6, 1.2, 4, 0.6)}
    by = {(r.split, r.singers): (r.examples, r.usable_size) for r in splits.report(examples, assignment, ["singers"], 20).collect()}
    assert by == {("test", "p;q"): (3, 30), ("test", "r"): (3, 30), ("train", "q;r"): (3, 30), ("train", ""): (3, 30), ("train", "p"): (3, 30), ("train", "s;p"): (3, 30)}


def test_ids_and_records():
    base = SplitSpec(name="Leave One Out!", test={"region": "coast"})
    assert base.split_id("x").startswith("leave-one-out-") and len(base.split_id("x")) == len("leave-one-out-") + 8
    assert base.split_id("x") == SplitSpec(name="Leave One Out!", metadata="/elsewhere.csv", test=[{"region": ["coast"]}]).split_id("x")
    changed = [SplitSpec(name="Leave One Out!", test={"region": "coast"}, **o) for o in ({"seed": 2}, {"dev_size": 0.2}, {"test_size": 3}, {"train_budget": 5.0})]
    assert len({base.split_id("x"), base.split_id("y"), *[c.split_id("x") for c in changed]}) == 6
    assert "test_size" not in base.record() and "train_budget_unit" not in SplitSpec(train_budget_unit="examples").record()
    json.dumps(base.record())
    assert SplitSpec.from_config({"enabled": True, "name": None, "multi_valued": ["singers"], "test_size": None}) == SplitSpec(multi_valued=("singers",))
    with pytest.raises(ValueError, match="colour"):
        SplitSpec.from_config({"colour": 1})


def test_default_assignment(spark):
    rows = spark.range(100).select(F.col("id").alias("example_index"), F.when(F.col("id") < 90, "train").otherwise("test").alias("source_split"))
    count = lambda df: {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert count(splits.default_assignment(rows, 0.2, 1)) == {"train": 72, "dev": 18, "test": 10}
    assert count(splits.default_assignment(rows, 15, 1)) == {"train": 75, "dev": 15, "test": 10}
    assert count(splits.default_assignment(rows.where("example_index < 23"), 0.1, 1)) == {"train": 20, "dev": 3}  # up, as 2.3 is more than two
    for size in (23, 0.99):
        with pytest.raises(ValueError, match="none of 23"):
            splits.default_assignment(rows.where("example_index < 23"), size, 1)
    named = rows.withColumn("source_split", F.when(F.col("example_index") < 3, "validation").otherwise(F.col("source_split")))
    assert count(splits.default_assignment(named, 0.2, 1)) == {"validation": 3, "train": 87, "test": 10}
    assert count(splits.default_assignment(rows.where("source_split = 'test'"), 0.2, 1)) == {"test": 10}


def test_budget_in_examples_without_sizes(spark):
    """An unknown size weighs an example like any other: the budget fills."""
    df = spark.range(20).select(F.col("id").alias("example_index"), F.col("id").cast("string").alias("key"), F.lit(None).cast("long").alias("size"))
    got = splits.assign(df, SplitSpec(test=[], dev=[], train_budget=3, train_budget_unit="examples", max_size=10)).collect()
    assert [r.split for r in got] == ["train"] * 3
    mixed = df.withColumn("size", F.when(F.col("example_index") < 10, 99))
    kept = splits.assign(mixed, SplitSpec(test=[], dev=[], train_budget=3, train_budget_unit="examples", max_size=10)).collect()
    assert sum(r.example_index >= 10 for r in kept) == 3  # the too large ones weigh nothing
