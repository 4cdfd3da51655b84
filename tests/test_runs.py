import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import runs as R


def test_parameters():
    config = {
        "experiment_id": "e7", "language": "xx", "model": {"short_name": "m", "path": "/p"}, "dataset": {"total": 5, "sources": []},
        "training": {"learning_rate": 0.001, "train_batch_size": 6, "gradient_accumulation_steps": 4, "max_steps": 900, "every": "${divide:${training.max_steps},4}", "bf16": True},
        "focus": {"enabled": False, "vocab_size": 64, "nested": {"a": 1}},
    }
    run, params = R.parameters(config)
    assert run == "e7" and params == {"language": "xx", "short_name": "m", "total": 5, "lr": 0.001, "train_batch_size": 6, "gradient_accumulation_steps": 4, "effective_batch": 24, "max_steps": 900, "bf16": True, "focus_enabled": False, "vocab_size": 64}
    assert R.parameters({"experiment_id": 1, "training": {"gradient_accumulation_steps": 3}})[1]["effective_batch"] == 3
    assert "effective_batch" not in R.parameters({"experiment_id": 1})[1]
    with pytest.raises(ValueError, match="experiment_id"):
        R.parameters({"training": {}})
    assert R.display_order(["zeta", "vocab_size", "alpha", "lr"]) == ["lr", "vocab_size", "alpha", "zeta"]
    assert list(map(R.shown, [3_000_000, 40_000, 1234, 0, 3e-5, 0.5, True, False, "text"])) == ["3M", "40k", "1234", "0", "3.0e-05", "0.5", "true", "false", "text"]


def test_display_and_natural_order(spark):
    df = spark.createDataFrame([("zeta",), ("vocab_size",), ("alpha",), ("lr",)], "p string")
    assert [r.p for r in df.orderBy(R.display_rank(F.col("p")), "p").collect()] == ["lr", "vocab_size", "alpha", "zeta"]
    want = ["", "3", "12", "a3", "v", "v1-a1", "v1-b2", "v1-b010", "v1-b10", "v1-b10c", "v2", "v10", "v" + "9" * 50, "v1" + "0" * 50]
    runs = spark.createDataFrame([(w,) for w in want], "r string").repartition(5)
    assert [r.r for r in runs.orderBy(*R.natural_key(F.col("r"))).collect()] == want


def test_diff_and_upsert(spark):
    params = spark.createDataFrame([("a", "lr", "1"), ("b", "lr", "1"), ("a", "drop", "2"), ("b", "drop", "3"), ("a", "only", "4")], "run string, param string, value string")
    assert {r.param: r.varies for r in R.parameter_diff(params, ["a", "b"]).collect()} == {"lr": False, "drop": True, "only": True}
    assert all(r.varies for r in R.parameter_diff(params, ["a", "missing"]).collect())
    old = spark.createDataFrame([("a", "p1", "kept"), ("z", "p0", None)], "run string, params string, note string")
    new = spark.createDataFrame([("a", "p2"), ("c", "p3")], "run string, params string")
    assert sorted(map(tuple, R.upsert(old, new, ["note"]).collect())) == [("a", "p2", "kept"), ("c", "p3", ""), ("z", "p0", "")]


def test_replicates_and_runs_of_no_group(spark):
    rows = [("r1", "g", "wer", 1, 4.0), ("r2", "g", "wer", 1, 6.0), ("r1", "g", "wer", 2, 1.0), ("r3", None, "wer", 1, 9.0), ("r3", None, "wer", 2, 8.0)]
    log = spark.createDataFrame(rows, "run string, grp string, metric string, step int, value double")
    got = {(r.label, r.step): (r.mean, r.low, r.high) for r in R.replicate_average(log, "minmax").collect()}
    assert got == {("g (n=2)", 1): (5.0, 4.0, 6.0), ("r3", 1): (9.0, 9.0, 9.0), ("r3", 2): (8.0, 8.0, 8.0)}
    assert {r.band for r in R.replicate_average(log).where("grp = 'g'").collect()} == {1.0}
    with pytest.raises(ValueError):
        R.replicate_average(log, "iqr")


def test_copies(spark):
    copies = spark.createDataFrame([("d2", "e"), ("d1", "e"), ("d3", None)], "directory string, experiment string")
    assert {r.experiment: r.directories for r in R.by_experiment(copies).collect()} == {"e": ["d1", "d2"], None: ["d3"]}
    files = spark.createDataFrame([("e", b"x"), ("e", None), ("e", b"x"), ("f", b"x"), ("f", b"y"), ("g", None)], "experiment string, content binary")
    assert {r.experiment: (r.present, r.agree) for r in R.agreeing(files, "experiment", "content").collect()} == {"e": (2, True), "f": (2, False), "g": (0, False)}


def test_selection(spark):
    rows = spark.createDataFrame([("exp-7", "2024-05-08"), ("exp-8", "2024-05-01"), ("", "2024-05-08"), ("other", "2024-05-08")], "run string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    now = F.lit("2024-05-09").cast("timestamp")
    names = lambda df: sorted(r.run for r in df.collect())
    assert names(R.in_window(rows, now, 7)) == ["exp-7", "other"] and names(R.in_window(rows, now, 0, "exp")) == ["exp-7", "exp-8"]
    registry = spark.createDataFrame([("a", "early", "x", {"lr": "1", "path": "p"}), ("b", "late", "x", {})], "run string, era string, group string, params map<string,string>")
    assert [(r.run, r.params) for r in R.selected(registry, era="early", hidden=["path"]).collect()] == [("a", {"lr": "1"})]
    assert names(R.selected(registry, group="x")) == ["a", "b"]
    paths = spark.createDataFrame([("a/s1.json",), ("b/s2.json",)], "p string")
    assert [r.p for r in R.path_selected(paths, "p", r"s\d", "^b").collect()] == ["a/s1.json"]
    assert [r[0] for r in paths.select(R.full_match(F.col("p"), r"a/.*|b")).collect()] == [True, False]


def test_slugs(spark):
    given = ["processed_big_x", "processed_big", "processed_bigger_x", "run-big", "big", "processed_x-big"]
    df = spark.createDataFrame([(g,) for g in given], "d string")
    assert [r[0] for r in df.select(R.of_model(F.col("d"), "big")).collect()] == [True, True, False, True, False, False]
    there = R.swapped_slug(F.col("d"), "big", "tiny")
    assert [r[0] for r in df.select(there).collect()] == ["processed_tiny_x", "processed_tiny", "processed_bigger_x", "run-tiny", "big", "processed_x-big"]
    assert [r[0] for r in df.select(R.swapped_slug(there, "tiny", "big")).collect()] == given
    names = spark.createDataFrame([("processed_m_a_focus-v-m",), ("processed_m_a_focus-v-n",), ("processed_m",), ("x",)], "d string")
    once = R.without_repeated_slug(F.col("d"))
    assert [r[0] for r in names.select(once).collect()] == [r[0] for r in names.select(R.without_repeated_slug(once)).collect()] == ["processed_m_a_focus-v", "processed_m_a_focus-v-n", "processed_m", "x"]


def test_record_plan(spark):
    legacy = spark.createDataFrame([(d, t, "r") for d, t in zip("abcde", ["paired", "paired", "paired", "odd", "paired"], strict=True)], "directory string, type string, record string")
    present = spark.createDataFrame([("a", None), ("b", "r"), ("c", "other"), ("d", None)], "directory string, record string")
    got = {r.directory: r.status for r in R.record_plan(legacy, present, ["paired"]).collect()}
    assert got == {"a": "write", "b": "already-migrated", "c": "differs", "d": "unknown-type", "e": "no-data"}


def test_fetch_latest_and_stopping(spark):
    remote = spark.createDataFrame([(r,) for r in "abcd"], "run string")
    local = spark.createDataFrame([("a", True, False), ("b", False, False), ("c", False, True)], "run string, finished boolean, closed boolean")
    assert {r.run: r.action for r in R.fetch_plan(remote, local).collect()} == {"a": "none", "b": "refresh", "c": "none", "d": "fetch"}
    copies = spark.createDataFrame([("e", "x", 0, 50), ("e", "y", 1, 10), ("e", "w", 1, 10), ("f", "z", -1, -1)], "exp string, name string, finished int, step int")
    order = [F.col("finished").desc(), F.col("step").desc(), F.col("name")]
    assert {r.exp: r.name for r in R.latest(copies, "exp", order).collect()} == {"e": "w", "f": "z"}
    closed = spark.createDataFrame([("a", None, True), ("b", None, False), ("c", None, None)], "run string, finished boolean, closed boolean")
    assert {r.run: r.action for r in R.fetch_plan(remote, closed).collect()} == {"a": "none", "b": "fetch", "c": "fetch", "d": "fetch"}


def stopped(log, patience, delay, threshold, greater):
    """The callback's rule, one evaluation after the other: (stop_step, best, diverged_step)."""
    best, waited, stop, broken = None, 0, None, None
    for step, value in log:
        better = best is None or ((value > best if greater else value < best) and abs(value - best) > threshold)
        if step >= delay:
            waited = 0 if better else waited + 1
            stop = step if stop is None and waited >= patience else stop
        if best is None or (value > best if greater else value < best):
            best = value
        broken = step if broken is None and (math.isnan(value) or math.isinf(value)) else broken
    return stop, repr(best), broken


@pytest.mark.parametrize("greater", [False, True])
@pytest.mark.parametrize(("patience", "delay", "threshold"), [(1, 0, 0.0), (3, 0, 0.0), (2, 40, 0.25), (4, 13, 1.0)])
def test_stopping_rule(spark, monkeypatch, greater, patience, delay, threshold):
    monkeypatch.setattr(R, "PIECE", 16)  # most logs are cut into pieces
    rng, odd = random.Random(patience), [math.nan, math.inf, -math.inf]
    logs = {f"r{i}": sorted((s, rng.choice(odd) if rng.random() < 0.02 else round(rng.gauss(5 - s / 60, 1), 2)) for s in rng.sample(range(200), rng.randint(1, 60))) for i in range(40)}
    logs |= {"nan first": [(0, math.nan), *[(i, 5.0 - i) for i in range(1, 30)]], "falls": [(i, 50.0 - i) for i in range(50)], "flat": [(i, 1.0) for i in range(50)]}
    df = spark.createDataFrame([(r, s, v) for r, log in logs.items() for s, v in log], "run string, step long, value double")
    got = {r.run: (r.stop_step, repr(r.best), r.diverged_step) for r in R.stopping_point(df, patience, delay, threshold, greater).collect()}
    assert got == {r: stopped(log, patience, delay, threshold, greater) for r, log in logs.items()}


def test_full_match_reads_line_breaks(spark):
    df = spark.createDataFrame([("a",), ("a\n",), ("ab",), ("b",), (None,)], "s string")
    assert [r.s for r in df.where(R.full_match(F.col("s"), "a|b")).collect()] == ["a", "b"]


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "split_report" in entry.queries()
