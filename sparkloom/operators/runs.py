"""Bookkeeping of runs: parameters of configs, diffs, upserts, debts, copies, replicate averages, rename plans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The parts of a config that hold parameters, names that are no parameters, and the order of the best known ones.
SECTIONS = ("model", "training", "dataset", "focus")
SKIPPED = {"name", "sources", "path", "cache_dir", "config", "tokenizer_path", "model_freeze_prefix", "metric_for_best_model", "optim", "lr_scheduler_type", "type", "split", "format", "external_eval_sets"}
PREFERRED = ("pretrained_name", "short_name", "language", "tokenizer", "lr", "effective_batch", "dropout", "weight_decay", "max_steps", "focus_enabled", "vocab_size", "tokenizer_algorithm")


def parameters(config: Mapping) -> tuple[str, dict]:
    """The experiment id of a config and its scalar parameters by name.

    Sections are flattened; learning_rate is lr, enabled of focus is focus_enabled, and effective_batch is
    the batch size times the accumulation steps, each 1 if absent. Interpolations are left out.
    """
    if not config.get("experiment_id"):
        raise ValueError("the config has no experiment_id")
    out = {}
    if isinstance(config.get("language"), str):
        out["language"] = config["language"]
    for section in SECTIONS:
        for name, value in (config.get(section) or {}).items():
            plain = isinstance(value, bool | int | float | str) and not (isinstance(value, str) and "${" in value)
            if name not in SKIPPED and plain:
                out[{"learning_rate": "lr"}.get(name, f"{section}_enabled" if name == "enabled" else name)] = value
    training = config.get("training") or {}
    sizes = [training.get(n) for n in ("train_batch_size", "gradient_accumulation_steps")]
    if any(isinstance(x, int) for x in sizes):
        out["effective_batch"] = (sizes[0] if isinstance(sizes[0], int) else 1) * (sizes[1] if isinstance(sizes[1], int) else 1)
    return str(config["experiment_id"]), out


def shown(value: object) -> str:
    """A parameter as it is displayed: 9M, 200k, 2.0e-05, true."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int) and value:
        for unit, letter in ((1_000_000, "M"), (1_000, "k")):
            if value % unit == 0:
                return f"{value // unit}{letter}"
    if isinstance(value, float) and value and abs(value) < 0.001:
        return f"{value:.1e}"
    return str(value)


def display_order(names: Iterable[str]) -> list[str]:
    """Well-known parameters first, in their order, then the others by name."""
    return sorted(names, key=lambda n: (PREFERRED.index(n) if n in PREFERRED else len(PREFERRED), n))


def display_rank(name: Column) -> Column:
    """display_order() as a sort column; the name itself comes second."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PREFERRED)), name), F.lit(0)), F.lit(len(PREFERRED) + 1))


def parameter_diff(params: DataFrame, runs: list[str]) -> DataFrame:
    """(param, n_values, varies) over the named runs; an absent parameter counts as a value of its own."""
    spark = params.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r,) for r in runs], "run string"))  # the runs named by the caller
    some = params.join(wanted, "run", "left_semi").groupBy("param").agg(F.countDistinct("value").alias("n"), F.countDistinct("run").alias("present"))
    n = F.col("n") + F.when(F.col("present") < len(runs), 1).otherwise(0)
    return some.select("param", n.alias("n_values"), (n > 1).alias("varies"))


def upsert(registry: DataFrame, params: DataFrame, human: list[str]) -> DataFrame:
    """New params replace old ones; human fields stay, and are empty for new runs."""
    old, new = registry.alias("o"), params.alias("n")
    both = old.join(new, F.col("o.run") == F.col("n.run"), "full")
    return both.select(F.coalesce("n.run", "o.run").alias("run"), F.coalesce("n.params", "o.params").alias("params"), *[F.coalesce(f"o.{h}", F.lit("")).alias(h) for h in human])


def natural_key(name: Column) -> list[Column]:
    """Sort columns for names like v2-b9 and v10-b1: every run of digits counts as a number, and the name itself decides ties.

    Numbers of any length are compared, by their digits without leading zeros.
    """
    number = lambda d: F.ltrim(d, F.lit("0"))
    texts, digits = (F.regexp_extract_all(name, F.lit(r"([^0-9]*)([0-9]*)"), F.lit(i)) for i in (1, 2))
    return [F.zip_with(texts, digits, lambda t, d: F.struct(t.alias("text"), F.length(number(d)).alias("size"), number(d).alias("digits"))), name]


def debts(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(run, debt): files without a row, rows without files, blank notes and blank observations. natural_key() sorts them."""
    missing_row = files.join(registry, "run", "left_anti").select("run", F.lit("unregistered").alias("debt"))
    missing_file = registry.join(files, "run", "left_anti").select("run", F.lit("no file").alias("debt"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    notes = registry.where(blank("note")).select("run", F.lit("note").alias("debt"))
    observations = registry.where(blank("observation")).select("run", F.lit("observation").alias("debt"))
    return missing_row.unionByName(missing_file).unionByName(notes).unionByName(observations)


def verify(registry: DataFrame, configs: DataFrame) -> DataFrame:
    """(run, param) whose recorded and configured values differ or exist on one side only."""
    a, b = registry.alias("a"), configs.alias("b")
    both = a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.param") == F.col("b.param")), "full")
    return both.where(~F.col("a.value").eqNullSafe(F.col("b.value"))).select(F.coalesce("a.run", "b.run").alias("run"), F.coalesce("a.param", "b.param").alias("param"), F.col("a.value").alias("recorded"), F.col("b.value").alias("configured"))


def replicate_average(log: DataFrame, band: str = "std") -> DataFrame:
    """Mean and band of (grp, metric, step), only at steps that every member of grp logged, labelled 'grp (n=members)'.

    A run whose grp is null stays by itself, under its own name.
    """
    if band not in ("std", "minmax"):
        raise ValueError("band must be std or minmax")
    named = log.withColumn("_own", F.col("grp").isNull()).withColumn("grp", F.coalesce("grp", "run"))
    keys = ["grp", "_own", "metric"]
    members = named.groupBy(*keys).agg(F.countDistinct("run").alias("members"))
    spread = [F.stddev_pop("value").alias("band")] if band == "std" else [F.min("value").alias("low"), F.max("value").alias("high")]
    stats = named.groupBy(*keys, "step").agg(F.avg("value").alias("mean"), *spread, F.countDistinct("run").alias("logged"))
    label = F.when(F.col("_own"), F.col("grp")).otherwise(F.concat("grp", F.lit(" (n="), F.col("members").cast("string"), F.lit(")")))
    return stats.join(members, keys).where("logged = members").withColumn("label", label).drop("logged", "_own")


def by_experiment(copies: DataFrame) -> DataFrame:
    """(experiment, directories) of copies(directory, experiment), sorted; the directories without an experiment under null.

    An experiment's directories are one row's list: there are as many as times it was copied, which is a few.
    """
    return copies.groupBy("experiment").agg(F.array_sort(F.collect_list("directory")).alias("directories"))


def agreeing(copies: DataFrame, by: str, content: str) -> DataFrame:
    """(by, present, agree): whether all copies that have content hold the same bytes; False if none has any."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    return copies.groupBy(by).agg(F.count(content).alias("present"), (F.coalesce(F.min(digest) == F.max(digest), F.lit(False))).alias("agree"))


def in_window(inventory: DataFrame, now: Column, days: int = 7, substring: str = "", modified: str = "modified") -> DataFrame:
    """Rows with a run id that holds substring, modified at most days before now; 0 days is no window."""
    rows = inventory.where(F.coalesce(F.col("run"), F.lit("")) != "").where(F.contains(F.col("run"), F.lit(substring)))
    return rows.where(F.col(modified) >= now - F.make_dt_interval(F.lit(days))) if days else rows


def selected(registry: DataFrame, era: str | None = None, group: str | None = None, hidden: Sequence[str] = ()) -> DataFrame:
    """Registry rows of an era and a group, without the hidden entries of the map params."""
    rows = registry if era is None else registry.where(F.col("era") == era)
    rows = rows if group is None else rows.where(F.col("group") == group)
    return rows.withColumn("params", F.map_filter("params", lambda k, v: ~k.isin(*hidden))) if hidden else rows


def path_selected(df: DataFrame, path: str, wanted: str | None = None, unwanted: str | None = None) -> DataFrame:
    """Rows whose path has a match of wanted and none of unwanted."""
    rows = df.where(F.col(path).rlike(wanted)) if wanted else df
    return rows.where(~F.col(path).rlike(unwanted)) if unwanted else rows


def full_match(name: Column, pattern: str) -> Column:
    """Whether pattern matches the whole name, its line breaks included."""
    return name.rlike(rf"\A(?:{pattern})\z")


def of_model(directory: Column, slug: str, prefix: str = "processed_") -> Column:
    """Whether a directory belongs to a model: prefix and slug, alone or before '_', or a name that ends in '-' and the slug."""
    return (directory == prefix + slug) | directory.startswith(f"{prefix}{slug}_") | (~directory.startswith(prefix) & directory.endswith(f"-{slug}"))


def swapped_slug(directory: Column, old: str, new: str, prefix: str = "processed_") -> Column:
    """The directory's name under a new slug; others stay. Swapping back gives the old name."""
    after = F.concat(F.lit(prefix + new), F.substr(directory, F.lit(len(prefix + old) + 1)))
    ending = F.concat(F.left(directory, F.length(directory) - len(old)), F.lit(new))
    return F.when(~of_model(directory, old, prefix), directory).when(directory.startswith(prefix), after).otherwise(ending)


def without_repeated_slug(directory: Column, prefix: str = "processed_", segment: str = "focus-") -> Column:
    """processed_M_..._focus-x-M without the last -M; other names stay, and so does the result of a second call."""
    parts = F.split(F.substr(directory, F.lit(len(prefix) + 1)), "_")
    last, ending = F.element_at(parts, -1), F.concat(F.lit("-"), parts[0])
    fits = directory.startswith(prefix) & (F.size(parts) > 1) & last.startswith(segment) & last.endswith(ending)
    return F.when(fits, F.left(directory, F.length(directory) - F.length(ending))).otherwise(directory)


def rename_plan(directories: DataFrame, target: Column) -> DataFrame:
    """(name, target, action): rename, none if the name stays, or skip if the target exists or two names have it."""
    named = directories.select("name", target.alias("target"))
    taken = named.select(F.col("name").alias("target"), F.lit(True).alias("taken"))
    wanted = named.where("name <> target").groupBy("target").agg(F.count("*").alias("wanted"))
    joined = named.join(taken, "target", "left").join(wanted, "target", "left")
    action = F.when(F.col("name") == F.col("target"), "none").when(F.col("taken") | (F.col("wanted") > 1), "skip").otherwise("rename")
    return joined.select("name", "target", action.alias("action"))


def record_plan(legacy: DataFrame, present: DataFrame, known: Sequence[str]) -> DataFrame:
    """(directory, status) of legacy(directory, type, record) against present(directory, record), a row where data exist.

    write if no record is there yet, already-migrated if it is equal, differs, no-data, or unknown-type.
    """
    joined = legacy.join(present.select("directory", F.lit(True).alias("data"), F.col("record").alias("existing")), "directory", "left")
    status = F.when(~F.coalesce(F.col("type").isin(*known), F.lit(False)), "unknown-type").when(F.col("data").isNull(), "no-data").when(F.col("existing").isNull(), "write")
    return joined.select("directory", status.when(F.col("existing") == F.col("record"), "already-migrated").otherwise("differs").alias("status"))


def with_features(predictions: DataFrame, features: DataFrame) -> DataFrame:
    """Predictions with the path of their example."""
    return predictions.join(features.select("example_index", F.col("audio_path").alias("example")), "example_index")


def latest(copies: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first row of each by in the order. Spark keeps only that row of each task's part before the shuffle, so a large by sorts nowhere whole."""
    return copies.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest_checkpoint(checkpoints: DataFrame, by: str = "run", path: str = "path") -> DataFrame:
    """(by, path, step) of the checkpoint with the largest number at the end of its path, so 10 comes after 9; paths without one don't count."""
    step = F.try_to_number(F.regexp_extract(path, r"([0-9]+)/*$", 1), F.lit("9" * 18)).cast("long")
    return checkpoints.withColumn("step", step).where("step is not null").groupBy(by).agg(F.max_by(path, F.struct("step", path)).alias(path), F.max("step").alias("step"))


def fetch_plan(remote: DataFrame, local: DataFrame) -> DataFrame:
    """(run, action): leave what is closed or complete, fetch what is missing or whose state is unknown, refresh what is unfinished."""
    joined = remote.join(local, "run", "left")
    action = F.when(F.col("closed"), "none").when(F.col("finished").isNull(), "fetch").when(F.col("finished"), "none").otherwise("refresh")
    return joined.select("run", action.alias("action"))


#: Steps whose rows one task scans.
PIECE = 1 << 16


def _scan(df: DataFrame, by: list[str], name: str, value: Column, how: str, last: int) -> DataFrame:
    """Adds the min, max or sum of value over the rows of by up to this one (last = 0) or the one before it (last = -1).

    Rows of (by, _piece) are scanned on their own and the totals of pieces once more, so a long log is cut into pieces.
    """
    total, join = {"min": (F.min, F.least), "max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}[how]
    keyed, keys = df.withColumn("_value", value), [*by, "_piece"]
    totals = keyed.groupBy(*keys).agg(total("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, total("_total").over(before).alias("_carried"))
    inside = total("_value").over(Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, last))
    return keyed.withColumn("_inside", inside).join(carried, keys).withColumn(name, join(F.col("_carried"), F.col("_inside"))).drop("_value", "_inside", "_carried")


def stopping_point(log: DataFrame, patience: int, delay: int = 0, threshold: float = 0.0, greater_is_better: bool = False) -> DataFrame:
    """(run, stop_step, best, diverged_step) of a log (run, step, value); steps are told apart and values not null.

    An evaluation improves if it is the run's first one or better than the best before it by more than threshold. From step
    delay on, evaluations that don't improve are counted, and one that does sets the count to 0; the run stops where the
    count reaches patience, null if it never does. The best so far follows all evaluations, those before delay too. A
    NaN improves nothing, and as the first value nothing improves on it. diverged_step is the first step of a NaN or an infinite value.
    """
    sign = -1.0 if greater_is_better else 1.0
    bad = F.isnan("value")
    rows = log.select("run", "step", "value", (sign * F.col("value")).alias("_cost")).withColumn("_piece", F.floor(F.col("step") / PIECE))
    firsts = rows.groupBy("run").agg(F.min("step").alias("_start"), F.isnan(F.min_by("_cost", "step")).alias("_stuck"))
    seen = _scan(rows, ["run"], "_best", F.when(~bad, F.col("_cost")), "min", -1).join(firsts, "run")
    better = ~F.col("_stuck") & ~bad & (F.col("_cost") < F.col("_best")) & (F.col("_best") - F.col("_cost") > threshold)
    improved = (F.col("step") == F.col("_start")) | better
    active = F.col("step") >= delay
    counted = _scan(seen.withColumn("_improved", improved), ["run"], "_at", active.cast("int"), "sum", 0)
    reset = _scan(counted, ["run"], "_reset", F.when(active & F.col("_improved"), F.col("_at")), "max", 0)
    waited = F.col("_at") - F.coalesce("_reset", F.lit(0))
    best = F.when(F.any_value("_stuck"), F.lit(float("nan"))).otherwise(sign * F.min(F.when(~bad, F.col("_cost"))))
    return reset.groupBy("run").agg(
        F.min(F.when(active & (waited >= patience), F.col("step"))).alias("stop_step"),
        best.alias("best"),
        F.min(F.when(bad | (F.abs("value") == float("inf")), F.col("step"))).alias("diverged_step"),
    )
