"""Run bookkeeping over events (a step log of runs) and part (parameters)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import compact_number
from ..operators import runs as R
from .common import Catalogue

_C = Catalogue()
query, QUERIES, ORACLES = _C.query, _C.queries, _C.oracles

_LOG = "log AS (SELECT 'run' || user_id AS run, 'g' || (user_id % 5) AS grp, event_type AS metric, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step, value, ts FROM events)"


def _log(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t("events").select(F.concat(F.lit("run"), "user_id").alias("run"), F.concat(F.lit("g"), F.col("user_id") % 5).alias("grp"), F.col("event_type").alias("metric"), F.row_number().over(w).alias("step"), "value", "ts")


def _params(t):
    """(run, param, value) from the columns of part."""
    columns = ["p_brand", "p_type", "p_size"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).cast("string").alias("value")) for c in columns]))
    return t("part").select(F.concat(F.lit("run"), "p_partkey").alias("run"), pairs.alias("p")).select("run", "p.*")


_PARAMS = "params AS (SELECT 'run' || p_partkey AS run, 'p_brand' AS param, p_brand AS value FROM part UNION ALL SELECT 'run' || p_partkey, 'p_type', p_type FROM part UNION ALL SELECT 'run' || p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part)"


@query(f"WITH {_PARAMS}, s AS (SELECT param, count(DISTINCT value) AS n, count(DISTINCT run) AS present FROM params WHERE run IN ('run1', 'run2', 'run3', 'absent') GROUP BY param) SELECT param, n + CASE WHEN present < 4 THEN 1 ELSE 0 END AS n_values, n + CASE WHEN present < 4 THEN 1 ELSE 0 END > 1 AS varies FROM s")
def run_params_diff(t):
    return R.parameter_diff(_params(t), ["run1", "run2", "run3", "absent"])


# Registered runs are parts by their number; the runs that files know are the parts that orders ask for, and customers' numbers.
_RUNS = "reg AS (SELECT 'run' || p_partkey AS run, p_type AS params, p_brand AS note FROM part), files AS (SELECT 'run' || c_custkey AS run, 'new ' || c_mktsegment AS params FROM customer)"


def _registry(t):
    return t("part").select(F.concat(F.lit("run"), "p_partkey").alias("run"), F.col("p_type").alias("params"), F.col("p_brand").alias("note"))


def _found(t):
    return t("customer").select(F.concat(F.lit("run"), "c_custkey").alias("run"), F.concat(F.lit("new "), "c_mktsegment").alias("params"))


@query(f"WITH {_RUNS} SELECT coalesce(files.run, reg.run) AS run, coalesce(files.params, reg.params) AS params, coalesce(note, '') AS note FROM reg FULL JOIN files ON reg.run = files.run")
def registry_upsert(t):
    return R.upsert(_registry(t), _found(t), ["note"])


@query("""WITH f AS (SELECT 'run' || c_custkey AS run FROM customer), r AS (SELECT 'run' || p_partkey AS run, CASE WHEN p_size < 10 THEN ' ' ELSE p_name END AS note, CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS observation FROM part)
SELECT run, 'unregistered' AS debt FROM f WHERE run NOT IN (SELECT run FROM r) UNION ALL SELECT run, 'no file' FROM r WHERE run NOT IN (SELECT run FROM f) UNION ALL SELECT run, 'note' FROM r WHERE coalesce(trim(note), '') = '' UNION ALL SELECT run, 'observation' FROM r WHERE coalesce(trim(observation), '') = ''""")
def annotation_debt(t):
    registry = t("part").select(F.concat(F.lit("run"), "p_partkey").alias("run"), F.when(F.col("p_size") < 10, " ").otherwise(F.col("p_name")).alias("note"), F.when(F.col("p_size") <= 40, F.col("p_type")).alias("observation"))
    return R.debts(_found(t).select("run"), registry)


@query("SELECT 'g' || c_nationkey || '-b' || c_custkey AS run, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS place FROM customer")
def natural_order(t):
    """Places in the order g2-b9, g2-b10, g10-b1."""
    from ..sources import indexed

    names = t("customer").select(F.concat(F.lit("g"), "c_nationkey", F.lit("-b"), "c_custkey").alias("run"), "c_mktsegment")
    key, _ = R.natural_key(F.col("run"))
    return indexed(names.withColumn("_key", key), ["_key", "run"], "place").select("run", (F.col("place") + 1).alias("place"))


@query(f"WITH {_PARAMS}, c AS (SELECT run, param, CASE WHEN value LIKE '%7' THEN value || 'x' ELSE value END AS value FROM params WHERE value <> 'ECONOMY') SELECT a.run, a.param, a.value AS recorded, c.value AS configured FROM params a LEFT JOIN c ON a.run = c.run AND a.param = c.param WHERE a.value IS DISTINCT FROM c.value")
def registry_verify(t):
    params = _params(t)
    configs = params.where("value <> 'ECONOMY'").withColumn("value", F.when(F.col("value").like("%7"), F.concat("value", F.lit("x"))).otherwise(F.col("value")))
    return R.verify(params, configs)


_AVG = f"WITH {_LOG}, m AS (SELECT grp, metric, count(DISTINCT run) AS members FROM log GROUP BY grp, metric)"


@query(f"{_AVG} SELECT l.grp, l.metric, step, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS band, any_value(members) AS members, l.grp || ' (n=' || any_value(members) || ')' AS label FROM log l JOIN m ON m.grp = l.grp AND m.metric = l.metric GROUP BY l.grp, l.metric, step HAVING count(DISTINCT run) = any_value(members)")
def seed_average(t):
    return R.replicate_average(_log(t)).withColumns({"mean": F.round("mean", 6), "band": F.round("band", 6)})


@query(f"{_AVG} SELECT l.grp, l.metric, step, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, any_value(members) AS members, l.grp || ' (n=' || any_value(members) || ')' AS label FROM log l JOIN m ON m.grp = l.grp AND m.metric = l.metric GROUP BY l.grp, l.metric, step HAVING count(DISTINCT run) = any_value(members)")
def seed_average_band(t):
    return R.replicate_average(_log(t), "minmax").withColumn("mean", F.round("mean", 6))


@query(f"WITH {_LOG} SELECT run, metric, CAST(step AS BIGINT) AS step, value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric = 'purchase' DESC, step DESC, metric) AS k FROM log) WHERE k = 1")
def latest_per_run(t):
    order = [(F.col("metric") == "purchase").desc(), F.col("step").desc(), F.col("metric")]
    return R.latest(_log(t), "run", order).select("run", "metric", F.col("step").cast("long").alias("step"), "value")


@query(f"WITH {_LOG} SELECT run, 'out/' || run || '/checkpoint-' || max(step) AS path, max(step) AS step FROM log GROUP BY run")
def latest_checkpoint(t):
    """Folders of all steps of a run; the largest number is the latest."""
    folders = _log(t).select("run", F.concat(F.lit("out/"), "run", F.lit("/checkpoint-"), F.col("step").cast("string")).alias("path"))
    return R.latest_checkpoint(folders)


@query("""WITH remote AS (SELECT DISTINCT 'run' || user_id AS run FROM events), l AS (SELECT 'run' || o_custkey AS run, bool_or(o_orderstatus = 'F') AS finished, bool_or(o_orderpriority = '5-LOW') AS closed FROM orders GROUP BY o_custkey)
SELECT remote.run, CASE WHEN closed THEN 'none' WHEN finished IS NULL THEN 'fetch' WHEN finished THEN 'none' ELSE 'refresh' END AS action FROM remote LEFT JOIN l ON l.run = remote.run""")
def fetch_status(t):
    """Runs that log events against copies that customers' orders stand for."""
    local = t("orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("finished"), F.bool_or(F.col("o_orderpriority") == "5-LOW").alias("closed"))
    return R.fetch_plan(t("events").select(F.concat(F.lit("run"), "user_id").alias("run")).distinct(), local.select(F.concat(F.lit("run"), "o_custkey").alias("run"), "finished", "closed"))


def _stopping_sql(metric: str, patience: int, delay: int, threshold: float, greater: bool) -> str:
    """The rule one evaluation after the other."""
    better, gain = ("v.value > m.best", "v.value - m.best") if greater else ("v.value < m.best", "m.best - v.value")
    return f"""WITH RECURSIVE {_LOG}, v AS (SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM log WHERE metric = '{metric}'),
m AS (SELECT run, k, step, value, value AS best, 0 AS waited FROM v WHERE k = 1 UNION ALL
SELECT v.run, v.k, v.step, v.value, CASE WHEN {better} THEN v.value ELSE m.best END, CASE WHEN v.step < {delay} THEN m.waited WHEN {better} AND {gain} > {threshold} THEN 0 ELSE m.waited + 1 END FROM m JOIN v ON v.run = m.run AND v.k = m.k + 1)
SELECT run, CAST(min(CASE WHEN waited >= {patience} AND step >= {delay} THEN step END) AS BIGINT) AS stop_step, arg_max(best, k) AS best, CAST(min(CASE WHEN isnan(value) OR isinf(value) THEN step END) AS BIGINT) AS diverged_step FROM m GROUP BY run"""


def _stopping(t, metric, patience, delay, threshold, greater):
    log = _log(t).where(F.col("metric") == metric).select("run", F.col("step").cast("long").alias("step"), "value")
    return R.stopping_point(log, patience, delay, threshold, greater)


@query(_stopping_sql("error", 5, 0, 0.0, False))
def early_stopping(t):
    return _stopping(t, "error", 5, 0, 0.0, False)


@query(_stopping_sql("purchase", 3, 6, 2.5, True))
def early_stopping_delayed(t):
    """A metric to be raised, judged from step 6 on, by gains of more than 2.5."""
    return _stopping(t, "purchase", 3, 6, 2.5, True)


@query("SELECT 'run' || user_id AS run, list_sort(list(DISTINCT event_type))[1] AS first_metric, count(*) AS copies FROM events GROUP BY user_id")
def run_grouping(t):
    return t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type"))[0].alias("first_metric"), F.count("*").alias("copies")).select(F.concat(F.lit("run"), "user_id").alias("run"), "first_metric", "copies")


@query("SELECT DISTINCT p_name AS name FROM part WHERE regexp_matches(p_name, 'ring|red') AND NOT regexp_matches(p_name, '^small')")
def path_pattern(t):
    return R.path_selected(t("part"), "p_name", "ring|red", "^small").select(F.col("p_name").alias("name")).distinct()


@query("SELECT event_type AS metric, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type")
def metric_full_match(t):
    names = t("events").withColumn("metric", F.col("event_type"))
    return names.where(R.full_match(F.col("metric"), "click|err|error")).groupBy("metric").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size * 1000 % 1000000 = 0 THEN CAST(p_size // 1000 AS VARCHAR) || 'M' ELSE CAST(p_size AS VARCHAR) || 'k' END AS shown FROM part")
def value_format(t):
    return t("part").select("p_partkey", compact_number((F.col("p_size") * 1000).cast("double")).alias("shown"))


@query("""WITH p AS (SELECT 'run' || p_partkey AS run, p_size, p_brand, p_type FROM part) SELECT run, 'language' AS param, lower(p_type) AS value FROM p
UNION ALL SELECT run, 'pretrained_name', p_brand FROM p UNION ALL SELECT run, 'dropout', CASE WHEN p_size % 2 = 0 THEN '0.25' ELSE '1.0e-05' END FROM p UNION ALL SELECT run, 'lr', '2.0e-05' FROM p
UNION ALL SELECT run, 'max_steps', p_size || 'k' FROM p UNION ALL SELECT run, 'save_steps', CAST(p_size * 1000 // 7 AS VARCHAR) FROM p WHERE p_size * 1000 // 7 % 1000 <> 0 UNION ALL SELECT run, 'save_steps', CAST(p_size // 7 AS VARCHAR) || 'k' FROM p WHERE p_size * 1000 // 7 % 1000 = 0
UNION ALL SELECT run, 'effective_batch', CAST(4 * p_size AS VARCHAR) FROM p UNION ALL SELECT run, 'train_batch_size', CAST(p_size AS VARCHAR) FROM p UNION ALL SELECT run, 'gradient_accumulation_steps', '4' FROM p UNION ALL SELECT run, 'focus_enabled', CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END FROM p""")
def config_parameters(t):
    """A YAML config a part, with comments, lists, interpolations and a quotient, read back into parameters."""
    from ..sources.configs import config_parameters as read

    half = F.when(F.col("p_size") % 2 == 0, "0.25").otherwise("1e-5")
    text = F.concat(
        F.lit("# config\nexperiment_id: run"), F.col("p_partkey").cast("string"), F.lit("\nlanguage: '"), F.lower("p_type"), F.lit("'  # lower case\nmodel:\n  name: none\n  pretrained_name: "), F.col("p_brand"),
        F.lit("\n  dropout: "), half, F.lit("\n  layers: [1, 2]\ntraining:\n  learning_rate: 2e-5\n  train_batch_size: "), F.col("p_size").cast("string"),
        F.lit("\n  gradient_accumulation_steps: 4\n  max_steps: "), (F.col("p_size") * 1000).cast("string"), F.lit("\n  save_steps: ${divide:${training.max_steps},7}\nfocus:\n  enabled: "), (F.col("p_size") > 25).cast("string"), F.lit("\n"),
    )
    configs = t("part").select(F.col("p_partkey").alias("file"), text.alias("text"))
    return read(configs, resolve=True).select("run", "param", "value")


@query("WITH p AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events) SELECT k, event_type, count(*) AS n FROM p GROUP BY k, event_type")
def record_read(t):
    return t("events").select(F.from_json("props", "k long")["k"].alias("k"), "event_type").groupBy("k", "event_type").agg(F.count("*").alias("n"))


@query("SELECT 'run' || user_id AS experiment, array_to_string(list_sort(list(event_type || '-' || event_id)), ',') AS directories FROM events GROUP BY user_id")
def copies_by_experiment(t):
    copies = t("events").select(F.concat(F.lit("run"), "user_id").alias("experiment"), F.concat_ws("-", "event_type", "event_id").alias("directory"))
    return R.by_experiment(copies).select("experiment", F.array_join("directories", ",").alias("directories"))


@query("SELECT source, count(nullif(text, '')) AS present, coalesce(min(sha256(nullif(text, ''))) = max(sha256(nullif(text, ''))), false) AS agree FROM documents GROUP BY source")
def agreeing_copies(t):
    return R.agreeing(t("documents").select("source", F.nullif("text", F.lit("")).alias("text")), "source", "text")


@query("SELECT 'run' || user_id AS run, event_id FROM events WHERE contains('run' || user_id, '7') AND ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY")
def inventory_window(t):
    inventory = t("events").select(F.concat(F.lit("run"), "user_id").alias("run"), "event_id", "ts")
    return R.in_window(inventory, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), 7, "7", "ts").select("run", "event_id")


@query("SELECT 'run' || p_partkey AS run, 'brand=' || p_brand AS params FROM part WHERE p_type = 'ECONOMY' AND p_size = 7")
def registry_selection(t):
    params = F.create_map(F.lit("brand"), "p_brand", F.lit("name"), "p_name")
    registry = t("part").select(F.concat(F.lit("run"), "p_partkey").alias("run"), F.col("p_type").alias("era"), F.col("p_size").cast("string").alias("group"), params.alias("params"))
    return R.selected(registry, "ECONOMY", "7", ["name"]).select("run", F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("params"))


@query("SELECT doc_id, CASE WHEN k < 7 THEN 'processed_' || 'wide' || substr(name, 15) ELSE name END AS renamed FROM (SELECT doc_id, 'processed_base_' || source AS name, length(source) AS k FROM documents WHERE length(source) < 7 UNION ALL SELECT doc_id, 'processed_basement_' || source, 7 FROM documents WHERE length(source) >= 7)")
def slug_swap(t):
    """processed_base_x goes over to processed_wide_x; processed_basement_x is another model's."""
    name = F.when(F.length("source") < 7, F.concat(F.lit("processed_base_"), "source")).otherwise(F.concat(F.lit("processed_basement_"), "source"))
    return t("documents").select("doc_id", R.swapped_slug(name, "base", "wide").alias("renamed"))


@query("SELECT DISTINCT 'processed_' || lang || '_' || source || '_focus-v' AS name FROM documents")
def repeated_slug_dropped(t):
    name = F.concat(F.lit("processed_"), "lang", F.lit("_"), "source", F.lit("_focus-v-"), "lang")
    once = R.without_repeated_slug(name)
    return t("documents").select(R.without_repeated_slug(once).alias("name")).distinct()


@query("""WITH d AS (SELECT DISTINCT source AS name FROM documents UNION SELECT DISTINCT lang FROM documents), n AS (SELECT name, left(name, 2) AS target FROM d), w AS (SELECT target, count(*) AS k FROM n WHERE name <> target GROUP BY target)
SELECT name, n.target, CASE WHEN name = n.target THEN 'none' WHEN n.target IN (SELECT name FROM d) OR k > 1 THEN 'skip' ELSE 'rename' END AS action FROM n LEFT JOIN w ON w.target = n.target""")
def rename_plan(t):
    names = t("documents").select(F.col("source").alias("name")).union(t("documents").select("lang")).distinct()
    return R.rename_plan(names, F.left("name", F.lit(2)))


@query("""WITH l AS (SELECT p_partkey AS directory, p_type AS type, p_brand AS record FROM part), e AS (SELECT c_custkey AS directory, CASE WHEN c_nationkey < 8 THEN NULL WHEN c_nationkey < 16 THEN p_brand ELSE c_mktsegment END AS record FROM customer LEFT JOIN part ON p_partkey = c_custkey)
SELECT l.directory, CASE WHEN type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'unknown-type' WHEN e.directory IS NULL THEN 'no-data' WHEN e.record IS NULL THEN 'write' WHEN e.record = l.record THEN 'already-migrated' ELSE 'differs' END AS status FROM l LEFT JOIN e ON e.directory = l.directory""")
def record_plan(t):
    legacy = t("part").select(F.col("p_partkey").alias("directory"), F.col("p_type").alias("type"), F.col("p_brand").alias("record"))
    same = t("customer").join(t("part"), F.col("p_partkey") == F.col("c_custkey"), "left")
    record = F.when(F.col("c_nationkey") >= 16, F.col("c_mktsegment")).when(F.col("c_nationkey") >= 8, F.col("p_brand"))
    return R.record_plan(legacy, same.select(F.col("c_custkey").alias("directory"), record.alias("record")), ["ECONOMY", "STANDARD", "PROMO"])


@query("SELECT conv_id AS example_index, text AS hypothesis, url AS example FROM conversations JOIN pages ON page_id = conv_id")
def prediction_paths(t):
    predictions = t("conversations").select(F.col("conv_id").alias("example_index"), F.col("text").alias("hypothesis"))
    return R.with_features(predictions, t("pages").select(F.col("page_id").alias("example_index"), F.col("url").alias("audio_path")))
