"""Split assignment over orders (examples) and customer (metadata), and over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling, splits
from ..operators.selectors import matches, normalize_selector
from .common import Catalogue

_C = Catalogue()
query, QUERIES, ORACLES = _C.query, _C.queries, _C.oracles

ATTRIBUTES = ["c_mktsegment", "c_nationkey"]
EX = "ex AS (SELECT o_orderkey AS example_index, o_custkey AS key, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS size, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)"


def examples(t) -> DataFrame:
    """Orders with the attributes of their customer; a size in cents."""
    orders = t("orders").select(F.col("o_orderkey").alias("example_index"), F.col("o_custkey").alias("key"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("size"))
    return orders.join(t("customer").select(F.col("c_custkey").alias("key"), *ATTRIBUTES), "key")


def _key_names(t) -> DataFrame:
    return t("documents").select("doc_id", F.concat(F.lit("/corpus/"), "source", F.lit("/"), "source", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".wav")).alias("path"))


_NAMES = "n AS (SELECT doc_id, '/corpus/' || source || '/' || source || '_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.wav' AS path FROM documents)"


@query(f"WITH {_NAMES} SELECT doc_id, regexp_extract(path, '[^/]+$') AS name, regexp_replace(regexp_extract(path, '[^/]+$'), '\\.[^.]+$', '') AS stem, nullif(regexp_extract(regexp_extract(path, '[^/]+$'), '^(.+)_\\d+\\.wav$', 1), '') AS key FROM n")
def key_extract(t):
    return _key_names(t).select("doc_id", T.basename(F.col("path")).alias("name"), T.stem(F.col("path")).alias("stem"), T.extract_key(F.col("path"), r"^(.+)_\d+\.wav$").alias("key"))


@query("SELECT d.doc_id, quality, toxic, l.doc_id IS NOT NULL AS matched FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_lookup(t):
    return splits.looked_up(t("documents").select("doc_id"), t("labels"), "doc_id").select("doc_id", "quality", "toxic", "matched")


@query("SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def unmatched_examples(t):
    return splits.unmatched(t("documents").select("doc_id", "source"), t("labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT md5(text) AS text_key, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_keys(t):
    return splits.duplicate_keys(t("documents").select(F.md5(F.col("text").cast("binary")).alias("text_key")), "text_key")


def _selected(t, selector) -> DataFrame:
    df = examples(t)
    return df.where(matches(normalize_selector(selector), df.columns)).select("example_index", "key", "c_mktsegment", "c_nationkey")


_SEL = f"WITH {EX} SELECT example_index, key, c_mktsegment, c_nationkey FROM ex WHERE "


@query(_SEL + "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)")
def selector_and_or(t):
    return _selected(t, {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3]})


@query(_SEL + "c_mktsegment = 'BUILDING' OR c_nationkey = 7")
def selector_list_or(t):
    return _selected(t, [{"c_mktsegment": "BUILDING"}, {"c_nationkey": [7]}])


@query(_SEL + "false")
def selector_empty(t):
    return _selected(t, [])


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ';') AS priorities FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) > 0")
def selector_multi_valued(t):
    cells = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))
    df = t("customer").select("c_custkey").join(cells, F.col("c_custkey") == F.col("o_custkey"))
    return df.where(matches(normalize_selector({"priorities": ["1-URGENT", "5-LOW"]}), df.columns, ["priorities"])).select("c_custkey", F.array_join("priorities", ";").alias("priorities"))


@query(f"WITH {EX} SELECT c_mktsegment, count(*) AS kept, (SELECT count(*) FROM ex WHERE c_nationkey IN (3, 4)) AS excluded FROM ex WHERE c_nationkey NOT IN (3, 4) GROUP BY c_mktsegment")
def exclude_filter(t):
    df = examples(t)
    out = matches(normalize_selector({"c_nationkey": [3, 4]}), df.columns)
    excluded = df.agg(F.count_if(out).alias("excluded"))
    return df.where(~out).groupBy("c_mktsegment").agg(F.count("*").alias("kept")).join(F.broadcast(excluded))


@query(f"WITH {EX} SELECT example_index, CASE WHEN c_mktsegment = 'BUILDING' THEN 'test' WHEN c_nationkey IN (1, 2) THEN 'dev' ELSE 'train' END AS split FROM ex WHERE c_nationkey <> 5")
def precedence_assign(t):
    return splits.assign(examples(t), splits.SplitSpec(exclude={"c_nationkey": 5}, test={"c_mktsegment": "BUILDING"}, dev={"c_nationkey": [1, 2]}))


def _sampled(size: str, target: str, where: str = "true", group: str = "CAST(key AS VARCHAR)") -> str:
    return f"""WITH {EX}, g AS (SELECT {group} AS grp, CAST(sum({size}) AS BIGINT) AS s FROM ex WHERE {where} GROUP BY 1),
p AS (SELECT grp, s, coalesce(sum(s) OVER (ORDER BY md5('1:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT grp, s AS group_size FROM p WHERE before < ({target})"""


def _sample(df: DataFrame, size: float, unit, amount: bool = False) -> DataFrame:
    rows = df.select(F.col("key").cast("string").alias("grp"), unit.cast("long").alias("unit"))
    drawn = sampling.sample_groups(rows, "grp", size, 1, amount=amount)
    return rows.join(drawn, "grp", "left_semi").groupBy("grp").agg(F.sum("unit").alias("group_size"))


@query(_sampled("1", "SELECT CAST(ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) FROM ex"))
def group_sample_examples(t):
    return _sample(examples(t), 0.2, F.lit(1))


@query(_sampled("size", "100000000"))
def group_sample_hours(t):
    return _sample(examples(t), 100_000_000, F.col("size"), True)


@query(_sampled("size", "SELECT sum(size) // 1000 * 217 FROM ex"))
def group_sample_hours_many(t):
    """About a fifth of all groups: the order and the overshoot of many."""
    df = examples(t)
    return _sample(df, df.agg(F.expr("sum(size) div 1000 * 217")).first()[0], F.col("size"), True)


@query(_sampled("CASE WHEN size <= 30000000 THEN size ELSE 0 END", "SELECT sum(size) // 1000 * 304 FROM ex"))
def group_sample_usable_many(t):
    df = examples(t)
    return _sample(df, df.agg(F.expr("sum(size) div 1000 * 304")).first()[0], F.when(F.col("size") <= 30_000_000, F.col("size")).otherwise(0), True)


@query(_sampled("CASE WHEN size <= 30000000 THEN size ELSE 0 END", "50000000.5"))
def group_sample_usable_only(t):
    return _sample(examples(t), 50_000_000.5, F.when(F.col("size") <= 30_000_000, F.col("size")).otherwise(0), True)


@query(_sampled("CASE WHEN size <= 30000000 THEN 1 ELSE 0 END", "0.5"))
def group_sample_amount_under_one(t):
    """An amount under one unit is no fraction: groups up to the first that weighs anything."""
    return _sample(examples(t), 0.5, F.when(F.col("size") <= 30_000_000, 1).otherwise(0), True)


def _filled(size: str, budget: str, where: str = "true") -> str:
    return f"""WITH {EX}, g AS (SELECT *, CAST(key AS VARCHAR) AS grp, {size} AS u FROM ex WHERE {where}),
p AS (SELECT example_index, u, coalesce(sum(u) OVER (ORDER BY md5('1:' || grp), grp, example_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT example_index, CAST(u AS BIGINT) AS unit FROM p WHERE before < ({budget})"""


def _fill(df: DataFrame, unit, budget: DataFrame) -> DataFrame:
    rows = df.select("example_index", F.col("key").cast("string").alias("grp"), unit.cast("long").alias("unit"))
    return sampling.fill_to_budget(rows, "grp", "example_index", budget, 1).select("example_index", "unit")


@query(_filled("size", "50000000"))
def budget_fill_numeric(t):
    df = examples(t)
    return _fill(df, F.col("size"), df.sparkSession.range(1).select(F.lit(50_000_000).cast("long").alias("budget")))


@query(_filled("size", "SELECT sum(size) // 1000 * 283 FROM ex"))
def budget_fill_many(t):
    """Rows of many groups, the last one partial."""
    df = examples(t)
    return _fill(df, F.col("size"), df.agg(F.expr("sum(size) div 1000 * 283").alias("budget")))


@query(_filled("1", "1000"))
def budget_fill_examples(t):
    df = examples(t)
    return _fill(df, F.lit(1), df.sparkSession.range(1).select(F.lit(1000).cast("long").alias("budget")))


@query(_filled("size", "SELECT sum(size) FROM ex WHERE c_mktsegment = 'BUILDING'", "c_mktsegment <> 'BUILDING'"))
def budget_fill_matched(t):
    df = examples(t)
    budget = df.where("c_mktsegment = 'BUILDING'").agg(F.sum("size").alias("budget"))
    return _fill(df.where("c_mktsegment <> 'BUILDING'"), F.col("size"), budget)


# Rules the SQL states by itself: whole groups in order while what was taken is under the target; test and dev groups and the
# order of the pool by dev_group_by; over-long rows weigh nothing in the budget, which is the pool's own size less the kept remainder's.
SPEC = splits.SplitSpec(test={"c_mktsegment": "BUILDING"}, test_size=0.5, dev_size=0.1, dev_group_by="c_nationkey", test_remainder="train", train_budget="matched", units_per_hour=360_000, max_size=45_000_000)
ASSIGNED = f"""{EX}, u AS (SELECT *, CAST(c_nationkey AS VARCHAR) AS grp, CASE WHEN size <= 45000000 THEN size ELSE 0 END AS unit FROM ex),
sel AS (SELECT * FROM u WHERE c_mktsegment = 'BUILDING'), rest AS (SELECT * FROM u WHERE c_mktsegment <> 'BUILDING'),
tg AS (SELECT grp, coalesce(sum(n) OVER (ORDER BY md5('1:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT grp, count(*) AS n FROM sel GROUP BY grp)),
td AS (SELECT grp FROM tg WHERE before < (SELECT CAST(round_even(count(*) * CAST(0.5 AS DOUBLE), 0) AS BIGINT) FROM sel)),
dg AS (SELECT grp, coalesce(sum(n) OVER (ORDER BY md5('1:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT grp, count(*) AS n FROM rest GROUP BY grp)),
dd AS (SELECT grp FROM dg WHERE before < (SELECT CAST(round_even(count(*) * CAST(0.1 AS DOUBLE), 0) AS BIGINT) FROM rest)),
pool AS (SELECT * FROM rest WHERE grp NOT IN (SELECT grp FROM dd)), kept AS (SELECT * FROM sel WHERE grp NOT IN (SELECT grp FROM td)),
pf AS (SELECT example_index, coalesce(sum(unit) OVER (ORDER BY md5('1:' || grp), grp, example_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pool),
asg AS (SELECT example_index, 'test' AS split FROM sel WHERE grp IN (SELECT grp FROM td) UNION ALL SELECT example_index, 'dev' FROM rest WHERE grp IN (SELECT grp FROM dd)
  UNION ALL SELECT example_index, 'train' FROM pf WHERE before < (SELECT sum(unit) FROM pool) - (SELECT coalesce(sum(unit), 0) FROM kept) UNION ALL SELECT example_index, 'train' FROM kept)"""
_REPORT = "count(*) AS examples, CAST(sum(size) AS BIGINT) AS total_size, count(*) FILTER (size <= 45000000) AS usable_examples, CAST(sum(CASE WHEN size <= 45000000 THEN size ELSE 0 END) AS BIGINT) AS usable_size"


@query(f"WITH {ASSIGNED} SELECT example_index, split FROM asg")
def split_assign_full(t):
    return splits.assign(examples(t), SPEC)


@query(f"WITH {ASSIGNED} SELECT split, {_REPORT} FROM asg JOIN ex USING (example_index) GROUP BY split")
def split_report(t):
    df = examples(t)
    return splits.report(df, splits.assign(df, SPEC), [], SPEC.max_size)


@query(f"WITH {ASSIGNED} SELECT split, c_mktsegment, {_REPORT} FROM asg JOIN ex USING (example_index) GROUP BY split, c_mktsegment")
def split_report_by(t):
    df = examples(t)
    return splits.report(df, splits.assign(df, SPEC), ["c_mktsegment"], SPEC.max_size)


@query(f"""WITH {ASSIGNED} SELECT s AS split, count(example_index) AS examples, round(coalesce(sum(size), 0) / 360000.0, 3) AS hours, count(example_index) FILTER (size <= 45000000) AS usable_examples,
round(coalesce(sum(size) FILTER (size <= 45000000), 0) / 360000.0, 3) AS usable_hours FROM (VALUES ('train'), ('dev'), ('test')) v(s) LEFT JOIN (SELECT * FROM asg JOIN ex USING (example_index)) a ON a.split = s GROUP BY s""")
def split_counts_hours(t):
    df = examples(t)
    return splits.split_sizes(df, splits.assign(df, SPEC), SPEC.units_per_hour, SPEC.max_size)


_HOURS = f"""{EX}, u AS (SELECT *, CAST(key AS VARCHAR) AS grp, c_mktsegment = 'BUILDING' AS sel FROM ex),
g AS (SELECT grp, coalesce(sum(s) OVER (ORDER BY md5('3:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT grp, sum(CASE WHEN size <= 20000000 THEN size ELSE 0 END) AS s FROM u WHERE sel GROUP BY grp)),
f AS (SELECT example_index, coalesce(sum(CASE WHEN size <= 20000000 THEN 1 ELSE 0 END) OVER (ORDER BY md5('3:' || grp), grp, example_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u WHERE NOT sel AND c_nationkey <> 4)"""


@query(f"WITH {_HOURS} SELECT example_index, 'test' AS split FROM u JOIN g USING (grp) WHERE sel AND before < 0.75 * 36000000 UNION ALL SELECT example_index, 'dev' FROM u WHERE NOT sel AND c_nationkey = 4 UNION ALL SELECT example_index, 'train' FROM f WHERE before < 1000")
def split_assign_hours(t):
    """A test split of less than an hour, whole keys, and a train budget in examples, where over-long rows weigh nothing."""
    spec = splits.SplitSpec(test={"c_mktsegment": "BUILDING"}, test_size=0.75, test_size_unit="hours", dev={"c_nationkey": 4}, train_budget=1000, train_budget_unit="examples", units_per_hour=36_000_000, max_size=20_000_000, seed=3)
    return splits.assign(examples(t), spec)


_UNKNOWN = f"""{EX}, u AS (SELECT example_index, CAST(key AS VARCHAR) AS grp, c_mktsegment = 'MACHINERY' AS sel, CASE WHEN o_orderpriority <> '5-LOW' THEN size END AS size FROM ex JOIN orders ON o_orderkey = example_index),
f AS (SELECT example_index, coalesce(sum(CASE WHEN size > 20000000 THEN 0 ELSE 1 END) OVER (ORDER BY md5('5:' || grp), grp, example_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u WHERE NOT sel)"""


@query(f"WITH {_UNKNOWN} SELECT example_index, 'test' AS split FROM u WHERE sel UNION ALL SELECT example_index, 'train' FROM f WHERE before < 5000")
def split_assign_unknown_sizes(t):
    """A budget in examples, where those of unknown size weigh one like the usable ones."""
    spec = splits.SplitSpec(test={"c_mktsegment": "MACHINERY"}, dev=[], train_budget=5000, train_budget_unit="examples", max_size=20_000_000, seed=5)
    unknown = t("orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("example_index"), F.lit(True).alias("unknown"))
    df = examples(t).join(unknown, "example_index", "left")
    return splits.assign(df.withColumn("size", F.when(F.col("unknown").isNull(), F.col("size"))), spec)


@query(f"WITH {EX}, h AS (SELECT o_orderkey AS example_index, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'PRIO-' || CAST(o_custkey AS VARCHAR) END AS source FROM orders) SELECT h.example_index, regexp_extract(source, '^PRIO-([0-9]+)$', 1) AS key, c_mktsegment FROM h JOIN ex USING (example_index) WHERE source IS NOT NULL")
def attributes_of_matched(t):
    """Keys from a column, and attributes by key; rows without a key are dropped."""
    spec = splits.SplitSpec(key_column="c_custkey", key_from="source", key_pattern="^PRIO-([0-9]+)$", unmatched="drop")
    source = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.concat(F.lit("PRIO-"), F.col("o_custkey").cast("string")))
    rows = splits.keyed(t("orders").select(F.col("o_orderkey").alias("example_index"), source.alias("source")), "source", spec)
    metadata = t("customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_mktsegment")
    return splits.attributed(rows, metadata, spec).select("example_index", "key", "c_mktsegment")


@query("""WITH s AS (SELECT doc_id AS example_index, CASE WHEN lang = 'de' THEN 'test' ELSE 'train' END AS source_split FROM documents),
p AS (SELECT example_index, row_number() OVER (ORDER BY md5('7:' || example_index), CAST(example_index AS VARCHAR)) - 1 AS before FROM s WHERE source_split = 'train')
SELECT s.example_index, CASE WHEN before < (SELECT CAST(ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) FROM p) THEN 'dev' ELSE source_split END AS split FROM s LEFT JOIN p USING (example_index)""")
def default_dev_split(t):
    rows = t("documents").select(F.col("doc_id").alias("example_index"), F.when(F.col("lang") == "de", "test").otherwise("train").alias("source_split"))
    return splits.default_assignment(rows, 0.2, 7)


@query(f"WITH {ASSIGNED} SELECT 'overlap' AS kind, count(*) AS n FROM (SELECT example_index FROM asg GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unused', count(*) FROM ex WHERE example_index NOT IN (SELECT example_index FROM asg)")
def split_invariants(t):
    df = examples(t)
    a = splits.assign(df, SPEC)
    overlap = splits.duplicate_keys(a, "example_index").agg(F.lit("overlap").alias("kind"), F.count("*").alias("n"))
    return overlap.unionByName(df.join(a, "example_index", "left_anti").agg(F.lit("unused").alias("kind"), F.count("*").alias("n")))
