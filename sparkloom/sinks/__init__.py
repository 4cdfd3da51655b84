"""Sinks: feature cache, split records, predictions, vocabularies, corpora, reports, sidecars, plans; and the cache's records.

Tables are written by executors as folders of part files; Spark's committer makes a folder visible as a
whole and marks it by _SUCCESS. Records are small files that the driver writes last, so a folder with its
record is complete. Records are JSON, which YAML readers read too.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..functions.text import slug_of
from ..operators.selectors import matches, normalize_selector
from ..operators.splits import ORDER, SplitSpec
from ..scratch import cleaned_up, dropped, written

RECORD = "config.yaml"


# records


def digest(record: Mapping) -> str:
    """Eight hexadecimal digits of a record, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(record, sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()[:8]


def content_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, computed by an executor."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def public_settings(settings: Mapping) -> dict:
    """Settings without private ones, whose names begin with an underscore, sorted."""
    return {k: v for k, v in sorted(settings.items()) if not k.startswith("_")}


def differences(cached: Mapping, current: Mapping, path: str = "") -> list[str]:
    """What differs between two records, by dotted paths."""
    out = []
    for key in sorted(set(cached) | set(current)):
        name = f"{path}{key}"
        if key not in current:
            out.append(f"{name}: only in the cached record ({cached[key]!r})")
        elif key not in cached:
            out.append(f"{name}: only in the current record ({current[key]!r})")
        elif isinstance(cached[key], Mapping) and isinstance(current[key], Mapping):
            out += differences(cached[key], current[key], f"{name}.")
        elif cached[key] != current[key]:
            out.append(f"{name}: cached {cached[key]!r}, current {current[key]!r}")
    return out


def write_record(spark: SparkSession, folder: str, record: Mapping, name: str = RECORD) -> None:
    files.write_text(spark, f"{folder}/{name}", json.dumps(record, indent=2, ensure_ascii=False, default=list) + "\n")


def _plain(record: Mapping) -> dict:
    return json.loads(json.dumps(record, default=list))


def record_matches(spark: SparkSession, folder: str, record: Mapping, error: bool = True) -> bool:
    """True if the folder's record is equal or absent; a different one raises with the differences, or gives False."""
    path = f"{folder}/{RECORD}"
    if not files.exists(spark, path):
        return True
    found = differences(json.loads(files.read_text(spark, path)), _plain(record))
    if found and error:
        raise ValueError(f"CONFIG MISMATCH in {folder}: " + "; ".join(found))
    return not found


# names of what is cached


def source_record(source: Mapping, seed: int) -> dict:
    """What identifies a source: paired files have no column names, others do; children of a concat are records too."""
    kind = source["type"]
    out = {k: v for k, v in source.items() if k not in ("cache_dir",) and not (kind == "paired" and k.endswith("_column"))}
    if kind == "concat":
        out["sources"] = [source_record(child, seed) for child in source["sources"]]
    return out | {"seed": seed}


def feature_record(source: Mapping, extractor: Mapping, input_column: str, sampling_rate: int, seed: int) -> dict:
    """What identifies extracted features; neither labels, splits, filters nor normalisation are part of it."""
    return {"source": source_record(source, seed), "feature_extractor": public_settings(extractor), "input_column": input_column, "sampling_rate": sampling_rate}


def feature_folder(record: Mapping) -> str:
    """features_<extractor>_<digest>; the splits of the source, known once it is read, do not count."""
    keyed = {k: v for k, v in record.items() if k != "source_splits"}
    return f"features_{slug_of(record['feature_extractor'].get('feature_extractor_type', 'features'))}_{digest(keyed)}"


def vocabulary_id(name: str, settings: Mapping, split_id: str | None = None) -> str:
    """A vocabulary's folder: its name, the settings it depends on, and the split its texts come from; no model is part of it."""
    return f"{slug_of(name)}-{digest({'settings': public_settings(settings), 'split': split_id})}"


def embedding_id(vocabulary: str, model: str) -> str:
    """Embeddings depend on the vocabulary and on the model they are made for."""
    return f"{vocabulary}-{slug_of(model)}"


def output_folder(root: str, model: str, experiment: str | None, split_id: str | None = None) -> str:
    return "/".join(x for x in (root.rstrip("/"), slug_of(model), split_id, experiment) if x)


# caches


def save_features(features: DataFrame, root: str, record: Mapping) -> str:
    """Writes all rows by source split and the record last; returns the folder. An existing folder raises."""
    spark, folder = features.sparkSession, f"{root}/{feature_folder(record)}"
    splits = sorted(r[0] for r in features.select("source_split").distinct().collect())  # names of splits
    features.write.mode("errorifexists").partitionBy("source_split").parquet(f"{folder}/data")
    write_record(spark, folder, dict(record) | {"source_splits": splits})
    return folder


def load_features(spark: SparkSession, folder: str, source_splits: Sequence[str] | None = None) -> DataFrame:
    """The rows of the splits, in the columns that all of them have, with the rank of the split in source_rank."""
    splits = list(source_splits or json.loads(files.read_text(spark, f"{folder}/{RECORD}"))["source_splits"])
    parts = [spark.read.parquet(f"{folder}/data/source_split={s}").withColumn("source_split", F.lit(s)).withColumn("source_rank", F.lit(i)) for i, s in enumerate(splits)]
    shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    return reduce(DataFrame.unionByName, [p.select(*shared) for p in parts])


def features_of(spark: SparkSession, root: str, record: Mapping, build: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The cached features of the record, built and saved if they are not there.

    A folder without its record was left by a run that died, and is discarded; one with another record raises.
    """
    folder = f"{root}/{feature_folder(record)}"
    if fresh or (files.exists(spark, folder) and not files.exists(spark, f"{folder}/{RECORD}")):
        files.delete(spark, folder)
    if files.exists(spark, folder):
        cached = json.loads(files.read_text(spark, f"{folder}/{RECORD}"))
        if found := differences({k: v for k, v in cached.items() if k != "source_splits"}, _plain(record)):
            raise ValueError(f"CONFIG MISMATCH in {folder}: " + "; ".join(found))
    else:
        save_features(build(), root, record)
    return load_features(spark, folder)


def source_of(spark: SparkSession, cache_dir: str, record: Mapping, build: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The source's rows under <cache_dir>/untokenized, read if its record matches, else built and saved."""
    folder = f"{cache_dir}/untokenized"
    if fresh or not files.exists(spark, f"{folder}/{RECORD}"):
        files.delete(spark, folder)
        build().write.parquet(f"{folder}/data")
        write_record(spark, folder, record)
    record_matches(spark, folder, record)
    return spark.read.parquet(f"{folder}/data")


def invalidate(spark: SparkSession, root: str, names: Sequence[str]) -> list[str]:
    """Deletes the named folders of the cache under root, and those only; returns the ones that were there."""
    if bad := [n for n in names if not n or n.startswith("/") or ".." in n.split("/")]:
        raise ValueError(f"outside the cache: {', '.join(bad)}")
    return [n for n in names if files.exists(spark, f"{root}/{n}") and files.delete(spark, f"{root}/{n}")]


# tables and reports


def save_split(examples: DataFrame, assignment: DataFrame, spec: SplitSpec, folder: str, source: str = "key", metadata_digest: str = "", unmatched: int = 0) -> dict:
    """Writes assignment.csv (example, split), ordered by train, dev, test and example_index, and split.yaml.

    assignment.csv is a folder of parts in order. The record has the id, counts and hours of each split, and how many examples are
    in none: excluded, of no metadata (unmatched, which the caller knows), or unused. All numbers but the last are observed while the
    joined rows are written once for the sort, so the examples are read in one job. Returns the record.
    """
    spark = examples.sparkSession
    excluded = matches(normalize_selector(spec.exclude), examples.columns, spec.multi_valued, dict(examples.dtypes)) if spec.exclude else F.lit(False)
    usable = F.lit(True) if spec.max_size is None else F.coalesce(F.col("size") <= spec.max_size, F.lit(True))
    rows = examples.select("example_index", F.col(source).alias("example"), "size", F.coalesce(excluded, F.lit(False)).alias("excluded"), usable.alias("usable"))
    seen = Observation()
    of = lambda name: F.col("split") == name
    counted = [F.count_if(of(s)).alias(s) for s in ORDER] + [F.coalesce(F.sum(F.when(of(s), F.col("size"))), F.lit(0)).alias(f"{s}_size") for s in ORDER]
    counted += [F.count_if(F.col("split").isNull() & F.col("excluded")).alias("excluded"), F.count_if(F.col("split").isNull() & ~F.col("excluded")).alias("unused"), F.count_if(F.col("split").isNotNull() & ~F.col("usable")).alias("too_long")]
    joined = written(rows.join(assignment, "example_index", "left").observe(seen, *counted), "assigned")
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("split"))
    joined.where("split is not null").orderBy(rank, "example_index").select("example", "split").write.mode("overwrite").csv(f"{folder}/assignment.csv", header=True)
    dropped(joined)
    sums = seen.get
    found = [s for s in ORDER if sums[s]]
    record = spec.record() | {
        "metadata_sha256": metadata_digest,
        "split_id": spec.split_id(metadata_digest),
        "counts": {s: sums[s] for s in found},
        "hours": {s: round(sums[f"{s}_size"] / spec.units_per_hour, 3) for s in found},
        "left_out": {"excluded": sums["excluded"], "unmatched": unmatched, "unused": sums["unused"], "too_long": sums["too_long"]},
    }
    write_record(spark, folder, record, "split.yaml")
    return record


def save_json_lines(df: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """A JSON object a row, in parts in order; letters beyond ASCII stay as they are and null fields are written.

    Rows are written once before they are sorted: a sort looks at all rows twice, and would compute them twice.
    """
    kept = written(df, "rows")
    kept.orderBy(*order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    dropped(kept)


def save_predictions(scored: DataFrame, path: str) -> None:
    """example, example_index, reference, hypothesis and the error counts of each row, in the order of example_index."""
    first = ["example", "example_index", "reference", "hypothesis"]
    save_json_lines(scored.select(*first, *[c for c in scored.columns if c not in first]), path, ["example_index"])


def save_decoded(decoded: DataFrame, path: str) -> None:
    """file (relative path) and transcription, sorted by file."""
    save_json_lines(decoded.select("file", "transcription"), path, ["file"])


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """One JSON object from token to id, in the order of ids; a vocabulary has at most a row a character."""
    rows = vocab.orderBy("id").collect()
    files.write_text(vocab.sparkSession, path, json.dumps({r["token"]: r["id"] for r in rows}, ensure_ascii=False, indent=2))


def save_report(report: DataFrame, path: str, keys: Sequence[str]) -> list[dict]:
    """The rows of a small report as a JSON list sorted by keys."""
    rows = [r.asDict() for r in report.orderBy(*keys).collect()]
    files.write_text(report.sparkSession, path, json.dumps(rows, ensure_ascii=False, indent=2))
    return rows


def save_corpus(texts: DataFrame, folder: str, index: str, text: str = "text") -> bool:
    """corpus.jsonl ({"text": ...}) and corpus.txt, line by line the same, in the order of index.

    Blank texts are left out and white space is flattened before by the caller. False, and nothing is
    written, if both are there; an empty corpus raises.
    """
    spark = texts.sparkSession
    if all(files.exists(spark, f"{folder}/corpus.{x}/_SUCCESS") for x in ("jsonl", "txt")):
        return False
    kept = written(texts.select(F.col(index).alias("index"), F.col(text).alias("text")), "corpus")  # computed once, not for each sort and its sample
    if kept.isEmpty():
        dropped(kept)
        raise ValueError("the corpus is empty")
    ordered = kept.orderBy("index").select("text")
    with cleaned_up(spark):
        ordered.write.mode("overwrite").json(f"{folder}/corpus.jsonl")
        ordered.write.mode("overwrite").text(f"{folder}/corpus.txt")
    dropped(kept)
    return True


def save_embeddings(inputs: DataFrame, outputs: DataFrame | None, folder: str, meta: Mapping) -> None:
    """The input matrix (id, vector), the output matrix if it is not tied to it, and meta.yaml last."""
    spark = inputs.sparkSession
    inputs.write.mode("overwrite").parquet(f"{folder}/input")
    if outputs is not None:
        outputs.write.mode("overwrite").parquet(f"{folder}/output")
    write_record(spark, folder, dict(meta) | {"tied": outputs is None}, "meta.yaml")


def apply_plan(plan: DataFrame, apply: bool = False, action: str = "rename") -> list[tuple[str, str]]:
    """The (name, target) pairs of a plan that its action names; renamed or copied only if apply is set.

    Plans list folders of a cache or of runs, so they are small; targets that exist are skipped.
    """
    spark, rows = plan.sparkSession, [(r["name"], r["target"]) for r in plan.where(F.col("action") == action).orderBy("name").collect()]
    if not apply:
        return rows
    if action == "copy":
        todo = [(a, b) for a, b in rows if not files.exists(spark, b)]
        for a, b in todo:
            files.copy(spark, a, b)
        return todo
    return [(a, b) for a, b in rows if files.rename(spark, a, b)]
