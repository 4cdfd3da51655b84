"""Corpus sources behind a registry, and readers of metadata, audio headers, records, vocabularies and run files."""

from __future__ import annotations

import struct
from collections.abc import Callable, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..files import exists, folders, read_text
from ..functions.text import relative_path, split_values, strip
from ..operators.labels import drop_reason
from ..scratch import written
from .configs import parse

Source = Callable[[SparkSession, Mapping], DataFrame]
_REGISTRY: dict[str, Source] = {}
SPLITS = ("train", "dev", "test")


def register_source(kind: str) -> Callable[[Source], Source]:
    def add(f: Source) -> Source:
        _REGISTRY[kind] = f
        return f

    return add


def known_sources() -> list[str]:
    return sorted(_REGISTRY)


def load_source(spark: SparkSession, config: Mapping) -> DataFrame:
    """The corpus that config names; ValueError for a missing or unknown type."""
    kind = config.get("type")
    if kind not in _REGISTRY:
        raise ValueError(f"source type {kind!r} is not one of {', '.join(known_sources())}")
    return _REGISTRY[kind](spark, config)


def standardize(df: DataFrame, audio_column: str | None, text_column: str | None) -> DataFrame:
    """Renames the columns to audio and transcription; absent ones are left, so it can run twice."""
    for old, new in ((audio_column, "audio"), (text_column, "transcription")):
        if old and old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def indexed(df: DataFrame, order: list[str], name: str = "example_index") -> DataFrame:
    """Adds the row's place in the order, from 0 without holes or repeats.

    Rows are range-partitioned, sorted and written to the scratch folder once, each with its partition and its place there;
    sizes of partitions and numbers come from that one table, so that both see the same partitions, whatever other
    columns there are. No task sees all rows. Nulls come first; rows that are equal in order are numbered in any order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(placed.withColumn("_loom_place", F.monotonically_increasing_id()), "indexed")
    rows = kept.withColumn("_loom_part", F.shiftrightunsigned("_loom_place", 33))
    sizes = rows.groupBy("_loom_part").agg(F.count("*").alias("_loom_n"))
    before = F.coalesce(F.sum("_loom_n").over(Window.orderBy("_loom_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_loom_part", before.alias("_loom_before"))  # a row a partition
    place = F.col("_loom_place").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.join(F.broadcast(starts), "_loom_part").withColumn(name, (place + F.col("_loom_before")).cast("long")).drop("_loom_part", "_loom_place", "_loom_before")
    out._loom_path = kept._loom_path  # dropped(out) deletes the table
    return out


def in_file_order(df: DataFrame, name: str = "example_index") -> DataFrame:
    """Adds the place of a row that was just read from text files: by file, then by line, from 0 without holes or repeats.

    Rows are written to the scratch folder once, where they lie; a row's place is that of its block of a file, which only the number
    of blocks has to be sorted for, and the row's place in the block.
    """
    kept = written(df.select("*", F.input_file_name().alias("_loom_file"), F.input_file_block_start().alias("_loom_block"), F.monotonically_increasing_id().alias("_loom_place")), "lines")
    blocks = kept.groupBy("_loom_file", "_loom_block").agg(F.count("*").alias("_loom_n"), F.min("_loom_place").alias("_loom_first"))
    before = F.coalesce(F.sum("_loom_n").over(Window.orderBy("_loom_file", "_loom_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_loom_file", "_loom_block", (before - F.col("_loom_first")).alias("_loom_shift"))  # a row a block
    out = kept.join(F.broadcast(starts), ["_loom_file", "_loom_block"]).withColumn(name, (F.col("_loom_place") + F.col("_loom_shift")).cast("long"))
    out = out.drop("_loom_file", "_loom_block", "_loom_place", "_loom_shift")
    out._loom_path = kept._loom_path  # dropped(out) deletes the table
    return out


def concat(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, with the rank of their part in source_rank."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def common_columns(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, with the columns that all of them have."""
    shared = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    return reduce(DataFrame.unionByName, [p.select(*shared) for p in parts])


def _files(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)


def paired_split(spark: SparkSession, path: str, audio_ext: str = ".wav", text_ext: str = ".txt", recursive: bool = False) -> DataFrame:
    """(audio_path, transcription, missing): audio files and the text file of the same folder and stem.

    missing marks audio without a text. Errors if there is no audio or no pair. Spark does not list files of
    no bytes, so these count as absent.
    """
    key = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    audio = _files(spark, path, f"*{audio_ext}", recursive).select(F.col("path").alias("audio_path"), key(F.col("path")).alias("pair"))
    texts = _files(spark, path, f"*{text_ext}", recursive).select(key(F.col("path")).alias("pair"), strip(F.decode("content", "UTF-8")).alias("transcription"))
    both = audio.join(texts, "pair", "left").select("audio_path", "transcription", F.col("transcription").isNull().alias("missing"))
    seen = both.agg(F.count("*"), F.count_if(~F.col("missing"))).first()
    if not seen[0]:
        raise ValueError(f"no {audio_ext} files in {path}")
    if not seen[1]:
        raise ValueError(f"no audio in {path} has a {text_ext} file")
    return both


@register_source("paired")
def paired(spark: SparkSession, config: Mapping) -> DataFrame:
    """Audio and text files; folders train, dev and test become splits if there are any, else all is train."""
    path, options = config["path"], {k: config[k] for k in ("audio_ext", "text_ext", "recursive") if k in config}
    found = [s for s in SPLITS if s in folders(spark, path)]
    parts = [(s, f"{path}/{s}") for s in found] or [("train", path)]
    frames = [paired_split(spark, p, **options).where("not missing").drop("missing").withColumn("source_split", F.lit(s)) for s, p in parts]
    return reduce(DataFrame.unionByName, frames)


@register_source("audiofolder")
def audiofolder(spark: SparkSession, config: Mapping) -> DataFrame:
    """Files listed by file_name, their path below the folder, in metadata.csv, or metadata.jsonl if there is one."""
    root = config["path"].rstrip("/")
    if exists(spark, f"{root}/metadata.jsonl"):
        manifest = spark.read.json(f"{root}/metadata.jsonl")
    else:
        manifest = spark.read.csv(f"{root}/metadata.csv", header=True, multiLine=True, escape='"')
    files = _files(spark, root, config.get("pattern", "*"), True).select(F.col("path").alias("audio_path"))
    named = files.withColumn("file_name", relative_path(F.regexp_replace("audio_path", "^[a-z0-9]+:/*", "/"), without_scheme(root)))
    return standardize(manifest.join(named, "file_name"), config.get("audio_column"), config.get("text_column")).withColumn("source_split", F.lit(config.get("split", "train")))


def without_scheme(root: str) -> str:
    """A folder without its scheme, as paths are compared."""
    return "/" + root.split(":", 1)[-1].lstrip("/")


@register_source("export")
def export(spark: SparkSession, config: Mapping) -> DataFrame:
    """A Parquet export of a published or saved dataset; code that ships with a dataset is never run.

    Rows of one split only if the export has a column split and the config names one.
    """
    df = spark.read.parquet(config["path"])
    if "split" in df.columns and "split" in config:
        df = df.where(F.col("split") == config["split"])
    return standardize(df, config.get("audio_column"), config.get("text_column")).withColumn("source_split", F.lit(config.get("split", "train")))


@register_source("lines")
def lines(spark: SparkSession, config: Mapping) -> DataFrame:
    """Lines of text files, stripped; blank ones are dropped."""
    return spark.read.text(config["path"]).select(strip(F.col("value")).alias("transcription")).where("transcription <> ''").withColumn("source_split", F.lit(config.get("split", "train")))


@register_source("concat")
def concat_source(spark: SparkSession, config: Mapping) -> DataFrame:
    """The child sources' rows, split by split, in child order; a seed is passed down to children without one."""
    down = {k: config[k] for k in ("seed",) if k in config}
    return concat([load_source(spark, down | dict(child)) for child in config["sources"]])


def metadata_table(spark: SparkSession, path: str, key: str, multi_valued: tuple[str, ...] = (), separator: str = ";") -> DataFrame:
    """A CSV of attributes, all strings; multi-valued cells become arrays without empty parts.

    Errors if the key column is missing or a key repeats.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if key not in df.columns:
        raise ValueError(f"{path} has no column {key}")
    df = df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])
    repeated = [r[0] for r in df.groupBy(key).count().where("count > 1").limit(3).collect()]
    if repeated:
        raise ValueError(f"repeated keys in {path}: {', '.join(repeated)}")
    return df.select(*[split_values(F.col(c), separator).alias(c) if c in multi_valued else F.col(c) for c in df.columns])


def examples_csv(spark: SparkSession, path: str) -> DataFrame:
    """example STRING, duration DOUBLE in file order, numbered from 0 as example_index."""
    return in_file_order(spark.read.csv(path, header=True, schema="example string, duration double"))


def wav_frames(head: bytes | None) -> tuple[float, int, int] | None:
    """(seconds, rate, channels) that the header of a WAV file states; None for anything else."""
    if not head or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, rate, channels, width = 12, 0, 0, 0
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(head):
            channels, rate, _, width = struct.unpack_from("<HIIH", head, at + 10)
        elif name == b"data":
            return (size / (rate * width), rate, channels) if rate and width else None
        at += 8 + size + size % 2
    return None


def _headers(heads: pd.Series) -> pd.DataFrame:
    found = [wav_frames(None if h is None else bytes(h)) for h in heads]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["seconds", "rate", "channels"]).astype({"seconds": "float64", "rate": "Int64", "channels": "Int32"})


def wav_header(content: Column, head_bytes: int = 1 << 16) -> Column:
    """Struct of seconds, rate and channels from the first bytes of WAV files; nulls where they can't be read."""
    return F.pandas_udf(_headers, "seconds double, rate long, channels int")(F.substring(content, 1, head_bytes))


def audio_headers(spark: SparkSession, path: str, suffix: str = ".wav") -> DataFrame:
    """(example, duration, rate, channels) of the files directly in path, by their headers; sort by example.

    Only the first bytes of a file reach Python. duration is null where the header can't be read.
    """
    files = _files(spark, path, f"*{suffix}", False).select(F.col("path").alias("example"), wav_header(F.col("content")).alias("h"))
    return files.select("example", F.col("h.seconds").alias("duration"), "h.rate", "h.channels")


def audio_listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".wav", ".flac", ".mp3", ".ogg")) -> DataFrame:
    """(file, length, modified) of all audio files below path, as paths relative to it; sort by file."""
    pattern = "*{" + ",".join(suffixes) + "}"
    files = _files(spark, path, pattern, True)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    return files.select(relative_path(plain, without_scheme(path)).alias("file"), "length", F.col("modificationTime").alias("modified"))


def run_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated inventory of runs: run, directory, state_path, config_path."""
    return spark.read.csv(path, sep="\t", schema="run string, directory string, state_path string, config_path string")


def trainer_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, global_step, finished, entry, position) of trainer state files, a row a log entry; finished if the last entry has train_runtime.

    A file that is no JSON has global_step -1 and finished -1 and no entries.
    """
    return trainer_states_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def trainer_states_of(texts: DataFrame) -> DataFrame:
    """trainer_states() of (file, value), state files whose texts are rows."""
    schema = "global_step long, log_history array<map<string, string>>"
    files = texts.select("file", F.from_json("value", schema).alias("s"))
    last = F.coalesce(F.map_contains_key(F.try_element_at("s.log_history", F.lit(-1)), "train_runtime"), F.lit(False))
    broken = F.col("s.global_step").isNull() & F.col("s.log_history").isNull()
    rows = files.select("file", F.when(broken, -1).otherwise(F.coalesce("s.global_step", F.lit(0))).alias("global_step"), F.when(broken, -1).otherwise(last.cast("int")).alias("finished"), "s.log_history")
    return rows.select("file", "global_step", "finished", F.posexplode_outer("log_history").alias("position", "entry"))


def record_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(directory, record) of all files called name below path, however deep."""
    files = _files(spark, path, name, True)
    return files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory"), F.decode("content", "UTF-8").alias("record"))


def read_record(spark: SparkSession, path: str) -> dict | None:
    """A record written as JSON or YAML; None if the file is absent, {} if it is empty."""
    return (parse(read_text(spark, path)) or {}) if exists(spark, path) else None


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) of a vocabulary written as one JSON object."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,int>").alias("m"))
    return parsed.select(F.explode("m").alias("token", "id"))


def embedding_files(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The input and output matrices (id, vector) saved under path; the input serves as output if they were tied.

    None twice, to compute both anew, if either is missing.
    """
    meta = read_record(spark, f"{path}/meta.yaml")
    if not meta or not exists(spark, f"{path}/input/_SUCCESS"):
        return None, None
    inputs = spark.read.parquet(f"{path}/input")
    if meta["tied"]:
        return inputs, inputs
    return (inputs, spark.read.parquet(f"{path}/output")) if exists(spark, f"{path}/output/_SUCCESS") else (None, None)


def external_sets(spark: SparkSession, entries: list[Mapping], normalize: Callable[[Column], Column], encode: Callable[[Column], Column], taken: tuple[str, ...] = (), max_seconds: float | None = None, max_label_length: int | None = None) -> DataFrame:
    """Rows (eval_set, audio_path, transcription, duration, labels, label_length) of named paired sets.

    Texts are normalised as for training. Audio that is too long goes before the texts are encoded, labels that are
    too long after it. Other types than paired, repeated names and names already taken raise.
    """
    frames, seen = [], set(taken)
    for entry in entries:
        name, kind = entry["name"], entry.get("type", "paired")
        if name in seen:
            raise ValueError(f"the evaluation set {name!r} is there already")
        if kind != "paired":
            raise ValueError(f"the evaluation set {name!r} has type {kind!r}; only 'paired' is supported")
        seen.add(name)
        options = {"audio_ext": entry.get("audio_ext", ".wav"), "text_ext": entry.get("transcript_ext", ".txt"), "recursive": entry.get("recursive", False)}
        pairs = paired_split(spark, entry["path"], **options).where("not missing").drop("missing")
        heads = _files(spark, entry["path"], f"*{options['audio_ext']}", options["recursive"]).select(F.col("path").alias("audio_path"), wav_header(F.col("content"))["seconds"].alias("duration"))
        frames.append(pairs.join(heads, "audio_path").withColumn("eval_set", F.lit(name)))
    rows = reduce(DataFrame.unionByName, frames)
    if max_seconds is not None:
        rows = rows.where(F.coalesce(F.col("duration") <= max_seconds, F.lit(True)))
    encoded = rows.withColumn("transcription", normalize(F.col("transcription"))).withColumn("labels", encode(F.col("transcription")))
    lengths = encoded.withColumn("label_length", F.size("labels").cast("long"))
    kept = drop_reason(F.lit(0), F.col("label_length"), None, max_label_length).isNull()
    return lengths.where(kept).select("eval_set", "audio_path", "transcription", "duration", "labels", "label_length")
