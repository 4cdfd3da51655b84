"""Sources and sinks: what is written is read back."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from sparkloom import files, sinks, sources
from sparkloom.functions import text as T
from sparkloom.operators import labels as L
from sparkloom.operators import metrics as M
from sparkloom.operators import runs as R
from sparkloom.operators import splits


def wav(seconds, rate=8000, channels=1, extra=b""):
    size = int(seconds * rate) * 2 * channels
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVE" + extra + b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16) + b"data" + struct.pack("<I", size) + b"\0" * size


@pytest.fixture
def archive(tmp_path):
    for split, names in (("train", "ab"), ("dev", "c")):
        (tmp_path / split).mkdir()
        for n in names:
            (tmp_path / split / f"{n}.wav").write_bytes(wav(0.5 if n == "a" else 2))
            (tmp_path / split / f"{n}.txt").write_text(f" Line {n}! \n")
    (tmp_path / "train" / "lonely.wav").write_bytes(b"RIFFxx")
    return tmp_path


def test_paired(spark, archive):
    rows = sources.load_source(spark, {"type": "paired", "path": str(archive)}).collect()
    assert {(r.source_split, r.transcription) for r in rows} == {("train", "Line a!"), ("train", "Line b!"), ("dev", "Line c!")}
    flat = sources.load_source(spark, {"type": "paired", "path": str(archive / "train")})
    assert {r.source_split for r in flat.collect()} == {"train"}
    assert sources.paired_split(spark, str(archive / "train")).where("missing").count() == 1
    (archive / "none").mkdir()
    with pytest.raises(ValueError, match="no .wav"):
        sources.paired_split(spark, str(archive / "none"))
    (archive / "none" / "x.wav").write_bytes(b"x")
    with pytest.raises(ValueError, match=".txt file"):
        sources.paired_split(spark, str(archive / "none"))
    with pytest.raises(FileNotFoundError):
        sources.load_source(spark, {"type": "paired", "path": str(archive / "nowhere")})
    for bad in ({}, {"type": "nothing"}):
        with pytest.raises(ValueError, match="paired"):
            sources.load_source(spark, bad)


def test_concat_and_own_source(spark, archive):
    sources.register_source("numbers")(lambda s, c: s.range(c["n"]).select(F.col("id").cast("string").alias("transcription"), F.lit(str(c.get("seed"))).alias("source_split")))
    both = {"type": "concat", "seed": 4, "sources": [{"type": "numbers", "n": 2}, {"type": "concat", "sources": [{"type": "numbers", "n": 1, "seed": 9}]}]}
    rows = sources.load_source(spark, both).orderBy("source_rank").collect()
    assert [(r.transcription, r.source_split) for r in rows] == [("0", "4"), ("1", "4"), ("0", "9")]
    assert {"paired", "audiofolder", "export", "lines", "concat"} <= set(sources.known_sources())


def test_audiofolder_export_lines(spark, archive):
    for folder in ("one", "two"):
        (archive / folder).mkdir()
        (archive / folder / "same.wav").write_bytes(wav(1))
    (archive / "metadata.csv").write_text('file_name,words,who\none/same.wav,"first, and more",x\ntwo/same.wav,second,y\n')
    rows = sources.load_source(spark, {"type": "audiofolder", "path": str(archive), "text_column": "words"}).collect()
    assert {(r.transcription, r.audio_path.split("/")[-2]) for r in rows} == {("first, and more", "one"), ("second", "two")}
    (archive / "metadata.jsonl").write_text('{"file_name": "two/same.wav", "words": "line"}\n')
    assert [r.transcription for r in sources.load_source(spark, {"type": "audiofolder", "path": str(archive), "text_column": "words"}).collect()] == ["line"]
    spark.createDataFrame([("a", "x", "train"), ("b", "y", "test")], "sentence string, clip string, split string").write.parquet(f"{archive}/export")
    kept = sources.load_source(spark, {"type": "export", "path": f"{archive}/export", "split": "test", "text_column": "sentence", "audio_column": "clip"}).collect()
    assert [(r.transcription, r.audio, r.source_split) for r in kept] == [("b", "y", "test")]
    (archive / "lines.txt").write_text(" one \n\n  \ntwo\n")
    assert [r.transcription for r in sources.load_source(spark, {"type": "lines", "path": f"{archive}/lines.txt"}).collect()] == ["one", "two"]


def test_metadata_and_examples(spark, tmp_path):
    path = f"{tmp_path}/m.csv"
    (tmp_path / "m.csv").write_text('tape,singers,place\nt1,p;q;,"a, b"\nt2,,\n')
    rows = {r.tape: (r.singers, r.place) for r in sources.metadata_table(spark, path, "tape", ("singers",)).collect()}
    assert rows == {"t1": (["p", "q"], "a, b"), "t2": ([], "")}
    with pytest.raises(ValueError, match="no column reel"):
        sources.metadata_table(spark, path, "reel")
    (tmp_path / "m.csv").write_text("tape\nt1\nt1\n")
    with pytest.raises(ValueError, match="repeated"):
        sources.metadata_table(spark, path, "tape")
    (tmp_path / "e.csv").write_text("example,duration\n" + "".join(f"z{99 - i}.wav,{i}.5\n" for i in range(99)))
    got = sources.examples_csv(spark, f"{tmp_path}/e.csv").orderBy("example_index").collect()
    assert [(r.example_index, r.example, r.duration) for r in got] == [(i, f"z{99 - i}.wav", i + 0.5) for i in range(99)]


def test_indexed(spark):
    df = spark.range(5000).select(F.hash("id").alias("a"), "id").repartition(7)
    got = sources.indexed(df, ["a", "id"]).collect()
    assert [r.example_index for r in sorted(got, key=lambda r: (r.a, r.id))] == list(range(5000))


@pytest.mark.parametrize("order", [["a", "id"], ["id"]])
def test_indexed_with_payload(spark, tmp_path, order):
    """Every number once and in its place, on a table with other columns, which changes how Spark samples and coalesces."""
    df = spark.range(0, 1_000_000, 1, 13).select(F.hash("id").alias("a"), "id", F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.repeat(F.lit("x"), F.col("id").cast("int") % 50).alias("more"))
    sources.indexed(df.repartition(11, "payload"), order).write.parquet(f"{tmp_path}/t")
    got = spark.read.parquet(f"{tmp_path}/t")
    assert got.columns == ["a", "id", "payload", "more", "example_index"]
    assert got.agg(F.count("*"), F.countDistinct("example_index"), F.min("example_index"), F.max("example_index")).first()[:] == (1_000_000, 1_000_000, 0, 999_999)
    table = got.select("a", "id", "example_index").toPandas().sort_values(order)
    assert (table["example_index"].to_numpy() == range(1_000_000)).all()


def test_indexed_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), ("b", 4), (None, 5)], "k string, v int")
    got = sources.indexed(df, ["k"]).orderBy("example_index").collect()
    assert [r.k for r in got] == [None, None, "a", "b", "b"] and [r.example_index for r in got] == list(range(5)) and {r.v for r in got} == {1, 2, 3, 4, 5}
    assert sources.indexed(df.limit(0), ["k"]).collect() == []


def test_audio_headers_and_listing(spark, archive):
    (archive / "train" / "odd.wav").write_bytes(wav(1.25, 16000, 2, b"JUNK" + struct.pack("<I", 3) + b"abc\0"))
    rows = {r.example.split("/")[-1]: (r.duration, r.rate, r.channels) for r in sources.audio_headers(spark, f"{archive}/train").collect()}
    assert rows == {"a.wav": (0.5, 8000, 1), "b.wav": (2.0, 8000, 1), "lonely.wav": (None, None, None), "odd.wav": (1.25, 16000, 2)}
    (archive / "dev" / "x.flac").write_bytes(b"f")
    (archive / "top.ogg").write_bytes(b"oo")
    listed = sources.audio_listing(spark, str(archive)).orderBy("file").collect()
    assert [r.file for r in listed] == ["dev/c.wav", "dev/x.flac", "top.ogg", "train/a.wav", "train/b.wav", "train/lonely.wav", "train/odd.wav"]


def test_external_sets(spark, archive):
    vocab = L.vocabulary(spark.createDataFrame([("line abc",)], "text string"))
    entries = [{"name": "far", "path": f"{archive}/train"}, {"name": "near", "path": f"{archive}/dev", "type": "paired"}]
    load = lambda e, **o: sources.external_sets(spark, e, T.normalizer(), L.encoder(vocab), **o)
    rows = load(entries).collect()
    assert {(r.eval_set, r.transcription, r.duration, r.label_length) for r in rows} == {("far", "line a", 0.5, 6), ("far", "line b", 2.0, 6), ("near", "line c", 2.0, 6)}
    assert {r.transcription for r in load(entries, max_seconds=1.0).collect()} == {"line a"}
    assert load(entries, max_label_length=5).count() == 0
    for bad, match in (([entries[0], entries[0]], "there already"), ([{**entries[0], "type": "hub"}], "only 'paired'")):
        with pytest.raises(ValueError, match=match):
            load(bad)
    with pytest.raises(ValueError, match="there already"):
        load(entries, taken=("near",))


def test_run_files(spark, tmp_path):
    states = {"a": {"global_step": 30, "log_history": [{"step": 10, "loss": 0.5}, {"step": 30, "train_runtime": 9.0}]}, "b": {"global_step": 20, "log_history": [{"step": 20}]}, "c": {"log_history": []}}
    for name, state in states.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(state))
    (tmp_path / "d.json").write_text("{broken")
    rows = {r.file.split("/")[-1][0]: (r.global_step, r.finished) for r in sources.trainer_states(spark, str(tmp_path)).select("file", "global_step", "finished").distinct().collect()}
    assert rows == {"a": (30, 1), "b": (20, 0), "c": (0, 0), "d": (-1, -1)}
    assert sources.trainer_states(spark, str(tmp_path)).where("entry is not null").count() == 3
    (tmp_path / "runs.tsv").write_text("v1\t/x/v1\t/x/v1/s.json\t/x/v1/c.yaml\n")
    assert tuple(sources.run_inventory(spark, f"{tmp_path}/runs.tsv").first()) == ("v1", "/x/v1", "/x/v1/s.json", "/x/v1/c.yaml")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "config.yaml").write_text("{}")
    assert [(r.directory.split("/")[-1], r.record) for r in sources.record_files(spark, str(tmp_path), "config.yaml").collect()] == [("er", "{}")]
    assert sources.read_record(spark, f"{tmp_path}/nothing") is None and sources.read_record(spark, f"{tmp_path}/deep/er/config.yaml") == {}


@pytest.fixture
def features(spark):
    rows = [("a.wav", [0.5] * 4, 4, "train", "x"), ("b.wav", [0.25] * 2, 2, "train", None), ("c.wav", [1.0], 1, "validation", "y")]
    return spark.createDataFrame(rows, "audio_path string, input_values array<double>, input_length long, source_split string, who string")


RECORD = {"source": {"type": "paired", "path": "/p", "seed": 1}, "feature_extractor": {"feature_extractor_type": "Mel Bank", "bins": 80, "_private": 1}, "input_column": "input_values", "sampling_rate": 16000}


def test_feature_cache(spark, features, tmp_path):
    record = sinks.feature_record({"type": "paired", "path": "/p", "text_column": "t"}, RECORD["feature_extractor"], "input_values", 16000, 1)
    assert record == {**RECORD, "feature_extractor": {"bins": 80, "feature_extractor_type": "Mel Bank"}}
    built = []
    build = lambda: (built.append(1), features)[1]
    root = str(tmp_path)
    for _ in range(2):
        back = sinks.features_of(spark, root, record, build)
        assert sorted((r.audio_path, r.source_split, r.source_rank, tuple(r.input_values)) for r in back.collect()) == [("a.wav", "train", 0, (0.5,) * 4), ("b.wav", "train", 0, (0.25,) * 2), ("c.wav", "validation", 1, (1.0,))]
    assert built == [1]
    folder = f"{root}/{sinks.feature_folder(record)}"
    assert sinks.feature_folder(record).startswith("features_mel-bank_") and sinks.feature_folder(record | {"source_splits": ["x"]}) == sinks.feature_folder(record)
    assert sinks.load_features(spark, folder, ["validation"]).count() == 1
    files.delete(spark, f"{folder}/config.yaml")  # as a run leaves it that died before its record
    sinks.features_of(spark, root, record, build)
    sinks.features_of(spark, root, record, build, fresh=True)
    assert built == [1, 1, 1]
    sinks.write_record(spark, folder, record | {"sampling_rate": 8000})
    with pytest.raises(ValueError, match="sampling_rate: cached 8000, current 16000"):
        sinks.features_of(spark, root, record, build)
    assert sinks.invalidate(spark, root, [sinks.feature_folder(record), "not-there"]) == [sinks.feature_folder(record)]
    for outside in ("", "/etc", "../x", "a/../../b"):
        with pytest.raises(ValueError, match="outside"):
            sinks.invalidate(spark, root, [outside])


def test_names_of_what_is_cached():
    record = RECORD | {"feature_extractor": sinks.public_settings(RECORD["feature_extractor"])}
    names = {sinks.feature_folder(record | change) for change in ({}, {"sampling_rate": 8000}, {"input_column": "x"}, {"source": {"type": "paired", "path": "/q"}}, {"feature_extractor": {"feature_extractor_type": "Mel Bank", "bins": 128}})}
    assert len(names) == 5
    hub = {"type": "export", "path": "/p", "text_column": "t", "cache_dir": "/c"}
    assert sinks.source_record({"type": "concat", "sources": [hub]}, 3) == {"type": "concat", "sources": [{"type": "export", "path": "/p", "text_column": "t", "seed": 3}], "seed": 3}
    assert sinks.vocabulary_id("Mine", {"size": 5, "_x": 1}) == sinks.vocabulary_id("mine", {"size": 5})
    assert sinks.vocabulary_id("mine", {"size": 5}, "s-1") != sinks.vocabulary_id("mine", {"size": 5})
    assert sinks.embedding_id("v-1", "Big Model") == "v-1-big-model" and sinks.output_folder("/o/", "Big", "e7", "s-1") == "/o/big/s-1/e7"


def test_source_cache_and_records(spark, features, tmp_path):
    built = []
    build = lambda: (built.append(1), features)[1]
    for _ in range(2):
        assert sinks.source_of(spark, str(tmp_path), {"a": {"b": 1}}, build).count() == 3
    assert built == [1]
    with pytest.raises(ValueError, match=r"a\.b: cached 1, current 2; a\.c: only in the current record"):
        sinks.source_of(spark, str(tmp_path), {"a": {"b": 2, "c": 3}}, build)
    assert not sinks.record_matches(spark, f"{tmp_path}/untokenized", {}, error=False)
    assert sinks.record_matches(spark, f"{tmp_path}/elsewhere", {"x": 1})
    (tmp_path / "f").write_bytes(b"abc")
    assert sinks.content_digest(spark, f"{tmp_path}/f").startswith("ba7816bf")


def test_split_record(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i // 2}", "xyz"[i % 3], 3600 + i) for i in range(20)], "example_index long, key string, who string, size long")
    spec = splits.SplitSpec(name="By Who", test={"who": "z"}, dev_size=4)
    assignment = splits.assign(rows, spec)
    record = sinks.save_split(rows, assignment, spec, str(tmp_path / "s"), metadata_digest="abc")
    saved = sources.read_record(spark, f"{tmp_path}/s/split.yaml")
    assert saved == json.loads(json.dumps(record)) and saved["split_id"] == spec.split_id("abc") and saved["counts"] == {"train": 10, "dev": 4, "test": 6}
    assert saved["hours"]["test"] == round(sum(3600 + i for i in range(20) if i % 3 == 2) / 3600, 3)
    back = spark.read.csv(f"{tmp_path}/s/assignment.csv", header=True)
    want = {r.example_index: r.split for r in assignment.collect()}
    assert sorted(map(tuple, back.collect())) == sorted((f"k{i // 2}", s) for i, s in want.items())
    lines = [line.strip().split(",") for part in sorted((tmp_path / "s" / "assignment.csv").glob("part-*")) for line in part.read_text().splitlines()[1:]]
    assert [s for _, s in lines] == ["train"] * 10 + ["dev"] * 4 + ["test"] * 6


def test_split_record_tells_what_is_left_out(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i}", "xyz"[i % 3], 10 * i if i else None) for i in range(30)], "example_index long, key string, who string, size long")
    spec = splits.SplitSpec(exclude={"who": "x"}, test={"who": "z"}, dev=[], train_budget=4, train_budget_unit="examples", max_size=200)
    record = sinks.save_split(rows, splits.assign(rows, spec), spec, str(tmp_path / "s"), unmatched=2)
    train = record["counts"]["train"]
    long = sum(10 * r.example_index > 200 for r in splits.assign(rows, spec).collect())
    assert record["left_out"] == {"excluded": 10, "unmatched": 2, "unused": 10 - train, "too_long": long} and record["counts"]["test"] == 10
    assert sources.read_record(spark, f"{tmp_path}/s/split.yaml")["left_out"] == record["left_out"]


def test_tables_and_reports(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "q", "süß", "suss"), (0, "p", "", "x")], "example_index long, example string, reference string, hypothesis string")
    sinks.save_predictions(M.error_counts(pairs), f"{tmp_path}/p")
    text = "".join(f.read_text() for f in sorted((tmp_path / "p").glob("part-*")))
    rows = [json.loads(line) for line in text.splitlines()]
    assert [r["example_index"] for r in rows] == [0, 1] and list(rows[1])[:4] == ["example", "example_index", "reference", "hypothesis"] and "süß" in text
    assert (rows[1]["ref_words"], rows[1]["word_edits"], rows[1]["ref_chars"], rows[1]["char_edits"]) == (1, 1, 3, 3)
    vocab = L.vocabulary(spark.createDataFrame([("né |",)], "text string"))
    sinks.save_vocabulary(vocab, f"{tmp_path}/deep/vocab.json")
    assert "é" in (tmp_path / "deep" / "vocab.json").read_text()
    assert sorted(map(tuple, sources.vocabulary_file(spark, f"{tmp_path}/deep/vocab.json").collect())) == sorted(map(tuple, vocab.collect()))
    assert sinks.save_report(pairs.select("example", "example_index"), f"{tmp_path}/r.json", ["example"]) == json.loads((tmp_path / "r.json").read_text()) == [{"example": "p", "example_index": 0}, {"example": "q", "example_index": 1}]
    sinks.save_decoded(spark.createDataFrame([("b/x.wav", "two"), ("a.wav", None)], "file string, transcription string"), f"{tmp_path}/d")
    assert [json.loads(x)["file"] for f in sorted((tmp_path / "d").glob("part-*")) for x in f.read_text().splitlines()] == ["a.wav", "b/x.wav"]
    corpus = spark.createDataFrame([(i, f"lïne {i}") for i in range(40)], "i long, text string").repartition(3)
    assert sinks.save_corpus(corpus, f"{tmp_path}/c", "i") and not sinks.save_corpus(corpus.limit(1), f"{tmp_path}/c", "i")
    lines = {k: [x for f in sorted((tmp_path / "c" / f"corpus.{k}").glob("part-*")) for x in f.read_text().splitlines()] for k in ("jsonl", "txt")}
    assert [json.loads(x)["text"] for x in lines["jsonl"]] == lines["txt"] == [f"lïne {i}" for i in range(40)]
    with pytest.raises(ValueError, match="empty"):
        sinks.save_corpus(corpus.limit(0), f"{tmp_path}/e", "i")


def test_embedding_files(spark, tmp_path):
    matrix = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id int, vector array<double>")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    sinks.save_embeddings(matrix, None, f"{tmp_path}/tied", {"model": "m"})
    assert all(same(m, matrix) for m in sources.embedding_files(spark, f"{tmp_path}/tied"))
    other = matrix.withColumn("vector", F.transform("vector", lambda x: -x))
    sinks.save_embeddings(matrix, other, f"{tmp_path}/free", {})
    got = sources.embedding_files(spark, f"{tmp_path}/free")
    assert same(got[0], matrix) and same(got[1], other)
    files.delete(spark, f"{tmp_path}/free/output")
    assert sources.embedding_files(spark, f"{tmp_path}/free") == sources.embedding_files(spark, f"{tmp_path}/none") == (None, None)


def test_plans(spark, tmp_path):
    for name in ("processed_old_x", "processed_older_x", "notes-old", "processed_new_y", "processed_old_y"):
        (tmp_path / name).mkdir()
    names = spark.createDataFrame([(p.name,) for p in tmp_path.iterdir()], "name string")
    plan = R.rename_plan(names, R.swapped_slug(F.col("name"), "old", "new"))
    assert {r.name: (r.target, r.action) for r in plan.collect()} == {"processed_old_x": ("processed_new_x", "rename"), "processed_older_x": ("processed_older_x", "none"), "notes-old": ("notes-new", "rename"), "processed_new_y": ("processed_new_y", "none"), "processed_old_y": ("processed_new_y", "skip")}
    full = plan.select(F.concat(F.lit(f"{tmp_path}/"), "name").alias("name"), F.concat(F.lit(f"{tmp_path}/"), "target").alias("target"), "action")
    assert len(sinks.apply_plan(full)) == 2 and (tmp_path / "notes-old").exists()
    assert len(sinks.apply_plan(full, apply=True)) == 2 and (tmp_path / "notes-new").exists() and not (tmp_path / "notes-old").exists()
    assert sinks.apply_plan(full, apply=True) == []
    copies = spark.createDataFrame([(f"{tmp_path}/notes-new", f"{tmp_path}/copied", "copy")], "name string, target string, action string")
    assert len(sinks.apply_plan(copies, True, "copy")) == 1 and sinks.apply_plan(copies, True, "copy") == [] and (tmp_path / "notes-new").exists()
