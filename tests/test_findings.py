"""What a review found on larger tables and odd values."""

import random
import struct
import tracemalloc
from collections import Counter

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparkloom import sinks, sources
from sparkloom.functions.text import flatten_whitespace, portions
from sparkloom.operators import labels as L
from sparkloom.operators import ngrams as G
from sparkloom.scratch import written
from sparkloom.sources import audio as A
from sparkloom.sources.configs import config_parameters


def against_sql(spark, folder, name, **tables):
    """The rows of a query and those of its SQL, sorted, over small tables."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]
    return sorted(got), sorted(con.sql(__spark_entry__.oracle_sql()[name]).fetchall())


def test_products_that_round_to_whole_numbers(spark, tmp_path):
    """0.009 as a float times 1000 is below 9 as a double, and 9 as a float."""
    vectors = spark.createDataFrame([(1, [0.009, -0.009, 0.5]), (2, [0.009])], "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(2, 4, 0), (2, 3, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got, want = against_sql(spark, tmp_path, "embedding_restore", embeddings=vectors, labels=labels)
    assert got == want


@pytest.mark.parametrize("batch", [1 << 21, 60])
@pytest.mark.parametrize("marks", [False, True])
@pytest.mark.parametrize("orders", [[1, 2, 3, 4, 5], [1, 3], [2], [4, 6], [1]])
def test_counts_of_counts_from_windows(spark, monkeypatch, batch, marks, orders):
    monkeypatch.setattr(G, "BATCH", batch)
    rng = random.Random(7)
    lines = [None, "", " ", "a", "ü b", "x\xa0y\x1cz", *(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(150))]
    df = spark.createDataFrame([(t,) for t in lines], "text string").repartition(3)
    want = Counter()
    for line in lines:
        ws = (line or "").split()
        ws = ["<s>", *ws, "</s>"] if ws and marks else ws
        want.update((n, tuple(ws[i : i + n])) for n in orders for i in range(len(ws) - n + 1))
    got = {(r.n, r["count"]): r.grams for r in G.ngram_counts_of_counts(df, orders=orders, marks=marks).collect()}
    assert got == Counter((n, k) for (n, _), k in want.items())


@pytest.mark.parametrize(("orders", "marks", "rows"), [([1, 2, 3, 4, 5], True, 10_000), ([1, 2, 3, 4, 5], False, 3), ([2, 4], False, 1), ([1], True, 5)])
def test_counts_of_counts_in_rounds(spark, monkeypatch, orders, marks, rows):
    """Words may hold what parts the words of windows; runs of equal grams go on in the next batch and, in other batches of lines, in other rows."""
    monkeypatch.setattr(G, "BATCH", 60)
    monkeypatch.setattr(G, "ROUND", 400)
    monkeypatch.setattr(G, "ROUNDS", 3)
    held = []
    monkeypatch.setattr(G, "written", lambda df, name: held.append(df) or written(df, name))
    rng = random.Random(11)
    words = ["a", "a\0", "a\1", "\0", "\1", "\0\1", "\1\2", "\1\1", "b\x02", "ü"]
    lines = [None, "", "a", *(" ".join(rng.choice(words[: rng.randint(1, 10)]) for _ in range(rng.randint(0, 9))) for _ in range(120))]
    want = Counter()
    for line in lines:
        ws = (line or "").split()
        ws = ["<s>", *ws, "</s>"] if ws and marks else ws
        want.update((n, tuple(ws[i : i + n])) for n in orders for i in range(len(ws) - n + 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        df = spark.createDataFrame([(t,) for t in lines], "text string").repartition(2)
        got = {(r.n, r["count"]): r.grams for r in G.ngram_counts_of_counts(df, orders=orders, marks=marks).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(held) == 3 and got == Counter((n, k) for (n, _), k in want.items())


def test_a_round_deals_out_its_share_alone():
    """The rows of the rounds are those of one round, so the disk holds about a ROUNDS-th of them at once."""
    rng = random.Random(2)
    lines = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))) for _ in range(200)]
    rows = lambda share: [r for f in G.window_lines(lines, [1, 2, 3], True, share) for r in f.itertuples(index=False, name=None)]
    whole, shares = rows((0, 1)), [rows((k, 4)) for k in range(4)]
    assert sorted(whole) == sorted(r for share in shares for r in share)
    assert max(map(len, shares)) < 0.3 * len(whole)
    heads = [{gram.split("\0")[0] if n else tuple(gram.split("\0")[:2]) for n, gram, _ in share} for share in shares]
    assert sum(map(len, heads)) == len(set().union(*heads))


def test_a_place_of_a_line_is_one_row(spark):
    """Long grams of all orders share one row, so the rows that are dealt out hardly grow with the orders."""
    lines = [" ".join(f"w{i}_{j}" for j in range(100)) for i in range(20)]
    rows = lambda orders: sum(map(len, G.window_lines(lines, orders, False)))
    assert rows([3]) == 20 * 98 and rows([3, 4, 5, 6, 7]) == 20 * 98
    plan = G.ngram_counts_of_counts(spark.createDataFrame([(t,) for t in lines], "text string"), orders=[3, 4, 5])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("MapInPandas") == 1


def test_grams_are_dealt_out_before_they_are_added_up(spark):
    """Nearly all grams of a task differ, so none of them are held before the shuffle."""
    plan = G.ngram_counts(spark.createDataFrame([("a b c",)], "text string"), orders=[1, 3])._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("Exchange hashpartitioning")
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == plan[:dealt].count("HashAggregate") > 0


@pytest.mark.parametrize("numbers", [1 << 62, 1])
def test_numbers_of_grams(monkeypatch, numbers):
    """Grams of orders that are not asked for are numbered only where pairs would grow too large."""
    monkeypatch.setattr(G, "NUMBERS", numbers)
    rng = random.Random(5)
    lines = ["", " ", "a", *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(60))]
    for orders in ([1, 3], [2], [5], [2, 6]):
        want = Counter((n, " ".join(ws[i : i + n])) for ws in map(str.split, lines) for n in orders for i in range(len(ws) - n + 1))
        got = {(n, gram): k for f in G.count_lines(lines, orders, False) for n, gram, k in f.itertuples(index=False, name=None)}
        assert got == want


def test_counting_lines_in_little_memory():
    """Eight million characters are counted in parts, so the peak does not grow with the batch that Spark hands over."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)]
    lines = [" ".join(rng.choices(words, k=500)) for _ in range(2_300)]
    tracemalloc.start()
    n = sum(int(frame["count"].sum()) for part in G._runs(lines) for frame in G.count_lines(part, (1, 3), True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2_300 * (502 + 500) and peak < 100e6


def test_a_batch_of_texts_is_taken_up_in_parts(monkeypatch):
    """Of 40 million characters that Spark hands over at once only a part is held as strings."""
    monkeypatch.setattr(G, "BATCH", 1 << 18)
    batch = pa.RecordBatch.from_arrays([pa.array([None, "", *["ab cd " * 400] * 16_666])], ["text"])
    tracemalloc.start()
    got = Counter()
    for part in G._counter(G.count_lines, (2,), False)(iter([batch, batch.slice(0, 2)])):
        got.update({r["gram"]: r["count"] for r in part.to_pylist()})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {"ab cd": 400 * 16_666, "cd ab": 399 * 16_666} and peak < 20e6


def test_samples_are_handed_back_in_portions(spark):
    body = bytes(range(256)) * 2000
    wav = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(body)) + body
    files = pd.Series([wav, None, b"bad", wav, wav, wav, wav], dtype=object)
    for rate in (8000, 11025):
        made = list(A.waves(rate).func(iter([files, files.iloc[:0]])))
        assert len(made) > 1 and max(sum(len(f) for f in part if f is not None) for part in made) <= 2 * (1 << 20) * rate // 8000
        whole = [f for part in made for f in part]
        assert [None if f is None else len(f) for f in whole] == [None if k in (1, 2) else -(-len(body) * rate // 8000) for k in range(7)]


def test_labels_are_handed_back_in_portions(spark):
    vocab = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("|", 2), ("a", 3)], "token string, id int")
    texts = pd.Series(["a b" * 300_000, None, "", "é", *["a" * 400_000] * 5])
    made = list(L.encoder(vocab).func(iter([texts, texts.iloc[:0]])))
    assert len(made) > 1 and max(sum(map(len, part)) for part in made) <= 1 << 20
    whole = [list(x) for part in made for x in part]
    assert whole[0] == [3, 2, 1] * 300_000 and whole[1:4] == [[], [], [1]] and [len(x) for x in whole[4:]] == [400_000] * 5


def test_characters_are_counted_in_portions():
    texts = ["abé" * 1000, None, "", "😀a"] * 1200
    batch = pa.RecordBatch.from_pydict({"lang": ["de", "en", "en", "en"] * 1200, "text": texts})
    tracemalloc.start()
    got = L.count_characters(batch, ["lang"], "text")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {k: {chr(c): n for c, n in v.items()} for k, v in got.items()} == {("de",): dict.fromkeys("abé", 1_200_000), ("en",): dict.fromkeys("😀a", 1200)}
    assert peak < 30e6


def test_portions():
    assert list(portions([])) == [] and list(portions([5, 1, 1], 2)) == [slice(0, 1), slice(1, 3)] and list(portions([1, 1, 9, 0], 2)) == [slice(0, 2), slice(2, 3), slice(3, 4)]


def test_collation_by_key(spark):
    """With a key the rows are not dealt out by batch, and come out the same."""
    rows = spark.createDataFrame([(1, 1, [7, 5], [1.0]), (2, 1, [7], [1.0, 2.0]), (3, 2, [], []), (4, 2, [7], None)], "i int, b int, labels array<int>, inputs array<double>")
    by_batch, by_key = (sorted(map(str, L.collate(rows, "b", inputs="inputs", start=7, mask="m", key=key).collect())) for key in (None, "i"))
    assert by_batch == by_key and len(by_key) == 4


def counting(spark, rows, schema):
    """The rows with a column that counts how often it is computed."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return spark.createDataFrame(rows, schema).withColumn("text", F.udf(same, "string")("text")), seen


def test_sinks_compute_their_rows_once(spark, tmp_path):
    df, seen = counting(spark, [(i, f"t{i}") for i in range(50, 0, -1)], "i int, text string")
    sinks.save_json_lines(df, f"{tmp_path}/rows", ["i"])
    assert seen.value == 50 and [r.i for r in spark.read.json(f"{tmp_path}/rows").coalesce(1).collect()] == list(range(1, 51))
    df, seen = counting(spark, [(i, f"t{i}") for i in range(50, 0, -1)], "i int, text string")
    assert sinks.save_corpus(df, f"{tmp_path}/corpus", "i") and not sinks.save_corpus(df, f"{tmp_path}/corpus", "i")
    assert seen.value == 50 and spark.read.text(f"{tmp_path}/corpus/corpus.txt").count() == 50


@pytest.mark.parametrize("block", ["1k", "128m"])
def test_rows_of_files_in_order_stay_where_they_lie(spark, tmp_path, block):
    """Files longer than a block, shorter ones and empty ones, with equal lines; no row is dealt out."""
    want = []
    for i, n in enumerate((300, 5, 0, 1000, 1)):
        lines = [f"line {i} {k % 7}" for k in range(n)]
        want += lines
        (tmp_path / f"part-{i:05}").write_text("".join(x + "\n" for x in lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        placed = sources.in_file_order(spark.read.text(str(tmp_path)), "place")
        assert placed.columns == ["value", "place"] and [(r.place, r.value) for r in placed.orderBy("place").collect()] == list(enumerate(want))
        assert "rangepartitioning(value" not in placed._jdf.queryExecution().executedPlan().toString()
        assert sources.in_file_order(spark.read.text(str(tmp_path)).where("value = 'none'")).collect() == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_white_space_runs(spark):
    given = [" a", "a  b", "a\tb", "a \t b", "\xa0 a　", "a \n", "", " ", "\x1c a \x1f\x85b  c d ", "a b c", "​a b", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in given], "t string").select(flatten_whitespace(F.col("t"))).collect()]
    assert got == [None if t is None else " ".join(t.split()) for t in given]


def test_small_tables_of_configs_are_dealt_out(spark):
    df = spark.createDataFrame([(i, f"experiment_id: r{i}\ntraining:\n  max_steps: {i}\n") for i in range(40)], "file int, text string").coalesce(1)
    rows = config_parameters(df)
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert {(r.file, r.run, r.param, r.value) for r in rows.collect()} == {(str(i), f"r{i}", "max_steps", str(i)) for i in range(40)}


def test_states_of_many_runs_are_few_files(spark, tmp_path):
    events = spark.range(400).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id % 90) AS ts", "id % 60 AS user_id", "concat('e', id % 3) AS event_type")
    got, want = against_sql(spark, tmp_path, "trainer_states", events=events)
    assert got == want and len(got) == 400
    assert len(__spark_entry__.queries()["trainer_states"](spark, str(tmp_path)).inputFiles()) < 20


def test_files_of_null_and_empty_texts(spark, tmp_path):
    texts = spark.createDataFrame([(0, None), (1, ""), (2, "a"), (3, "é\0\x7f😀"), (4, "b\n" * 40_000)], "doc_id long, text string")
    for name in ("pcm_decode", "pcm_resample"):
        (tmp_path / name).mkdir()
        got, want = against_sql(spark, tmp_path / name, name, documents=texts)
        assert got == want and len(got) == 5
