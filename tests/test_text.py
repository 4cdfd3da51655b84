import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import labels as L
from sparkloom.operators import metrics as M
from sparkloom.operators import vectors as V


def mapped(spark, values, column, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column(F.col("t"))).collect()]


def test_normalizer(spark):
    given = ["  The KETTLE -- isn't (yet)\thot! ", "naïve_4", "", None, "　 "]
    assert mapped(spark, given, T.normalizer()) == ["the kettle isn't yet hot", "naïve_4", "", None, ""]
    keep = T.TextSettings(lowercase=False, remove_punctuation=False, unicode_normalize=None, replacements={"a": "b", "b": "cc"})
    assert mapped(spark, [" a-b  A "], T.normalizer(keep)) == ["cc-cc  A"]


@pytest.mark.parametrize("form", T.FORMS)
def test_unicode_forms(spark, form):
    given = ["plain", "é ﬁ Å", None, ""]
    assert mapped(spark, given, lambda c: T.unicode_form(c, form)) == [g and unicodedata.normalize(form, g) if g is not None else None for g in given]
    with pytest.raises(ValueError):
        T.unicode_form(F.col("t"), "NFX")


def test_paths_and_cells(spark):
    given = ["/a/b/c.tar.gz", "c.wav", "/top.txt", "a/"]
    assert mapped(spark, given, T.basename) == ["c.tar.gz", "c.wav", "top.txt", ""]
    assert mapped(spark, given, T.stem) == ["c.tar", "c", "top", ""]
    assert mapped(spark, given, T.dirname) == ["/a/b", "", "", "a"]
    assert mapped(spark, given, lambda c: T.relative_path(c, "/a")) == ["b/c.tar.gz", "c.wav", "/top.txt", "a/"]
    assert mapped(spark, ["x|y||z", "", None, "|"], lambda c: T.split_values(c, "|")) == [["x", "y", "z"], [], [], []]
    names = ["Über Größe 7!", "--a b--", "..."]
    assert mapped(spark, names, T.slug) == [T.slug_of(n) for n in names] == ["über-größe-7", "a-b", ""]


def test_vocabulary_and_encoding(spark):
    texts = spark.createDataFrame([("bad cab",), ("a|b \U0001f600",), ("",), (None,)], "text string")
    vocab = {r.token: r.id for r in L.vocabulary(texts).collect()}
    assert vocab == {"[PAD]": 0, "[UNK]": 1, "|": 2, "a": 3, "b": 4, "c": 5, "d": 6, "\U0001f600": 7}
    frequent = L.vocabulary(texts, min_frequency=3)
    assert {r.token for r in frequent.collect()} == {"[PAD]", "[UNK]", "|", "a", "b"}
    encode = L.encoder(frequent)
    rows = texts.union(spark.createDataFrame([("b\u0000z￿\U0010ffff a|",)], "text string"))
    assert [r[0] for r in rows.select(encode(F.col("text"))).collect()] == [[4, 3, 1, 2, 1, 3, 4], [3, 2, 4, 2, 1], [], [], [4, 1, 1, 1, 1, 2, 3, 2]]
    by = texts.withColumn("lang", F.when(F.col("text").contains("|"), None).otherwise("x"))
    counts = {(r.lang, r.token): r.n for r in L.character_counts(by, by="lang").collect()}
    assert counts["x", "a"] == 2 and counts[None, "a"] == 1 and sum(counts.values()) == 12
    assert L.vocabulary(texts.limit(0)).count() == 2


def test_id_spaces(spark):
    frame = lambda rows: spark.createDataFrame(rows, "token string, id int")
    L.check_id_space(frame([("x", 1), ("y", 0)]))
    with pytest.raises(ValueError, match="contiguous"):
        L.check_id_space(frame([("x", 0), ("y", 2)]))
    with pytest.raises(ValueError, match="more than once"):
        L.check_id_space(frame([("x", 0), ("x", 1)]))
    assert [r.token for r in L.colliding(frame([("x", 0), ("<s>", 1)]), frame([("<s>", 9)])).collect()] == ["<s>"]
    block = {r.token: r.new_id for r in L.special_block(frame([("<b>", 7), ("<a>", 3)]), 50).collect()}
    assert block == {"<a>": 50, "<b>": 51}
    moved = {r.old_id: r.new_id for r in L.remap(spark.createDataFrame([(0,), (1,)], "old_id int"), frame([("x", 0), ("y", 1)]), frame([("y", 5)])).collect()}
    assert moved == {0: None, 1: 5}
    old, new = {0: "<s>", 1: "<pad>", 2: "en", 3: "gone"}, {"<s>": 9, "en": 4, "<pad>": 0}
    given = {"bos_token_id": 0, "eos_token_id": 3, "other": 3, "lang_to_id": {"en": 2, "xx": 3}, "suppress_tokens": [1, 2], "begin_suppress_tokens": [2, 3, 1], "forced_decoder_ids": [[1, 2]], "pad_token_id": None}
    want = {"bos_token_id": 9, "eos_token_id": None, "other": 3, "lang_to_id": {"en": 4}, "suppress_tokens": [], "begin_suppress_tokens": [4, 0], "forced_decoder_ids": None, "pad_token_id": None}
    assert L.remap_settings(given, old, new) == want
    canon = lambda rows: spark.createDataFrame(rows, "token string, id int, canonical string")
    got = L.overlap(canon([("A", 4, "a"), ("a", 2, "a"), ("?", 0, "")]), canon([("_a", 1, "a"), ("!", 3, ""), ("b", 5, "b")])).collect()
    assert [tuple(r) for r in got] == [("_a", 1, 2)]


def test_collation(spark):
    rows = [(1, "x", [7, 3, 4], [0.5]), (2, "x", [7, 6], [0.1, 0.2]), (3, "y", [7, 5], [1.0]), (4, "y", [], [2.0]), (5, "z", [], []), (6, "w", [7], [1.0])]
    df = spark.createDataFrame(rows, "i int, b string, labels array<int>, input array<double>")
    got = {r.i: (r.labels, r.input) for r in L.collate(df, "b", inputs="input", start=7).collect()}
    assert got == {1: ([3, 4], [0.5, 0.0]), 2: ([6, -100], [0.1, 0.2]), 3: ([7, 5], [1.0]), 4: ([-100, -100], [2.0]), 5: ([], []), 6: ([], [1.0])}
    plain = {r.i: r.labels for r in L.collate(df, "b").collect()}
    assert plain[1] == [7, 3, 4] and plain[2] == [7, 6, -100]


def test_decoding(spark):
    ids = spark.createDataFrame([([4, 4, 0, 4, 2, 2, 3],)], "ids array<int>")
    collapsed = L.collapse(F.col("ids"))
    tokens = F.array(*map(F.lit, ["", "?", "|", "o", "x"]))
    assert ids.select(collapsed, L.decode(collapsed, tokens), L.drop_special(F.col("ids"), [0, 2]), L.mask_to_pad(F.array(F.lit(-100), F.lit(5)))).first() == ([4, 4, 2, 3], "xx o", [4, 4, 4, 3], [0, 5])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_error_counts(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["sun", "moon", "sön", "日本", "x"])
    pairs = [(" ".join(word() for _ in range(rng.randrange(8))), " ".join(word() for _ in range(rng.randrange(8)))) for _ in range(60)] + [("  two \t words ", "two  words"), ("", "x"), (None, "x"), ("x", None)]
    got = M.error_counts(spark.createDataFrame(pairs, "reference string, hypothesis string")).collect()
    for (r, h), row in zip(pairs, got, strict=True):
        r, h = (r or "").strip(), (h or "").strip()
        want = (len(r.split()), edit_distance(r.split(), h.split()), len(r), edit_distance(r, h)) if r else (0, 0, 0, 0)
        assert (row.ref_words, row.word_edits, row.ref_chars, row.char_edits) == want
        s, d, i = M.align(r.split(), h.split())
        assert s + d + i == edit_distance(r.split(), h.split()) and d - i == len(r.split()) - len(h.split())
    counted = M.error_counts(spark.createDataFrame(pairs, "reference string, hypothesis string"))
    total, rates = [sum(r[c] for r in got) for c in ("word_edits", "ref_words", "char_edits", "ref_chars")], M.error_rates(counted).first()
    assert (rates.wer, rates.cer) == (total[0] / total[1], total[2] / total[3])
    blank = M.error_rates(counted.where("reference = ''")).first()
    assert (blank.wer, blank.cer) == (1.0, 1.0)
    assert M.align(["a", "b", "c"], ["x", "b"]) == (1, 1, 0)  # a hit and a substitution before a deletion


def test_more_words_than_letters_before_the_surrogates(spark):
    many = [f"w{i}" for i in range(60_000)]
    reference, hypothesis = M.letters(many, [*many[:5], "new", *many[5:]])
    assert len(reference) == 60_000 and len(set(reference)) == 60_000 and len(set(hypothesis)) == 60_001
    reference.encode()
    short = " ".join(many[:40_000])
    row = M.error_counts(spark.createDataFrame([("a " + short[:9], "a " + short[:9])], "reference string, hypothesis string")).first()
    assert row.word_edits == 0


def test_sparsemax(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.random() * 3, 0.5])) for g in range(4) for _ in range(25)] + [(9, 1.0), (8, None)]
    got = {}
    for r in V.sparsemax(spark.createDataFrame(rows, "g int, s double"), "g", "s").collect():
        got.setdefault(r.g, []).append((r.s, r.weight))
    for g, pairs in got.items():
        values = sorted((s for s, _ in pairs if s is not None), reverse=True)
        if not values:
            continue
        k = max(k for k in range(1, len(values) + 1) if 1 + k * values[k - 1] > sum(values[:k]))
        tau = (sum(values[:k]) - 1) / k
        assert all(math.isclose(w, max(s - tau, 0), abs_tol=1e-12) for s, w in pairs)
        assert math.isclose(sum(w for _, w in pairs), 1)


def test_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "token string, vector array<double>")
    target, source = frame([("x", [1.0]), ("y", [2.0])]), frame([("y", [9.0])])
    assert {r.token: (r.vector, r.restored) for r in V.restore_all(target, source).collect()} == {"x": ([1.0], False), "y": ([9.0], True)}
    with pytest.raises(ValueError, match="z"):
        V.restore_all(target, frame([("z", [0.0])]))
    rng = np.random.default_rng(1)
    base = frame([(f"t{i}", rng.normal([5, -5, 0], [1, 0.1, 2]).tolist()) for i in range(300)])
    rare = V.initialised(spark.createDataFrame([(f"r{i}", i % 2) for i in range(800)], "token string, n int"), base, 3)
    drawn = np.array([r.vector for r in rare.collect()])
    assert drawn.shape == (400, 3) and np.allclose(drawn.mean(0), [5, -5, 0], atol=0.4) and np.allclose(drawn.std(0), [1, 0.1, 2], rtol=0.2)
