"""Normalization, vocabularies, label encoding and corpus preparation over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batches as B
from ..operators import labels as L
from ..operators import ngrams as G
from ..operators import sampling
from .common import Catalogue

_C = Catalogue()
query, QUERIES, ORACLES = _C.query, _C.queries, _C.oracles

_FLAT = f"trim(regexp_replace(text, '[{T.WS}]+', ' ', 'g'))"
_PUNCT = rf"[^\p{{L}}\p{{N}}_{T.WS}'']"
NORM = f"trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '{_PUNCT}', '', 'g'), '[{T.WS}]+', ' ', 'g'))"
ENDS = f"'^[{T.WS}]+|[{T.WS}]+$', '', 'g'"


@query(f"SELECT doc_id, {NORM} AS norm FROM documents")
def normalize_text(t):
    return t("documents").select("doc_id", T.normalizer()(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, regexp_replace(lower(text), {ENDS}) AS norm FROM documents")
def normalize_keep_punct(t):
    return t("documents").select("doc_id", T.normalizer(T.TextSettings(remove_punctuation=False, unicode_normalize=None))(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, regexp_replace(replace(replace(replace(text, 'ü', 'ue'), 'ß', 'ss'), '&', ' and '), {ENDS}) AS norm FROM documents")
def custom_replacements(t):
    s = T.TextSettings(False, False, None, {"ü": "ue", "ß": "ss", "&": " and "})
    return t("documents").select("doc_id", T.normalizer(s)(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, {_FLAT} AS flat FROM documents")
def flatten_whitespace(t):
    return t("documents").select("doc_id", T.flatten_whitespace(F.col("text")).alias("flat"))


@query("SELECT DISTINCT source, lang, lower(regexp_replace(regexp_replace(source || ' / ' || lang, '[^\\p{L}\\p{N}]', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents")
def slugify(t):
    return t("documents").select("source", "lang").distinct().withColumn("slug", T.slug(F.concat_ws(" / ", "source", "lang")))


_CHARS = "c AS (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''), k AS (SELECT CASE WHEN ch = ' ' THEN '|' ELSE ch END AS token, count(*) AS n FROM c GROUP BY 1)"
_VOCAB = "v AS (SELECT token, CAST(row_number() OVER (ORDER BY encode(CASE WHEN token = '|' THEN ' ' ELSE token END)) + 1 AS INTEGER) AS id FROM k WHERE n >= {least}), vocab AS (SELECT * FROM v UNION ALL VALUES ('[PAD]', 0), ('[UNK]', 1))"


@query(f"WITH {_CHARS}, {_VOCAB.format(least=1)} SELECT token, id FROM vocab")
def char_vocab(t):
    return L.vocabulary(t("documents"))


@query(f"WITH {_CHARS}, {_VOCAB.format(least=500)} SELECT token, id FROM vocab")
def char_vocab_min_freq(t):
    return L.vocabulary(t("documents"), min_frequency=500)


@query("SELECT lang, ch AS token, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY lang, ch")
def vocab_by_split(t):
    return L.character_counts(t("documents"), by="lang")


_MAP = f"WITH {_CHARS}, {_VOCAB.format(least=500)}, m AS (SELECT map(list(token), list(id)) AS vm FROM vocab)"
_IDS = "CASE WHEN text = '' THEN [] ELSE list_transform(string_split(replace(text, ' ', '|'), ''), lambda x: coalesce(vm[x], 1)) END"


@query(f"{_MAP} SELECT doc_id, md5(array_to_string({_IDS}, ',')) AS labels_md5, CAST(len({_IDS}) AS BIGINT) AS label_length FROM documents, m")
def encode_labels(t):
    docs = t("documents")
    encode = L.encoder(L.vocabulary(docs, min_frequency=500))
    ids = docs.select("doc_id", encode(F.col("text")).alias("labels"))
    return ids.select("doc_id", F.md5(F.array_join(F.col("labels").cast("array<string>"), ",").cast("binary")).alias("labels_md5"), F.size("labels").cast("long").alias("label_length"))


@query(f"{_MAP} SELECT item_id, CAST(len(text) AS BIGINT) AS n, CAST(len(list_filter({_IDS}, lambda x: x = 1)) AS BIGINT) AS unknown FROM benchmark, m")
def unk_rate_external(t):
    ids = L.encoder(L.vocabulary(t("documents"), min_frequency=500))(F.col("text"))
    return t("benchmark").select("item_id", F.length("text").cast("long").alias("n"), F.size(F.filter(ids, lambda x: x == 1)).cast("long").alias("unknown"))


_REASON = "CASE WHEN n_chars > 4000 THEN 'input' WHEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) > 1500 THEN 'label' END"


def _reasons(t):
    label_length = F.length(F.regexp_replace("text", "[^a-zA-Z]", ""))
    return t("documents").select("doc_id", "n_chars", label_length.cast("long").alias("label_length"), L.drop_reason(F.col("n_chars"), label_length, 4000, 1500).alias("reason"))


@query(f"SELECT doc_id, n_chars, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS label_length FROM documents WHERE {_REASON} IS NULL")
def length_filters(t):
    return _reasons(t).where("reason is null").drop("reason")


@query(f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def filter_reasons(t):
    return _reasons(t).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT d.doc_id AS example_index, CASE WHEN toxic = 1 THEN 'test' WHEN quality = 0 THEN 'dev' ELSE 'train' END AS split FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT example_index, split, n_chars AS input_length, length(replace(text, ' ', '')) AS label_length FROM a JOIN documents ON doc_id = example_index WHERE n_chars <= 20000 AND length(replace(text, ' ', '')) <= 9000""")
def assemble_splits(t):
    assignment = t("labels").select(F.col("doc_id").alias("example_index"), F.when(F.col("toxic") == 1, "test").when(F.col("quality") == 0, "dev").otherwise("train").alias("split"))
    features = t("documents").select(F.col("doc_id").alias("example_index"), F.col("n_chars").alias("input_length"), F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("long").alias("label_length"))
    return features.join(assignment, "example_index").where("input_length <= 20000 and label_length <= 9000").select("example_index", "split", "input_length", "label_length")


@query(f"SELECT doc_id, {_FLAT} AS line FROM documents WHERE {_FLAT} <> ''")
def corpus_prepare(t):
    flat = T.flatten_whitespace(F.col("text"))
    return t("documents").select("doc_id", flat.alias("line")).where("line <> ''")


@query("SELECT doc_id, n_chars FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 50")
def corpus_sample(t):
    return sampling.sample_rows(t("documents").select("doc_id", "n_chars"), "doc_id", 50, 3)


@query("SELECT count(*) AS transcripts, CAST(sum(length(text)) AS BIGINT) AS characters, sum(length(text)) < 1000000 AS small FROM documents")
def corpus_stats(t):
    return t("documents").agg(F.count("*").alias("transcripts"), F.sum(F.length("text")).cast("long").alias("characters"), (F.sum(F.length("text")) < 1000000).alias("small"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(t):
    return t("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT md5(text) AS content, count(*) AS copies, count(DISTINCT source) > 1 AS across_sources FROM documents GROUP BY 1")
def identical_copies(t):
    return t("documents").groupBy(F.md5(F.col("text").cast("binary")).alias("content")).agg(F.count("*").alias("copies"), (F.countDistinct("source") > 1).alias("across_sources"))


@query(f"""WITH w AS (SELECT doc_id, string_split({_FLAT}, ' ') AS ws FROM documents WHERE {_FLAT} <> ''),
g AS (SELECT unnest(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def ngram_counts(t):
    return G.ngram_counts(t("documents"), orders=[2], marks=False).select("gram", F.col("count").alias("n"))


_MARKED = f"w AS (SELECT list_concat(['<s>'], string_split({_FLAT}, ' '), ['</s>']) AS ws FROM documents WHERE {_FLAT} <> '')"


@query(f"""WITH {_MARKED}, g AS (SELECT n, unnest(list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS gram FROM w, range(1, 6) r(n)),
c AS (SELECT n, gram, count(*) AS k FROM g GROUP BY n, gram) SELECT CAST(n AS INTEGER) AS n, k AS count, count(*) AS grams FROM c GROUP BY n, k""")
def ngram_counts_of_counts(t):
    """All orders from 1 to 5 in one pass, with the marks of lines."""
    return G.ngram_counts_of_counts(t("documents"), orders=[1, 2, 3, 4, 5])


@query(f"WITH {_MARKED}, g AS (SELECT n, unnest(list_transform(range(1, greatest(len(ws) - n + 2, 1)), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS gram FROM w, (VALUES (1), (3)) r(n)) SELECT n, gram, count(*) AS count FROM g GROUP BY n, gram")
def ngram_counts_marked(t):
    return G.ngram_counts(t("documents"), orders=[1, 3])


_BATCHES = """o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) - 1 AS p FROM documents),
b AS (SELECT doc_id, n_chars, p // 64 AS run, row_number() OVER (PARTITION BY p // 64 ORDER BY n_chars DESC, p) - 1 AS k FROM o),
lb AS (SELECT doc_id, n_chars, CAST(run * 8 + k // 8 AS BIGINT) AS batch, CAST(k % 8 AS INTEGER) AS place FROM b)"""


@query(f"WITH {_BATCHES} SELECT * FROM lb")
def length_batches(t):
    return B.length_batches(t("documents"), "doc_id", "n_chars", 8, 9, mega=8)


@query(f"WITH {_BATCHES}, e AS (SELECT batch, count(*) AS n, sum(n_chars) AS units, max(n_chars) AS longest FROM lb GROUP BY batch) SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS examples, CAST(sum(units) AS BIGINT) AS units, CAST(sum(n * longest) AS BIGINT) AS padded FROM e")
def length_batches_padding(t):
    return B.padding(B.length_batches(t("documents"), "doc_id", "n_chars", 8, 9, mega=8), "n_chars")


@query("SELECT 'documents' AS origin, CAST(doc_id AS BIGINT) AS id, md5(text) AS content, 0 AS source_rank FROM documents UNION ALL SELECT 'benchmark', CAST(item_id AS BIGINT), md5(text), 1 FROM benchmark")
def concat_sources(t):
    from ..sources import concat

    docs = t("documents").select(F.lit("documents").alias("origin"), F.col("doc_id").cast("long").alias("id"), F.md5(F.col("text").cast("binary")).alias("content"))
    bench = t("benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").cast("long").alias("id"), F.md5(F.col("text").cast("binary")).alias("content"))
    return concat([docs, bench])


@query("SELECT text AS transcription FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations")
def common_columns(t):
    from ..sources import common_columns as shared

    return shared([t("documents"), t("benchmark"), t("conversations")]).withColumnRenamed("text", "transcription")


@query("SELECT conv_id AS audio, turn, role, text AS transcription FROM conversations")
def standardize_columns(t):
    from ..sources import standardize

    return standardize(t("conversations"), "conv_id", "text")


@query(f"WITH {_CHARS}, {_VOCAB.format(least=1)}, s AS (SELECT source AS token, min(doc_id) AS id FROM documents GROUP BY source) SELECT token, id AS old_id, CAST(row_number() OVER (ORDER BY id) - 1 + (SELECT count(*) FROM vocab) AS INTEGER) AS new_id FROM s")
def special_block_ids(t):
    """Sources as special tokens, in the order of their first document, behind the learned vocabulary."""
    special = t("documents").groupBy(F.col("source").alias("token")).agg(F.min("doc_id").alias("id"))
    return L.special_block(special, L.vocabulary(t("documents")).count())


@query(f"WITH {_CHARS}, {_VOCAB.format(least=1)} SELECT count(*) AS size, min(id) = 0 AND max(id) = count(*) - 1 AND count(DISTINCT id) = count(*) AS contiguous, count(DISTINCT token) = count(*) AS distinct_tokens FROM vocab")
def vocab_id_space(t):
    return L.id_space_problems(L.vocabulary(t("documents")))


_TWO = f"WITH {_CHARS}, {_VOCAB.format(least=1)}, k2 AS (SELECT * FROM k WHERE n >= 500), old AS (SELECT * FROM vocab), new AS (SELECT token, CAST(row_number() OVER (ORDER BY encode(CASE WHEN token = '|' THEN ' ' ELSE token END)) + 1 AS INTEGER) AS id FROM k2 UNION ALL VALUES ('[PAD]', 0), ('[UNK]', 1))"


@query(f"{_TWO} SELECT old.token, old.id AS old_id, new.id AS new_id FROM old LEFT JOIN new ON old.token = new.token")
def token_remap(t):
    old, new = L.vocabulary(t("documents")), L.vocabulary(t("documents"), min_frequency=500)
    return L.remap(old.select(F.col("id").alias("old_id")), old, new).select("token", "old_id", "new_id")


@query(f"{_TWO} SELECT id AS stale_id FROM old WHERE id >= (SELECT count(*) FROM new)")
def stale_ids(t):
    size = L.vocabulary(t("documents"), min_frequency=500).agg(F.count("*").alias("size"))
    return L.vocabulary(t("documents")).join(F.broadcast(size)).where("id >= size").select(F.col("id").alias("stale_id"))


@query("SELECT doc_id, source, md5(text) AS digest, n_chars, CAST(row_number() OVER (ORDER BY source, doc_id) - 1 AS BIGINT) AS example_index FROM documents")
def example_index(t):
    """Numbers carried with the whole rows."""
    from ..sources import indexed

    rows = indexed(t("documents"), ["source", "doc_id"])
    return rows.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"), "n_chars", "example_index")


@query("SELECT source || '/' || doc_id || '.wav' AS example, n_chars / 16.0::DOUBLE AS duration, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS example_index FROM documents")
def examples_csv(t):
    """Written as CSV files in the order of doc_id and read back, numbered in the order of their lines."""
    from ..scratch import scratch_dir
    from ..sources import examples_csv as read

    rows = t("documents").orderBy("doc_id").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("example"), (F.col("n_chars") / 16.0).alias("duration"))
    path = f"{scratch_dir(rows.sparkSession)}/examples-{uuid.uuid4().hex}"
    rows.write.csv(path, header=True)
    return read(rows.sparkSession, path)


@query(f"SELECT doc_id, regexp_replace(nfc_normalize(text), '^x', '') AS nfc, length(nfc_normalize(text)) AS nfc_length FROM documents")
def unicode_nfc(t):
    form = T.unicode_form(F.col("text"), "NFC")
    return t("documents").select("doc_id", F.regexp_replace(form, "^x", "").alias("nfc"), F.length(form).cast("long").alias("nfc_length"))


_PATHS = "n AS (SELECT doc_id, '/corpus/' || source || '/' || lang || '/' || doc_id || '.wav' AS path, source || ';;' || lang || ';' AS cell FROM documents)"


@query(f"WITH {_PATHS} SELECT doc_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, substr(path, 9) AS below, array_to_string(list_filter(string_split(cell, ';'), lambda x: x <> ''), '+') AS cell FROM n")
def path_parts(t):
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))
    cell = F.concat("source", F.lit(";;"), "lang", F.lit(";"))
    return t("documents").select("doc_id", T.dirname(path).alias("folder"), T.relative_path(path, "/corpus").alias("below"), F.array_join(T.split_values(cell), "+").alias("cell"))


@query(f"""WITH {_BATCHES}, p AS (SELECT d.doc_id, batch, list_transform(string_split(text, ''), lambda c: ascii(c)) AS labels FROM documents d JOIN lb USING (doc_id) WHERE text <> ''),
s AS (SELECT batch, max(len(labels)) AS longest FROM p GROUP BY batch)
SELECT doc_id, batch, md5(array_to_string(list_concat(labels, list_transform(range(len(labels), longest), lambda x: -100)), ',')) AS labels, md5(array_to_string(list_concat(labels, list_transform(range(len(labels), longest), lambda x: 0)), ',')) AS inputs,
md5(array_to_string(list_concat(list_transform(labels, lambda x: 1), list_transform(range(len(labels), longest), lambda x: 0)), ',')) AS mask FROM p JOIN s USING (batch)""")
def collate_labels(t):
    """Code points of whole texts as labels and as inputs, padded in batches of like length, with the mask of what is no padding."""
    batches = B.length_batches(t("documents"), "doc_id", "n_chars", 8, 9, mega=8).select("doc_id", "batch")
    points = F.transform(T.characters(F.col("text")), lambda c: F.ascii(c))
    texts = t("documents").where("text <> ''").select("doc_id", "text").join(batches, "doc_id")
    rows = texts.select("doc_id", "batch", points.alias("labels"), points.alias("inputs"))
    listed = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary")).alias(c)
    return L.collate(rows, "batch", inputs="inputs", mask="mask", key="doc_id").select("doc_id", "batch", *map(listed, ("labels", "inputs", "mask")))


@query("""WITH b AS (SELECT conv_id, turn, list_concat([CASE WHEN role = 'user' OR conv_id % 2 = 0 THEN 7 ELSE 8 END], list_transform(string_split(text, ''), lambda c: ascii(c))) AS labels FROM conversations),
s AS (SELECT conv_id, max(len(labels)) AS longest, bool_and(labels[1] = 7) AS starts FROM b GROUP BY conv_id)
SELECT conv_id, turn, array_to_string(list_concat(CASE WHEN starts THEN labels[2:] ELSE labels END, list_transform(range(len(labels), longest), lambda x: -100)), ',') AS labels FROM b JOIN s USING (conv_id)""")
def collate_start_stripped(t):
    """The start token 7 goes from conversations whose every turn begins with it."""
    start = F.array(F.when((F.col("role") == "user") | (F.col("conv_id") % 2 == 0), 7).otherwise(8))
    points = F.transform(T.characters(F.col("text")), lambda c: F.ascii(c))
    rows = t("conversations").select("conv_id", "turn", F.concat(start, points).alias("labels"))
    return L.collate(rows, "conv_id", start=7).select("conv_id", "turn", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@query(f"WITH {_CHARS}, {_VOCAB.format(least=1)}, s AS (SELECT lower(token) AS canonical, min(id) AS source_id FROM vocab WHERE trim(token) <> '' GROUP BY 1), b AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM benchmark WHERE text <> '') SELECT token, source_id FROM b JOIN s ON canonical = lower(token)")
def vocabulary_overlap(t):
    """All characters of the benchmark against those of the documents, by their lower case."""
    source = L.vocabulary(t("documents")).withColumn("canonical", F.trim(F.lower("token")))
    token = F.explode(T.characters(F.col("text"))).alias("token")
    target = t("benchmark").where("text <> ''").select(token).distinct().select("token", F.lit(0).alias("id"), F.lower("token").alias("canonical"))
    return L.overlap(source, target).select("token", "source_id")


@query("SELECT DISTINCT source AS token FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'de')")
def special_collisions(t):
    learned = t("documents").select(F.col("source").alias("token")).distinct()
    return L.colliding(learned, t("documents").where("lang = 'de'").select(F.col("source").alias("token")))
