"""Decoding, error rates and vectors over conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decoding as D
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import vectors as V
from ..sources import audio as A
from .common import Catalogue

_C = Catalogue()
query, QUERIES, ORACLES = _C.query, _C.queries, _C.oracles

_FRAMES = "f AS (SELECT vec_id, list_transform(range(0, 16), lambda i: CAST(list_position(embedding[i * 4 + 1:i * 4 + 4], list_max(embedding[i * 4 + 1:i * 4 + 4])) - 1 AS INTEGER)) AS ids FROM embeddings)"
_COLLAPSE = "list_filter(list_filter(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i > 1 AND ids[i] = ids[i - 1] THEN -1 ELSE ids[i] END), lambda x: x <> -1), lambda x: x <> 0)"


def _frames(t):
    """Embeddings read as 16 frames of 4 scores; the best score of each frame."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)))
    return t("embeddings").select("vec_id", cut.alias("frames")).select("vec_id", F.transform("frames", L.argmax).alias("ids"))


def _list(ids):
    return F.array_join(ids.cast("array<string>"), ",")


@query(f"WITH {_FRAMES} SELECT vec_id, array_to_string(ids, ',') AS ids FROM f")
def argmax_frames(t):
    return _frames(t).select("vec_id", _list(F.col("ids")).alias("ids"))


@query(f"WITH {_FRAMES} SELECT vec_id, array_to_string({_COLLAPSE}, ',') AS ids FROM f")
def ctc_collapse(t):
    return _frames(t).select("vec_id", _list(L.collapse(F.col("ids"))).alias("ids"))


@query(f"WITH {_FRAMES} SELECT vec_id, replace(array_to_string(list_transform({_COLLAPSE}, lambda x: ['', 'a', '|', 'b'][x + 1]), ''), '|', ' ') AS decoded FROM f")
def ctc_decode(t):
    tokens = F.array(*map(F.lit, ["", "a", "|", "b"]))
    return _frames(t).select("vec_id", L.decode(L.collapse(F.col("ids")), tokens).alias("decoded"))


@query(f"WITH {_FRAMES} SELECT vec_id, array_to_string(list_filter(ids, lambda x: x NOT IN (0, 2)), ',') AS ids FROM f")
def drop_special_ids(t):
    return _frames(t).select("vec_id", _list(L.drop_special(F.col("ids"), [0, 2])).alias("ids"))


@query(f"WITH {_FRAMES} SELECT vec_id, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 3 THEN 0 ELSE x END), ',') AS padded, array_to_string(list_filter(ids, lambda x: x <> 3), ',') AS dropped FROM f")
def strip_sentinel(t):
    masked = F.transform("ids", lambda x: F.when(x == 3, F.lit(-100)).otherwise(x))
    return _frames(t).select("vec_id", _list(L.mask_to_pad(masked)).alias("padded"), _list(F.array_remove(masked, -100)).alias("dropped"))


@query(f"WITH {_FRAMES}, c AS (SELECT vec_id, {_COLLAPSE} AS ids FROM f), w AS (SELECT max(len(ids)) AS longest FROM c) SELECT vec_id, array_to_string(list_concat(ids, list_transform(range(len(ids), longest), lambda x: -100)), ',') AS labels FROM c, w")
def pad_labels(t):
    short = _frames(t).select("vec_id", L.collapse(F.col("ids")).alias("ids"))
    longest = short.agg(F.max(F.size("ids")).alias("longest"))
    return short.join(F.broadcast(longest)).select("vec_id", _list(L.pad_to(F.col("ids"), F.col("longest"))).alias("labels"))


def _pairs(t):
    """Turn k of a conversation as reference, turn k + 1 as hypothesis."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    short = T.flatten_whitespace(F.col("text"))
    return t("conversations").select("conv_id", "turn", "role", short.alias("reference")).withColumn("hypothesis", F.lead("reference").over(w)).where("hypothesis is not null")


_P = f"""c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[{T.WS}]+', ' ', 'g')) AS reference FROM conversations),
p AS (SELECT * FROM (SELECT *, lead(reference) OVER (PARTITION BY conv_id ORDER BY turn) AS hypothesis FROM c) WHERE hypothesis IS NOT NULL)"""


def _dp(split: str) -> str:
    """Edit distance of two lists, row by row; sequences a (reference) and b (hypothesis)."""
    return f"""s AS (SELECT conv_id, turn, role, reference, {split.format('reference')} AS a, {split.format('hypothesis')} AS b FROM p),
d AS (SELECT conv_id, turn, 0 AS i, range(0, len(b) + 1) AS r FROM s
 UNION ALL SELECT d.conv_id, d.turn, d.i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [least(r[j + 1] + 1, r[j] + CASE WHEN a[d.i + 1] = b[j] THEN 0 ELSE 1 END)]), lambda x, y: list_append(x, least(y[1], x[-1] + 1)), CAST([d.i + 1] AS BIGINT[])) FROM d JOIN s ON d.conv_id = s.conv_id AND d.turn = s.turn WHERE d.i < len(a)),
e AS (SELECT s.conv_id, s.turn, role, reference, CAST(len(a) AS BIGINT) AS n, CASE WHEN reference = '' THEN 0 ELSE CAST(r[-1] AS BIGINT) END AS edits FROM s JOIN d ON d.conv_id = s.conv_id AND d.turn = s.turn AND d.i = len(a))"""


_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"


@query(f"WITH RECURSIVE {_P}, {_dp(_WORDS)} SELECT conv_id, turn, n AS ref_words, edits AS word_edits FROM e")
def word_errors(t):
    return M.error_counts(_pairs(t)).select("conv_id", "turn", "ref_words", "word_edits")


# DuckDB's edit distance counts bytes, so each of the corpus's characters becomes one ASCII character first: this SQL, not the
# operator, holds for corpora of fewer than 127 distinct characters.
_ASCII = f"""{_P}, k AS (SELECT string_agg(ch, '' ORDER BY ch) AS every, string_agg(chr(CAST(n AS INTEGER)), '' ORDER BY ch) AS plain FROM (SELECT ch, row_number() OVER (ORDER BY ch) AS n FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM conversations WHERE text <> ''))),
ce AS (SELECT conv_id, turn, role, length(reference) AS ref_chars, CASE WHEN reference = '' THEN 0 ELSE levenshtein(translate(reference, every, plain), translate(hypothesis, every, plain)) END AS char_edits FROM p, k)"""


@query(f"WITH {_ASCII} SELECT conv_id, turn, ref_chars, char_edits FROM ce")
def char_errors(t):
    return M.error_counts(_pairs(t)).select("conv_id", "turn", "ref_chars", "char_edits")


@query(f"WITH {_ASCII} SELECT CAST(sum(ref_chars) AS BIGINT) AS ref_chars, CAST(sum(char_edits) AS BIGINT) AS char_edits, sum(char_edits) / CAST(sum(ref_chars) AS DOUBLE) AS cer FROM ce")
def corpus_cer(t):
    return M.error_rates(M.error_counts(_pairs(t))).select("ref_chars", "char_edits", "cer")


@query(f"WITH {_P} SELECT CAST(0 AS BIGINT) AS ref_words, 1.0::DOUBLE AS wer, 1.0::DOUBLE AS cer FROM p WHERE reference = 'no such turn' HAVING count(*) = 0")
def rates_without_references(t):
    """Without references both rates are 1."""
    return M.error_rates(M.error_counts(_pairs(t).where("reference = 'no such turn'"))).select("ref_words", "wer", "cer")


@query(f"WITH RECURSIVE {_P}, {_dp(_WORDS)} SELECT CAST(sum(n) AS BIGINT) AS ref_words, CAST(sum(edits) AS BIGINT) AS word_edits, sum(edits) / CAST(sum(n) AS DOUBLE) AS wer FROM e")
def corpus_wer(t):
    return M.error_rates(M.error_counts(_pairs(t))).select("ref_words", "word_edits", "wer")


@query(f"WITH RECURSIVE {_P}, {_dp(_WORDS)} SELECT role, CAST(sum(n) AS BIGINT) AS ref_words, CAST(sum(edits) AS BIGINT) AS word_edits, sum(edits) / CAST(sum(n) AS DOUBLE) AS wer FROM e GROUP BY role")
def wer_by_group(t):
    return M.error_rates(M.error_counts(_pairs(t)), "role").select("role", "ref_words", "word_edits", "wer")


@query(f"WITH RECURSIVE {_P}, {_dp(_WORDS)} SELECT e.conv_id, e.turn, edits AS total, n - len({_WORDS.format('hypothesis')}) AS deletions_less_insertions FROM e JOIN p ON e.conv_id = p.conv_id AND e.turn = p.turn")
def word_alignment(t):
    split = M.alignment(F.col("reference"), F.col("hypothesis"))
    return _pairs(t).select("conv_id", "turn", split.alias("x")).select("conv_id", "turn", F.expr("x.substitutions + x.deletions + x.insertions").alias("total"), F.expr("x.deletions - x.insertions").alias("deletions_less_insertions"))


def _tokens(t):
    return t("embeddings").select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("token"), "vec_id", "label", F.col("embedding").alias("vector"))


@query("""WITH s AS (SELECT 't' || doc_id AS token, list(quality ORDER BY quality, toxic) AS v FROM labels GROUP BY doc_id)
SELECT 't' || vec_id AS token, md5(array_to_string(coalesce(v, list_transform(embedding, lambda x: CAST(floor(x * 1000) AS BIGINT))), ',')) AS vector_md5, v IS NOT NULL AS restored FROM embeddings LEFT JOIN s ON s.token = 't' || vec_id""")
def embedding_restore(t):
    """Vectors by token; where a label has the number, its own short vector is put in place.

    Components are multiplied in their own precision, as in the SQL: a product that rounds up to a whole number counts as that number.
    """
    target = _tokens(t).select("token", F.transform("vector", lambda x: F.floor(x.cast("float") * F.lit(1000).cast("float"))).alias("vector"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("quality", "toxic"))), lambda r: r["quality"].cast("long"))
    source = t("labels").groupBy("doc_id").agg(listed.alias("vector")).select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("token"), "vector")
    return V.restore(target, source).select("token", F.md5(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary")).alias("vector_md5"), "restored")


_ANCHOR = "anchor AS (SELECT label, embedding AS av FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k = 1)"


def _scored(t):
    """Every vector's cosine with its label's first vector, which a label finds by one aggregation."""
    anchor = t("embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("av"))
    return t("embeddings").join(anchor, "label").select("vec_id", "label", V.cosine(F.col("embedding"), F.col("av")).alias("score"), F.col("embedding").alias("vector"))


@query(f"WITH {_ANCHOR} SELECT vec_id, e.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(av AS DOUBLE[])), 6) AS score FROM embeddings e JOIN anchor a ON a.label = e.label")
def anchor_cosine(t):
    return _scored(t).select("vec_id", "label", F.round("score", 6).alias("score"))


_SPARSE = f"""{_ANCHOR}, s AS (SELECT vec_id, e.label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(av AS DOUBLE[])) AS score, embedding FROM embeddings e JOIN anchor a ON a.label = e.label),
r AS (SELECT *, row_number() OVER w AS k, sum(score) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC)),
z AS (SELECT label, max(k) AS n FROM r WHERE 1 + k * score > c GROUP BY label),
x AS (SELECT r.vec_id, r.label, r.embedding, greatest(score - (q.c - 1) / n, 0) AS weight FROM r JOIN z ON z.label = r.label JOIN (SELECT r.label, r.c FROM r JOIN z ON z.label = r.label AND r.k = z.n) q ON q.label = r.label)"""


@query(f"WITH {_SPARSE} SELECT vec_id, label, round(weight, 6) AS weight FROM x")
def sparsemax_weights(t):
    return V.sparsemax(_scored(t), "label", "score").select("vec_id", "label", F.round("weight", 6).alias("weight"))


@query(f"WITH {_SPARSE} SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(sum(weight * CAST(embedding[pos] AS DOUBLE)), 4) AS value FROM x, (SELECT unnest(range(1, 65)) AS pos) WHERE weight > 0 GROUP BY label, pos")
def sparsemax_combine(t):
    weights = V.sparsemax(_scored(t), "label", "score").select("vec_id", "label", "weight")
    out = V.combine(weights, t("embeddings").select("vec_id", F.col("embedding").alias("vector")), "label", "vec_id")
    return out.select("label", "pos", F.round("value", 4).alias("value"))


def _weights_sql(replicates: int) -> str:
    limits = ", ".join(map(str, M.POISSON))
    return f"""u AS (SELECT e.*, r.r AS replicate, CAST('0x' || substr(md5('4:' || (r.r // 8) || ':' || conv_id || '/' || turn), CAST(1 + 4 * (r.r % 8) AS INTEGER), 4) AS INTEGER) AS x FROM ce e, range({replicates}) r(r)),
b AS (SELECT role, CAST(replicate AS INTEGER) AS replicate, CAST(sum(len(list_filter([{limits}], lambda l: x >= l)) * char_edits) AS BIGINT) AS errors, CAST(sum(len(list_filter([{limits}], lambda l: x >= l)) * ref_chars) AS BIGINT) AS total FROM u GROUP BY role, replicate)"""


def _resampled(t):
    """Character errors of every turn, drawn again for 40 corpora a role."""
    counted = M.error_counts(_pairs(t)).withColumn("pair", F.concat_ws("/", "conv_id", "turn"))
    return M.bootstrap(counted, "pair", "char_edits", "ref_chars", "role", seed=4)


@query(f"WITH {_ASCII}, {_weights_sql(40)} SELECT role, replicate, errors, total, errors / CAST(total AS DOUBLE) AS rate FROM b")
def cer_bootstrap(t):
    return _resampled(t)


@query(f"WITH {_ASCII}, {_weights_sql(40)} SELECT role, round(quantile_cont(errors / CAST(total AS DOUBLE), 0.025), 9) AS low, round(quantile_cont(errors / CAST(total AS DOUBLE), 0.975), 9) AS high FROM b GROUP BY role")
def cer_intervals(t):
    return M.intervals(_resampled(t), "role").select("role", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query()
def beam_decode(t):
    """The best labelling of each vector's 16 frames by prefix beams; tests compare it with the sum over all paths."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, F.lit(4)))
    found = D.beam_decode(t("embeddings").select("vec_id", cut.alias("frames")), "frames", 4, width=24)
    return found.select("vec_id", _list(F.col("labels")).alias("ids"), F.round("log_prob", 6).alias("log_prob"))


def _wav(body):
    """A WAV file of 8-bit samples at 8 kHz around the bytes of body."""
    little = lambda n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 8, "0"), i, 2) for i in (7, 5, 3, 1)]))
    head = bytearray(b"WAVEfmt \x10\0\0\0\x01\0\x01\0\x40\x1f\0\0\x40\x1f\0\0\x01\0\x08\0data")
    size = F.octet_length(body).cast("long")
    return F.concat(F.lit(bytearray(b"RIFF")), little(size + 36), F.lit(head), little(size), body)


@query("""WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents) SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS input_length,
CAST(coalesce(list_sum(list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS INTEGER) - 128)), 0) AS BIGINT) AS level FROM h""")
def pcm_decode(t):
    """Every text's bytes as the samples of a WAV file, decoded."""
    rows = A.with_waveforms(t("documents").select("doc_id", _wav(F.encode("text", "UTF-8")).alias("content")), 8000)
    level = F.aggregate("features", F.lit(0).cast("long"), lambda x, y: x + F.round(y * 128).cast("long"))
    return rows.select("doc_id", "input_length", F.coalesce(level, F.lit(0)).cast("long").alias("level"))


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text)) * 441 / 320.0) AS BIGINT) AS input_length FROM documents")
def pcm_resample(t):
    """The same files at 11,025 Hz; tests compare the samples with closed forms."""
    rows = A.with_waveforms(t("documents").select("doc_id", _wav(F.encode("text", "UTF-8")).alias("content")), 11025)
    return rows.select("doc_id", "input_length")
