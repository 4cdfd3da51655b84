"""Secret scans with corpus-wide ownership frequency; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import evenly_joined, table, whole_text, written

# The patterns of the base kinds, in the order that breaks ties, and their least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "owned")
#: Least characters: of group 2 of assign, of access, of hex.
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Other tokens that may be credentials: this many characters with a digit, a capital and a small letter.
GENERIC, GENERIC_LEAST = r"[A-Za-z0-9+/_-]{20,}", 20
#: Runs of hex are extracted only where they are long enough; a shorter run is maximal too, so none is lost.
HEX_LONG = r"[0-9a-f]{32,}"
BLOCK = 128


def running_totals(values: Column) -> Column:
    """Inclusive prefix sums of an array of longs, in blocks, so that long arrays stay near linear."""
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    zero = F.lit(0).cast("long")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, lambda s, x: s + x)

    def before(sums: Column) -> Column:
        start = F.array(zero)
        return F.aggregate(sums, start, lambda out, s: F.concat(out, F.array(F.element_at(out, -1) + s)))

    offsets = before(F.transform(blocks, total))
    inner = F.transform(blocks, lambda blk, b: F.transform(blk, lambda x, i: offsets[b] + total(F.slice(blk, F.lit(1), i + 1))))
    return F.when(n > 0, F.flatten(inner)).otherwise(F.array().cast("array<long>"))


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.length(s).cast("long"))


def _candidates(text: Column, kind: int, pattern: str) -> list[tuple[str, Column]]:
    """The columns, to be added one after the other, that end in c<kind>: [start, kind, end, value]."""
    # start of match i = all pieces up to i, and the matches before it
    p, m, ends = f"p{kind}", f"m{kind}", f"e{kind}"
    spans = F.transform(F.col(m), lambda x, i: F.struct((F.col(ends)[i] - F.length(x)).alias("start"), F.lit(kind).alias("kind"), F.col(ends)[i].alias("end"), F.col(f"v{kind}")[i].alias("value")))
    none = F.array().cast("array<string>")
    found = F.size(m) > 0
    return [
        (m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
        (f"v{kind}", F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(2))).otherwise(none) if kind == 0 else F.col(m)),
        (p, F.when(found, F.split(text, pattern, -1)).otherwise(none)),
        (f"l{kind}", F.zip_with(_lengths(F.slice(F.col(p), F.lit(1), F.size(m))), _lengths(F.col(m)), lambda a, b: a + b)),
        (ends, running_totals(F.col(f"l{kind}"))),
        (f"c{kind}", spans),
    ]


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (start, kind, end, ...) in order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _long_enough(least: int) -> Callable[[Column], Column]:
    return lambda s: F.length(s["value"]) >= least


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per row: base spans and generic candidates, with the row's owner and repository.

    Starts and ends are in code points. A generic candidate that touches a base span is no candidate.
    """
    rows = docs.select(F.col("doc_id").cast("long"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), whole_text().alias("text"))
    text = F.col("text")
    keep = ["doc_id", "owner", "repository"]
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX_LONG, GENERIC)):
        for name, column in _candidates(text, kind, pattern):
            rows = rows.withColumn(name, column)
        rows = rows.select(*keep, "text", f"c{kind}")
        keep.append(f"c{kind}")
    least = [LEAST["assign"], LEAST["access"], LEAST["hex"]]
    base = F.concat(*[F.filter(F.col(f"c{k}"), _long_enough(n)) for k, n in enumerate(least)])
    rows = rows.select("doc_id", "owner", "repository", base.alias("base"), "c3")
    mixed = F.filter("c3", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    rows = rows.select("doc_id", "owner", "repository", "base", mixed.alias("c3"))
    free = F.filter("c3", lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.unhex(F.md5(s["value"])).alias("hash"), F.length(s["value"]).cast("long").alias("size")))
    return rows.select("doc_id", "owner", "repository", hashed(F.col("base")).alias("base"), hashed(free).alias("generic"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of candidates(hash, owner, repository), each level pre-aggregated.

    A null owner or repository counts as one value of its own.
    """
    places = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = places.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def held(rows: DataFrame) -> DataFrame:
    """A row for each candidate of rows(uid, owner, repository, base, generic), with its ownership.

    A secret that very many documents hold meets its counts in no one task.
    """
    found = rows.select("uid", "owner", "repository", F.explode(F.concat("base", "generic")).alias("s")).select("uid", "owner", "repository", "s.*")
    counts = ownership(found.select("hash", "owner", "repository"))
    return evenly_joined(found, counts, ["hash"], ["uid", "start"], "inner")


def find_secrets(docs: DataFrame, owner: Column, repository: Column, copied_owners: int = 2) -> DataFrame:
    """Secrets of every whole text, told apart by how many owners hold the same candidate.

    A candidate held by copied_owners owners or more is a widely copied example, any other is specific to
    its owner and looks live. Base spans (assign, access, hex) stay whatever their class;
    generic tokens are added to spans, as kind owned, if they are specific to one owner.
    n_live and n_copied count the candidates of either class, generic ones included;
    max_owners and max_repositories are the largest counts among them, 0 without candidates.

    A null or empty text has no spans. Repeated rows give repeated results and count as one
    place; other columns are ignored; no rows give none.
    """
    rows = written(scan(docs, owner, repository).withColumn("uid", F.monotonically_increasing_id()), "secrets")
    live = F.col("owners") < copied_owners
    by_row = held(rows).groupBy("uid").agg(
        F.collect_list(F.when(live & (F.col("kind") == 3), F.struct("start", "kind", "end"))).alias("owned"),
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_copied"),
        F.max("owners").alias("max_owners"),
        F.max("repositories").alias("max_repositories"),
    )
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    no_spans = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = rows.join(by_row, "uid", "left").select("*", plain.alias("plain"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    rest = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "max_owners", "max_repositories")]
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("plain")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("plain", F.coalesce("owned", no_spans))).alias("spans"), *rest)


def mask_live(docs: DataFrame, owner: Column, repository: Column, copied_owners: int = 2, mask: str = "[secret]") -> DataFrame:
    """docs with the values of all candidates of fewer than copied_owners owners replaced by mask in text.

    Overlapping values are masked once. Every row stays, repeated ones included, and so do all other
    columns; a text without such candidates, null or empty, is unchanged.
    """
    name = next(n for n in (f"uid{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    kept = written(docs.withColumn(name, F.monotonically_increasing_id()), "texts")
    scanned = scan(kept.withColumn("doc_id", F.col(name)), owner, repository).withColumnRenamed("doc_id", "uid")
    # written before anything is asked of the spans: a filter on them would be pushed into the scan and repeat it for every span
    live = held(written(scanned, "secrets")).where(F.col("owners") < copied_owners)
    spans = live.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "end"))).alias("live_spans"))
    both = kept.join(spans.withColumnRenamed("uid", name), name, "left")
    text = F.col("text")

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        piece = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int")), F.lit(mask))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.when(fresh, piece).otherwise(done["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("live_spans", start, step, lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text))))
    return both.select(*[F.when(F.col("live_spans").isNull(), text).otherwise(masked).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document stands for the owner, each of its languages for a repository."""
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


def _sql_kind(kind: int, name: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    value = f"regexp_extract_all(text, '{quoted}', 2)" if kind == 0 else f"regexp_extract_all(text, '{quoted}', 0)"
    return f"""{name} AS (
  SELECT uid, owner, repository, {kind} AS kind, unnest(m) AS m, unnest(v) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s
  FROM (SELECT uid, owner, repository, regexp_extract_all(text, '{quoted}', 0) AS m, {value} AS v, string_split_regex(text, '{quoted}') AS p FROM rows)
  WHERE len(m) > 0)"""


_KIND_SQL = ",\n".join(_sql_kind(k, n, p) for k, (n, p) in enumerate(zip(("k_assign", "k_access", "k_hex", "k_generic"), (ASSIGN, ACCESS, HEX, GENERIC), strict=True)))
ORACLE = f"""
WITH rows AS (SELECT row_number() OVER () AS uid, doc_id, source AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS text FROM documents),
{_KIND_SQL},
base AS (
  SELECT uid, owner, repository, kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, v FROM (
    SELECT * FROM k_assign WHERE length(v) >= 8 UNION ALL SELECT * FROM k_access WHERE length(v) >= 16 UNION ALL SELECT * FROM k_hex WHERE length(v) >= 32)),
generic AS (
  SELECT uid, owner, repository, kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e, v FROM k_generic g
  WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.uid = g.uid AND g.s < b.e AND b.s < g.s + length(g.m))),
found AS (SELECT * FROM base UNION ALL SELECT * FROM generic),
held AS (SELECT v, count(DISTINCT coalesce(owner, chr(0))) AS owners, count(DISTINCT struct_pack(o := owner, r := repository)) AS repositories FROM found GROUP BY v),
named AS (
  SELECT uid, kind, s, e, owners, repositories, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e AS span
  FROM found JOIN held USING (v)),
by_row AS (
  SELECT uid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base_spans,
    string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3 OR owners < 2) AS spans,
    count(*) FILTER (owners < 2) AS n_live, count(*) FILTER (owners >= 2) AS n_copied,
    max(owners) AS max_owners, max(repositories) AS max_repositories
  FROM named GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  coalesce(max_owners, 0) AS max_owners, CAST(coalesce(max_repositories, 0) AS BIGINT) AS max_repositories
FROM rows LEFT JOIN by_row USING (uid)
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_secrets": op2_secrets}
ORACLES: dict[str, str] = {"op2_secrets": ORACLE}
