"""Merkle manifests against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import merkle as M

SHAPE = "doc_id long, source string, lang string, n_chars long, text string, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return out


def steps(tree, at, arity):
    for level in tree[:-1]:
        run = level[at // arity * arity : at // arity * arity + arity]
        yield run[: at % arity], run[at % arity + 1 :]
        at //= arity


def brute(rows, arity=3):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = levels([leaf(r) for r in groups[name]], arity)
    top = levels([trees[n][-1][0] for n in names], arity)
    out = []
    for g, name in enumerate(names):
        for at, r in enumerate(groups[name]):
            path = [*steps(trees[name], at, arity), *steps(top, g, arity)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            got = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
            for left, right in path:
                got = sha("".join([*left, got, *right]))
            proof = sha("".join(h for left, right in path for h in [*left, *right]))
            out.append((r[0], leaf(r), trees[name][-1][0], top[-1][0], proof, got, got == top[-1][0]))
    return out


def documents(seed, sources, most=40):
    rng, rows = random.Random(seed), []
    for s in sources:
        for _ in range(rng.choice((1, 2, 3, 4, 9, 10, 27, 28, most))):
            text = rng.choice((None, "", "a\nb", "plain", "é\n\n日本", "x" * 5000))
            rows.append((len(rows), s, rng.choice((None, "en", "")), rng.choice((None, 7)), text))
    return rows


def shown(spark, rows, tmp_path):
    path = f"{tmp_path}/{len(rows)}"
    # a clashing column of the same name as one inside the operator
    spark.createDataFrame([(*r, "clash") for r in rows], SHAPE).repartition(5).write.parquet(f"{path}/documents.parquet")
    return sorted([tuple(r) for r in M.op12_merkle(spark, path).collect()], key=str)


@pytest.mark.parametrize("few", [100, 0])
def test_against_plain_python(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(M, "FEW", few)
    rows = documents(few, [None, "", "a", "Z", "é", "ab", "b", "日"], most=100)
    rows += [(None, "a", "en", 1, "no\nid"), (5, "a", "en", 2, "same id"), rows[3], rows[3], (None, None, None, None, None), (None, None, None, None, None)]
    got = shown(spark, rows, tmp_path)
    assert got == sorted(brute(rows), key=str)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(4, "s", "en", 3, "a\nb")], [(4, None, None, None, None)], [(i, str(i), "en", 1, "t\n") for i in range(5)], [(i, "one", "en", 1, "t\n") for i in range(10)]])
def test_small_tables(spark, tmp_path, rows):
    assert shown(spark, rows, tmp_path) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("arity", [2, 5])
def test_other_runs(spark, arity):
    rows = documents(arity, ["a", "b", "c"])
    df = spark.createDataFrame([(*r, None) for r in rows], SHAPE)
    sealed = M.leaf(*[F.col(c) for c in M.FIELDS])
    got = M.manifest(df, sealed, sealed, arity=arity).select("doc_id", *[M.hexed(F.col(c)) for c in ("leaf", "subroot", "root", "folded")]).collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[1], r[2], r[3], r[3]) for r in brute(rows, arity))
