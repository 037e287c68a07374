import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tandem.llm import manifest

from .helper import same_as_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + add, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes, fanout):
    """Root, and for each leaf its steps (before, after)."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for i, a in enumerate(at):
            run, slot = runs[a // fanout], a % fanout
            steps[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[i] = a // fanout
        level = [h(*r) for r in runs]
    return level[0], steps


def by_hand(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of each row."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], fanout)
    root, above = tree([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, above):
        for r, steps in zip(groups[g], trees[g][1]):
            acc = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for before, after in [*steps, *up]:
                acc = h(before, acc, after)
            out.append((r[0], leaf(r), trees[g][0], root, h(*(b + a for b, a in [*steps, *up])), acc, acc == root))
    return sorted(out, key=repr)


def drawn(n):
    langs = ["en"] * 6 + ["de", "fr", None, "", "日本"]
    rows = [(i * 3 % 1009, f"text é {i}" if i % 9 else None, langs[i * i % 11], None if i % 5 == 0 else f"s{i % 3}", None if i % 6 == 0 else i) for i in range(n)]
    return rows + [(2000 + i, "", f"own{i}", "s", 0) for i in range(min(n, 4))]


def test_query_and_sql_and_plain_python(spark, tmp_path):
    for n in (1, 120):
        rows = drawn(n)
        assert same_as_sql(spark, tmp_path, {"documents": (rows, SCHEMA)}, manifest.op11_sibling_manifest, manifest.SQL) == len(rows)
        got = manifest.op11_sibling_manifest(spark, str(tmp_path)).collect()
        assert sorted((tuple(r) for r in got), key=repr) == by_hand(rows)
        assert n < 40 or {r.verified for r in got} == {True, False}


def test_nulls_repeated_rows_clashes_and_empty_tables(spark):
    rows = [(None, "a", "en", None, None), (None, "a", "en", None, None), (1, "b", "en", "s", 1), (1, "c", "en", "s", 1), (1, "c", "en", "s", 1), (49, None, None, None, None)]
    df = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", root string").withColumn("idx", F.lit(7))
    got = manifest.manifest(df, "lang")
    assert {"root_0", "idx_0", "root", "text"} <= set(got.columns)
    found = got.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("path")), 256), manifest.fold(F.col("leaf"), F.col("path")), F.col("root_0")).collect()
    assert sorted((tuple(r[:5]) for r in found), key=repr) == sorted((x[:5] for x in by_hand(rows)), key=repr)
    assert all(r[5] == r[3] and r[6] == "own" for r in found)
    assert manifest.manifest(df.limit(0), "lang").count() == 0


@pytest.mark.parametrize("fanout", [3, 7])
def test_other_fanouts(spark, fanout):
    rows = drawn(60)
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA), "lang", fanout=fanout)
    found = got.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("path")), 256), manifest.fold(F.col("leaf"), F.col("path")).alias("f")).collect()
    assert sorted((tuple(r[:5]) for r in found), key=repr) == sorted((x[:5] for x in by_hand(rows, fanout)), key=repr)
    assert all(r.f == r.root for r in found)


def test_any_change_is_seen(spark):
    rows = drawn(12)
    roots = {manifest.manifest(spark.createDataFrame(r, SCHEMA), "lang", columns=["doc_id"]).first().root for r in (rows, rows[::-1], rows[:-1], [(*rows[0][:1], "other", *rows[0][2:]), *rows[1:]])}
    assert len(roots) == 3  # the order of rows alone changes nothing
    with pytest.raises(ValueError):
        manifest.manifest(spark.createDataFrame(rows, SCHEMA), "lang", fanout=1)


def test_very_long_texts(spark):
    rows = [(1, "é" * 500_000, "en", "s", 500_000), (2, "x" * 1_000_000, "en", "s", 1)]
    got = manifest.manifest(spark.createDataFrame(rows, SCHEMA), "lang", columns=["doc_id"]).collect()
    assert {r.doc_id: r.leaf for r in got} == {r[0]: leaf(r) for r in rows}
