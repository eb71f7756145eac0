"""Merkle manifests against trees built the plain way."""

import hashlib
import itertools
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm import merkle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    """(own place is odd, sibling or '') from below."""
    out = []
    for nodes in levels[:-1]:
        out.append((at % 2, nodes[at ^ 1] if at ^ 1 < len(nodes) else ""))
        at //= 2
    return out


def lead(leaf, steps):
    for odd, other in steps:
        leaf = h(other, leaf) if odd else h(leaf, other)
    return leaf


def brute(rows):
    """rows of (grp, key, leaf, claimed) -> (grp, key, leaf, subroot, root, proof, folded_root)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=str.encode)
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        trees[g] = tree([r[2] for r in groups[g]])
    crown = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(crown, k)
            out.append((*r[:3], trees[g][-1][0], crown[-1][0], [x for _, x in steps if x], lead(r[3], steps)))
    return sorted(out, key=str)


LEAVES = T.StructType([T.StructField("grp", T.StringType()), T.StructField("key", T.LongType()), T.StructField("leaf", T.StringType()), T.StructField("claimed", T.StringType())])


def made(spark, rows, parts=5):
    return merkle.manifest(spark.createDataFrame(rows, LEAVES).repartition(parts))


def test_runs_and_their_missing_nodes():
    """For every run of every small tree the nodes that a multiproof needs are few, enough, and give each proof."""
    for size in (1, 2, 3, 5, 8, 11, 16, 21):
        leaves = [h(str(i)) for i in range(size)]
        levels = tree(leaves)
        nodes = {(k, i): x for k, row in enumerate(levels) for i, x in enumerate(row)}
        for a, b in itertools.combinations(range(size + 1), 2):
            tops = merkle.climb(a, leaves[a:b], size)
            assert all(nodes[k, i] == x for k, i, x in tops)
            fetched = {}
            for k in range(len(levels) - 1):
                low, high = a >> k, (b - 1) >> k
                if low % 2:
                    fetched[k, low - 1] = nodes[k, low - 1]
                if high % 2 == 0 and high + 1 < len(levels[k]):
                    fetched[k, high + 1] = nodes[k, high + 1]
            known = merkle.expand(a, leaves[a:b], size, fetched)
            assert known[-1] == (0, [levels[-1][0]])
            for i in range(a, b):
                assert merkle.path_of(known, i) == [(o if x else 0, x) for o, x in path(levels, i)]
                assert merkle.fold(leaves[i], merkle.path_of(known, i)) == levels[-1][0]


def test_missing_is_minimal(spark):
    rows = [(p, "g", f, n, size, merkle.height(size)) for p, (size, f, n) in enumerate((s, a, b - a) for s in (1, 2, 7, 13) for a, b in itertools.combinations(range(s + 1), 2))]
    df = spark.createDataFrame(rows, "part int, grp string, first bigint, n bigint, size bigint, tallest int")
    got = {}
    for r in merkle.missing(df).collect():
        got.setdefault(r["part"], set()).add((r["level"], r["place"]))
    for p, _, first, n, size, tallest in rows:
        known, want = set(range(first, first + n)), set()
        for level in range(tallest):
            width = (size + (1 << level) - 1) >> level
            need = {i ^ 1 for i in known if i ^ 1 < width} - known
            want |= {(level, i) for i in need}
            known = {i // 2 for i in known}
        assert got.get(p, set()) == want


@pytest.mark.parametrize("levels", [16, 2])
def test_manifest_against_brute_force(spark, monkeypatch, levels):
    """Groups of one to some hundred leaves, repeated and null keys, equal rows; subtrees of two levels take many rounds."""
    monkeypatch.setattr(merkle, "ROUND_LEVELS", levels)
    rng = random.Random(levels)
    rows = []
    for g, n in (("!", 3), ("+", 1), ("+de", 257), ("+en", 64), ("+é", 2), ("+\U0001f600", 7)):
        for i in range(n):
            leaf = h(g, str(rng.randrange(n)))
            rows.append((g, rng.choice([None, *range(n)]), leaf, leaf if rng.random() < 0.8 else h("other")))
    rows += [("+en", 5, h("copy"), h("copy"))] * 40
    got = sorted((tuple(r) for r in made(spark, rows).collect()), key=str)
    assert got == brute(rows)


def test_one_row_and_nothing(spark):
    got = [tuple(r) for r in made(spark, [("+a", 1, h("x"), h("y"))]).collect()]
    assert got == [("+a", 1, h("x"), h("x"), h("x"), [], h("y"))]
    assert made(spark, []).collect() == []


def test_documents_with_nulls_and_other_columns(spark):
    rows = [(1, None, "en", 3, "a:b", "x"), (None, "s", None, None, None, "x"), (2, "", "", 0, "", "x"), (2, "", "", 0, "", "x"), (-7, "é", "en", 1, "中" * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string").repartition(3)
    chosen = F.col("doc_id") == 1

    def leaf(r, more=0):
        fields = (r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4])
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])

    want = brute([("!" if r[2] is None else "+" + r[2], r[0], leaf(r), leaf(r, int(r[0] == 1))) for r in rows])
    got = merkle.document_manifest(df, claim={"n_chars": F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert merkle.document_manifest(df.where("false")).collect() == []


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.SQL["op13_merkle"])
    columns = [d[0] for d in want.description]
    got = queries.op13_merkle(spark, SF).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    for r in got:
        assert r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0)
