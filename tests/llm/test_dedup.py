"""Exact, line and near deduplication against brute force."""

import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.llm import exactdedup, linededup, queries, simhash
from trackloom.llm.common import components
from trackloom.llm.fingerprints import fingerprint

from .conftest import AWKWARD

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- exact


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def exact_brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(ascii_lower(text), []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        same = groups[ascii_lower(text)]
        ids = [x for x in same if x is not None]
        keep = max(ids) if ids else None
        out.append((doc_id, keep, len(same), doc_id is not None and doc_id == keep, hashlib.sha256(ascii_lower(text).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups_of_awkward_rows(docs):
    assert rows_of(exactdedup.exact_groups(docs(AWKWARD))) == exact_brute(AWKWARD)


@pytest.mark.parametrize("bits", [0, 2])
def test_exact_groups_survive_collisions(docs, bits):
    """A digest of few or no bits puts different texts under one hash; the bytes tell them apart."""
    found = exactdedup.exact_groups(docs(AWKWARD), digest=lambda t: F.pmod(F.xxhash64(t), F.lit(1 << bits)))
    assert rows_of(found) == exact_brute(AWKWARD)


def test_exact_groups_of_nothing(docs):
    assert exactdedup.exact_groups(docs([])).collect() == []


def test_ascii_lower_changes_ascii_only(spark):
    text = "AZaz ÄÉİΣǅⅣ +%41 %c3 \U0001f600"
    row = spark.createDataFrame([(text,)], "t string").select(exactdedup.ascii_lower(F.col("t"))).first()
    assert row[0] == ascii_lower(text)


@pytest.mark.parametrize("name", ["op7_exact_dedup", "op9_chat_format"])
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert rows_of(got) == sorted(want.fetchall(), key=str)


# ---- components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    edges += [(5000, 5001 + i) for i in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in list(parent)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# ---- near


def near_brute(rows, tau=2):
    prints = [fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= tau and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        value = prints[i] - (1 << 64) if prints[i] >> 63 else prints[i]
        out.append((doc_id, value, min(ids) if ids else None))
    return sorted(out, key=str)


def test_fingerprint_by_hand():
    import xxhash

    words = ["the", "quick", "brown", "fox", "the", "quick", "brown"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)
    assert fingerprint("The quick\tBROWN fox\n the quick brown") == want
    assert fingerprint("Two words") == xxhash.xxh64_intdigest("two words", 42)
    assert fingerprint(" \n") == fingerprint(None) == 0


def test_fingerprint_hash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("two words"))).first()
    assert row[0] % (1 << 64) == fingerprint("two words")


def test_near_groups_of_awkward_rows(docs):
    assert rows_of(simhash.near_groups(docs(AWKWARD))) == near_brute(AWKWARD)


def test_near_groups_of_nothing(docs):
    assert simhash.near_groups(docs([])).collect() == []


def test_near_groups_of_edited_copies(docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 150, 600]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + family, " ".join(copy)))
    assert rows_of(simhash.near_groups(docs(rows))) == near_brute(rows)


@pytest.mark.parametrize("tau", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("spread", ["even", "skewed"])
def test_links_are_complete(spark, tau, spread):
    """All pairs within tau and no others, with values that agree in many bits and values that do not."""
    rng = random.Random(tau)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64) if spread == "even" else rng.getrandbits(12) * 0x0010_0100_1001_0011 % (1 << 64)
        values.add(base)
        for _ in range(4):
            near = base
            for _ in range(rng.randrange(1, 6)):
                near ^= 1 << rng.randrange(64)
            values.add(near)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= tau}
    found = simhash.hamming_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), tau).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


@pytest.mark.parametrize("rows", [1, 1000, 10**7, 10**10])
def test_plans_satisfy_the_pigeonhole_principle(rows):
    import numpy as np

    sample = np.random.default_rng(1).integers(0, 1 << 63, 2000, dtype=np.uint64)
    for tau in (0, 2, 3):
        probes = simhash.plan_probes(sample, rows, tau)
        # the thresholds of all m partitions sum to tau - m + 1, unprobed ones counting -1: so do the probed ones alone
        assert sum(p.threshold + 1 for p in probes) == tau + 1
        assert all(a.mask & b.mask == 0 for i, a in enumerate(probes) for b in probes[:i])


def test_drop_near_duplicates_keeps_one(docs):
    kept = simhash.drop_near_duplicates(docs(AWKWARD))
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    want = sorted((d for d, _, c in near_brute(AWKWARD) if d is None or d == c), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want


# ---- lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines_brute(rows, tau=2, min_chars=20, near_chars=40):
    """Dropped line numbers by document, ids being unique."""
    seen, out = [], []
    for doc_id, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        gone = []
        lines = (text or "").split("\n")
        for pos, line in enumerate(x.strip(" ") for x in lines):
            if len(line) < min_chars:
                continue
            near = [s for s in seen if s == line or len(s) >= near_chars and len(line) >= near_chars and abs(len(s) - len(line)) <= tau and edits(s, line) <= tau]
            if near:
                gone.append(pos)
            if line not in seen:
                seen.append(line)
        out.append((doc_id, len(lines), gone))
    out += [(None, len((r[1] or "").split("\n")), []) for r in rows if r[0] is None]
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé \U0001f600") for _ in range(rng.randrange(1, 9)))
    pool = [" ".join(word() for _ in range(rng.choice([2, 6, 12, 30]))) for _ in range(40)]
    rows = []
    for doc_id in range(0, 60, 2):
        lines = []
        for _ in range(rng.randrange(9)):
            line = rng.choice(pool)
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(line) + 1)
                line = rng.choice([line[:at] + "q" + line[at:], line[:at] + line[at + 1 :], line[:at] + "z" + line[at + 1 :]])
            lines.append(line + rng.choice(["", " ", "\r"]))
        rows.append((doc_id, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_line_decisions_against_brute_force(docs, tau):
    rows = line_rows() + [(-5, None), (1001, ""), (None, "a line that has no document id at all, which stays")]
    got = sorted(((r[0], r[1], r[2]) for r in linededup.line_decisions(docs(rows), tau=tau).collect()), key=str)
    assert got == lines_brute(rows, tau)


def test_lines_of_awkward_rows(docs):
    rows = [r for i, r in enumerate(AWKWARD) if r[0] not in [x[0] for x in AWKWARD[:i]] or r[0] is None]
    got = sorted(((r[0], r[1], r[2]) for r in linededup.line_decisions(docs(rows)).collect()), key=str)
    assert got == lines_brute(rows)
    assert linededup.line_decisions(docs([])).collect() == []
    assert linededup.drop_repeated_lines(docs([])).collect() == []
    # rows that repeat an id do not fail
    assert linededup.line_decisions(docs(AWKWARD)).count() == len(AWKWARD)


def test_texts_are_rebuilt_without_the_dropped_lines(docs):
    rows = line_rows() + [(-5, None), (None, "x")]
    gone = {d: g for d, _, g in lines_brute(rows)}
    want = []
    for doc_id, text, *_ in rows:
        lines = [x for i, x in enumerate((text or "").split("\n")) if i not in gone[doc_id]]
        want.append((doc_id, text if not gone[doc_id] else "\n".join(lines), "en", "x"))
    found = linededup.drop_repeated_lines(docs(rows))
    assert found.columns == ["doc_id", "text", "lang", "score"]
    assert rows_of(found) == sorted(want, key=str)


@pytest.mark.parametrize("tau", [0, 1, 2, 4])
def test_within_edits(spark, tau):
    rng = random.Random(tau)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choice("abc\U0001f600") for _ in range(rng.randrange(12)))
        b = a
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b = rng.choice([b[:at] + "x" + b[at:], b[:at] + b[at + 1 :], b[:at] + "c" + b[at + 1 :]])
        pairs.append((a, b))
    df = spark.createDataFrame([(list(a), list(b), a, b) for a, b in pairs], "a array<string>, b array<string>, s string, t string")
    for r in df.withColumn("near", linededup.within_edits(F.col("a"), F.col("b"), tau)).collect():
        assert r["near"] == (edits(r["s"], r["t"]) <= tau), (r["s"], r["t"])


def test_hot_line(docs):
    """One line in every document stays once, and its copies make no pairs."""
    line = "the very same line in all of the documents of this table"
    found = linededup.line_decisions(docs([(i, f"{line}\nshort {i}") for i in range(300)])).collect()
    assert sorted((r["doc_id"], r["dropped"]) for r in found) == [(i, [0] if i else []) for i in range(300)]


def test_columns_of_any_name(spark):
    """Stages keep columns that are named like their own."""
    from trackloom.llm import nearsets

    names = ["_id", "_kept", "_gone", "gone", "lost", "lost_id", "_lines", "doc id"]
    line = "a line of more than forty characters that repeats"
    rows = [(i, f"{line}\nown {i} and some more words here {i}", *["v"] * len(names)) for i in range(3)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in [("doc_id", "bigint"), ("text", "string"), *[(n, "string") for n in names]]))
    shorter = linededup.drop_repeated_lines(df)
    assert shorter.columns == df.columns
    assert sorted(r["text"].count(line) for r in shorter.collect()) == [0, 0, 1]
    for stage in (nearsets, simhash):
        left = stage.drop_near_duplicates(df.unionByName(df.withColumn("doc_id", F.col("doc_id") + 10)))
        assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} <= {0, 1, 2}
