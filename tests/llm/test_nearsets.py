"""Near duplicates by shingle sets against brute force."""

import random
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import nearsets

from .conftest import AWKWARD


def groups_brute(rows, share=Fraction(4, 5)):
    sets = [frozenset(nearsets.shingle_set(t, 5).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a & b and Fraction(len(a & b), len(a | b)) >= share:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {d: min(rows[j][0] for j in range(len(rows)) if group[j] == group[i]) for i, (d, _) in enumerate(rows)}


def edited_copies(seed, families=8, copies=12):
    """Families of texts with up to a tenth of their words replaced, and a passage that all of them have."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for family in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 60, 300]))] + shared * (family % 2)
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + family, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_complete(docs, seed):
    rows = edited_copies(seed)
    found = {r["doc_id"]: r["component_id"] for r in nearsets.near_groups(docs(rows)).collect()}
    assert found == groups_brute(rows)


def test_order_of_shingles_does_not_change_groups(docs, monkeypatch):
    rows = edited_copies(3, families=4)
    monkeypatch.setattr(nearsets, "COMMON", 5)
    found = {r["doc_id"]: r["component_id"] for r in nearsets.near_groups(docs(rows)).collect()}
    assert found == groups_brute(rows)


def test_stage_drops_copies_with_small_edits(spark, docs):
    """One word of 200 replaced: the 64-bit fingerprints differ in more than 2 bits, 0.95 of the shingles are shared."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(2000)}" for _ in range(200)]
    rows = [(1, " ".join(words))] + [(i, " ".join([*words[: i * 9], "other", *words[i * 9 + 1 :]])) for i in range(2, 12)]
    rows.append((50, " ".join(reversed(words))))
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs(rows), "").collect()) == [1, 50]


def test_awkward_rows(docs):
    kept = nearsets.drop_near_duplicates(docs(AWKWARD))
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    # 1, 2 and 3 have no words; 6, 7 and 8 have the same ones
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 4, 5, 6, 9, 10, None, -3, 12, 13], key=str)
    assert nearsets.drop_near_duplicates(docs([])).collect() == []


def test_parity_never_shows_more_differences_than_there_are():
    rng = random.Random(4)
    for size in (0, 1, 30, 500):
        whole = nearsets.shingle_set(" ".join(f"w{rng.randrange(10_000)}" for _ in range(size)), 5)
        for kept in (0, size // 2, len(whole)):
            # other shingles in the place of those that go
            other = nearsets.shingle_set(" ".join(f"v{rng.randrange(10_000)}" for _ in range(size - kept)), 5)
            both = np.unique(np.concatenate([whole[:kept], other]))
            bits = sum(int(x).bit_count() for x in (nearsets.parity(whole) ^ nearsets.parity(both)).view(np.uint64))
            differ = len(np.setxor1d(whole, both))
            assert bits <= differ and bits % 2 == differ % 2


def test_crowded_key_with_texts_that_are_not_near(docs):
    """All texts have one long passage, so all meet under its shingles; only the planted copies are near."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*passage, *(f"w{rng.randrange(5000)}" for _ in range(60))])) for i in range(0, 120, 2)]
    rows += [(d + 1, t + " end") for d, t in rows[:10]]
    found = {r["doc_id"]: r["component_id"] for r in nearsets.near_groups(docs(rows)).collect()}
    assert found == groups_brute(rows)
    assert len(set(found.values())) == 60


def test_stage_drops_by_fingerprints_too(spark, docs):
    """Fingerprints within 2 bits, though less than 0.8 of the five-word shingles are shared."""
    from trackloom.llm.fingerprints import fingerprint

    base = " ".join(["a b c d e f g h i j k"] * 30)
    other = base + " x y"
    distant = base + " " + " ".join(f"w{i}" for i in range(9))
    texts = {3: base, 5: other, 9: distant}
    prints = {d: fingerprint(t, 3, 42) for d, t in texts.items()}
    assert (prints[3] ^ prints[9]).bit_count() <= 2
    sets = {d: set(nearsets.shingle_set(t, 5)) for d, t in texts.items()}
    assert len(sets[3] & sets[9]) < 0.8 * len(sets[3] | sets[9])
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    assert [r["doc_id"] for r in nearsets.drop_near_duplicates(docs([(3, base), (9, distant)])).collect()] != [3]
    assert [r["doc_id"] for r in stage(spark, docs(sorted(texts.items())), "").collect()] == [3]


def test_long_parity_never_shows_more_differences_than_there_are():
    rng = random.Random(5)
    sets = []
    for size in (0, 1, 200, 256, 257, 700, 3000):
        whole = nearsets.shingle_set(" ".join(f"w{rng.randrange(10_000)}" for _ in range(size)), 5)
        sets += [whole, whole[: len(whole) * 9 // 10], np.sort(np.concatenate([whole[: len(whole) // 2], whole[:7] + 1]))]
    for a in sets:
        for b in sets:
            bits, differ = nearsets.apart(nearsets.long_parity(a), nearsets.long_parity(b)), len(np.setxor1d(a, b))
            assert bits <= differ and (bits - differ) % 2 == 0
    assert nearsets.apart(nearsets.long_parity(sets[-6]), nearsets.long_parity(sets[-3])) > 300


def test_whole_sets_go_to_pairs_that_are_about_as_near(docs, monkeypatch):
    """Long texts that meet under a few shingles, where 256 bits tell nothing."""
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([*(f"w{rng.randrange(50_000)}" for _ in range(1200)), *passage])) for i in range(0, 60, 2)]
    rows += [(d + 1, t + " end") for d, t in rows[:3]]
    counts, plain = {}, nearsets.settle

    def counted(df, label="table", **more):
        made = plain(df, label, **more)
        counts[label] = max(counts.get(label, 0), made.count())
        return made

    monkeypatch.setattr(nearsets, "settle", counted)
    monkeypatch.setattr(nearsets, "COMMON", 1)  # the passage is not known to be common
    found = {r["doc_id"]: r["component_id"] for r in nearsets.near_groups(docs(rows)).collect()}
    assert found == groups_brute(rows)
    assert len(set(found.values())) == 30 and counts["met-pairs"] > 20
    assert counts["whole-sets"] <= 6


def test_sets_without_one_of_their_size_under_a_key_do_not_meet(docs, monkeypatch):
    """A passage in texts of quite different lengths leads to no meetings."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([*passage, *(f"w{rng.randrange(50_000)}" for _ in range(50 * 3**i))])) for i in range(4)]
    rows += [(10, rows[0][1] + " end"), (20, rows[3][1] + " end")]
    counts, plain = {}, nearsets.settle

    def counted(df, label="table", **more):
        made = plain(df, label, **more)
        if label == "prefix-meetings":
            counts.update((r["fp"], r["count"]) for r in made.groupBy("fp").count().collect())
        return made

    monkeypatch.setattr(nearsets, "settle", counted)
    monkeypatch.setattr(nearsets, "COMMON", 1)
    found = {r["doc_id"]: r["component_id"] for r in nearsets.near_groups(docs(rows)).collect()}
    assert found == groups_brute(rows)
    assert len(counts) == 4


def test_settled_tables_leave_no_shuffle_files(spark):
    """However rarely the driver collects its garbage."""
    import time

    from trackloom.plans.session import settle

    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    settings = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    table = settle(spark.range(0, 1000, 1, 4).selectExpr("id % 10 as k", "id").groupBy("k").sum("id"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == settings
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert table.count() == 10


def test_settled_tables_bound_what_python_workers_get(spark):
    from trackloom.plans.session import settle

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    # 500 rows of about 10,000 bytes
    rows = spark.range(0, 500, 1, 1).selectExpr("id", "repeat('x', 10000) as text").mapInArrow(sizes, "n long")
    most = [max(r["n"] for r in settle(rows, "sizes", **more).collect()) for more in ({}, {"batch_bytes": 100_000})]
    assert most[0] == 500 and most[1] <= 20
