"""Quantiles and ranks of split tracks equal those of whole ones, whatever the values look like."""

import numpy as np
import pytest

from trackloom.operators.quantiles import exact_quantiles, rank_position

PROBABILITIES = [0.0, 0.2, 0.5, 0.98, 1.0]
RNG = np.random.default_rng(5)
VALUES = {
    "outlier": [*RNG.uniform(0, 1, 400).tolist(), 1e300],
    "both ends": [-1e308, *RNG.normal(0, 1e-9, 300).tolist(), 1e308],
    "few values": [float(x) for x in RNG.integers(0, 3, 500)],
    "equal": [7.0] * 50,
    "single": [1.5],
    "gaps": [None, 1.0, None, 3.0, float("nan"), 2.0],
}


@pytest.fixture(scope="module")
def rows(spark):
    listed = [(t, i, i // 50, v) for t, values in VALUES.items() for i, v in enumerate(values)]
    return spark.createDataFrame(listed, "track_id string, idx int, chunk bigint, x double")


def test_quantiles_by_counting_equal_numpy(rows):
    found = {r["track_id"]: r for r in exact_quantiles(rows, "x", PROBABILITIES).collect()}
    assert set(found) == set(VALUES)
    for track, values in VALUES.items():
        known = np.array([v for v in values if v is not None and v == v])
        assert found[track]["n"] == len(known)
        place = np.array(PROBABILITIES) * (len(known) - 1)
        low, high = np.sort(known)[np.floor(place).astype(int)], np.sort(known)[np.ceil(place).astype(int)]
        share = place - np.floor(place)
        assert found[track]["q"] == pytest.approx((1 - share) * low + share * high, rel=1e-12)


def test_quantiles_of_chunks_equal_those_of_tracks(rows):
    some = rows.where("track_id <> 'both ends'")
    split, whole = (sorted(exact_quantiles(df, "x", PROBABILITIES).collect()) for df in (some, some.drop("chunk")))
    assert [r["track_id"] for r in split] == [r["track_id"] for r in whole]
    for a, b in zip(split, whole, strict=True):
        assert a["q"] == pytest.approx(b["q"], rel=1e-12)


def test_ranks_of_chunks_equal_those_of_tracks(rows):
    some = rows.where("track_id <> 'gaps'")
    split, whole = (
        sorted((r["track_id"], r["idx"], r["rank_pos"]) for r in rank_position(df, "x").collect()) for df in (some, some.drop("chunk"))
    )
    assert split == whole
