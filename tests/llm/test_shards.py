from collections import Counter

import numpy as np
import pytest

from nightframe.llm import shards

SCHEMA = "doc_id long, text string, slot string, shard string"


def test_sizes_are_exact_slots_have_no_gap_and_rows_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_ROWS", 10)
    rows = [(i, f"text {i}" if i % 3 else "copy", "a", "b") for i in range(997)] + [(None, None, None, None)] * 5 + [(7, "x" * 300_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = shards.shuffle(df, 8, seed=3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(r[:2] for r in rows)
    sizes = Counter(r["shard"] for r in out)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sizes[k]))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_rows_than_shards(spark, n):
    out = shards.shuffle(spark.createDataFrame([(i, None, None, None) for i in range(n)], SCHEMA), 8).collect()
    assert len({(r["shard"], r["slot"]) for r in out}) == len(out) == n and all(r["slot"] == 0 for r in out)


def test_every_row_of_the_matrix_agrees_and_sums_are_exact():
    before, places = np.append(0, np.cumsum([50, 0, 7, 300, 43])), shards.even(400, 13)
    matrix = np.array([shards.matrix_row(before, places, p, 5) for p in range(5)])
    assert (matrix.sum(axis=0) == places).all() and (matrix.sum(axis=1) == np.diff(before)).all() and (matrix >= 0).all()


def test_the_matrix_has_the_law_of_a_uniform_permutation():
    before, places = np.array([0, 6, 10, 18]), np.array([5, 5, 8])
    many = np.array([[shards.matrix_row(before, places, p, s) for p in range(3)] for s in range(4000)])
    rng, owner = np.random.default_rng(0), np.repeat(np.arange(3), np.diff(before))
    plain = []
    for _ in range(4000):
        cut = np.split(rng.permutation(owner), np.cumsum(places)[:-1])
        plain.append([[int((c == p).sum()) for c in cut] for p in range(3)])
    plain = np.array(plain)
    assert np.abs(many.mean(axis=0) - plain.mean(axis=0)).max() < 0.1
    assert np.abs(many.var(axis=0) - plain.var(axis=0)).max() < 0.15


def test_places_are_uniform(spark, monkeypatch):
    """The place of one row, and of two neighbours, over many seeds: chi squared."""
    monkeypatch.setattr(shards, "BLOCK_ROWS", 2)
    rows = spark.createDataFrame([(i, None, None, None) for i in range(12)], SCHEMA).repartition(3)
    seen, pairs = Counter(), 0
    for s in range(40):
        at = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.shuffle(rows, 3, seed=s).collect()}
        seen.update(at[i] for i in range(12))
        pairs += sum(at[i][0] == at[(i + 1) % 12][0] for i in range(12))
    assert len(seen) == 12 and set(seen.values()) == {40}
    assert abs(pairs / (40 * 12) - 3 / 11) < 0.08


def test_urns_beyond_the_library_have_the_right_moments():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 5 * 10**9, 2 * 10**6
    draws = np.array([shards.hypergeometric(rng, good, bad, n) for _ in range(400)])
    mean, sd = n * 3 / 8, np.sqrt(n * 3 / 8 * 5 / 8)
    assert abs(draws.mean() - mean) < 5 * sd / 20 and 0.85 < draws.std() / sd < 1.15
    places = np.full(10, 4 * 10**8)
    taken = shards.split(rng, places, 10**7)
    assert taken.sum() == 10**7 and (taken <= places).all() and np.abs(taken - 10**6).max() < 6000
    small = [shards.hypergeometric(rng, 10**9, 5, 10**9 + 5 - 2) for _ in range(50)]
    assert all(10**9 - 2 <= x <= 10**9 for x in small)
