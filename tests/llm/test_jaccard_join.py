import random
import re

import pytest

from nightframe.llm import components, jaccard_join, scratch


def brute(rows, width=5, percent=75):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(repr((d, len(s), None if d is None else least[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    rng = random.Random(seed)
    rows, d = [], 1000
    hot = [f"h{i}" for i in range(60)]
    for g in range(14):
        base = [f"{rng.choice('xyz')}{rng.randint(0, 400)}" for _ in range(rng.choice([2, 5, 7, 30, 90, 200]))]
        if g % 3 == 0:
            base += hot
        for _ in range(rng.choice([1, 1, 3, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8]) if len(w) > 8 else rng.choice([0, 1])):
                w[rng.randrange(len(w))] = rng.choice(["E", "e", f"e{rng.randint(0, 99)}"])
            rows.append((d, (" \n"[rng.random() < 0.2]).join(w if rng.random() < 0.8 else [x.upper() for x in w])))
            d -= rng.randint(1, 3)
    rows += [(1, None), (2, ""), (3, " \n "), (4, None), (None, rows[0][1]), (5, rows[0][1]), (5, rows[0][1]), (5, rows[3][1]), (6, "a b"), (7, "A B"), (8, "\xa0")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,leaf", [(1, 512), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, leaf):
    rows = corpus(seed)
    monkeypatch.setattr(jaccard_join.link_components, "__defaults__", (75, leaf, 1 << 21))
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 1 << 22 if seed == 1 else 0)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, point string").repartition(3)
    got = jaccard_join.near_duplicates(df).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def edited_copies(seed, n, size, edits, words=40):
    """Copies of one text with some words replaced: components of many sizes, and points just beyond the radius."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    rows = []
    for d in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(words)}"
        if rng.random() < 0.2:
            del w[rng.randrange(size) :][: rng.choice([1, 5])]
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,edits,leaf", [(1, [0, 1, 2, 3, 5, 8], 12), (2, [3, 4, 5, 6], 8), (3, [1, 2], 5)])
def test_large_group_of_edited_copies(spark, monkeypatch, seed, edits, leaf):
    """Pivots, windows, recursion and blocks find what all pairs find."""
    rows = edited_copies(seed, 220, 90, edits)
    monkeypatch.setattr(jaccard_join.link_components, "__defaults__", (75, leaf, 1 << 21))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_regions_are_split_by_windows(spark):
    """Several far groups on one island: children of regions are smaller, and nothing is lost."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(40)]
        for k in range(25):
            w = base + common
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
            rows.append((g * 100 + k, " ".join(w)))
    sets = {d: frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for d, t in rows}
    number = {x: i * 0x9E3779B97F4A7C15 % 2**64 for i, x in enumerate(sorted(set().union(*sets.values())))}
    points = [(d, len(s), b"".join(x.to_bytes(8, "little") for x in sorted(number[x] for x in s))) for d, s in sets.items()]
    got = dict(map(tuple, jaccard_join.link_components(spark.createDataFrame(points, "point long, n int, shingles binary"), leaf=20).collect()))
    low = {}
    for d, c in got.items():
        low[c] = min(d, low.get(c, d))
    assert sorted(repr((d, len(sets[d]), low[c])) for d, c in got.items()) == brute(rows)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (50, 129)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 10 for i in range(10, 41)) and all(got[i] == 50 for i in [50, *range(100, 130)]) and 7 not in got


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(df).count() == 0


def test_nothing_that_grows_with_the_input_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 0, raising=False)
    seen = []
    stored = scratch._stored
    monkeypatch.setattr(scratch, "_stored", lambda df, path: seen.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, path))
    rows = [(i, " ".join(f"w{k}" for k in range(i % 5 * 100, i % 5 * 100 + 40)) + f" e{i // 5 % 2}") for i in range(40)] + [(99, None)]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {i: i % 5 for i in range(40)} | {99: 99}
    assert any("Join" in plan for plan in seen) and not any("Broadcast" in plan for plan in seen)
