import math

import numpy as np
import pytest

from nightframe.llm import product_codes as pc


def brute(rows, rounds=6):
    """The contract by plain loops: rows of (id, vector, label)."""
    ok = lambda v: v is not None and len(v) and len(v) % 8 == 0 and all(c is not None and math.isfinite(c) for c in v)
    rows = sorted((r for r in rows if ok(r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    width = len(rows[0][1]) // 8
    whole = [[math.floor(4096 * c) for c in v] for _, v, _ in rows]
    split = [[v[p * width : (p + 1) * width] for v in whole] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in split]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda k: (dist(x, book[k]), k))
    for _ in range(rounds):
        for p in range(8):
            own = [nearest(x, books[p]) for x in split[p]]
            for k in range(len(books[p])):
                if mine := [x for x, c in zip(split[p], own) if c == k]:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for i, (key, _, label) in enumerate(rows):
        codes = [nearest(split[p][i], books[p]) for p in range(8)]
        out.append([key, "".join(f"{c:02x}" for c in codes), sum(dist(split[p][i], books[p][c]) for p, c in enumerate(codes)), label])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    return sorted(((r[0], r[1], r[2], total[r[3]]) for r in out), key=repr), np.array(books)


SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def made(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (5, d))
    x = np.float32(centres[rng.integers(0, 5, n)] + rng.normal(0, 0.05, (n, d)))
    x[: n // 3] = x[0]  # a third of all rows is one vector
    return [(int(i), v.tolist(), None if i % 7 == 0 else int(i % 3), "x") for i, v in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("n", [1, 9, 400])
def test_codes_equal_plain_loops(spark, n, monkeypatch):
    monkeypatch.setattr(pc, "CHUNK", 97)
    rows = made(n)
    if n > 9:
        rows += [rows[5], (10**6, None, 1, None), (10**6 + 1, [None] + [0.0] * 15, 1, None), (10**6 + 2, [float("nan")] * 16, 1, None), (10**6 + 3, [float("inf")] * 16, 1, None), (10**6 + 4, [], 1, None), (10**6 + 5, [0.5] * 8, 1, None), (10**6 + 6, [0.5] * 5, 1, None), (None, [0.25] * 16, 2, None)]
    want, books = brute([r[:3] for r in rows])
    got = pc.product_codes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=repr) == want
    assert {r["codebooks_sha256"] for r in got} == {pc.digest(books)}


def test_empty_tables_give_no_row(spark):
    assert pc.product_codes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_trees_cover_their_points_and_prune():
    x = pc.scaled(np.array([r[1] for r in made(3000, d=8, seed=4)]))
    order, nodes = pc.cover_tree(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    for node in nodes:
        inside = order[node["start"] : node["end"]]
        assert node["centre"] in inside and (np.sqrt(pc.squared(x[inside], x[node["centre"]])) <= node["radius"] + 1e-9).all()
        if node["hi"] > node["lo"]:
            kids = nodes[node["lo"] : node["hi"]]
            assert kids["start"][0] == node["start"] and kids["end"][-1] == node["end"] and (kids["start"][1:] == kids["end"][:-1]).all()
            assert (kids["radius"] <= node["radius"] / 2 + 1e-9).all()
    book = x[:16].astype(np.int64)
    (start, end, _), (place, _) = pc.walk(x, order, nodes, book)
    assert (end - start).sum() + len(place) == len(x) and len(place) < len(x) / 2


def test_ties_go_to_the_lower_entry_and_large_numbers_stay_exact():
    x = np.array([[0] * 4, [2] * 4, [1] * 4] + [[1] * 4] * 40, np.int32)
    order, nodes = pc.cover_tree(x)
    assert pc.codes_of(x, order, nodes, np.array([[2] * 4, [0] * 4])).tolist() == [1, 0, 0] + [0] * 40
    far = pc.scaled(np.array([1e30, -1e30, 16384.0, 0.99 / 4096]))
    assert far.tolist() == [pc.LIMIT, -pc.LIMIT, pc.LIMIT, 0]
    assert int(pc.squared(far[:1].repeat(8), far[1:2].repeat(8))) == 8 * (2 * pc.LIMIT) ** 2
