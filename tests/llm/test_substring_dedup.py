import hashlib
import random
import re

import pytest

from nightframe.llm import sharing, substring_dedup


def brute(rows, width):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), " ".join(kept)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = [f"p{i}é" for i in range(40)]
    rows = []
    for d in range(80):
        w = [rng.choice("abcdefgh") + str(rng.randint(0, 9 if d % 3 else 1)) for _ in range(rng.choice([0, 3, 12, 13, 14, 60, 200]))]
        if rng.random() < 0.4:
            a = rng.randint(0, 25)
            w[rng.randint(0, len(w)) : 0] = passage[a : a + rng.randint(10, 40)]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(w) + rng.choice(["", " ", "\xa0x"])))
    rows += [(200 + i, rows[i * 7][1]) for i in range(8)] + [(3, rows[3][1]), (3, rows[50][1]), (None, rows[5][1]), (None, None), (400, None), (401, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,width,gram", [(1, 13, 7), (2, 4, 2), (3, 13, 13)])
def test_equals_brute_force(spark, monkeypatch, seed, width, gram):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, starts int, version string").repartition(5)
    want = brute(rows, width)
    got = substring_dedup.dedup(df, width, gram, digest=True).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, n, g, hashlib.sha256(k.encode()).hexdigest())) for d, n, g, k in want)
    if seed == 1:
        back = substring_dedup.dedup(df.withColumn("source", substring_dedup.F.lit("x")), width, gram)
        assert back.columns == ["doc_id", "text", "starts", "version", "source"]
        assert sorted(repr((r[0], r[1])) for r in back.collect()) == sorted(repr((d, k if g else t)) for (d, _, g, k), (_, t) in zip(want, rows))
        repeats = substring_dedup.maximal_repeats(df, width, gram).collect()
        assert all(r["n_words"] >= width for r in repeats)
        assert sum(r["n_words"] for r in repeats) == sum({(d, t): g for (d, _, g, _), (_, t) in zip(want, rows)}.values())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup(df, digest=True).count() == 0


def test_other_columns_stay(spark):
    words = " ".join(f"w{i}" for i in range(20))
    names = ["starts", "hits", "__id", "__version", "rest", "at", "code"]
    df = spark.createDataFrame([(k, words, *(f"{n}{k}" for n in names)) for k in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r["doc_id"]: r for r in substring_dedup.dedup(df).collect()}
    assert got[1]["text"] == words and got[2]["text"] == ""
    assert all(got[k][n] == f"{n}{k}" for k in (1, 2) for n in names)
