import random

import numpy as np
import pyarrow as pa

from nightframe.llm import decontaminate as dc


def test_lcs():
    rng = random.Random(1)

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert dc.lcs(a, b) == plain(a, b)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 6)))
    words = [word() for _ in range(3000)]
    items = [(i, [rng.choice(words) for _ in range(rng.randint(15, 60))]) for i in range(25)]
    docs, truth = [], {}
    for d in range(160):
        w = [rng.choice(words) for _ in range(rng.choice([0, 20, 200, 900]))]
        held = []
        for i, x in rng.sample(items, rng.choice([0, 0, 1, 2])):
            y = list(x)
            for _ in range(len(y) // 12):  # a paraphrase: some words replaced, some dropped, the answer kept
                k = rng.randrange(len(y) - 5)
                y[k : k + 1] = rng.choice([[], [word()]])
            at = rng.randint(0, len(w)) if not held else 0
            w[at:at] = y
            held.append(i)
        text = " ".join(x.upper() if rng.random() < 0.1 else x + rng.choice(["", "", ",", "."]) for x in w)
        docs.append((d, text))
        truth[d] = sorted(held)
    return docs, [(i, " ".join(x) + "?") for i, x in items], truth


def test_paraphrases_are_found(spark, monkeypatch):
    docs, items, truth = corpus()
    df = spark.createDataFrame([(*r, 0) for r in docs + [(None, docs[3][1]), (900, None), (901, ""), (3, docs[3][1])]], "doc_id long, text string, cover int")
    bench = spark.createDataFrame(items + [(None, "x y z"), (99, None), (98, "")], "item_id long, text string")
    rows = dc.matches(df, bench).collect()
    assert len(rows) == len(docs) + 4
    got = {r["doc_id"]: r["items"] for r in rows}
    found = sum(len(set(got[d]) & set(t)) for d, t in truth.items())
    assert found >= 0.95 * sum(map(len, truth.values()))
    assert all(set(got[d]) <= set(t) for d, t in truth.items())
    kept = dc.clean(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} >= {d for d, t in truth.items() if not t} | {900, 901}
    monkeypatch.setattr(dc, "BLOCK", 10)  # items in blocks give the same
    again = {r["doc_id"]: sorted(r["items"]) for r in dc.matches(df.filter("doc_id < 160").dropDuplicates(["doc_id"]), bench).collect()}
    assert all(again[d] == got[d] for d in again)


def test_blocks_of_items_keep_all_rows(spark, monkeypatch):
    docs, items, _ = corpus()
    df = spark.createDataFrame([(*r, 0) for r in docs + [(None, docs[3][1]), (None, docs[4][1]), (None, None), (None, None), (900, None), (901, ""), (3, docs[3][1]), docs[0], docs[0]]], "doc_id long, text string, cover int")
    # every tenth item has words of nearly all items of its block, but of few in the benchmark
    bench = spark.createDataFrame(items + [(100 + i, f"shared{i // 10} words{i // 10} own{i} other{i} last{i}") for i in range(30)] + [(None, "x y z"), (99, None)], "item_id long, text string")
    rows = lambda out: sorted(map(repr, out.collect()))
    whole, kept = rows(dc.matches(df, bench)), rows(dc.clean(df, bench))
    assert len(whole) == len(docs) + 9
    for block in (10, 7, 1):
        monkeypatch.setattr(dc, "BLOCK", block)
        assert rows(dc.matches(df, bench)) == whole
    monkeypatch.setattr(dc, "BLOCK", 10)
    assert rows(dc.clean(df, bench)) == kept


def test_svd_finds_the_leading_space(spark):
    docs, items, _ = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = dc.fit(df, spark.createDataFrame(items, "item_id long, text string"))
    rows = []
    for _, text in docs:
        h, first = dc.words_of(*dc.text_bytes(pa.array([text])))
        _, begin, _ = dc.passages(first)
        f, p = dc.features_of(h, begin, model.numbers)
        a = np.zeros((len(begin), len(model.idf)))
        np.add.at(a, (p, f), model.idf[f])
        rows.append(a)
    a = np.concatenate(rows)
    full = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(model.basis.T @ model.basis, np.eye(dc.RANK), atol=1e-3)
    # energy within the basis, against the best basis of that rank
    assert np.linalg.norm(a @ model.basis) ** 2 >= 0.7 * (full[: dc.RANK] ** 2).sum()


def exhaustive(docs, items):
    """All pairs of a document and an item that the checks accept around some passage."""
    parts = lambda text: [(h.tolist(), n) for h, n in [dc.words_of(*dc.text_bytes(pa.array([text or ""], pa.string())))]][0][0]
    out = set()
    for i, x in items:
        item = parts(x)
        for d, text in docs:
            w = parts(text)
            if any(dc.holds(item, w[max(0, a - len(item)) : a + 2 * dc.SIZE + len(item)])[0] for a in range(0, len(w), dc.SIZE)):
                out.add((d, i))
    return out


def test_recall_of_the_search_with_templates(spark):
    """Items that differ in a name only, and documents that hold the template with other names."""
    docs, items, _ = corpus()
    rng = random.Random(4)
    template = "question {} wrote the long book about the river and the hills in which year of the old king answer {} of spring".split()
    items = items[:12] + [(50 + k, " ".join(template).format(f"name{k}", f"year{k}")) for k in range(6)]
    filler = [w for _, t in docs for w in t.split()]
    docs = docs[:70] + [(500 + k, " ".join([*rng.sample(filler, 30 * (k % 3)), " ".join(template).format(f"other{k}", f"year{k % 9}"), *rng.sample(filler, 40)])) for k in range(12)]
    want = exhaustive(docs, items)
    got = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], i) for r in got for i in r["items"]}
    assert found <= want and len(want) > 60
    assert len(found) >= 0.9 * len(want)


def test_items_of_any_length(spark, monkeypatch):
    """Verbatim and edited items of 1 to 1,000 words, found as by comparing all passages with all items."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 6))) for _ in range(4000)]
    usual = words[:60]
    draw = lambda: rng.choice(usual) if rng.random() < 0.4 else rng.choice(words)
    sizes = [1, 2, 13, 47, 64, 65, 96, 97, 140, 250, 400, 1000]
    items = [(10 * n + k, [rng.choice(words[60:]) if n < 3 else draw() for _ in range(n)]) for n in sizes for k in range(3)]
    docs, d = [(0, ""), (1, " ".join(draw() for _ in range(3000)))], 2
    for i, x in items:
        for edited in (False, True):
            y = list(x)
            if edited and len(y) > 12:
                for _ in range(len(y) // 10):
                    k = rng.randrange(len(y) - 5)
                    y[k : k + 1] = rng.choice([[], [draw()], [draw(), draw()]])
            before, after = ([draw() for _ in range(rng.choice([0, 7, 130]))] for _ in range(2))
            docs.append((d, " ".join(before + y + after)))
            d += 1
    items = [(i, " ".join(x)) for i, x in items]
    want = exhaustive(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r["doc_id"], i) for r in dc.matches(df, bench).collect() for i in r["items"]}
    got = found()
    assert got <= want and len(want) >= 2 * len(items)
    for n in sizes:
        of = {(a, i) for a, i in want if 10 * n <= i < 10 * n + 3}
        assert len(of) >= 6 and len(got & of) >= 0.9 * len(of), n
        plain = {(2 + 2 * k, i) for k, (i, _) in enumerate(items) if 10 * n <= i < 10 * n + 3}
        assert plain <= got, n
    monkeypatch.setattr(dc, "BLOCK", 7)  # parts of one item in several blocks
    assert found() == got


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.matches(docs, bench).count() == 0
    assert dc.matches(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), bench).collect()[0]["items"] == []


def test_covers_of_many_candidates_are_those_of_one():
    rng = np.random.default_rng(5)
    size = np.array([1, 2, 30, 63, 64, 64])
    begin = np.append(0, np.cumsum(size)[:-1])
    flat = rng.integers(0, 40, size.sum()).astype(np.uint64) << np.uint64(48)
    vocabulary, places = np.unique(flat, return_inverse=True)
    x = {"flat": flat, "vocabulary": vocabulary, "places": places, "size": size, "begin": begin}
    text = rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(48)
    text[100:164] = flat[begin[4] :][:64]
    known = dc._known(x, text, np.zeros(1 << dc.BITS, np.int32))
    items = rng.integers(0, len(size), 300)
    lo = np.append(rng.integers(0, 400, 297), [100, 399, 0])
    hi = np.minimum(400, lo + rng.integers(1, 150, 300))
    want = [dc.lcs(flat[begin[i] : begin[i] + size[i]].tolist(), text[a:b].tolist()) for i, a, b in zip(items, lo, hi)]
    assert dc._covers(x, known, lo, hi, items).tolist() == want
