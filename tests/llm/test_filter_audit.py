import re
from collections import Counter
from itertools import permutations

from nightframe.llm import filter_audit as fa

DOCS, LABELS = "doc_id long, text string, lang string, mask string, id int", "doc_id long, quality int, toxic int"
MANY = " ".join(f"w{i}" for i in range(220))


def fixture():
    texts = [MANY, MANY + " one", "the " * 230, "SHOUT " * 50, "a $ b", "", None, MANY + "\x0bx", "wörd\x85wide " * 210, MANY, MANY, "A" * 4 + "b" * 96, "A" * 3 + "b" * 97, "longer " * 20_000]
    docs = [(i, t, ["en", "de", None, ""][i % 4], "m", 0) for i, t in enumerate(texts)] + [(40 - k, MANY + " late", "en", "m", 0) for k in range(9)] + [(40, MANY + " late", "en", "m", 0)]
    docs += [(None, MANY, "en", None, None), (None, None, None, None, None), (3, MANY, "fr", None, None)]
    return docs, [(0, 1, 0), (1, 0, 1), (9, 1, 1), (9, 1, None), (33, None, 1), (None, 1, 1), (35, 1, 0), (99, 1, 1)]


def brute(docs, labels):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((lang or "", {k for k, v in bad.items() if v}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                c, before = Counter(), set(order[:k])
                for p, bad, good, toxic in rows:
                    if p != part:
                        continue
                    gone = bool(bad & before)
                    removed = f in bad and not gone
                    c.update({"kept": not gone and f not in bad, "removed": removed, "redundant": f in bad and gone, "unique_fails": bad == {f}, "good_lost": removed and good, "toxic_lost": removed and toxic})
                shapley[f] += c["removed"]
                out[part, order, k + 1] = c
        for (p, order, k), c in out.items():
            if p == part:
                c["shapley"] = shapley[order[k - 1]]
    return out


def test_all_orders_equal_plain_counting(spark):
    docs, labels = fixture()
    got = fa.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(docs, labels)
    assert len(got) == len(want) == 4 * 600
    for r in got:
        c = want[r["part"], r["filter_order"], r["step"]]
        assert {k: int(c[k]) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} == {k: r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}, r


def test_a_full_sketch_only_costs_speed(spark, monkeypatch):
    docs, labels = fixture()
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    usual = sorted(map(str, fa.audit(docs, labels).collect()))
    monkeypatch.setattr(fa, "MAX_BLOCKS", 1)
    assert sorted(map(str, fa.audit(docs, labels).collect())) == usual


def test_the_prepass_lets_every_repeat_through_and_clears_most_others(spark):
    rows = spark.createDataFrame([(i, f"text {i if i % 10 else 0}") for i in range(2000)], "id long, text string")
    told = fa.possible_repeats(rows, fa.sketch(rows, 500), 500).collect()
    assert all(r["maybe"] for r in told if r["text"] == "text 0")
    assert sum(r["maybe"] for r in told if r["text"] != "text 0") < 100


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert fa.audit(spark.createDataFrame([], DOCS), labels).collect() == []
    assert len(fa.audit(spark.createDataFrame([(1, "a", "en", None, None)], DOCS), labels).collect()) == 600
