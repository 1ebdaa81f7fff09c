import random

import numpy as np

from nightframe.llm import toxicity


def corpus(n=600, seed=3):
    """Texts of made-up words; toxic ones hold words with a telling beginning, bad ones repeat themselves."""
    rng = random.Random(seed)
    docs, labels = [], []
    for d in range(n):
        toxic, bad = rng.random() < 0.15, rng.random() < 0.2
        w = [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnp") * rng.randint(1, 3) + str() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(2, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilex", "Grossq", "vilexan", "grossqel"]))
        if bad:
            w += ["spamword", "SPAMWORD!"]
        docs.append((d, " ".join(w)))
        labels.append((d, int(not bad), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    extra = [(None, "vilex grossq vilex"), (9001, None), (9002, ""), (5, docs[5][1]), (9003, "clean " * 20000 + "vilex grossq")]
    df = spark.createDataFrame([(*r, 1.0) for r in docs + extra], "doc_id long, text string, p_toxic double").drop("p_toxic")
    train = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1, 1), (1, None, 1), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, train)
    rows = toxicity.score(df, chain).collect()
    assert len(rows) == len(docs) + len(extra)
    got = {r["doc_id"]: r for r in rows}
    held = [x for x in labels if not x[0] % 3]
    assert np.mean([got[d]["rejected"] == bool(t) for d, _, t in held]) >= 0.96
    assert np.mean([(got[d]["p_low_quality"] >= 0.5) == (not q) for d, q, _ in held]) >= 0.96
    assert np.mean([(got[d]["p_severe"] >= 0.5) == (not q and t == 1) for d, q, t in held]) >= 0.96
    assert got[None]["rejected"] and got[9003]["rejected"] and not got[9001]["rejected"] and not got[9002]["rejected"]
    kept = toxicity.reject(df, chain)
    assert kept.columns == df.columns and kept.count() == sum(not r["rejected"] for r in rows)


def test_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, none)
    assert [r["rejected"] for r in toxicity.score(df, chain).collect()] == [False]
    assert toxicity.score(df.limit(0), chain).count() == 0


def test_sample_is_bounded_and_never_empty(spark):
    """Many rows of one id and text: the sample has max_rows of them, whatever their hash."""
    from nightframe.llm import toxicity

    for text in ("mild words here", "other words there", "more of them"):
        docs = spark.createDataFrame([(7, text)] * 400, "doc_id long, text string")
        labels = spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")
        chain = toxicity.train(docs, labels, max_rows=20, min_docs=1)
        assert toxicity.score(docs, chain).filter("rejected").count() == 400
