import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.test_toxicity import corpus

SAMPLE = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs, labels = corpus(200)
    passage = " ".join(f"passage{i}" for i in range(60))
    leak = " ".join(f"item{i}" for i in range(30))
    clean = [t for (d, t), (_, q, x) in zip(docs, labels) if not x][0]
    unique = lambda k: " ".join(f"w{k}n{i}" for i in range(80))
    rows = docs + [(1000, unique(1)), (1001, unique(1)), (1002, unique(1) + " tail"), (1003, unique(3) + " " + passage), (1004, unique(4) + " " + passage), (1005, unique(5) + " " + leak), (1006, "vilex grossq vilexan " + unique(6)), (1007, None), (1008, "")]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string()), "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())})
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [x[0] for x in labels], "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [leak]}), tmp_path / "benchmark.parquet")
    current, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = current.columns
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, str(tmp_path))
        if name != "bpe":
            assert current.columns == columns
            current.write.parquet(f"{tmp_path}/{name}")
            current = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = {r["doc_id"]: r["text"] for r in current.collect()}
    assert 1006 not in seen["toxicity"] and {1000, 1001, 1002, 1005, 1007} <= set(seen["toxicity"])
    assert {1000, 1001, 1002} & set(seen["near_duplicates"]) == {1000}
    assert {1003, 1004, 1005, 1007, 1008} <= set(seen["near_duplicates"])
    assert seen["substring_dedup"][1003].endswith("passage59") and seen["substring_dedup"][1004] == unique(4)
    assert 1005 not in seen["decontamination"] and 1000 in seen["decontamination"]
    assert {r["doc_id"] for r in current.collect()} == set(seen["decontamination"])


def test_repeats_go_and_rows_without_text_stay(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (2, words), (3, None), (4, ""), (5, " \n "), (None, None), (6, "a b"), (7, "own " + words)]
    docs = spark.createDataFrame([(k, t, "en", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, n_chars long")
    kept = corpus_pipeline.cut_repeats(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()))) == sorted(map(repr, [(1, words, len(words)), (3, None, 0), (4, "", 0), (5, " \n ", 3), (None, None, 0), (6, "a b", 3), (7, "own", 3)]))


def test_run_on_the_sample(spark):
    out = corpus_pipeline.run(spark, SAMPLE)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 200
