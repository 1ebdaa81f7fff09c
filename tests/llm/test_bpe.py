import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nightframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "a", "'s", "<|endoftext|>", "<|end", "\n", "'", "''", "'ll", "　", "é", "1", "½", "日本", "\x1c", "\xa0", "x" * 60, "😀"]


def texts():
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(800)] + ["ab" * 3000, "", "'s", "<|endoftext|>"]


def test_round_trip_equals_the_library(spark):
    rows = list(enumerate(texts())) + [(None, None), (7, "same"), (7, "same")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, bpe.round_trip(df, PATH).collect()), key=repr)
    lib = Tokenizer.from_file(PATH)
    want = []
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_encode_then_decode(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, PATH), PATH)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_small_table_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_LIMIT", 16)
    coder = bpe.ByteBPE(PATH)
    lib = Tokenizer.from_file(PATH)
    for t in texts()[:200]:
        data = np.frombuffer(t.encode(), np.uint8)
        ids, _ = coder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
