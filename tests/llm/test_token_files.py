import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nightframe.llm import scratch, token_files
from nightframe.llm.crc32c import crc32c, masked

PATH = public_tokenizers.path("word_bpe_49k.json")


def scalar_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc32c_of_rows():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 3, 4, 5, 9, 127, 128, 129, 700, 2]
    data = rng.integers(0, 256, sum(sizes), dtype=np.uint8)
    at = np.cumsum([0, *sizes])
    assert crc32c(data, at).tolist() == [scalar_crc32c(data[a:b].tobytes()) for a, b in zip(at, at[1:])]
    assert crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0, 9])).tolist() == [0xE3069283]
    assert masked(np.array([0], np.uint32)).tolist() == [0xA282EAD8]


def texts():
    rng = random.Random(9)
    pieces = [" ", "\n", "Word", "naïve", "É", "É", "<|endoftext|>", "1234", "'s", "　", " ", "\t", "日本", "x" * 90, ".", ",", "...!", "#.", "a.", "WORD,", "<|ENDOFTEXT|>", "É.", "e\u0301", ".\u0301", "1."]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)]


def expected(rows):
    lib = Tokenizer.from_file(PATH)
    at, out = 0, []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((k, at, ids))
        at += len(ids)
    return out


def test_written_records_equal_the_library(spark):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    rows += [(None, None), (7, None), (7, "b"), (7, "b")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, ids string")
    manifest = token_files.write(df, scratch.new_folder(spark, "records"), PATH, end_id=2, shards=3)
    got = sorted(map(tuple, token_files.read(manifest).collect()), key=lambda r: r[1])
    assert [(k, s, i) for k, s, _, i in got] == [(k, s, i) for k, s, i in expected(rows)]
    crc = {(r["start"]): r["ids_crc32"] for r in token_files.read(manifest, digest=True).collect()}
    assert crc == {s: zlib.crc32(np.array(i, "<u4").tobytes()) for _, s, i in expected(rows)}
    a = [tuple(r) for r in token_files.read_shuffled(manifest, 1).collect()]
    b = [tuple(r) for r in token_files.read_shuffled(manifest, 2).collect()]
    assert a != b and sorted(map(repr, a)) == sorted(map(repr, b)) == sorted(repr((k, i)) for k, _, i in expected(rows))


def test_a_damaged_record_is_found(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    row = token_files.write(df, scratch.new_folder(spark, "records"), PATH).collect()[0]
    path = row["path"].removeprefix("file://") + ".rec"
    data = bytearray(open(path, "rb").read())
    data[13] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(token_files._records(row["path"], row["width"]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.read(token_files.write(df, scratch.new_folder(spark, "records"), PATH)).count() == 0
