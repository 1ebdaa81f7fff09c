import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nightframe.llm.bpe import byte_symbols
from nightframe.llm.token_counts import section_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
SYMBOLS = {s: b for b, s in enumerate(byte_symbols())}


def brute(text, sections, rule):
    """Spans of tokens from their bytes, section by section."""
    raw, at, out, crossing, n = text.encode(), 0, [0.0] * len(sections), 0, 0
    for token in LIB.encode(text, add_special_tokens=False).tokens:
        size = len(token) if token == "<|endoftext|>" else len(bytes(SYMBOLS[c] for c in token))
        lead = lambda k: sum(1 for x in raw[:k] if x & 0xC0 != 0x80)
        a, b = lead(at), lead(at + size)
        at += size
        n += 1
        part = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        crossing += sum(p > 0 for p in part) > 1
        if rule == "first" or not sum(part):
            out[max(i for i, (s, e) in enumerate(sections) if s <= a and (s < e or len(sections) == 1))] += 1
        elif rule == "majority":
            out[part.index(max(part))] += 1
        else:
            out = [o + p / sum(part) for o, p in zip(out, part)]
    return n, crossing, out


def lines(text):
    out, at = [], 0
    for x in [p + "\n" for p in text.split("\n")]:
        out.append((at, min(len(text), at + len(x))))
        at += len(x)
    return out if len(out) == 1 or out[-1][0] < len(text) else out[:-1]


@pytest.mark.parametrize("rule", ["majority", "first", "share"])
def test_lines(spark, rule):
    rng = random.Random(2)
    pieces = [" ", "\n", "\n\n", "word", "é", "'s", " \n ", "1", "...", "\n\n\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, "", "a"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in section_tokens(df, PATH, rule).collect():
        t = texts[r["doc_id"]] or ""
        n, crossing, want = brute(t, lines(t), rule)
        assert (r["n_tokens"], r["n_sections"], r["n_crossing"]) == (n, len(want), crossing), repr(t)
        assert r["section_tokens"] == pytest.approx(want), repr(t)


def test_fields(spark):
    df = spark.createDataFrame([(1, "a title", "a body\nwith lines"), (2, None, None), (3, "", "x")], "doc_id long, title string, body string")
    got = {r["doc_id"]: r for r in section_tokens(df, PATH, fields=["title", "body"]).collect()}
    assert got[1]["section_tokens"] == [3.0, 5.0] and got[1]["n_tokens"] == 8
    assert all(r["n_sections"] == 2 for r in got.values())


def test_empty_table(spark):
    assert section_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
