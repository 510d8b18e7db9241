import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.encode import LONG_WORD, PATTERN, TOKENIZERS, ByteBpe, encode_text, load

FILE = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary")


@pytest.fixture(scope="module")
def ours():
    return load(FILE)


@pytest.fixture(scope="module")
def theirs():
    import tiktoken

    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(bpe, texts):
    ends, flat = bpe.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_words_of_many_kinds(ours, theirs):
    rnd = random.Random(2)
    letters = "abcdefgetionsr ABC é日本がの  ing\n\t'"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 120))) for _ in range(3000)]
    texts += ["a" * k for k in range(1, 200, 7)] + [" " * k for k in range(1, 200, 7)] + ["ab" * 5000, "-" * 5000, "<|endoftext|>", "🔥👩‍💻", "\x00\x01"]
    assert ids(ours, texts) == [theirs.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    bpe, enc = _pair()
    assert ids(bpe, [text])[0] == enc.encode_ordinary(text)
    assert b"".join(enc.decode_single_token_bytes(i) for i in ids(bpe, [text])[0]) == text.encode()


_KEPT = []


def _pair():
    if not _KEPT:
        import tiktoken

        bpe = load(FILE)
        _KEPT.append((bpe, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})))
    return _KEPT[0]


def test_verification_equals_merging(ours):
    import numpy as np

    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 50256, 4000), rnd.integers(0, 50256, 4000)
    fine = ours.verify(a, b)
    raw = {i: t for t, i in ours.ranks.items()}
    for x, y, ok in zip(a.tolist(), b.tolist(), fine.tolist(), strict=True):
        word = raw[x] + raw[y]
        if len(word) <= LONG_WORD:
            assert ok == (ours.exact(word) == [x, y])
    assert fine.any() and not fine.all()


def test_small_vocabulary_of_its_own():
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    bpe = ByteBpe(ranks)
    assert bpe.exact(b"abc") == [258] and bpe.exact(b"aabc") == [97, 258] and bpe.exact(b"aaab") == [259, 256]


def test_column(spark, theirs):
    texts = ["", None, "Hello world", "x" * 20000, " \n ", "Grüße, 世界"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encode_text(df, "text").collect()}
    assert got == {k: theirs.encode_ordinary(t or "") for k, t in enumerate(texts)}
    n = {r["doc_id"]: r["ids"] for r in encode_text(df, "text", count_only=True).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    clash = df.withColumnRenamed("doc_id", "Ids").selectExpr("Ids", "text", "1 as other")
    assert encode_text(clash, "text").columns == ["other", "ids"]
    assert encode_text(df.limit(0), "text").count() == 0
