import random

import public_tokenizers
import pytest
import tiktoken

from lamina.llm.bpe import Bpe


@pytest.fixture(scope="module")
def bpe():
    return Bpe.load()


@pytest.fixture(scope="module")
def exact(bpe):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_every_token_encodes_to_itself(bpe):
    assert all(bpe.merge(t) == [t] for t in bpe.ranks if len(t) <= 40)


def texts():
    rng = random.Random(5)
    alphabets = ["ab", "the retion ing", "x \n\t'slldre", "0123456789abcdef", "éèçàüß qu'", "中文字 a", "\x1c\x85  a'", "'́ ²½x"]
    for n in (0, 1, 2, 3, 17, 60, 333, 5000, 13000):
        for a in alphabets:
            yield "".join(rng.choice(a) for _ in range(n))
    yield "a" * 20000
    yield " " * 9000 + "x" + "'" * 5000 + "ll"
    yield "<|endoftext|>"


def test_equals_the_exact_encoder(bpe, exact):
    for t in texts():
        assert bpe.encode(t) == exact.encode_ordinary(t), t[:60]
        assert bpe.decode(bpe.encode(t)) == t.encode()


def test_small_leaves_join(bpe, exact, monkeypatch):
    from lamina.llm import bpe as module

    monkeypatch.setattr(module, "LEAF", 5)
    monkeypatch.setattr(module, "KEPT", 50)
    own = Bpe.load()
    for t in texts():
        if len(t) <= 5000:
            assert own.encode(t) == exact.encode_ordinary(t), t[:60]


def test_frame_edge_cases(spark):
    from lamina.llm.bpe import encode_frame

    df = spark.createDataFrame([(1, None), (None, ""), (2, "a b"), (2, "a b")], "doc_id long, text string")
    rows = encode_frame(df, ids=True).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2] and len(rows) == 4
    assert encode_frame(df.limit(0)).count() == 0
