import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lamina.llm import token_store as ts
from lamina.llm.session import new_dir


def stored(docs, counts, ids):
    out = []
    ts.dump(docs, counts, np.asarray(ids, np.uint32), out.append)
    return ts.load(ts.in_memory(b"".join(out)))


def test_codes_give_every_token_alone():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = rng.choice(np.array([0, 5, 255, 256, 50256, 65535, 65536, 2**24, 2**32 - 1], np.uint64), n).astype(np.uint32)
        codes = stored([1], [n], ids)[2]
        assert [codes[i] for i in range(n)] == ids.tolist()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert codes.slice(a, b).tolist() == ids[a:b].tolist()


def test_file_round_trip():
    docs, first, codes = stored([None, 4, 4], [1, 0, 3], [2, 70000, 1, 2])
    assert docs == [None, 4, 4] and first.tolist() == [0, 1, 1, 4] and codes.slice(1, 4).tolist() == [70000, 1, 2]


ODD = ["a b\n\n c\r\n\td  x", "\u010a \u0120x \u00e9\u010aé", "it's don't 'll '' ''s 're're've'lll x'S \n's  's", "\x00\x1c\x85 \u2028 y", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "日本 ½ ²", "", "\n", "é'ss ª×÷µ¼ a\u00a0b  ", "'", " '", "''t", "x" * 5000, None]


def test_encoder_equals_the_library(monkeypatch):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    signs = [" ", " ", "\n", "\t", "'", "'s", "'ll", "'re", "a", "b", "word", "É", "ß", "ñ", "1", "23", "²", ".", ",", "--", "\x1f", "ĺ", "ȿ"]
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for kept in (40, 100_000):
        monkeypatch.setattr(ts, "KEPT", kept)
        own = ts.Encoder()
        for k in (0, 700):
            ids, counts = own.encode(pa.array(texts[k:] + texts[:k], pa.string()))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[k:] + want[:k]
        assert own.used <= kept and own.encode(pa.array([], pa.string()))[1].tolist() == []


def brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_written_files_read_back(spark, monkeypatch):
    texts = ["", None, "hello <|endoftext|> world's  \n\n x", "é" * 3000, "a b " * 4000, "中文 ² ½"]
    rows = [(i * 7 % 50, texts[i % 6]) for i in range(50)] + [(None, "null id"), (100, "twice"), (100, "twice")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start long").repartition(3)
    manifest = ts.write(df, new_dir(spark, "t"))
    assert sum(r.n_docs for r in manifest.collect()) == len(rows)
    assert all(os.path.exists(r.path.replace("file:", "")) for r in manifest.collect())
    part = spark.read.parquet(manifest.inputFiles()[0].rpartition("/")[0]).orderBy("part", "seq").first()
    want = next(b for b in brute(rows) if b[0] == ts.document(part.path, 0)[0])
    assert zlib.crc32(ts.document(part.path, 0)[1].astype("<u4").tobytes()) == want[3]
    key = lambda r: (r[1], r[2])
    assert sorted((tuple(r) for r in ts.read(manifest).collect()), key=key) == sorted(brute(rows), key=key)
    assert ts.read(ts.write(df.limit(0), new_dir(spark, "t"))).count() == 0
