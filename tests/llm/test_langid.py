import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lamina.llm import langid
from lamina.llm.langid import Lookup, Strings, log_likelihood


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(3)
    pieces = [bytes([i]) for i in range(256)] + [b"ab", b" a", b"abc", b"bc", b" ab", b"ccccc"]
    probs = rng.random((len(pieces), 2)) / 100
    lookup, number = Lookup(pieces), {p: i for i, p in enumerate(pieces)}

    def brute(b, g):
        if not b:
            return 1.0
        return sum(probs[number[b[:k]], g] * brute(b[k:], g) for k in range(1, len(b) + 1) if b[:k] in number)

    words = [b"a", b"abc", b"abcabcab", b"cccccc", b"xyz"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    strings = Strings(data, end - [len(w) for w in words], end)
    got = log_likelihood(strings, lookup, probs)
    for row, i in zip(got, strings.order):
        assert np.allclose(row, [np.log(brute(b" " + words[i], g)) for g in (0, 1)])


def test_long_words_do_not_underflow():
    model = langid.Model(["x", "y"], [bytes([i]) for i in range(256)], np.full((256, 2), 1 / 256))
    langs, scores = model.score(pa.array(["q" * 5000, None, "", "12 34 …", "a"]))
    assert langs == ["x", "und", "und", "und", "x"] and np.allclose(scores, [0.5, 0, 0, 0, 0.5])


def test_long_runs_are_summed_whole(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 64)
    rng = np.random.default_rng(4)
    pieces = [bytes([i]) for i in range(256)] + [b"ab", b" a", b"abc", b"bca", b"cabcab", "é".encode(), "éa".encode()]
    probs = rng.random((len(pieces), 3)) / 100
    lookup, number = Lookup(pieces), {p: i for i, p in enumerate(pieces)}
    for n in (1, 5, 63, 64, 65, 66, 128, 130, 700):
        run = b" " + "".join(rng.choice(list("abcé"), n)).encode()
        alpha = np.zeros((len(run) + 1, 3), np.longdouble)
        alpha[0] = 1
        for j in range(1, len(run) + 1):
            for k in range(1, min(j, lookup.longest) + 1):
                if run[j - k : j] in number:
                    alpha[j] += alpha[j - k] * probs[number[run[j - k : j]]]
        assert np.allclose(langid.long_run(np.frombuffer(run, np.uint8), lookup, probs), np.log(alpha[-1]).astype(float))
    model = langid.Model(["x", "y", "z"], pieces, probs)
    text = "".join(rng.choice(list("abcé"), 600))
    whole = langid.long_run(np.frombuffer(b" " + text.encode(), np.uint8), lookup, probs)
    monkeypatch.setattr(langid, "BLOCK", 10_000)
    assert np.isclose(model.score(pa.array([text]))[1][0], 1 / np.exp(whole - whole.max()).sum())


def test_expected_uses_by_brute_force():
    rng = np.random.default_rng(6)
    pieces = [bytes([i]) for i in range(256)] + [b"ab", b" a", b"abc", b"bc"]
    probs = rng.random((len(pieces), 2)) / 10
    number = {p: i for i, p in enumerate(pieces)}

    def cuts(b):
        if not b:
            yield []
        for k in range(1, len(b) + 1):
            if b[:k] in number:
                for rest in cuts(b[k:]):
                    yield [number[b[:k]], *rest]

    words, inner = [b"abcab", b"a", b"bcabc"], [False, True, False]
    weight = np.array([[1.0, 2], [3, 0], [0, 5]])
    data, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    strings = Strings(data, end - [len(w) for w in words], end, inner)
    want = np.zeros_like(probs)
    for w, i, n in zip(words, inner, weight):
        every = list(cuts(w if i else b" " + w))
        for g in range(2):
            p = np.array([np.prod(probs[c, g]) for c in every])
            for c, x in zip(every, p / p.sum() * n[g]):
                np.add.at(want[:, g], c, x)
    assert np.allclose(langid.expectation(strings, Lookup(pieces), probs, weight[strings.order]), want)


def test_scripts_without_spaces(spark):
    rng = np.random.default_rng(2)
    one, two = [chr(0x4E00 + k) for k in range(40)], [chr(0x3041 + k) for k in range(40)]
    rows = [(k, "".join(rng.choice(one if k % 2 else two, 900)), "zz" if k % 2 else "yy") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.fit(df.where("doc_id < 20"))).collect()}
    assert all(got[k][0] == g and got[k][1] > 0.99 for k, _, g in rows)


def test_copies_take_one_place_of_the_sample(spark):
    rows = [(k, "gleich", "a") for k in range(300)] + [(1000 + k, f"wort{'abcdefgh'[k]}", "a") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, per_lang=9)
    uniform = langid.SMOOTH / (langid.SMOOTH * len(model.probs))
    assert model.probs[[ord(c) for c in "wort"]].max() > uniform


def test_held_out_accuracy(spark):
    out = langid.op3_unigram_language(spark, "/root/testdata/sf0.01").collect()
    true = dict(zip(*(pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pydict()[c] for c in ("doc_id", "lang"))))
    assert len(out) == len(true) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r.lang_pred == true[r.doc_id] for r in out if r.held_out]
    assert sum(held) / len(held) >= 0.95, sum(held) / len(held)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (None, None, "en")], "doc_id long, text string, lang string")
    assert [tuple(r)[1:] for r in langid.predict(df, langid.fit(df)).collect()] == [("und", 0.0)] * 2
