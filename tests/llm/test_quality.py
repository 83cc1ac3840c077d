import random
import re
from collections import Counter

import pyarrow as pa

from lamina.llm import quality as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = sum(map(len, words))
    lines = Counter(x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    of = lambda x: len(re.sub(r"[\x20\x09-\x0D]", "", x))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": sum(n - 1 for n in lines.values()), "dup_line_chars": sum((n - 1) * of(x) for x, n in lines.items())}
    fine = 100 * out["dup_line_chars"] <= q.LINE_LIMIT * chars
    for n, most in q.LIMITS.items():
        runs = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        hit = {j for i in range(len(words) - n + 1) if runs[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        out[f"dup_{n}gram_chars"] = sum(len(words[j]) for j in hit)
        if n == q.WINDOW:
            out["n_repeat_words"] = len(hit)
        fine &= 100 * out[f"dup_{n}gram_chars"] <= most * chars
    out["base_failed"] = len(words) < q.MIN_WORDS or 100 * out["n_repeat_words"] > q.WINDOW_LIMIT * len(words)
    out["kept"] = fine and not out["base_failed"]
    return out


def texts():
    rng = random.Random(6)
    yield from (None, "", " \n\t", "a", "\n\nx\n\nx\n", "é é\xa0é\x85 é é " * 9, "a b c d e f g h " * 2, "|" * 50)
    for _ in range(120):
        vocabulary = [rng.choice(["ab", "é", "日本", "c#", "x|y", "longer"]) + str(k) for k in range(rng.choice([3, 10, 60, 400]))]
        yield "".join(rng.choice(vocabulary) + rng.choice([" "] * 8 + ["\n", "  ", "\t", "\r\n"]) for _ in range(rng.randint(1, 150)))


def test_measures_by_brute_force():
    rows = list(texts())
    got = q.measure(pa.array(rows, pa.string()))
    for i, t in enumerate(rows):
        want = brute(t)
        assert {k: got[k][i] for k in want} == want, t
    whole = sum(got["kept"])
    assert 0 < whole < len(rows)


def test_slices_do_not_change_results(monkeypatch, spark):
    from lamina.llm import words

    rows = list(texts())
    df = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(rows)], "doc_id long, text string, n_words string, kept boolean").repartition(3)
    got = {r.doc_id: r for r in q.score(df, df.columns).collect()}
    assert len(got) == len(rows) and all(got[i].kept == brute(t)["kept"] and got[i].n_words == brute(t)["n_words"] for i, t in enumerate(rows))
    kept = q.keep_clean(df).collect()
    assert {r.doc_id for r in kept} == {i for i, t in enumerate(rows) if brute(t)["kept"]} and {r.n_words for r in kept} == {"x"}
    assert q.score(df.limit(0)).count() == 0
    assert words.SLICE_BYTES == 1 << 20
