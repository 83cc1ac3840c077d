import random
import re

import numpy as np

from lamina.llm import decontam


def brute(a, b):
    """Plain Smith-Waterman over word lists."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_by_brute_force():
    rng = random.Random(0)
    a = [[rng.randint(2, 6) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    b = [[rng.randint(2, 6) for _ in range(rng.randint(1, 25))] for _ in range(60)]
    got = decontam.aligned([np.array(x, np.uint64) for x in a], [np.array(x, np.uint64) for x in b])
    for x, y, (score, lo, hi) in zip(a, b, got):
        assert abs(score * 2 * len(x) - brute(x, y)) < 1e-9
        assert brute(x, y[lo:hi]) == brute(x, y)


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())


def fixture():
    rng = random.Random(4)
    vocabulary = [f"w{i}é" for i in range(300)] + ["the", "of"] * 20
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randint(15, 50)) for _ in range(12)] + [["two", "words"]]
    docs = []
    for d in range(150):
        t = say(rng.randint(30, 200))
        if d % 5 == 0:
            item = [w if rng.random() > 0.15 else rng.choice(vocabulary) for w in items[d // 5 % 12]]
            t[10:10] = item
        if d % 3 == 0:
            t[20:20] = items[0]  # in a third of the documents
        docs.append((d, ("\n" if d % 2 else " ").join(t).upper()))
    docs[7] = (7, docs[7][1] + " Two, WORDS!")
    return docs + [(None, None), (900, ""), (900, "")], [(i, " ".join(x)) for i, x in enumerate(items)] + [(None, None), (77, "")]


def test_pairs_equal_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    got = decontam.pairs(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i) for d, t in docs if t for i, x in items if x and brute(words(x), words(t)) / (2 * len(words(x))) >= max(0.5, min(8, len(words(x))) / len(words(x)))}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 60
    text = dict(docs)
    for r in got:
        part = words(text[r.doc_id][r.start : r.end])
        assert abs(brute(words(items[r.item_id][1]), part) / (2 * len(words(items[r.item_id][1]))) - r.score) < 1e-9


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = {tuple(r) for r in decontam.pairs(df, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 150)
    assert {tuple(r) for r in decontam.pairs(df, bench).collect()} == one
    assert decontam.pairs(df.limit(0), bench).count() == 0 and decontam.pairs(df, bench.limit(0)).count() == 0


def edited(rng, item, every=9):
    """item with every ninth word changed, which leaves about two thirds of its 3-grams."""
    return [f"new{rng.random()}" if k % every == every - 1 else w for k, w in enumerate(item)]


def test_edited_copy_in_a_tiny_table(spark):
    rng = random.Random(6)
    item = [f"w{i}" for i in range(40)]
    docs = [(0, " ".join(["a", "b", *edited(rng, item), "c"])), (1, "nothing of it"), (2, " ".join(f"v{i}" for i in range(60)))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.pairs(df, bench).collect()] == [(0, 5)]
    assert {r.doc_id for r in decontam.drop_contaminated(df, bench).collect()} == {1, 2}


def test_edited_copy_in_a_third_of_all_rows(spark):
    rng = random.Random(7)
    item = [f"w{i}" for i in range(40)]
    passage = edited(rng, item)
    docs = [(d, " ".join([f"v{rng.randrange(500)}" for _ in range(30)] + (passage if d % 3 == 0 else []))) for d in range(300)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontam.pairs(df, bench).collect()} == set(range(0, 300, 3))


def test_no_alignment_scores_over_the_bound():
    rng = random.Random(8)
    a = [[rng.randint(2, 9) for _ in range(rng.randint(1, 12))] for _ in range(80)]
    b = [[rng.randint(2, 9) for _ in range(rng.randint(1, 25))] for _ in range(80)]
    most = decontam.bound([np.array(x, np.uint64) for x in a], [np.array(x, np.uint64) for x in b])
    assert all(brute(x, y) <= m for x, y, m in zip(a, b, most.tolist()))
    own = [np.array(x, np.uint64) for x in a]
    assert decontam.bound(own, own).tolist() == [2 * len(x) for x in a]


def test_a_common_phrase_is_no_copy_of_a_short_item(spark):
    items = spark.createDataFrame([(1, "a few more words that are here"), (2, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so there are a few more words in it"), (2, "well a few more words that are here now"), (3, "x one two three four five six seven eight y"), (4, "x one two three four five six seven y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.pairs(docs, items).collect()) == [(2, 1), (3, 2)]
