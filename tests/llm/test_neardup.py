import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lamina.llm import neardup as nd


def fixture():
    rng = random.Random(8)
    vocabulary = [f"wörd{i}" for i in range(400)]
    docs, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for base in range(40):
        t = [rng.choice(vocabulary) for _ in range(rng.randint(40, 300))]
        if base % 3 == 0:
            t += passage
        docs.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            u = list(t)
            for _ in range(rng.randint(0, 1 + len(u) // 40)):
                u[rng.randrange(len(u))] = rng.choice(vocabulary)
            docs.append(u)
    base = docs[5]
    for _ in range(60):  # a large group
        u = list(base)
        u[rng.randrange(len(u))] = rng.choice(vocabulary)
        docs.append(u)
    rows = [(i * 3, " ".join(t)) for i, t in enumerate(docs)]
    return rows + [(10_000, rows[0][1]), (10_000, rows[0][1]), (None, rows[1][1]), (10_001, None), (10_002, None), (10_003, ""), (10_004, ""), (10_005, " \n"), (10_006, "a b"), (10_007, "A  b"), (10_008, "a c")]


def brute(rows):
    """Similarity of two texts by the definition."""
    texts = [t for _, t in rows]
    frequency = np.zeros(nd.BUCKETS, np.int64)
    for t in texts:
        nd.count_documents(pa.array([t], pa.string()), frequency)
    idf = nd.idf_of(frequency, len(texts))

    def bag(t):
        words = (t or "").lower().split()
        value = {w: float(idf[nd._bucket(nd.split(pa.array([w])).hash)][0]) for w in set(words)}
        runs = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
        return {g: n * sum(value[w] for w in g) / len(g) for g, n in runs.items()}

    bags = {t: bag(t) for t in set(texts)}

    def sim(a, b):
        both = sum(min(w, bags[b].get(g, 0)) for g, w in bags[a].items())
        whole = sum(bags[a].values()) + sum(bags[b].values()) - both
        return both / whole if whole else 0.0

    return sim, idf


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def joined(cell, root, texts, idf):
    """The classes that linked() makes of roots, and its links."""
    i, j = nd.linked(np.array(cell), np.array(root), *nd.shingles(pa.array(texts, pa.string()), idf))
    return list(zip(i.tolist(), j.tolist()))


def test_links_of_cells_are_those_of_all_pairs():
    rng = random.Random(1)
    rows = [r for r in fixture() if r[1] and r[1].split()]
    sim, idf = brute(rows)
    for trial in range(6):
        texts = [rng.choice(rows)[1] for _ in range(90)]
        cell = sorted(rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7]) for _ in texts)
        root = [100 + k % (4 if trial % 2 else 90) for k in range(len(texts))]
        got = joined(cell, root, texts, idf)
        assert all(cell[i] == cell[j] and root[i] != root[j] and sim(texts[i], texts[j]) >= nd.LEAST for i, j in got)
        same = [(i, j) for i in range(len(texts)) for j in range(i) if cell[i] == cell[j] and root[i] == root[j]]
        every = [(i, j) for i in range(len(texts)) for j in range(i) if cell[i] == cell[j] and sim(texts[i], texts[j]) >= nd.LEAST]
        assert components(len(texts), same + got) == components(len(texts), same + every)
    assert joined([0, 0], [0, 1], [rows[0][1], rows[0][1]], idf) and not joined([0, 0], [1, 1], [rows[0][1], rows[0][1]], idf) and not joined([0, 1], [0, 1], [rows[0][1], rows[0][1]], idf)


def test_samples_agree_as_often_as_texts_are_alike():
    rows = [r for r in fixture() if r[1]]
    sim, idf = brute(rows)
    sig = nd.samples(*nd.shingles(pa.array([t for _, t in rows]), idf), len(rows))
    some = [(i, i + 1) for i in range(len(rows) - 1)]
    real = np.array([sim(rows[i][1], rows[j][1]) for i, j in some])
    seen = np.array([(sig[i] == sig[j]).mean() for i, j in some])
    assert abs((seen - real).mean()) < 0.02 and np.abs(seen - real).max() < 0.35


def test_classes_equal_brute_force(spark):
    rows = fixture()
    sim, _ = brute(rows)
    links = [(i, j) for i, (_, a) in enumerate(rows) for j, (_, b) in enumerate(rows[:i]) if a is not None and b is not None and (a == b or sim(a, b) >= nd.LEAST)]
    want = {}
    for k, (d, _) in zip(components(len(rows), links), rows):
        want.setdefault(k, []).append(d)
    want = Counter(tuple(sorted(v, key=str)) for v in want.values())
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string").repartition(5)
    got = {}
    out = nd.near_duplicates(df).collect()
    for k, r in enumerate(out):
        got.setdefault(f"null {k}" if r.class_key is None else r.class_key, []).append(r.doc_id)
        assert r.class_id is not None
    assert Counter(tuple(sorted(v, key=str)) for v in got.values()) == want
    kept = nd.keep_one(df).collect()
    assert len(kept) == len(want) and {r.key for r in kept} == {"x"}
    least = {r.class_id for r in out}
    assert Counter(r.doc_id for r in kept) == Counter(least)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def passages(pairs=60, seed=3):
    """Texts of one common passage, all alike by about 0.75, and in couples (2k, 2k + 1) by more than 0.8."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)]  # in every text, so that weights are all but equal
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = say(240), []
    for _ in range(pairs):
        own = say(40)
        texts += [passage + own, passage + own[:14] + say(26)]
    return [" ".join(t) for t in texts]


def couples_apart(rows):
    of = {r.doc_id: r.class_key for r in rows}
    return [k for k in range(0, 2 * (max(d for d in of if d < 1000) // 2) + 1, 2) if of[k] != of[k + 1]]


def test_couples_among_texts_that_share_a_passage(spark):
    texts = passages()
    frequency = np.zeros(nd.BUCKETS, np.int64)
    nd.count_documents(pa.array(texts), frequency)
    idf = nd.idf_of(frequency, len(texts))
    sim, _ = brute(list(enumerate(texts)))
    assert all(sim(a, b) >= nd.LEAST for a, b in zip(texts[::2], texts[1::2])) and all(sim(a, b) < nd.LEAST for a, b in zip(texts, texts[2:]))
    got = nd.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert couples_apart(got) == [] and len({r.class_key for r in got}) == len(texts) // 2


def test_last_cells_hold_every_pair_of_different_classes(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)
    rng = random.Random(4)
    members = [(b, u, 10) for b in range(5) for u in rng.sample(range(60), 3 + 11 * b)]
    root = {u: u % 2 * u % 9 for u in range(0, 60, 2)} | {u: u for u in range(1, 60, 2)}
    placed = spark.createDataFrame(members, "band long, uid long, bytes long")
    rows = nd.last_cells(placed, spark.createDataFrame(list(root.items()), "uid long, root long")).select("uid", "root", nd.F.explode("cells").alias("c")).select("c.*", "uid", "root").collect()
    cells = {}
    for r in rows:
        assert r.root == root[r.uid]
        cells.setdefault((r.band, r.low, r.high), []).append(r.uid)
    assert max(map(len, cells.values())) <= 3 * 7 * 2 and all(len(set(c)) == len(c) for c in cells.values())
    got = {(b, x, y) for (b, _, _), c in cells.items() for x in c for y in c if root[x] != root[y]}
    of = {b: [u for k, u, _ in members if k == b] for b in range(5)}
    assert got == {(b, x, y) for b, c in of.items() for x in c for y in c if root[x] != root[y]}


def test_edit_trees_equal_brute_force(spark, monkeypatch):
    """Texts that come from each other by edits, so that classes hang together by few links."""
    monkeypatch.setattr(nd, "BLOCK", 40)
    rng, rows = random.Random(17), []
    for tree in range(3):
        texts = [[f"t{rng.randrange(600)}" for _ in range(90)]]
        while len(texts) < 220:
            u = list(rng.choice(texts))
            for _ in range(rng.randint(1, 3)):
                u[rng.randrange(len(u))] = f"t{rng.randrange(600)}"
            texts.append(u)
        rows += [(1000 * tree + k, " ".join(u)) for k, u in enumerate(texts)]
    sim, _ = brute(rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] // 1000 == rows[j][0] // 1000 and sim(rows[i][1], rows[j][1]) >= nd.LEAST]
    want = components(len(rows), links)
    first = {r.doc_id: (r.class_id, r.class_key) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {d: c for d, (c, _) in first.items()}
    lost = sum(got[rows[i][0]] != got[rows[j][0]] for i, j in links)
    assert lost == 0 and [got[d] for d, _ in rows] == [rows[k][0] for k in want]
    again = {r.doc_id: (r.class_id, r.class_key) for r in nd.near_duplicates(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)).collect()}
    assert again == first


def test_couples_are_found_beside_a_hot_group(spark):
    rng = random.Random(11)
    base = [f"h{i}" for i in range(150)]
    hot = [" ".join(base[:k] + [f"x{rng.random()}"] + base[k + 1 :]) for k in range(150) for _ in range(4)]  # many links of no concern to others
    rows = list(enumerate(passages(100, seed=5))) + [(1000 + k, t) for k, t in enumerate(hot)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert couples_apart(got) == [] and len({r.class_key for r in got if r.doc_id >= 1000}) == 1
