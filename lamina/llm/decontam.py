"""Benchmark decontamination: n-gram seeds, a bound of the score, then Smith-Waterman alignment.

Words are runs of ASCII letters, digits and non-ASCII bytes of the lower-cased text. Every n-gram of a
test item is a seed, however many documents have it, and opens a window in each of them. No alignment of a
window with the item scores more than bound(), which needs no alignment; only windows whose bound is under
the limit are passed over, so no pair is lost by it. The others are aligned with the whole item; the best score
over what a perfect copy would have is the pair's score. The limit is LEAST, and at least what EVIDENCE matching words
(or all of a shorter item) score, so that a common turn of phrase is no copy of a short item.

The benchmark is taken in blocks of about BLOCK_WORDS words, so what is sent to executors is bounded;
each block is matched with all documents.

Edge cases: null and empty texts match nothing; items of fewer than N words have one seed, the whole
item; repeated rows (and null ids) each give their pairs; equal items give a pair each; with no item or no document there is no pair.
Other columns are not read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from . import words as W
from .session import schema_of, small_batches, spread, table, with_text

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score, of 1 for a perfect copy; and the matching words that it must be worth, or all of a shorter item's.
LEAST, EVIDENCE = 0.5, 8
#: Words a window has besides the item's own number, on either side: SLACK and a quarter of the item.
SLACK = 8
BLOCK_WORDS = 1_000_000
#: Cells of the alignments made at a time.
CELLS = 4_000_000
U = np.uint64
_OTHER = np.ones(256, bool)
_OTHER[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


def split(texts):
    return W.words(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), _OTHER)


def grams(w):
    """(first word, hash) of each n-gram; a text of fewer words has one, of all its words."""
    at, h = W.windows(w.hash, w.doc, N)
    first = np.cumsum(w.count) - w.count
    for size in range(1, N):
        few = np.flatnonzero(w.count == size)
        if len(few):
            s = np.zeros(len(few), U)
            for k in range(size):
                s = s * U(0xD6E8FEB86659FD93) + w.hash[first[few] + k]
            at, h = np.concatenate([at, first[few]]), np.concatenate([h, W.mix(s + U(size))])
    return at, h


class Seeds:
    """The n-grams of a block's items, sorted by hash, and which item has each at which word."""

    def __init__(self, item_ids, texts):
        w = split(pa.array(texts, pa.large_string()))
        first = np.cumsum(w.count) - w.count
        self.ids = item_ids
        self.items = [w.hash[f : f + n] for f, n in zip(first, w.count)]
        at, h = grams(w)
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        self.keys, self.from_ = np.unique(h, return_index=True)
        self.to = np.append(self.from_[1:], len(h))
        self.item, self.word = w.doc[at], at - first[w.doc[at]]
        self.short = {n: np.unique(h[w.count[self.item] == n]) for n in range(1, N)}
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.keys >> U(44)] = True

    def hits(self, w):
        """(word, number of its n-gram) for each n-gram of texts that an item has."""
        at, h = W.windows(w.hash, w.doc, N)
        first = [(at, h)]
        for n, keys in self.short.items():
            if len(keys):
                a, _ = W.windows(w.hash, w.doc, n)
                s = np.zeros(len(a), U)
                for k in range(n):
                    s = s * U(0xD6E8FEB86659FD93) + w.hash[a + k]
                first.append((a, W.mix(s + U(n))))
        at, h = (np.concatenate(x) for x in zip(*first)) if len(first) > 1 else first[0]
        may = np.flatnonzero(self.sieve[h >> U(44)])
        at, h = at[may], h[may]
        k = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        found = self.keys[k] == h if len(self.keys) else np.zeros(len(h), bool)
        return at[found], k[found]


def align(a, b):
    """Smith-Waterman with linear gaps over rows of a (padded with 0) and b (padded with 1):
    (score, last column + 1) of the best local alignment of each pair of rows."""
    n, width = b.shape
    gap = -GAP * np.arange(width + 1, dtype=np.int32)
    row = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        t = np.zeros((n, width + 1), np.int32)
        t[:, 1:] = row[:, :-1] + np.where(a[:, i : i + 1] == b, MATCH, MISMATCH)
        np.maximum(t, row + GAP, out=t)
        np.maximum(t, 0, out=t)
        row = np.maximum.accumulate(t + gap, 1) - gap  # a gap from any column to the left
        at = row.argmax(1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
    return best, end


def _padded(rows, fill):
    out = np.full((len(rows), max(map(len, rows))), fill, U)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def aligned(items, spans):
    """(score of 1 at most, first column, last column + 1) for each pair of word arrays."""
    out = []
    k = 0
    while k < len(items):
        most, j = 0, k
        while j < len(items) and (j == k or max(most, len(items[j]) + len(spans[j])) * 100 * (j - k + 1) < CELLS):
            most = max(most, len(items[j]) + len(spans[j]))
            j += 1
        a, b = items[k:j], spans[k:j]
        score, end = align(_padded(a, 0), _padded(b, 1))
        back, size = align(_padded([x[::-1] for x in a], 0), _padded([x[:e][::-1] if e else x[:1] for x, e in zip(b, end)], 1))
        out += [(s / (MATCH * len(x)), int(e - n), int(e)) for s, x, e, n in zip(score.tolist(), a, end, size)]
        k = j
    return out


def _best_run(found, part, parts):
    """The most that a run of each part's words can score, if each word found is a match and each other costs what an edit does."""
    value = np.where(found, MATCH, max(MISMATCH, GAP)).astype(np.int64)
    far = part * (4 * MATCH * len(part) + 1)  # so that no part sees the sums of those before it
    total = np.cumsum(value)
    run = total - far - np.minimum.accumulate(total - value - far)
    best = np.zeros(parts, np.int64)
    np.maximum.at(best, part, run)
    return best


def bound(items, spans):
    """No local alignment of a pair of word arrays scores more: a match needs the word on both sides, and each other word
    between the ends costs an edit, in the item as in the span."""
    keys, parts = [], []
    for rows in (items, spans):
        part = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        keys.append(np.concatenate(rows) ^ W.mix(part.astype(U)))  # equal keys of different pairs can only raise the bound
        parts.append(part)
    return np.minimum(*(_best_run(np.isin(own, other), part, len(items)) for own, other, part in zip(keys, keys[::-1], parts)))


def limit(size):
    """The least score of items of so many words."""
    return np.maximum(LEAST, np.minimum(size, EVIDENCE) / size)


def promising(items, spans):
    """Which pairs can reach the limit."""
    size = np.array([len(x) for x in items])
    cells = np.cumsum(size + [len(x) for x in spans])
    cuts = np.searchsorted(cells, np.arange(CELLS // 4, cells[-1], CELLS // 4)) if len(cells) else []
    cuts = np.unique([0, *cuts, len(items)])
    most = np.concatenate([bound(items[a:b], spans[a:b]) for a, b in zip(cuts, cuts[1:])])
    return np.flatnonzero(most / (MATCH * size) >= limit(size))


def find(seeds, texts):
    """(text, item, score, start, end) of the pairs at or over the limit; start and end are code points of the lower-cased text."""
    w = split(texts)
    first = np.cumsum(w.count) - w.count
    at, k = seeds.hits(w)
    n = seeds.to[k] - seeds.from_[k]
    entry = np.repeat(seeds.from_[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(at, n)
    if not len(entry):
        return []
    doc, item = w.doc[at], seeds.item[entry]
    size = np.array([len(x) for x in seeds.items])
    slack = SLACK + size[item] // 4
    begin = at - seeds.word[entry]
    bucket = begin // slack  # hits of one copy share a window, or two that overlap
    _, one = np.unique(np.stack([doc, item, bucket]), axis=1, return_index=True)
    doc, item, begin, slack = doc[one], item[one], begin[one], slack[one]
    a = np.maximum(begin - slack, first[doc])
    b = np.minimum(begin + size[item] + slack, first[doc] + w.count[doc])
    items, spans = [seeds.items[i] for i in item], [w.hash[x:y] for x, y in zip(a, b)]
    may = promising(items, spans)
    doc, item, a = doc[may], item[may], a[may]
    got = aligned([items[k] for k in may], [spans[k] for k in may])
    best = {}
    for d, i, x, (score, lo, hi) in zip(doc.tolist(), item.tolist(), a.tolist(), got):
        if score >= limit(size[i]) and score > best.get((d, i), (0,))[0]:
            best[d, i] = (score, x + lo, x + hi - 1)
    if not best:
        return []
    point = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum((w.data & 0xC0) != 0x80, out=point[1:])
    return [(d, i, s, int(point[w.start[x]] - point[w.offs[d]]), int(point[w.end[y]] - point[w.offs[d]])) for (d, i), (s, x, y) in best.items()]


def _blocks(benchmark, item_id, text):
    """(ids, texts) of each block; its size is bounded by that of a block and of its longest item."""
    own = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("length(text) > 0")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // (6 * BLOCK_WORDS))
    for k in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(part.collect(), key=lambda r: (r.item_id is None, r.item_id, r.text))
        yield [r.item_id for r in rows], [r.text for r in rows]


def pairs(docs, benchmark, keep=("doc_id",), text="text", item_id="item_id", item_text="text"):
    """The columns `keep` of docs with item_id, score, start and end: one row for each document and item that it contains."""
    spark = docs.sparkSession
    small_batches(spark)
    source, text = with_text(docs, keep, text, ("item_id", "score", "start", "end"))
    fields = source.columns[:-1]
    kinds = schema_of(source, "item_id long, score double, start long, end long")
    out = spark.createDataFrame([], kinds)
    for ids, texts in _blocks(benchmark, item_id, item_text):

        def match(batches, shared=spark.sparkContext.broadcast(Seeds(ids, texts))):
            seeds = shared.value
            for batch in batches:
                for part in W.slices(batch, text):
                    if got := find(seeds, part.column(text)):
                        d, i, s, a, b = zip(*got)
                        rows = part.take(pa.array(d, pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [*(rows.column(f) for f in fields), pa.array([seeds.ids[x] for x in i], pa.int64()), pa.array(s, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                            names=[*fields, "item_id", "score", "start", "end"],
                        )

        out = out.unionByName(source.mapInArrow(match, kinds))
    return out


def drop_contaminated(docs, benchmark, text="text", item_id="item_id", item_text="text"):
    """The rows of docs that contain no item, with their columns; rows stay where they are, none is exchanged."""
    small_batches(docs.sparkSession)
    context, out = docs.sparkSession.sparkContext, spread(docs)
    for ids, texts in _blocks(benchmark, item_id, item_text):

        def clean(batches, shared=context.broadcast(Seeds(ids, texts))):
            for batch in batches:
                for part in W.slices(batch, text):
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, *_ in find(shared.value, part.column(text))]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op10_seed_and_align(spark, sf_dir):
    return pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
