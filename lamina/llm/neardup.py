"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of SIZE lower-cased words; a shingle weighs its count in the text times
the mean inverse document frequency of its words. Document frequencies cover all documents; words are
hashed into BUCKETS counters, so the table sent to executors has a fixed size. Each of SAMPLES
samples draws one shingle with probability in proportion to its weight, consistently between texts:
two texts agree in a sample with the probability of their weighted Jaccard similarity. Texts equal in
all samples of a band are candidates.

Equal texts are one candidate, and of buckets with the same texts one is kept. Two rounds compare texts by the exact weighted
Jaccard similarity of their shingles. The first gathers classes: every text is compared within a block of the largest and of
the smallest of its buckets. The second is complete: in every bucket whose texts are not yet of one class, all pairs
of texts of different classes are compared. A cell of the second round is a block of texts outside the bucket's largest class and
any other block, so the work follows the rows of a bucket times the texts that are not of its largest class. Nothing is sieved
or left out: the classes are the components of all pairs that share a bucket and have a similarity of LEAST or more, whatever
the order of rows. They are found by passing the least label along links in joins; nothing but counts comes to the driver.

Edge cases: a null text is a class by itself; equal texts (the empty one too) are always one class; a
text of fewer than SIZE words has one shingle, of all its words; texts without words are alike only if
equal. class_id is the class's least doc_id (null if it has none). Repeated rows each give a row; clashing names
of other columns do no harm.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from . import words as W
from .session import materialize, small, small_batches, spread, table

SIZE, LEAST = 5, 0.8
#: Samples, those of a band, and how often samples are dealt out to bands anew: texts of similarity 0.8 share
#: no band in about 1 of 500 cases, and unlike texts that share a passage rarely share one.
SAMPLES, ROWS, DEALS = 40, 5, 4
BUCKETS = 1 << 18
#: Texts, and bytes of text, of a block of a large bucket; bytes of text that a task compares at a time.
BLOCK, BLOCK_BYTES, CHUNK = 256, 4 << 20, 4 << 20
#: Bytes of text worked on at a time, so that arrays stay in the processor's cache.
SLICE = 1 << 18
#: Quantiles of a distribution that random numbers are taken from.
QUANTILES = 1 << 12
U = np.uint64


def _gamma2():
    """Quantiles of the Gamma(2, 1) distribution, whose distribution function is 1 - (1 + x) exp(-x)."""
    p = (np.arange(QUANTILES) + 0.5) / QUANTILES
    low, high = np.zeros_like(p), np.full_like(p, 50.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return mid


_R = _gamma2().astype(np.float32)
_LOG_C = np.log(_gamma2()).astype(np.float32)
_SEEDS = W.mix(np.arange(1, SAMPLES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_dealt = np.random.default_rng(5)
#: The samples of each band.
BANDS = np.concatenate([_dealt.permutation(SAMPLES).reshape(-1, ROWS) for _ in range(DEALS)])


def split(texts):
    return W.words(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))


def _bucket(hashes):
    return (hashes >> U(46)).astype(np.int64)


def count_documents(texts, into):
    """Adds to `into` the number of texts with a word of each bucket."""
    w = split(texts)
    own = np.unique(w.doc.astype(np.int64) * BUCKETS + _bucket(w.hash))
    into += np.bincount(own % BUCKETS, minlength=BUCKETS)


def idf_of(frequency, docs):
    return (np.log((1 + docs) / (1 + frequency)) + 1).astype(np.float32)


def shingles(texts, idf):
    """(text, shingle hash, weight) of each distinct shingle of each text, by text; and which texts have any."""
    w = split(texts)
    per = idf[_bucket(w.hash)].astype(np.float64)
    at, h = W.windows(w.hash, w.doc, SIZE)
    mean = sum(per[at + k] for k in range(SIZE)) / SIZE
    few = np.flatnonzero((w.count > 0) & (w.count < SIZE))
    if len(few):
        first = (np.cumsum(w.count) - w.count)[few]
        s, total = np.zeros(len(few), U), np.zeros(len(few))
        for k in range(SIZE - 1):
            more = w.count[few] > k
            s[more] = s[more] * U(0xD6E8FEB86659FD93) + w.hash[first[more] + k]
            total[more] += per[first[more] + k]
        at, h = np.concatenate([at, first]), np.concatenate([h, W.mix(s + w.count[few].astype(U))])
        mean = np.concatenate([mean, total / w.count[few]])
    doc = w.doc[at]
    order = np.lexsort((h, doc))
    doc, h, mean = doc[order], h[order], mean[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    return doc[at], h[at], count * mean[at]


def samples(doc, h, weight, docs):
    """A (docs, SAMPLES) table of samples; zeros for texts without shingles."""
    out = np.zeros((docs, len(_SEEDS)), np.uint32)
    if not len(h):
        return out
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    log_w = np.log(weight).astype(np.float32)
    mask, bits = U(QUANTILES - 1), U(QUANTILES.bit_length() - 1)
    for k, seed in enumerate(_SEEDS):
        x = W.mix(h ^ seed)
        r = _R[(x & mask).astype(np.int32)]
        log_c = _LOG_C[((x >> bits) & mask).astype(np.int32)]
        beta = (x >> U(40)).astype(np.float32) / np.float32(1 << 24)
        t = np.floor(log_w / r + beta)
        a = (log_c - r * (t - beta + np.float32(1))).view(np.uint32)
        order = a ^ np.where(a >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))  # as floats are ordered
        name = ((x >> U(16)) ^ (t.astype(np.int64).astype(U) * U(0x9E3779B1))) & U(0xFFFFFFFF)
        out[doc[start], k] = (np.minimum.reduceat((order.astype(U) << U(32)) | name, start) & U(0xFFFFFFFF)).astype(np.uint32)
    return out


def bands(sig="sig"):
    """A Column: the array of a hash for each band of a column of samples; those of different bands have nothing in common."""
    return F.array(*(F.xxhash64(F.lit(k), *(F.col(sig)[int(i)] for i in band)) for k, band in enumerate(BANDS)))


def linked(cell, root, doc, h, weight, least=LEAST):
    """Pairs (i, j) of texts that join all the classes which links (similarity of at least `least`) make of the texts of each cell.

    cell, root: of each text, those of a cell together; texts of one root are one class already. doc, h, weight: their shingles.
    Text by text is compared with its whole cell by exact weighted Jaccard similarity, one text of every cell at a time. A text
    is passed over only while it is of its cell's largest class: of two texts that end up in different classes one at least has
    been compared with all others, so no link between classes is lost.
    """
    n = len(cell)
    _, label = np.unique(np.stack([cell, root]), axis=1, return_inverse=True)
    label = np.unique(label.ravel(), return_index=True)[1][label.ravel()]  # a class is named by its first text
    own = np.bincount(doc, weight, n)
    _, rank = np.unique(W.mix(h ^ W.mix(cell[doc].astype(U))), return_inverse=True)
    dense = np.zeros(int(rank.max()) + 1 if len(rank) else 1)
    done, texts = np.bincount(doc, minlength=n) == 0, np.arange(n)
    found = []
    while True:
        size = np.bincount(label, minlength=n)[label[texts]]
        first = np.flatnonzero(np.append(True, cell[texts][1:] != cell[texts][:-1])) if len(texts) else texts
        top = np.maximum.reduceat(size * n + label[texts], first) % n if len(texts) else texts
        per = np.diff(np.append(first, len(texts)))
        open_ = ~done[texts] & (label[texts] != np.repeat(top, per))
        left = np.add.reduceat(open_, first) > 0 if len(texts) else open_
        if not left.any():
            return np.array([x for i, _ in found for x in i], np.int64), np.array([x for _, j in found for x in j], np.int64)
        if left.sum() < 0.7 * len(left):  # cells that are done are left out from here on
            keep = np.zeros(n, bool)
            keep[texts[np.repeat(left, per)]] = True
            texts, some = np.flatnonzero(keep), keep[doc]
            doc, rank, weight = doc[some], rank[some], weight[some]
            continue
        at = np.flatnonzero(open_)
        at = at[np.append(True, np.searchsorted(first, at[1:], "right") != np.searchsorted(first, at[:-1], "right"))]
        chosen = texts[at]
        done[chosen] = True
        of = np.full(n, -1)  # the text that each text is compared with
        of[texts] = np.repeat(_spread(chosen, np.searchsorted(first, at, "right") - 1, len(first)), per)
        mine = np.zeros(n, bool)
        mine[chosen] = True
        mine = mine[doc]
        dense[rank[mine]] = weight[mine]
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        both = np.add.reduceat(np.minimum(weight, dense[rank]), start)
        dense[rank[mine]] = 0
        j = doc[start]
        i = of[j]
        alike = (i >= 0) & (both >= (least - 1e-9) * (own[j] + own[i] - both))
        i, j = i[alike], j[alike]
        new = label[i] != label[j]
        i, j = i[new], j[new]
        _, one = np.unique(label[j], return_index=True)
        found.append((i[one].tolist(), j[one].tolist()))
        to = np.arange(n)
        to[label[j]] = label[i]
        label = to[label]


def _spread(values, places, n):
    out = np.full(n, -1)
    out[places] = values
    return out


def links_within(cells, idf, least=LEAST):
    """The links (a, b) by linked() of the texts of each cell; cells: (band, low, high, uid, root, text), a text once a cell."""
    key = ["band", "low", "high"]
    shared = cells.sparkSession.sparkContext.broadcast(idf)

    def found(t):
        columns = [t.column(c).to_numpy() for c in key]
        new = np.append(False, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        parts = []
        for part in W.slices(t.combine_chunks().to_batches()[0], most=SLICE):
            doc, h, w = shingles(part.column("text"), shared.value)
            parts.append((doc + sum(len(p[3]) for p in parts), h, w, range(part.num_rows)))
        doc, h, w = (np.concatenate([p[k] for p in parts]) for k in range(3))
        i, j = linked(np.cumsum(new), t.column("root").to_numpy(), doc, h, w, least)
        uid = t.column("uid").to_numpy()
        if len(i):
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(uid[i], uid[j])), "b": pa.array(np.minimum(uid[i], uid[j]))})

    def run(batches):
        rest, size = [], 0
        for batch in batches:
            for part in W.slices(batch, most=CHUNK):
                rest.append(part)
                size += part.column("text").nbytes
                if size >= CHUNK:
                    t = pa.Table.from_batches(rest)
                    same = np.logical_and.reduce([t.column(c).to_numpy() == t.column(c)[-1].as_py() for c in key])
                    cut = int(np.argmax(same))  # the last cell may go on in the next batch
                    if cut:
                        yield from found(t.slice(0, cut))
                    rest = t.slice(cut).combine_chunks().to_batches()
                    size = 0 if cut else size
        if rest:
            yield from found(pa.Table.from_batches(rest))

    return cells.repartition(*key).sortWithinPartitions(*key, "uid").mapInArrow(run, "a long, b long")


def first_cells(placed):
    """Cells of the first links: every text in the largest and in the smallest of its buckets, and these cut into blocks."""
    spark = placed.sparkSession
    two = placed.groupBy("uid").agg(F.max(F.struct("n", "band")).alias("x"), F.min(F.struct("n", "band")).alias("y"), F.first("bytes").alias("bytes"))
    two = materialize(spark, two.select("uid", "bytes", F.explode(F.array_distinct(F.array("x.band", "y.band"))).alias("band")), "chosen")
    blocks = materialize(spark, two.groupBy("band").agg(_blocks(F.count("*"), F.sum("bytes")).alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n"), "blocks")
    place = F.pmod(F.xxhash64("uid"), "blocks").cast("int")
    return two.join(small(blocks), "band").select("uid", F.col("uid").alias("root"), F.array(F.struct("band", place.alias("low"), place.alias("high"))).alias("cells"))


def _blocks(rows, size):
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def last_cells(placed, rooted):
    """Cells that hold every pair of texts which share a bucket and have different roots. In each bucket the texts that are not
    of its largest class are cut into blocks, and so are the others; a cell is two blocks, of which the first is of the former."""
    spark = placed.sparkSession
    roots = placed.join(small(rooted), "uid", "left").select("band", "uid", "bytes", F.coalesce("root", "uid").alias("root"))
    per = roots.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    per = per.groupBy("band").agg(F.max(F.struct("n", "root", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("classes")).where("classes > 1")
    mixed = per.select("band", F.col("top.root").alias("top"), _blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("few"), _blocks(F.col("top.n"), F.col("top.bytes")).alias("many"))
    mixed = materialize(spark, mixed, "mixed")
    own = roots.join(small(mixed), "band")
    rest, place = F.col("root") != F.col("top"), lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
    cell = lambda low, high: F.struct(F.col("band"), low.alias("low"), high.alias("high"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # the blocks of the largest class are numbered after those of the rest
    of_rest = F.concat(F.transform(upto("many"), lambda k: cell(place("few"), F.col("few") + k)), F.transform(F.filter(upto("few"), lambda k: k != place("few")), lambda k: cell(F.least(k, place("few")), F.greatest(k, place("few")))))
    of_top = F.transform(upto("few"), lambda k: cell(k, F.col("few") + place("many")))
    return own.select("uid", "root", F.when(rest, of_rest).otherwise(of_top).alias("cells"))


def with_texts(cells, texts):
    """Rows for links_within() from (uid, root, cells) and the texts (uid, text)."""
    return cells.join(texts, "uid").select("uid", "root", "text", F.explode("cells").alias("c")).select("c.*", "uid", "root", "text")


def document_frequencies(texts):
    """The idf table over all rows of a one-column frame. The driver gets BUCKETS counts at most."""

    def run(batches):
        found, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for part in W.slices(batch):
                count_documents(part.column("text"), found)
        k = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"k": pa.array([-1, *k], pa.int64()), "n": pa.array([docs, *found[k]], pa.int64())})

    frequency, docs = np.zeros(BUCKETS, np.int64), 0
    for k, n in texts.mapInArrow(run, "k long, n long").groupBy("k").sum("n").collect():
        if k < 0:
            docs = n
        else:
            frequency[k] = n
    return idf_of(frequency, docs)


def signatures(keyed, idf):
    """The other columns of keyed with the array `sig` of samples (null for texts without words) in place of text."""
    spark = keyed.sparkSession
    names = [c for c in keyed.columns if c != "text"]
    shared = spark.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, most=SLICE):
                doc, h, weight = shingles(part.column("text"), shared.value)
                sig = samples(doc, h, weight, part.num_rows).view(np.int32)
                none = np.ones(part.num_rows, bool)
                none[doc] = False
                offs = pa.array(np.arange(part.num_rows + 1) * SAMPLES, pa.int32(), mask=np.append(none, False))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(offs, pa.array(sig.ravel()))], names=[*names, "sig"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keyed.schema if f.name != "text")
    return keyed.mapInArrow(run, kinds + "sig array<int>")


def components(links):
    """(uid, root) of every end of the links (a, b): the least uid that it is linked to, over any number of links."""
    spark = links.sparkSession
    n = 2 * links.count()
    both = materialize(spark, links.union(links.select("b", "a")).distinct(), "links", n)
    label = materialize(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("uid"), F.least("a", "m").alias("root")), "labels", n)
    while True:
        near = both.join(small(label.select(F.col("uid").alias("b"), "root")), "b").groupBy("a").agg(F.min("root").alias("m"))
        near = materialize(spark, small(label).join(near.withColumnRenamed("a", "uid"), "uid").select("uid", F.col("root").alias("old"), F.least("root", "m").alias("root")), "labels", n)
        jump = near.select(F.col("uid").alias("root"), F.col("root").alias("next"))
        label = materialize(spark, near.join(small(jump), "root").select("uid", F.least("root", "next").alias("root"), "old"), "labels", n)
        if not label.where("root <> old").limit(1).count():
            return label.select("uid", "root")


def joined(rooted, links):
    """The components `rooted` (uid, root) with more links (a, b), of which only roots are followed."""
    spark = rooted.sparkSession
    of = lambda end: small(rooted.select(F.col("uid").alias(end), F.col("root").alias(f"root_{end}")))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = rooted.join(small(more.select(F.col("uid").alias("root"), F.col("root").alias("new"))), "root", "left").select("uid", F.coalesce("new", "root").alias("root"))
    alone = more.join(small(rooted.select("uid")), "uid", "left_anti").select("uid", "root")
    return materialize(spark, moved.union(alone), "labels", rooted.count() + 2 * links.count())


def classes(docs, keep="doc_id", text="text", least=LEAST):
    """Frames (rows, of): `rows` has doc_id and key of each row of docs (key: a digest of its text, none for null texts);
    `of` has key, doc_id (the least of the text's), class_key and class_id of each text."""
    spark = docs.sparkSession
    small_batches(spark)
    own = spread(docs.select(F.col(keep).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    keyed = own.where("text IS NOT NULL").select("doc_id", F.md5("text").alias("key"), F.octet_length("text").cast("long").alias("bytes"), "text")
    idf = document_frequencies(own.select("text"))
    signed = materialize(spark, signatures(keyed, idf), "signatures")
    unique = signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("sig").alias("sig"), F.any_value("bytes").alias("bytes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = unique.repartition(parts, "key").sortWithinPartitions("key")  # so that a text gets the same uid in every run
    unique = materialize(spark, unique.withColumn("uid", F.monotonically_increasing_id()), "texts")

    rows = unique.where("sig IS NOT NULL").select("uid", "bytes", F.explode(bands()).alias("band"))
    mark = F.xxhash64("uid")
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("y")).where("n > 1")
    sizes = materialize(spark, sizes.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n"), "sizes")  # of buckets with the same texts one does
    placed = materialize(spark, rows.join(small(sizes), "band"), "buckets")
    some = materialize(spark, unique.select("key", "uid").join(small(placed.select("uid").distinct()), "uid"), "keys")
    texts = materialize(spark, keyed.select("key", "text").join(small(some), "key").groupBy("uid").agg(F.any_value("text").alias("text")), "candidates")

    first = materialize(spark, links_within(with_texts(first_cells(placed), texts), idf, least), "links")
    rooted = components(first)
    last = materialize(spark, links_within(with_texts(last_cells(placed, rooted), texts), idf, least), "links")
    if last.limit(1).count():
        rooted = joined(rooted, last)

    whole = unique.join(small(rooted), "uid", "left").select("key", "doc_id", F.coalesce("root", "uid").alias("class_key"))
    ids = whole.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    return signed.select("doc_id", "key"), materialize(spark, whole.join(ids, "class_key").select("key", "doc_id", "class_key", "class_id"), "classes")


def near_duplicates(docs, keep="doc_id", text="text", least=LEAST):
    """doc_id, class_id and class_key of every row of docs; rows of one class_key are near-duplicates."""
    rows, of = classes(docs, keep, text, least)
    null = docs.where(F.col(text).isNull()).select(F.col(keep).cast("long").alias("doc_id"))
    return rows.join(of.drop("doc_id"), "key").select("doc_id", "class_id", "class_key").union(null.select("doc_id", "doc_id", F.lit(None).cast("long")))


def keep_one(docs, keep="doc_id", text="text", least=LEAST):
    """One row of docs for each class: that of its least doc_id (null ones last), with all columns; null texts all stay."""
    _, of = classes(docs, keep, text, least)
    first = of.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("f"))
    first = materialize(docs.sparkSession, first.select(F.col("f.doc_id").alias("__id"), F.col("f.key").alias("__key")), "kept")
    own = docs.where(F.col(text).isNotNull()).withColumn("__own", F.md5(F.col(text).cast("string")))
    found = own.join(first, F.equal_null(F.col(keep).cast("long"), F.col("__id")) & (F.col("__own") == F.col("__key")))
    return found.dropDuplicates(["__own", "__id"]).select(*docs.columns).union(docs.where(F.col(text).isNull()))


def op8_weighted_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
