"""Language identification by unigrams over pieces, with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary; a word's probability is
the sum, over all ways to cut it into pieces, of the product of theirs (the forward algorithm), and a
text's is the product over its words. Pieces are those of the vocabulary that are letters, with or
without a leading space, and all single bytes, so that every word can be cut.

Words are runs of ASCII letters and non-ASCII bytes of the lower-cased text; in scripts without spaces they may be as long as
the text. A run over BLOCK bytes is summed in blocks: for each, the linear map from the sums before it to those after it, and
then the product of these maps, which is the sum over all segmentations of the whole run.

Fitting takes at most PER_LANG distinct whole texts of each language (those of lowest hash): a documented bound
on a sample of labelled rows. Piece probabilities come from expectation maximisation over all their words; those over
BLOCK bytes are learned from in parts, cut between characters.

Edge cases: a null text, or one without a letter, is `und` with score 0; equal rows get equal results; a
null doc_id is never learned from and not held out; other columns are not looked at. With nothing to
learn from, every text is `und`.
"""

import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import words as W
from .session import schema_of, small_batches, table, with_text

#: Most texts of a language that are learned from.
PER_LANG = 200
ROUNDS, SMOOTH = 4, 0.5
#: Parts of a language's texts that are ranked by themselves.
RANKED = 64
#: Bytes of a block of a long run.
BLOCK = 512
#: Most numbers in one table of expectation().
CELLS = 4_000_000
U = np.uint64
_OTHER = np.ones(256, bool)
_OTHER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False


def vocabulary(path=None):
    """Pieces: all bytes, then the letter tokens of the rank file."""
    out = [bytes([i]) for i in range(256)]
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        for line in f:
            b = base64.b64decode(line.split()[0])
            body = b.removeprefix(b" ").decode("utf-8", "ignore")
            if len(b) > 1 and body.isalpha() and body == body.lower() and len(body.encode()) >= len(b) - 1:
                out.append(b)
    return out


class Lookup:
    """Piece numbers by hash: three tables, each with what did not fit the one before."""

    def __init__(self, pieces):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = ends - [len(p) for p in pieces]
        up, down = W._power(len(data) + 1)
        prefix = np.zeros(len(data) + 1, U)
        np.cumsum(W._CODE[data] * up[: len(data)], out=prefix[1:])
        key = W.mix((prefix[ends] - prefix[starts]) * down[starts])
        self.longest, self.tables, rest = max(map(len, pieces)), [], np.arange(len(pieces))
        for k in range(8):
            if not len(rest):
                break
            keys, ids = np.zeros(1 << 18, U), np.full(1 << 18, -1, np.int32)
            slot = (key[rest] >> U(7 * k)) & U((1 << 18) - 1)
            keys[slot], ids[slot] = key[rest], rest
            self.tables.append((U(7 * k), keys, ids))
            rest = rest[ids[slot] != rest]

    def __call__(self, raw):
        """Numbers of the pieces with these unmixed hashes; -1 where there is none."""
        key = W.mix(raw)
        out = np.full(len(key), -1, np.int32)
        for shift, keys, ids in self.tables:
            slot = (key >> shift) & U((1 << 18) - 1)
            np.copyto(out, ids[slot], where=keys[slot] == key)
        return out


class Strings:
    """Words as one buffer, longest first, each with a leading space unless `inner` says that it begins inside a run."""

    def __init__(self, data, start, end, inner=None):
        size, lead = end - start, np.ones(len(start), np.int64) if inner is None else 1 - np.asarray(inner, np.int64)
        self.order = np.argsort(-(size + lead), kind="stable")
        start, size, lead = start[self.order], size[self.order], lead[self.order]
        self.size = size + lead
        self.at = np.cumsum(self.size) - self.size
        total = int(self.size.sum())
        index = np.arange(total) - np.repeat(self.at + lead, self.size) + np.repeat(start, self.size)
        buffer = data[np.maximum(index, 0)] if len(data) else np.zeros(0, np.uint8)
        buffer = buffer.copy()
        buffer[self.at[lead > 0]] = 32
        self.prefix = np.zeros(total + 1, U)
        up, self.down = W._power(total + 1)
        np.cumsum(W._CODE[buffer] * up[:total], out=self.prefix[1:])

    def part(self, a, b):
        """The words from a to b, which must be ordered as all are."""
        out = object.__new__(Strings)
        out.order, out.size, out.at, out.prefix, out.down = np.arange(b - a), self.size[a:b], self.at[a:b], self.prefix, self.down
        return out

    def steps(self, lookup):
        """(j, l, rows, pieces): the words of which bytes j-l to j are a piece, by rising j."""
        for j in range(1, int(self.size[0]) + 1 if len(self.size) else 1):
            active = int(np.searchsorted(-self.size, -j, "right"))
            for n in range(1, min(j, lookup.longest) + 1):
                a = self.at[:active] + (j - n)
                ids = lookup((self.prefix[a + n] - self.prefix[a]) * self.down[a])
                rows = np.flatnonzero(ids >= 0)
                if len(rows):
                    yield j, n, rows, ids[rows]


def log_likelihood(strings, lookup, probs):
    """log of the summed probability of each word (rows, in the order of strings) for each language."""
    n, langs = len(strings.size), probs.shape[1]
    keep = lookup.longest + 1
    ring = np.zeros((keep, n, langs))
    ring[0] = 1
    scale, out, last = np.zeros((n, langs)), np.zeros((n, langs)), 0

    def close(j):
        done = slice(int(np.searchsorted(-strings.size, -j, "left")), int(np.searchsorted(-strings.size, -j, "right")))
        out[done] = np.log(ring[j % keep, done]) + scale[done]

    for j, k, rows, ids in strings.steps(lookup):
        if j != last:
            if last:
                close(last)
                if last % 16 == 0:
                    active = int(np.searchsorted(-strings.size, -j, "right"))
                    top = ring[last % keep, :active].copy()  # never zero: every byte is a piece
                    ring[:, :active] /= top
                    scale[:active] += np.log(top)
            ring[j % keep] = 0
            last = j
        ring[j % keep, rows] += ring[(j - k) % keep, rows] * probs[ids]
    if last:
        close(last)
    return out


def long_run(data, lookup, probs):
    """log of the summed probability of one run of bytes for each language: log_likelihood() for runs of any length."""
    n, langs, deep = len(data), probs.shape[1], lookup.longest
    up, down = W._power(n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum(W._CODE[data] * up[:n], out=prefix[1:])
    first = np.arange(0, n, BLOCK)
    rows, keep = len(first) * deep, deep + 1
    # a row is a block and a place k before its start from which alone the sums begin; ring[j % keep] has those at place j
    ring, scale = np.zeros((keep, rows, langs)), np.zeros((rows, langs))
    for k in range(deep):
        ring[-k % keep, k::deep] = 1
    state = np.zeros((len(first), deep, deep, langs))  # [block, k, m]: of the sums m before the block's end
    ends = np.minimum(first + BLOCK, n) - first
    for j in range(1, BLOCK + 1):
        new = np.zeros((len(first), deep, langs))
        for k in range(1, deep + 1):
            to = first + j
            some = np.flatnonzero((to <= n) & (to - k >= 0))
            a = to[some] - k
            ids = lookup((prefix[a + k] - prefix[a]) * down[a])
            some, ids = some[ids >= 0], ids[ids >= 0]
            if len(some):
                new[some] += ring[(j - k) % keep].reshape(len(first), deep, langs)[some] * probs[ids][:, None, :]
        ring[j % keep] = new.reshape(rows, langs)
        if (done := ends == j).any():
            for m in range(deep):
                state[done, :, m] = ring[(j - m) % keep].reshape(len(first), deep, langs)[done]
        if j % 16 == 0:
            top = ring.max(0)
            top[(top == 0) | np.repeat(ends <= j, deep)[:, None]] = 1
            ring /= top
            scale += np.log(top)
    scale = np.where(state.max(2) > 0, scale.reshape(len(first), deep, langs), -np.inf)
    now, log = np.zeros((deep, langs)), np.zeros(langs)
    now[0] = 1
    for block in range(len(first)):
        most = scale[block].max(0)
        now = np.einsum("kl,kml->ml", now * np.exp(scale[block] - most), state[block])
        if ends[block] < deep:  # places before a short last block go on as they are, but only the end of it counts
            now = now[:1]
        top = now[0]  # the sum up to the block's end, never zero
        now, log = now / top, log + most + np.log(top)
    return log + np.log(now[0])


def expectation(strings, lookup, probs, weight):
    """Expected uses of each piece for each language, over words that occur `weight` times in it."""
    langs, out, a = probs.shape[1], np.zeros_like(probs), 0
    while a < len(strings.size):
        b = min(len(strings.size), a + max(1, CELLS // ((int(strings.size[a]) + 1) * langs)))
        out += _expected(strings.part(a, b), lookup, probs, weight[a:b])
        a = b
    return out


def _expected(strings, lookup, probs, weight):
    n, langs = weight.shape
    top = int(strings.size[0])
    # every byte of a word counts `rise` times, which takes sums over long words to about 1 and cancels in the end
    rise = np.exp(-log_likelihood(strings, lookup, probs) / strings.size[:, None])
    rise = [rise**k for k in range(lookup.longest + 1)]
    alpha, beta = np.zeros((top + 1, n, langs)), np.zeros((top + 1, n, langs))
    alpha[0] = 1
    steps = list(strings.steps(lookup))
    for j, k, rows, ids in steps:
        alpha[j, rows] += alpha[j - k, rows] * probs[ids] * rise[k][rows]
    beta[strings.size, np.arange(n)] = 1
    for j, k, rows, ids in reversed(steps):
        beta[j - k, rows] += beta[j, rows] * probs[ids] * rise[k][rows]
    per = weight / alpha[strings.size, np.arange(n)]
    out = np.zeros_like(probs)
    for j, k, rows, ids in steps:
        used = alpha[j - k, rows] * probs[ids] * rise[k][rows] * beta[j, rows] * per[rows]
        for g in range(langs):
            out[:, g] += np.bincount(ids, used[:, g], len(probs))
    return out


class Model:
    def __init__(self, langs, pieces, probs):
        self.langs, self.lookup, self.probs = langs, Lookup(pieces), probs

    def score(self, texts):
        """(language, score) of each of an array's texts."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # a first look at ASCII spares most texts the Unicode match
        letters = pc.or_(pc.match_substring_regex(texts, "[A-Za-z]"), pc.match_substring_regex(texts, r"\p{L}")).to_numpy(zero_copy_only=False)
        n, langs = len(texts), len(self.langs)
        total = np.zeros((n, langs))
        if langs:
            w = W.words(pc.utf8_lower(texts), _OTHER)
            start, end, doc, key = w.start, w.end, w.doc, w.hash
            if len(start):
                _, first, which = np.unique(key, return_index=True, return_inverse=True)
                per = np.empty((len(first), langs))
                long = end[first] - start[first] >= BLOCK
                strings = Strings(w.data, start[first][~long], end[first][~long])
                per[np.flatnonzero(~long)[strings.order]] = log_likelihood(strings, self.lookup, self.probs)
                for k in np.flatnonzero(long):
                    per[k] = long_run(np.append(np.uint8(32), w.data[start[first[k]] : end[first[k]]]), self.lookup, self.probs)
                for g in range(langs):
                    total[:, g] = np.bincount(doc, per[which, g], n)
        found = letters & (langs > 0)
        best = total.argmax(1) if langs else np.zeros(n, int)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1) if langs else np.zeros(n)
        return [self.langs[b] if f else "und" for b, f in zip(best, found)], np.where(found, share, 0.0)


def _parts(word):
    """A word of up to BLOCK bytes, or the parts of a longer one, cut between characters."""
    out = []
    while len(word) > BLOCK:
        cut = BLOCK
        while word[cut] & 0xC0 == 0x80:
            cut -= 1
        out.append(word[:cut])
        word = word[cut:]
    return [*out, word]


def fit(rows, text="text", lang="lang", per_lang=PER_LANG, path=None):
    """A Model from a frame of labelled texts; null texts and labels are passed over."""
    own = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    own = own.withColumn("h", F.xxhash64("text"))
    some = own.select("lang", "h").distinct()
    for of in (["lang", F.pmod("h", F.lit(RANKED))], ["lang"]):  # first within parts, so that no task gets all of a language
        some = some.withColumn("r", F.row_number().over(Window.partitionBy(*of).orderBy("h"))).where(F.col("r") <= per_lang).drop("r")
    own = own.join(F.broadcast(some), ["lang", "h"]).groupBy("lang", "h").agg(F.any_value("text").alias("text"))  # per_lang rows a language
    found = own.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z\x{80}-\x{10FFFF}]+)"))).alias("word")).groupBy("lang", "word").count().collect()
    langs = sorted({r["lang"] for r in found})
    pieces = vocabulary(path)
    number, inner = {}, []
    weight = []
    for r in sorted(found, key=lambda r: (r["word"], r["lang"])):
        for k, part in enumerate(_parts(r["word"].encode())):
            i = number.setdefault((part, k > 0), len(number))
            if i == len(weight):
                weight.append([0] * len(langs))
                inner.append(k > 0)
            weight[i][langs.index(r["lang"])] += r["count"]
    weight = np.array(weight, float).reshape(len(number), len(langs))
    data = np.frombuffer(b"".join(b for b, _ in number), np.uint8)
    end = np.cumsum([len(b) for b, _ in number], dtype=np.int64)
    start = end - np.array([len(b) for b, _ in number], np.int64)
    model = Model(langs, pieces, np.full((len(pieces), len(langs)), 1 / len(pieces)))
    if len(number):
        strings = Strings(data, start, end, inner)
        weight = weight[strings.order]
        for _ in range(ROUNDS):
            used = expectation(strings, model.lookup, model.probs, weight) + SMOOTH
            model.probs = used / used.sum(0)
    return model


def predict(df, model, keep=("doc_id",), text="text"):
    """The columns `keep` of df with lang_pred and score."""
    small_batches(df.sparkSession)
    source, text = with_text(df, keep, text, ("lang_pred", "score"))
    fields = source.columns[:-1]
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is that of the vocabulary

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, text):
                langs, scores = shared.value.score(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(f) for f in fields), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*fields, "lang_pred", "score"])

    return source.mapInArrow(run, schema_of(source, "lang_pred string, score double"))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def op3_unigram_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(held_out() != 1))
    return predict(docs, model).select("doc_id", F.coalesce(held_out() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
