"""Token ids in directly addressable codes, written to binary files and read back by position.

An id is cut into chunks of CHUNK bits, lowest first. Level 0 holds every id's first chunk, level k
the chunks of the ids that need more than k. Each level has a bitmap that says which ids go on, and a
directory of the ones before every 512 bits, so the place of an id's next chunk is one rank away: any
token is found by itself, without decoding those around it.

File: MAGIC, then little-endian (docs, tokens, levels) as uint64; doc ids (int64), their validity
(uint8), first tokens (int64, docs + 1 of them); then for each level its length (uint64), chunks
(uint8), bitmap (bytes, lowest bit first) and directory (uint64).

Edge cases: a null text is the empty text (only the end id is written); rows of equal or null doc_id are
kept, null ones first, ties ordered by text; the empty table gives no file and no row; other columns are not read.
"""

import unicodedata
import uuid
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from . import files
from . import words as W
from .bpe import compile_pattern
from .session import materialize, new_dir, small_batches, table

MAGIC = b"DACv1\0\0\0"
CHUNK, BLOCK = 8, 512
#: Tokens after which a file is closed and the next one begun.
FILE_TOKENS = 2_000_000
END_ID = 2
#: Distinct matches of which a worker keeps the ids, some 40 MB; when there are more it starts anew.
KEPT = 1_000_000
#: Matches that the library is asked for at a time.
LINES = 10_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint64)


class Level:
    """One level as it lies in memory or in a file: n chunks, then the bitmap of those whose ids go on, then its rank directory.
    take(offset, size) gives bytes; no more are asked for than the ids in question need."""

    def __init__(self, take, at, n):
        self.take, self.at, self.n = take, at, n
        self.bits = at + n
        self.directory = self.bits + -(-n // 8)
        self.end = self.directory + 8 * (-(-n // BLOCK) + 1)

    def chunks(self, a, b):
        return np.frombuffer(self.take(self.at + a, b - a), np.uint8)

    def more(self, a, b):
        """Whether the ids from a to b go on."""
        first = a // 8
        found = np.frombuffer(self.take(self.bits + first, -(-b // 8) - first), np.uint8)
        return np.unpackbits(found, bitorder="little")[a - first * 8 : b - first * 8].astype(bool)

    def rank(self, i):
        """Ids before i that go on."""
        block = i // BLOCK
        return int(np.frombuffer(self.take(self.directory + 8 * block, 8), "<u8")[0]) + int(self.more(block * BLOCK, i).sum())


class Codes:
    def __init__(self, levels, n):
        self.levels, self.n = levels, n

    def slice(self, a, b):
        """Ids from a to b, found from ranks alone."""
        out, where = np.zeros(b - a, np.uint32), np.arange(b - a)
        for k, level in enumerate(self.levels):
            if b <= a:
                break
            out[where] |= level.chunks(a, b).astype(np.uint32) << np.uint32(CHUNK * k)
            more = level.more(a, b)
            where = where[more]
            if len(where):
                a = level.rank(a)
            b = a + len(where)
        return out

    def __getitem__(self, i):
        return int(self.slice(i, i + 1)[0])


def levels_of(ids):
    """The parts of each level in turn: chunks, bitmap, directory."""
    rest = np.asarray(ids, np.uint32)
    first = True
    while len(rest) or first:
        first = False
        high = rest >> CHUNK
        more = high > 0
        bitmap = np.packbits(more, bitorder="little")
        directory = np.zeros(-(-len(rest) // BLOCK) + 1, np.uint64)
        if len(bitmap):
            sums = np.add.reduceat(_BITS[bitmap], np.arange(0, len(bitmap), BLOCK // 8))
            directory[1 : len(sums) + 1] = np.cumsum(sums)
        yield (rest & 0xFF).astype(np.uint8), bitmap, directory
        rest = high[more]


def dump(doc_ids, counts, ids, write):
    """Gives write() the bytes of a file, a part at a time. doc_ids may hold None."""
    depth, high = 1, int(ids.max()) if len(ids) else 0
    while high >> CHUNK * depth:
        depth += 1
    write(MAGIC + np.array([len(doc_ids), len(ids), depth], "<u8").tobytes())
    write(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], "u1").tobytes())
    write(np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes())
    for chunks, bitmap, directory in levels_of(ids):
        write(np.array([len(chunks)], "<u8").tobytes())
        for part in (chunks, bitmap, directory.astype("<u8")):
            write(part.tobytes())


def load(take):
    """(doc ids, first tokens, Codes) of a file of which take(offset, size) gives the bytes; no code is read before it is asked for."""
    if bytes(take(0, 8)) != MAGIC:
        raise ValueError("not a file of directly addressable codes")
    docs, tokens, depth = map(int, np.frombuffer(take(8, 24), "<u8"))
    at = 32
    ids, valid, first = np.frombuffer(take(at, 8 * docs), "<i8"), np.frombuffer(take(at + 8 * docs, docs), "u1"), np.frombuffer(take(at + 9 * docs, 8 * (docs + 1)), "<i8")
    at += 17 * docs + 8
    found = []
    for _ in range(depth):
        found.append(Level(take, at + 8, int(np.frombuffer(take(at, 8), "<u8")[0])))
        at = found[-1].end
    return [int(d) if v else None for d, v in zip(ids, valid)], first, Codes(found, tokens)


def in_memory(raw):
    raw = memoryview(raw)
    return lambda at, size: raw[at : at + size]


# Classes of characters for the splitting pattern: white space, letters, numbers, others.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
#: Characters under this one, the first of three bytes' worth of Latin, are split without a regular expression.
_LATIN = 0x240


def _class(c):
    kind = unicodedata.category(chr(c))[0]
    return _SPACE if 9 <= c <= 13 or chr(c) in " \x85\xa0" else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER


_CLASS = np.array([_class(c) for c in range(_LATIN)], np.int8)
_SHORT_ENDS = np.zeros(256, bool)
_SHORT_ENDS[list(b"stmd")] = True


def starts_of(data, offs):
    """Where the matches of the splitting pattern start, in texts under U+0240 that have no white space over U+007F."""
    n = len(data)
    kind = _CLASS[data]
    two = np.flatnonzero(data >= 0xC0)
    kind[two] = _CLASS[((data[two] & 0x1F).astype(np.int64) << 6) | (data[two + 1] & 0x3F)]
    kind[two + 1] = kind[two]
    before, after = np.full(n, -1, np.int8), np.full(n, -1, np.int8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    begin, last = offs[:-1][offs[1:] > offs[:-1]], offs[1:][offs[1:] > offs[:-1]] - 1
    before[begin] = after[last] = -1
    white, blank = kind == _SPACE, np.zeros(n, bool)
    blank[1:] = data[:-1] == 32  # one blank before other characters is part of their match
    blank[begin] = False
    start = np.where(white, (before != _SPACE) | (after > _SPACE), (kind != before) & ~blank)
    quote = np.flatnonzero((data == 39) & start & (after == _LETTER))  # 's 't 'm 'd 're 've 'll
    end = np.append(offs[1:], n)[np.searchsorted(offs[1:], quote, "right")]
    one, next_ = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
    short = _SHORT_ENDS[one]
    long = (quote + 2 < end) & (((one == 114) | (one == 118)) & (next_ == 101) | (one == 108) & (next_ == 108))
    size = np.where(short, 2, 3)[short | long]
    quote, end = quote[short | long], end[short | long]
    start[quote + 1] = False
    rest = (quote + size)[quote + size < end]
    start[rest] = True
    return np.flatnonzero(start)


class Encoder:
    """The tokenizers library, asked once for each distinct match of the splitting pattern.

    The vocabulary's merges never cross a match, so a text's ids are those of its matches. Matches are told apart by a 64-bit
    hash; the ids of at most KEPT of them are kept. The library's model gets new matches as lines of one text, with bytes written
    as the vocabulary writes them; only matches that are white space hold line feeds, and these are encoded one by one. Texts with
    characters from U+0240, or white space over U+007F, are split by the pattern itself; texts that hold an added token's string
    (such as <|endoftext|>) are left to the library whole, so they get the ids that it gives.
    """

    def __init__(self, path=None):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        whole = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.whole, self.lines = whole, Tokenizer(whole.model)
        self.added = [t.content for t in whole.get_added_tokens_decoder().values()]
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.written = np.arange(256, dtype="<u4")
        self.written[rest] = 256 + np.arange(len(rest))
        self.lines.pre_tokenizer = CharDelimiterSplit(chr(self.written[10]))
        self.bytes_of = np.zeros(whole.get_vocab_size(), np.int64)
        for token, i in whole.get_vocab().items():
            self.bytes_of[i] = len(token)
        self.split = compile_pattern()
        self._forget()

    def _forget(self):
        """Starts anew: hashes of the kept matches in order, and their numbers; by number, their first id in the pool and how many."""
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.new_keys, self.new_numbers = self.keys, self.numbers
        self.from_, self.count, self.pool, self.used, self.filled = np.zeros(KEPT, np.int32), np.zeros(KEPT, np.int32), np.zeros(1 << 16, np.uint32), 0, 0

    def _known(self, keys):
        """The numbers of the kept matches with these hashes, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        for have, numbers in ((self.keys, self.numbers), (self.new_keys, self.new_numbers)):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                np.copyto(out, numbers[at], where=have[at] == keys)
        return out

    def _add(self, ids, counts):
        size = int(counts.sum())
        while self.filled + size > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + size] = ids
        self.from_[self.used : self.used + len(counts)] = self.filled + np.cumsum(counts) - counts
        self.count[self.used : self.used + len(counts)] = counts
        self.used, self.filled = self.used + len(counts), self.filled + size

    def _learn(self, data, start, end):
        """Adds the ids of the matches of data with these bounds, in their order."""
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        if (odd := feeds[end] > feeds[start]).any():  # they are white space, so there are few
            cuts = np.flatnonzero(np.append(True, odd[1:] | odd[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(odd))):
                if odd[a]:
                    ids = np.array(self.whole.encode(data[start[a] : end[a]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                    self._add(ids, np.array([len(ids)]))
                else:
                    self._learn(data, start[a:b], end[a:b])
            return
        for a in range(0, len(start), LINES):
            first, size = start[a : a + LINES], (end - start)[a : a + LINES]
            to = np.cumsum(size + 1)
            text = data[np.minimum(np.arange(to[-1]) - np.repeat(to - size - 1, size + 1) + np.repeat(first, size + 1), len(data) - 1)]
            text[to - 1] = 10
            ids = np.array(self.lines.encode_batch_fast([self.written[text[:-1]].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.uint32)
            done, ends = np.cumsum(self.bytes_of[ids]), np.cumsum(size)
            at = np.searchsorted(done, ends) + 1
            if (done[at - 1] != ends).any():
                raise ValueError("the vocabulary does not keep lines apart")
            self._add(ids, np.diff(at, prepend=0))

    def _numbers(self, keys, data, start, end):
        """The numbers of the distinct matches with these hashes (in order) and bounds; new ones are learned."""
        if self.used + len(keys) > KEPT:
            self._forget()
        out = self._known(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = np.arange(self.used, self.used + len(new))
            self._learn(data, start[new], end[new])
            self.new_keys, self.new_numbers = _merged(self.new_keys, self.new_numbers, keys[new], out[new])
            if len(self.new_keys) > LINES + len(self.keys) // 8:
                self.keys, self.numbers = _merged(self.keys, self.numbers, self.new_keys, self.new_numbers)
                self.new_keys, self.new_numbers = self.keys[:0], self.numbers[:0]
        return out

    def _of_starts(self, data, offs, start):
        """(ids of all texts, number of ids of each)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        end = np.append(start[1:], len(data))
        up, down = W._power(len(data) + 1)
        prefix = np.zeros(len(data) + 1, W.U)
        np.cumsum(W._CODE[data] * up[: len(data)], out=prefix[1:])
        key = W.mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(W.U))
        doc = np.searchsorted(offs, start, "right") - 1
        ids, counts = [], np.zeros(len(offs) - 1, np.int64)
        for a in range(0, len(start), KEPT // 2):  # never more distinct matches at once than are kept
            part = key[a : a + KEPT // 2]
            distinct, one, which = np.unique(part, return_index=True, return_inverse=True)
            place = self._numbers(distinct, data, start[a + one], end[a + one])[which]
            size = self.count[place].astype(np.int64)
            total = np.cumsum(size)
            ids.append(self.pool[np.arange(total[-1]) + np.repeat(self.from_[place] - (total - size), size)])
            counts += np.bincount(doc[a : a + KEPT // 2], size, len(counts)).astype(np.int64)
        return np.concatenate(ids), counts

    def encode(self, texts):
        """(uint32 ids of all texts one after another, number of ids of each) for an Arrow array."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data, offs = W.buffers(texts)
        odd = np.flatnonzero(data >= 0xC9)
        wide = np.flatnonzero(data[:-1] == 0xC2)
        odd = np.concatenate([odd, wide[(data[wide + 1] == 0x85) | (data[wide + 1] == 0xA0)]])
        way = np.zeros(len(texts), np.int8)  # 0: by classes, 1: by the pattern, 2: by the library
        way[np.searchsorted(offs, odd, "right") - 1] = 1
        for s in self.added:
            way[pc.match_substring(texts, s).to_numpy(zero_copy_only=False)] = 2
        if not way.any():
            return self._of_starts(data, offs, starts_of(data, offs) if len(data) else None)
        parts = [None] * len(texts)
        plain = np.flatnonzero(way == 0)
        if len(plain):
            own, at = W.buffers(texts.take(pa.array(plain)))
            ids, counts = self._of_starts(own, at, starts_of(own, at) if len(own) else None)
            for k, x in zip(plain.tolist(), np.split(ids, np.cumsum(counts)[:-1])):
                parts[k] = x
        for k in np.flatnonzero(way).tolist():
            t = texts[k].as_py()
            if way[k] == 2:
                parts[k] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                own = np.frombuffer(t.encode(), np.uint8)
                sizes = np.array([len(m.encode()) for m in self.split(t)])
                parts[k] = self._of_starts(own, np.array([0, len(own)]), np.cumsum(sizes) - sizes)[0]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


def _merged(keys, numbers, more, own):
    keys, numbers = np.concatenate([keys, more]), np.concatenate([numbers, own])
    order = np.argsort(keys, kind="stable")
    return keys[order], numbers[order]


@lru_cache(2)
def encoder(path=None):
    """A worker's encoder: what it has kept serves the worker's later tasks too."""
    return Encoder(path)


def write(df, place, key="doc_id", text="text", tokenizer=None, end_id=END_ID):
    """Writes df's texts as files under `place`, in ascending order of key; returns the manifest, one row for each file:
    part, seq (files in order), n_docs, n_tokens, path."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        seq, docs, counts, ids, tokens = 0, [], [], [], 0

        def flush():
            path = f"{place}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with files.Output(path) as out:
                dump(docs, counts, np.concatenate(ids), out.write)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(docs)], "n_tokens": [tokens], "path": [path]})

        for batch in batches:
            for piece in W.slices(batch):
                found, size = own.encode(piece.column("text"))
                ids.append(np.insert(found, np.cumsum(size), end_id).astype(np.uint32))
                docs += piece.column("doc_id").to_pylist()
                counts += (size + 1).tolist()
                tokens += len(ids[-1])
                if tokens >= FILE_TOKENS:
                    yield flush()
                    seq, docs, counts, ids, tokens = seq + 1, [], [], [], 0
        if docs:
            yield flush()

    manifest = rows.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, path string")
    return materialize(spark, manifest, "manifest")


def with_starts(manifest):
    """The manifest with start: tokens in all files before. The driver gets one sum for each writing task."""
    from pyspark.sql import Window

    spark = manifest.sparkSession
    sums = sorted(tuple(r) for r in manifest.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, starts = 0, []
    for part, n in sums:
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(starts, "part int, part_start long")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(starts, "part").withColumn("start", F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("part_start")


def read(manifest):
    """One row for each document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    n = max(1, manifest.count())
    placed = with_starts(manifest).select("path", "start").repartition(n)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                docs, first, codes = load(in_memory(files.read(path)))
                crc = [zlib.crc32(codes.slice(a, b).astype("<u4").tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(start + first[:-1], pa.int64()), "n_tokens": pa.array(np.diff(first), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document(path, i):
    """(doc_id, ids) of the i-th document of a file; of the codes only its own are read."""
    with files.opened(path) as f:

        def take(at, size):
            f.seek(at)
            return f.read(size)

        docs, first, codes = load(take)
        return docs[i], codes.slice(int(first[i]), int(first[i + 1]))


def op5_addressable_codes(spark, sf_dir):
    return read(write(table(spark, sf_dir, "documents"), new_dir(spark, "tokens")))
