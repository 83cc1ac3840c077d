"""Byte-level BPE as a monoid: halves are encoded by themselves and joined at the seam.

Two levels use it. A match of the splitting pattern is encoded by halving its bytes: at a join the
tokens next to the seam are encoded anew in a window that grows until the pairs across both of its
edges stay apart. A row of tokens of which every neighbouring pair encodes to itself is the encoding
of the whole, so the tokens outside the window are then proven final. A text is split by halving it
likewise: at a join the matches that end within LOOK characters of the seam are matched anew,
onwards until a match ends where one of the right half does. Texts of any length take time n log n.

Decoding concatenates the bytes of tokens up the same tree.
"""

import base64
import hashlib
import re
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
import regex

from .session import schema_of, small_batches, table, with_text

#: Characters up to which a text is a leaf, split by one pass of the pattern.
LEAF = 4096
#: The pattern looks at most two characters past the end of a match.
LOOK = 3
#: Bytes up to which the encoding of a part of a match is kept.
SHORT = 8
#: Encodings a worker keeps, of each kind; when there are more it starts anew.
KEPT = 150_000
#: Rank of a pair that is no token.
NONE = 1 << 60
#: White space as Unicode has it (Python's own \s has also \x1c to \x1f).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _letters(below=0x250):
    """Letters under a code point, as the inside of a character class."""
    import unicodedata

    out, a = [], None
    for c in range(below + 1):
        is_letter = c < below and unicodedata.category(chr(c))[0] == "L"
        if is_letter and a is None:
            a = c
        elif not is_letter and a is not None:
            out.append(f"{chr(a)}-{chr(c - 1)}")
            a = None
    return "".join(out)


def compile_pattern(pattern=public_tokenizers.PATTERN):
    """A function text -> its matches; texts under U+0250 take the standard library's faster matcher."""
    white = pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\S", rf"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    every = regex.compile(white)
    latin = re.compile(white.replace(r"\p{L}", "\0").replace(r"\p{N}", "\1").replace(f"{WHITE}\0\1]", f"{WHITE}{_letters()}0-9²³¹¼-¾]").replace("\0", f"[{_letters()}]").replace("\1", "[0-9²³¹¼-¾]"))
    far = re.compile(r"[^\x00-\u024f]")
    return lambda text: (every if far.search(text) else latin).findall(text)


class Bpe:
    def __init__(self, ranks, pattern=public_tokenizers.PATTERN):
        self.ranks, self.split = ranks, compile_pattern(pattern)
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.kept, self.older, self.pairs, self.parts = {}, {}, {}, {}

    @classmethod
    def load(cls, path=None):
        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    # -- one match -------------------------------------------------------------------------------

    def merge(self, b):
        """The encoding of short bytes: the pair of lowest rank is merged, leftmost first, until none is left."""
        get = self.ranks.get
        parts = [b[i : i + 1] for i in range(len(b))]
        pairs = [get(b[i : i + 2], NONE) for i in range(len(b) - 1)]
        while pairs and (low := min(pairs)) != NONE:
            i = pairs.index(low)
            new = parts[i] + parts[i + 1]
            parts[i : i + 2] = (new,)
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + new, NONE)
            if i < len(pairs):
                pairs[i] = get(new + parts[i + 1], NONE)
        return parts

    def pair(self, a, b):
        """The encoding of the bytes of two tokens."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            known = self.pairs[a, b] = tuple(self.merge(a + b))
        return known

    def stays(self, a, b):
        """Whether tokens a and b side by side encode to themselves."""
        return self.pair(a, b)[0] == a

    def join(self, left, right):
        """The encoding of the bytes of two encodings."""
        i = j = 1
        new = self.pair(left[-1], right[0])
        while True:
            more_left = i < len(left) and not self.stays(left[-i - 1], new[0])
            more_right = j < len(right) and not self.stays(new[-1], right[j])
            if not (more_left or more_right):
                return left[: len(left) - i] + new + right[j:]
            i, j = min(i + more_left * i, len(left)), min(j + more_right * j, len(right))
            new = tuple(self.merge(b"".join(left[len(left) - i :] + right[:j])))

    def reduce(self, b):
        """The tokens (as bytes) of one match; those of short parts are kept."""
        if b in self.ranks:
            return (b,)
        if (known := self.parts.get(b)) is None:
            known = self.join(self.reduce(b[: len(b) // 2]), self.reduce(b[len(b) // 2 :]))
            if len(b) <= SHORT:
                if len(self.parts) >= KEPT:
                    self.parts.clear()
                self.parts[b] = known
        return known

    def piece(self, s):
        """The ids of one match, from the two generations of kept ones or encoded now."""
        if (ids := self.older.get(s)) is None:
            ids = tuple([self.ranks[t] for t in self.reduce(s.encode("utf-8", "surrogatepass"))])
        if len(self.kept) >= KEPT:
            self.older = dict(self.kept)
            self.kept.clear()  # encode() holds on to this dict
        self.kept[s] = ids
        return ids

    # -- one text --------------------------------------------------------------------------------

    def matches(self, text):
        """The matches of the pattern over a text, by halves."""
        if len(text) <= LEAF:
            return self.split(text)
        half = len(text) // 2
        return self.join_matches(self.matches(text[:half]), self.matches(text[half:]))

    def join_matches(self, left, right):
        back, size = 0, 0
        while back < len(left) and size < LOOK:
            back += 1
            size += len(left[-back])
        back = min(back + 1, len(left))  # the match before it began where it did in any case
        head = "".join(left[len(left) - back :])
        take = 4
        while True:
            take = min(take, len(right))
            tail = right[:take]
            text = head + "".join(tail)
            ends, at = set(), len(head)
            for m in tail:
                at += len(m)
                ends.add(at)
            at, out = 0, []
            for m in self.split(text):
                at += len(m)
                out.append(m)
                if at in ends and at <= len(text) - LOOK:
                    used, k = len(head), 0
                    while used < at:
                        used += len(right[k])
                        k += 1
                    return left[: len(left) - back] + out + right[k:]
            if take == len(right):
                return left[: len(left) - back] + out
            take *= 2

    def encode(self, text):
        ids, piece, kept = [], self.piece, self.kept
        for m in self.matches(text):
            ids += kept.get(m) or piece(m)
        return ids

    def decode(self, ids, leaf=4096):
        """The bytes of ids: leaves are looked up, halves concatenated."""
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


def encode_frame(df, path=None, keep=("doc_id",), text="text", ids=False):
    """The columns `keep` of df with n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for) of each row's text.

    Edge cases: a null text is the empty text (no token; the digests are those of nothing); equal rows get equal
    results; null doc_ids are kept; other columns are not looked at. Every worker loads the vocabulary from `path`.
    """
    small_batches(df.sparkSession)
    source, text = with_text(df, keep, text, ("n_tokens", "ids_sha256", "decoded_sha256", "ids"))
    fields = source.columns[:-1]

    def run(batches):
        bpe = Bpe.load(path)
        for batch in batches:
            n, coded, decoded, lists = [], [], [], []
            for t in batch.column(text):
                got = bpe.encode(t.as_py() or "")
                n.append(len(got))
                coded.append(hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(got)).hexdigest())
                if ids:
                    lists.append(pa.array(got, pa.int32()))
            cols = [*(batch.column(f) for f in fields), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = [*fields, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                offs = pa.array([0, *accumulate(n)], pa.int32())
                cols.append(pa.ListArray.from_arrays(offs, pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return source.mapInArrow(run, schema_of(source, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids))


def op9_monoid_bpe(spark, sf_dir):
    return encode_frame(table(spark, sf_dir, "documents"))
