"""Repetition coverage: which characters of a text lie inside n-grams and lines that it repeats.

Edge cases: a null or empty text has no word and is base_failed; equal rows get equal results; a row
with null doc_id is scored like any other; other columns of the input are not looked at.
"""

import numpy as np
import pyarrow as pa

from .session import schema_of, small_batches, spread, table, with_text
from .words import SPACE, mix, per_doc, repeated, slices, windows, words

#: n-gram length -> most per cent of a text's word characters that may lie in its repeated n-grams.
LIMITS = {5: 30, 6: 29, 7: 28, 8: 27, 9: 26, 10: 25}
#: Most per cent of word characters in lines that are equal to an earlier line.
LINE_LIMIT = 30
WINDOW, MIN_WORDS, WINDOW_LIMIT = 8, 20, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in LIMITS) + ", base_failed boolean, kept boolean"


def _covered(w, n, key_of_doc, among):
    """Words (as a mask) inside n-grams that their text has twice or more; only texts in `among` are looked at."""
    picked = np.flatnonzero(among[w.doc])
    at, h = windows(w.hash[picked], w.doc[picked], n)
    many, _ = repeated(h ^ key_of_doc[w.doc[picked][at]])
    edge = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(edge, picked[at[many]], 1)
    np.add.at(edge, picked[at[many]] + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts):
    """The columns of SCHEMA for a string array."""
    w = words(texts)
    docs = len(w.count)
    key_of_doc = mix(np.arange(docs, dtype=np.uint64) + np.uint64(77))
    point = ((w.data & 0xC0) != 0x80) & ~SPACE[w.data]
    points = np.zeros(len(point) + 1, np.int64)
    np.cumsum(point, out=points[1:])
    chars = points[w.end] - points[w.start]
    word_offs = np.concatenate([[0], np.cumsum(w.count)])
    out = {"n_words": w.count.astype(np.int64), "word_chars": points[w.offs[1:]] - points[w.offs[:-1]], "n_symbols": per_doc(_SYMBOL[w.data], w.offs)}

    begins = np.unique(np.concatenate([w.offs[:-1], np.flatnonzero(w.data == 10) + 1]))
    begins = begins[begins < len(w.data)]
    of = np.searchsorted(w.offs, begins, "right") - 1
    ends = np.append(begins[1:], len(w.data))
    ends = ends - (w.data[ends - 1] == 10) if len(ends) else ends
    full = points[ends] > points[begins]
    begins, ends, of = begins[full], ends[full], of[full]
    _, later = repeated(w.span_hash(begins, ends) ^ key_of_doc[of])
    out["n_dup_lines"] = np.bincount(of[later], minlength=docs)
    dup_line_chars = np.bincount(of[later], (points[ends] - points[begins])[later], docs).astype(np.int64)

    out["n_repeat_words"] = np.zeros(docs, np.int64)
    out["dup_line_chars"] = dup_line_chars
    among = np.ones(docs, bool)
    for n in LIMITS:  # ascending: without a repeated n-gram there is no longer one
        hit = _covered(w, n, key_of_doc, among)
        out[f"dup_{n}gram_chars"] = per_doc(chars * hit, word_offs)
        if n == WINDOW:
            out["n_repeat_words"] = per_doc(hit, word_offs)
        among &= out[f"dup_{n}gram_chars"] > 0
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > WINDOW_LIMIT * out["n_words"])
    fine = 100 * dup_line_chars <= LINE_LIMIT * out["word_chars"]
    for n, most in LIMITS.items():
        fine &= 100 * out[f"dup_{n}gram_chars"] <= most * out["word_chars"]
    out["kept"] = ~out["base_failed"] & fine
    return out


def score(df, keep=("doc_id",), text="text"):
    """The columns `keep` of df and those of SCHEMA, one row for each row of df."""
    small_batches(df.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    source, text = with_text(df, keep, text, names)
    fields = source.columns[:-1]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                m = measure(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in fields), *(pa.array(m[c].astype(bool if c in ("base_failed", "kept") else np.int64)) for c in names)], names=[*fields, *names])

    return source.mapInArrow(run, schema_of(source, SCHEMA))


def keep_clean(df, text="text"):
    """The rows of df whose text is kept, with their columns."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(measure(part.column(text))["kept"]))

    return spread(df).mapInArrow(run, df.schema)


def op4_repetition_coverage(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), ("doc_id",))


def _oracle():
    grams = "".join(
        f"""
, g{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, i, array_to_string(ws[i:i+{n - 1}], ' ') AS g FROM positions WHERE i + {n - 1} <= len(ws))) WHERE c > 1)
, c{n} AS (SELECT doc_id, count(*) AS words, sum(length(ws[j])) AS chars FROM (
    SELECT DISTINCT g.doc_id, g.i + o.o AS j FROM g{n} g, range({n}) AS o(o)) JOIN base USING (doc_id) GROUP BY doc_id)"""
        for n in LIMITS
    )
    joins = "".join(f" LEFT JOIN c{n} ON c{n}.doc_id = base.doc_id" for n in LIMITS)
    cols = ", ".join(f"CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS dup_{n}gram_chars" for n in LIMITS)
    rules = " AND ".join(f"100 * dup_{n}gram_chars <= {most} * word_chars" for n, most in LIMITS.items())
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
, positions AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM base)
, lines AS (
  SELECT doc_id, line, count(*) AS c, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
, dup AS (SELECT doc_id, sum(c - 1) AS n, sum((c - 1) * chars) AS chars FROM lines GROUP BY doc_id){grams}
, counted AS (
  SELECT base.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c{WINDOW}.words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(dup.chars, 0) AS BIGINT) AS dup_line_chars, {cols}
  FROM base LEFT JOIN dup ON dup.doc_id = base.doc_id{joins})
, judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {WINDOW_LIMIT} * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars AND {rules} AS kept FROM judged"""


ORACLE_SQL = _oracle()
