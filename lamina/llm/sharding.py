"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows are written once to the shared folder; each written file is a partition, and a row's place
in it is fixed, so that every later step gives the same answer when it runs again. The driver draws
how many rows each partition sends to each shard: the matrix that a uniform permutation of all rows
would give (row sums are the partitions' sizes, column sums the shards'). Rows are permuted inside
their partition, cut by the matrix, exchanged, and permuted again inside their shard. The matrix has
one cell for each written file and shard; rows never come to the driver.

Edge cases: rows may hold nulls in any column and may repeat; they are told apart by their place. The
empty table gives no row. The columns `shard`, `slot` of the input, if any, are replaced.
"""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .session import materialize, table

SHARDS, SEED = 8, 20240229
#: Rows that are ordered together in a shard, and most such groups of a shard.
GROUP_ROWS, GROUPS = 2_000, 10_000


def hypergeometric(rng, good, bad, drawn):
    """One exact draw: good ones among `drawn` of good + bad, for counts of any size.

    The probabilities around the mode come from their ratios; those further than 12 standard deviations
    and 50 from it are below what a double can tell from none.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    n = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (n + 2)))
    sd = math.sqrt(drawn * (good / n) * (bad / n) * ((n - drawn) / max(1, n - 1)))
    a, b = max(low, mode - int(12 * sd) - 50), min(high, mode + int(12 * sd) + 50)
    x = np.arange(a, b, dtype=np.float64)
    ratio = np.log((good - x) * (drawn - x)) - np.log((x + 1) * (bad - drawn + x + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def sizes(rows, shards):
    """Shard sizes, at most one apart."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def matrix(rows, columns, seed):
    """A table with these row and column sums, as a uniform permutation would make it."""
    rng = np.random.default_rng(seed)
    left, out = list(columns), []
    for n in rows:
        line, rest, total = [], n, sum(left)
        for m in left:
            x = hypergeometric(rng, m, total - m, rest)
            line.append(x)
            rest, total = rest - x, total - m
        left = [m - x for m, x in zip(left, line)]
        out.append(line)
    return out


def shuffle(df, shards=SHARDS, seed=SEED):
    """df with shard (int) and slot (long, gapless from 0 in each shard); any order of rows is equally likely."""
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    source = materialize(spark, df.select(*names), "shuffle")
    placed = source.select("*", F.col("_metadata.file_name").alias("__part"), F.col("_metadata.row_index").alias("__row"))
    # the driver gets one row for each written file
    parts = sorted(tuple(r) for r in placed.groupBy("__part").count().collect())
    rows = sum(n for _, n in parts)
    drawn = matrix([n for _, n in parts], sizes(rows, shards), seed)
    cuts = spark.createDataFrame([(name, k, [int(x) for x in np.cumsum(line)[:-1]]) for k, ((name, _), line) in enumerate(zip(parts, drawn))], "__part string, __nth int, __cuts array<bigint>")

    local = Window.partitionBy("__nth").orderBy(F.xxhash64(F.lit(seed), "__nth", "__row"), "__row")  # each file has an order of its own
    sent = placed.join(cuts, "__part").withColumn("__pos", F.row_number().over(local) - 1)
    groups = min(GROUPS, max(1, rows // (shards * GROUP_ROWS)))
    order = F.xxhash64(F.lit(seed + 1), "__nth", "__row")
    sent = sent.select(*names, F.size(F.filter("__cuts", lambda c: c <= F.col("__pos"))).alias("shard"), order.alias("__order"), F.pmod(order, F.lit(groups)).alias("__group"), "__nth", "__row")
    sent = materialize(spark, sent, "exchange")

    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    first = sent.groupBy("shard", "__group").count().select("shard", "__group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    again = Window.partitionBy("shard", "__group").orderBy("__order", "__nth", "__row")
    ranked = sent.withColumn("__rank", F.row_number().over(again))
    return ranked.join(first, ["shard", "__group"]).select(*names, "shard", (F.col("__first") + F.col("__rank") - 1).alias("slot"))


def op2_hypergeometric_shuffle(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
