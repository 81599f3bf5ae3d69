"""Exact de-duplication by an extendible-hash index kept in shared files.

Texts are equal when they are identical after lower-casing A-Z only. The 64-bit hash of the
normalised text is the index key. A directory over its leading bits is doubled, one bit at a
time, wherever a bucket holds more keys than its capacity; buckets are key ranges, so an owner
task works on whole ranges. Equal hashes are chained: within a chain the bytes of the texts
themselves are compared. Only DataFrame functions are used.

Many rows with one text collapse in the map tasks, before any shuffle, so a hot text reaches its
owner once per map task. A hash whose rows exceed the capacity at full depth stays one chain of
distinct texts; nothing is dropped.

Defined cases: a null text counts as empty, and all empty texts are one group. A null doc_id
loses against any other. Of rows with equal text and equal doc_id one stays. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept_rows, stored

#: Rows of keys (about 100 bytes each) that a bucket may hold before it splits.
CAPACITY = 100_000
#: Directory bits at most; the directory has at most 2 ** MAX_DEPTH entries.
MAX_DEPTH = 14


def normalised(text: Column) -> Column:
    """Lower-case A-Z only. Texts without other letters take the faster function."""
    whole = F.coalesce(text, F.lit(""))
    mapped = F.translate(whole, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(mapped)


def prefix(key: Column, bits: int) -> Column:
    """The leading ``bits`` of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, depth, bucket): for each used slot of full depth its bucket and local depth.

    A prefix of d bits is overfull when more than ``capacity`` keys share it. Every overfull
    prefix is split, so the local depth of a slot is the number of its overfull prefixes. At
    most 2 ** max_depth rows go in, since counts are taken per slot first.
    """
    slots = keys.groupBy(prefix(F.col("h"), max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = F.sequence(F.lit(0), F.lit(max_depth - 1))
    paths = slots.select("slot", "n", F.explode(levels).alias("d")).withColumn("p", F.expr(f"shiftright(slot, {max_depth} - d)"))
    split = paths.groupBy("d", "p").agg(F.sum("n").alias("held")).filter(F.col("held") > capacity)
    depths = paths.join(split, ["d", "p"], "left_semi").groupBy("slot").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    found = slots.select("slot").join(depths, "slot", "left").na.fill(0, ["depth"])
    return found.withColumn("bucket", F.expr(f"shiftleft(1, depth) + shiftright(slot, {max_depth} - depth)"))


def _with_bucket(rows: DataFrame, slots: DataFrame, max_depth: int) -> DataFrame:
    # Bounded: a directory has at most 2 ** max_depth rows of 12 bytes.
    return rows.join(F.broadcast(slots.select("slot", "bucket")), prefix(F.col("h"), max_depth) == F.col("slot")).drop("slot")


def find_duplicates(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and the key h.

    Of equal texts the row with the largest doc_id stays.
    """
    if max_depth > 16:
        raise ValueError("a directory of more than 2 ** 16 slots is not broadcast")
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    keys = stored(
        texts.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")),
        "dedup-keys",
    )
    slots = stored(directory(keys, capacity, max_depth), "dedup-directory")

    # The index: one entry per distinct text. Grouping by the text itself compares bytes.
    entries = _with_bucket(texts, slots, max_depth).groupBy("bucket", "h", "norm").agg(F.count(F.lit(1)).alias("n"))
    index = stored(
        entries.select("bucket", "h", F.sha2("norm", 256).alias("text_sha256"), "n", F.octet_length("norm").alias("n_bytes")),
        "dedup-index",
    )

    # Owner tasks: per key range, the entries of a chain meet the rows that point to them.
    newest = F.max(F.struct("doc_id", "row")).alias("newest")
    heads = _with_bucket(keys, slots, max_depth).groupBy("bucket", "h", "text_sha256").agg(newest, F.count(F.lit(1)).alias("rows"))
    chained = index.groupBy("bucket", "h", "text_sha256").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    owned = heads.join(chained, ["bucket", "h", "text_sha256"])
    agree = (F.col("texts") == 1) & (F.col("n") == F.col("rows"))
    size = F.when(agree, F.col("n")).otherwise(F.raise_error("different texts share one digest").cast("long"))
    picks = owned.select("h", "text_sha256", F.col("newest.doc_id").alias("keep_id"), F.col("newest.row").alias("keep_row"), size.alias("group_size"))
    return keys.join(picks, ["h", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "h"
    )


def drop_duplicates(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of ``docs`` that stay, one per text, with all their columns."""
    kept = find_duplicates(docs, capacity, max_depth).filter("kept")
    return kept_rows(docs, F.xxhash64(normalised(F.col("text"))), kept, "h")
