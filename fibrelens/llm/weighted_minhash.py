"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a bag of shingles of five words (lower-cased A-Z, punctuation ignored; a shorter text
is one shingle). A shingle weighs its count times a damped inverse document frequency. From
each text, samples are drawn so that two texts agree in a sample with the probability of their
weighted Jaccard similarity; bands of three samples give candidates, and a candidate is a link
only after its weighted Jaccard similarity was computed over both whole bags, with shingles named
by 32 bits, and reached the threshold.
Classes are the connected components of the links.

*Weights.* Document frequencies are counted over all documents in a table of hashed shingles
of fixed size. The damping keeps every weight per occurrence between 0.8 and 1: the shingles
of a large group of copies are frequent only because of the copies, and an undamped idf would
tear an edited copy away from its group.

*Recall.* Twelve bands of three find a pair of similarity 0.8 with probability 0.9998 and one
of 0.9 with more than 0.999999.

*Candidates.* The number of samples in which two texts agree follows a binomial law around their
similarity. A pair whose number would be that low at the threshold with probability of at most
one in a million is no candidate, and its bags are not fetched.

*Large groups.* Equal word sequences are one node. In a bucket, nodes meet one pivot instead of each
other. A bucket whose nodes are one component then is done. An open one is dealt by total weight:
texts of one link differ in it by at most the threshold, so they share a range of weights. The nodes
of a range that is still open are packed into blocks of bounded size, and every two blocks are
compared in one matrix product over the shingles that both have: all pairs are looked at exactly,
also those that the samples would pass over, but no pair is a row. Of the links that a task finds
it returns those that join components. So a group of similar texts costs about one comparison per
text; the texts of an open range cost arithmetic with the square of their number, and rows with the
square of the number of their blocks. No bucket is capped.

Defined cases: null counts as empty; texts without words have no duplicates, each row is its own
class. The class id is the smallest doc_id of the class (null last). Rows that repeat doc_id
and text belong to one class. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import ALNUM_WORDS, mix, pieces, words
from .shared import kept_rows, ship, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
#: Entries of the table of document frequencies (1 MB).
FREQUENCIES = 1 << 18
#: Probability at most that a pair at the threshold is no candidate for its number of equal samples.
MISSED = 1e-6
#: Share of a weight that follows the inverse document frequency.
DAMPING = 0.2
#: About so much weight and so many nodes are in a block of an open bucket, and shingles in a step of their product.
BLOCK_WEIGHT, BLOCK_NODES, STEP = 1 << 17, 512, 1024

_U = np.uint64
_SHORT = _U(0xFFFFFFFF)
_NEGLOG = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts whose words are ``hashes``, and the texts' first shingles."""
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(n_shingles)])
    if not len(hashes):
        return np.zeros(0, np.uint64), start
    at = np.arange(start[-1]) - np.repeat(start[:-1] - first[:-1], n_shingles)
    short = np.repeat(n_words < SHINGLE, n_shingles)
    last = np.repeat(first[1:], n_shingles)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    total = np.zeros(len(at), np.uint64)
    for i in range(SHINGLE):
        word = padded[at + i]
        if short.any():
            word = np.where(at + i < last, word, _U(i + 1))
        total *= _U(0xD6E8FEB86659FD93)
        total += word
    return mix(total), start


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct shingles per text, sorted, and the hash of each text's words."""
    found = words(data, offsets, ALNUM_WORDS)
    hashed, start = shingles(found.hashes, found.first)
    key, row = hashed & _U((1 << 44) - 1), np.repeat(np.arange(len(offsets) - 1), np.diff(start))
    parts, counts = [], []
    step = 1 << 19  # rows fit the upper 20 bits
    for low in range(0, len(offsets) - 1, step):
        i, j = start[low], start[min(low + step, len(offsets) - 1)]
        packed, n = np.unique((row[i:j] - low).astype(np.uint64) << _U(44) | key[i:j], return_counts=True)
        parts.append(((packed >> _U(44)).astype(np.int64) + low, packed & _U((1 << 44) - 1)))
        counts.append(n)
    rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    keys = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
    place = np.arange(len(found.hashes)) - np.repeat(found.first[:-1], np.diff(found.first))
    terms = np.concatenate([[_U(0)], np.cumsum(mix(found.hashes + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))])
    whole = mix(terms[found.first[1:]] - terms[found.first[:-1]] + np.diff(found.first).astype(np.uint64))
    return rows, keys, np.concatenate(counts) if counts else np.zeros(0, np.int64), whole


def frequency_slot(keys: np.ndarray) -> np.ndarray:
    return (mix(keys & _SHORT) >> _U(46)).astype(np.int64)


def _count_frequencies(batches):
    total = np.zeros(FREQUENCIES, np.int64)
    for batch in batches:
        for _, _, data, offsets in pieces(batch.column(0)):
            rows, keys, _, _ = bags(data, offsets)
            slots = np.unique(rows * FREQUENCIES + frequency_slot(keys)) % FREQUENCIES
            total += np.bincount(slots, minlength=FREQUENCIES)
    used = np.flatnonzero(total)
    for at in range(0, len(used), 1 << 16):
        part = used[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["slot", "n"])


def occurrence_weights(docs: DataFrame) -> np.ndarray:
    """Weight of one occurrence by frequency slot, from all documents. At most FREQUENCIES rows
    come to the driver."""
    counts = docs.select("text").mapInArrow(_count_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    n_docs = max(2, docs.count())
    found = counts.toPandas()
    frequency = np.ones(FREQUENCIES)
    frequency[found["slot"].to_numpy(int)] = found["n"].to_numpy()
    idf = np.clip(np.log(n_docs / frequency) / np.log(n_docs), 0, 1)
    return (1 - DAMPING + DAMPING * idf).astype(np.float32)


def samples(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """``n`` samples per text that has shingles (rows ascending): a 64-bit name of shingle and level."""
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    spread = np.diff(np.append(first, len(rows)))
    log_weight = np.log(weights).astype(np.float32)
    low = _U(0xFFFF)
    for k in range(n):
        h = mix(keys + _U((k + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
        r = _NEGLOG[h & low] + _NEGLOG[h >> _U(16) & low]
        c = _NEGLOG[h >> _U(32) & low] + _NEGLOG[h >> _U(48)]
        beta = ((h * _U(0xE7037ED1A0B428DB)) >> _U(40)).astype(np.float32) / np.float32(1 << 24)
        level = np.floor(log_weight / r + beta)
        rank = np.log(c) - r * (level - beta + 1)
        at = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, first), spread))
        at = at[np.searchsorted(at, first)]
        yield mix(keys[at] * _U(0x8EBC6AF09C88C6E3) + level[at].astype(np.int64).astype(np.uint64) * _U(0x589965CC75374CC3) + _U(k))


def _signatures(weights):
    def sign(batches):
        table = weights.value
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                rows, keys, counts, whole = bags(data, offsets)
                filled = np.zeros(high - low, bool)
                filled[rows] = True
                drawn, total = np.zeros((high - low, BANDS * ROWS), np.int64), np.zeros(high - low)
                if len(rows):
                    own = counts * table[frequency_slot(keys)]
                    drawn[filled] = np.stack(list(samples(rows, keys, own, BANDS * ROWS)), 1).view(np.int64)
                    total = np.bincount(rows, own.astype(np.float64), high - low)
                node = pa.array(whole.view(np.int64), mask=~filled)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(drawn.ravel()), BANDS * ROWS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), batch.column("text_key").slice(low, high - low), node, flat, pa.array(total)],
                    ["doc_id", "text_key", "node", "samples", "total"],
                )

    return sign


def weighted_jaccard(left: tuple, right: tuple, n: int, table: np.ndarray) -> np.ndarray:
    """Similarity per row of two columns of bags (row, shingle, count), sorted by row and shingle."""
    total = [np.bincount(r, c * table[frequency_slot(k)].astype(np.float64), n) for r, k, c in (left, right)]
    ours, theirs = (r.astype(np.uint64) << _U(44) | k for r, k, _ in (left, right))
    at = np.searchsorted(theirs, ours)
    both = np.flatnonzero(np.append(theirs, ~_U(0))[at] == ours)
    rows, keys, counts = left[0][both], left[1][both], left[2][both]
    least = np.minimum(counts, right[2][at[both]]) * table[frequency_slot(keys)].astype(np.float64)
    shared = np.bincount(rows, least, n)
    return shared / np.maximum(total[0] + total[1] - shared, 1e-12)


def _unpacked(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags (row, shingle, count) of lists that name a shingle as often as it occurs, sorted."""
    keys = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    first = np.flatnonzero(np.diff(keys, prepend=_U(1 << 63)).astype(bool) | np.diff(rows, prepend=-1).astype(bool))
    return rows[first], keys[first], np.diff(np.append(first, len(keys)))


def _occurrences(bags_of: pa.ListArray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, name, weight) of every occurrence in lists that name a shingle as often as it occurs, and
    the rows' total weights. The k-th occurrence of a shingle has the same name in all rows."""
    offsets = bags_of.offsets.to_numpy()
    keys = bags_of.flatten().to_numpy(zero_copy_only=False).astype(np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(bags_of)), np.diff(offsets))
    fresh = np.diff(keys, prepend=_U(1 << 63)).astype(bool) | np.diff(rows, prepend=-1).astype(bool)
    first = np.flatnonzero(fresh)
    occurrence = np.arange(len(keys)) - first[np.cumsum(fresh) - 1]
    weight = table[frequency_slot(keys)].astype(np.float64)
    return rows, keys << _U(32) | occurrence.astype(np.uint64), weight, np.bincount(rows, weight, len(bags_of))


def similarities(left: pa.ListArray, right: pa.ListArray, table: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of every row of ``left`` with every row of ``right``."""
    (rows_a, names_a, weight, total_a), (rows_b, names_b, _, total_b) = (_occurrences(side, table) for side in (left, right))
    both = np.intersect1d(names_a, names_b)
    shared = np.zeros((len(left), len(right)))
    places = []
    for rows, names, values in ((rows_a, names_a, weight), (rows_b, names_b, np.ones(len(names_b)))):
        at = np.searchsorted(both, names)
        known = np.flatnonzero(np.append(both, ~_U(0))[at] == names)
        known = known[np.argsort(at[known], kind="stable")]
        places.append((rows[known], at[known], values[known]))
    for low in range(0, len(both), STEP):
        sides = []
        for (rows, at, values), n in zip(places, shared.shape):
            i, j = np.searchsorted(at, (low, low + STEP))
            side = np.zeros((n, min(STEP, len(both) - low)))
            side[rows[i:j], at[i:j] - low] = values[i:j]
            sides.append(side)
        shared += sides[0] @ sides[1].T
    return shared / np.maximum(total_a[:, None] + total_b - shared, 1e-12)


def _joining(pairs: np.ndarray, left: tuple, right: tuple) -> Iterator[tuple[int, int]]:
    """Those of the linked pairs (places in left and right) that join components; a side is (nodes, labels)."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in pairs.tolist():
        a, b = top(left[1][i]), top(right[1][j])
        if a != b:
            parent[a] = b
            yield left[0][i], right[0][j]


def _compare_blocks(weights, threshold: float):
    def compare(batches):
        table = weights.value
        for batch in batches:
            for one, other, same in zip(batch.column("one"), batch.column("other"), batch.column("same").to_pylist()):
                sides = [(x.values.field("node").to_pylist(), x.values.field("label").to_pylist()) for x in (one, other)]
                if len({*sides[0][1], *sides[1][1]}) < 2:
                    continue
                linked = similarities(one.values.field("bag"), other.values.field("bag"), table) >= threshold
                linked &= np.array(sides[0][1])[:, None] != np.array(sides[1][1])
                if same:
                    linked = np.triu(linked, 1)
                found = list(_joining(np.argwhere(linked), *sides))
                columns = [pa.array([pair[k] for pair in found], pa.int64()) for k in range(2)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return compare


def _verify(weights, threshold: float):
    def check(batches):
        table = weights.value
        for batch in batches:
            sides = [batch.column(name) for name in ("pivot_bag", "bag")]
            size = np.cumsum(sum(np.diff(side.offsets.to_numpy()) for side in sides))
            keep, low = [np.zeros(0, bool)], 0
            while low < batch.num_rows:  # blocks of about a quarter of a million shingles, one pair at least
                high = int(np.searchsorted(size, size[low] + (1 << 18), "right"))
                high = min(max(high, low + 1), low + (1 << 16))
                bags_of = [_unpacked(side.slice(low, high - low)) for side in sides]
                keep.append(weighted_jaccard(*bags_of, high - low, table) >= threshold)
                low = high
            yield batch.select(["pivot", "node"]).filter(pa.array(np.concatenate(keep)))

    return check


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component; links are (a, b).

    Every round takes the smallest label of the neighbours and then the label of the label,
    so the number of rounds follows the logarithm of a path's length.
    """
    ends = links.select(F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")))).alias("e"))
    both = stored(ends.select("e.a", "e.b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "labels")
    while True:
        met = both.join(labels, F.col("b") == F.col("node"))
        nearest = met.groupBy("a").agg(F.min("label").alias("via"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = stored(nearest.join(jump, "via").select(F.col("a").alias("node"), "old", F.least("via", "far").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            return labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after more links: only links between different components are followed."""
    if labels is None:
        return None if links.isEmpty() else components(links)
    side = [labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab"]
    named = links.join(side[0], "a", "left").join(side[1], "b", "left")
    between = named.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    between = stored(between.filter("a <> b"), "between")
    if between.isEmpty():
        return labels
    higher = components(between).select(F.col("node").alias("label"), F.col("label").alias("top"))
    own = labels.join(higher, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = higher.select(F.col("label").alias("node"), F.col("top").alias("label")).join(labels, "node", "left_anti")
    return stored(own.union(fresh), "labels")


def least_agreement(threshold: float) -> int:
    """The number of equal samples that a pair at the threshold reaches but with probability MISSED."""
    n, below = BANDS * ROWS, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if below > MISSED:
            return k
    return n


def _agreement(left: str, right: str) -> Column:
    return reduce(add, ((F.col(left)[i] == F.col(right)[i]).cast("int") for i in range(BANDS * ROWS)))


def _alike(a: str, b: str, threshold: float) -> Column:
    """Whether the total weights let the similarity reach the threshold."""
    return F.least(a, b) >= F.greatest(a, b) * (threshold * (1 - 1e-6))


def _bucket_rows(nodes: DataFrame) -> DataFrame:
    """(key, node): one row per node and band."""

    def band(i: int):
        own = F.array(*(F.col("samples")[i * ROWS + j] for j in range(ROWS)))
        return F.xxhash64(F.lit(i), own)

    return nodes.select("node", F.explode(F.array(*map(band, range(BANDS)))).alias("key"))


def near_duplicate_links(docs: DataFrame, signed: DataFrame, weights, threshold: float) -> DataFrame | None:
    """Components (node, label) of all nodes that have a link; None if there is no link."""
    same = signed.filter("node is not null").groupBy("node")
    nodes = stored(same.agg(F.min("doc_id").alias("doc_id"), F.first("samples").alias("samples"), F.first("total").alias("total")), "nodes")
    rows = _bucket_rows(nodes)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).filter("size > 1")
    buckets = stored(rows.join(sizes, "key"), "buckets")

    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("_doc"))
    fetched = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("node", "text")
    held = stored(fetched.mapInArrow(_own_bags, "node long, bag array<int>").dropDuplicates(["node"]), "bags")

    least = least_agreement(threshold)
    pairs = buckets.filter("node <> pivot").select("pivot", "node").distinct()
    own = nodes.select("node", "samples", "total")
    of_pivot = nodes.select(F.col("node").alias("pivot"), F.col("samples").alias("pivot_samples"), F.col("total").alias("pivot_total"))
    near = (_agreement("samples", "pivot_samples") >= least) & _alike("total", "pivot_total", threshold)
    pairs = pairs.join(own, "node").join(of_pivot, "pivot").filter(near).select("pivot", "node")
    pivot_bags = held.select(F.col("node").alias("pivot"), F.col("bag").alias("pivot_bag"))
    sided = pairs.join(held, "node").join(pivot_bags, "pivot").select("pivot", "node", "pivot_bag", "bag")
    found = sided.mapInArrow(_verify(weights, threshold), "pivot long, node long")
    labels = _merged(None, stored(found.select(F.col("pivot").alias("a"), F.col("node").alias("b")), "links"))
    rest = _dealt(buckets, labels, nodes, threshold)
    if rest is None:
        return labels
    links = _block_pairs(rest, held).mapInArrow(_compare_blocks(weights, threshold), "a long, b long")
    return _merged(labels, stored(links, "links"))


def _open_rows(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of buckets that hold several components, with their labels."""
    rows = rows.drop("label")
    if labels is None:
        rows = rows.withColumn("label", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    return rows.drop("size").join(mixed.filter("low <> high").select("key", "size"), "key")


def _dealt(buckets: DataFrame, labels: DataFrame | None, nodes: DataFrame, threshold: float) -> DataFrame | None:
    """(key, node, label, total) of open buckets after the pivots' round, each row under two
    neighbouring ranges of total weight as wide as a link can be; None if there are none."""
    rows = stored(_open_rows(buckets.filter("size > 2").select("key", "node"), labels).select("key", "node"), "open")
    width = max(-math.log(threshold), 1e-3) * (1 + 1e-3)
    level = F.floor(F.log("total") / width)
    parts = F.explode(F.array(level, level + 1)).alias("part")
    ranged = rows.join(nodes.select("node", "total"), "node").select("key", "node", "total", parts)
    ranged = ranged.withColumn("key", F.xxhash64("key", "part")).drop("part")
    found = stored(_open_rows(ranged, labels).select("key", "node", "label", "total"), "buckets")
    return None if found.isEmpty() else found


def _block_pairs(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(one, other, same): every two blocks of a bucket, and each with itself; a block is an array of
    (node, label, bag)."""
    sizes = rows.groupBy("key").agg(
        F.greatest(F.ceil(F.sum("total") / BLOCK_WEIGHT), F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.lit(1)).cast("int").alias("n")
    )
    dealt = rows.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n")).cast("int"))
    member = F.struct("node", "label", "bag")
    blocks = dealt.join(held, "node").groupBy("key", "part", "n").agg(F.collect_list(member).alias("members"))
    blocks = stored(blocks, "blocks")
    partners = F.explode(F.sequence(F.col("part"), F.col("n") - 1)).alias("with")
    one = blocks.select("key", F.col("members").alias("one"), "part", partners)
    other = blocks.select("key", F.col("part").alias("with"), F.col("members").alias("other"))
    return one.join(other, ["key", "with"]).select("one", "other", (F.col("part") == F.col("with")).alias("same"))


def _own_bags(batches):
    """(node, bag) of the rows whose text is their node's: rows of a doc_id may hold several texts.
    A bag lists the lower 32 bits of its shingles, sorted, each as often as it occurs."""
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        for low, high, data, offsets in pieces(batch.column("text")):
            rows, keys, counts, whole = bags(data, offsets)
            own = whole.view(np.int64) == nodes[low:high]
            packed = np.sort(np.repeat(rows.astype(np.uint64) << _U(32) | keys & _SHORT, counts))
            start = np.searchsorted(packed, np.arange(high - low + 1, dtype=np.uint64) << _U(32))
            short = pa.array((packed & _SHORT).astype(np.uint32).view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), short)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[low:high]), lists], ["node", "bag"]).filter(pa.array(own))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept, and the row's text_key.

    ``kept`` marks the rows of the class's representative: the smallest doc_id.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    weights = spark.sparkContext.broadcast(occurrence_weights(docs))
    keyed = docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(keyed.mapInArrow(_signatures(weights), f"doc_id {id_type}, text_key long, node long, samples array<long>, total double"), "signed")
    labels = near_duplicate_links(docs, signed, weights, threshold)
    rows = signed.select("doc_id", "text_key", "node")
    if labels is None:
        rows = rows.withColumn("label", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Rows without words stay alone: their label is null.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first")
    classes = rows.filter("label is not null").groupBy("label").agg(first, F.count(F.lit(1)).alias("class_size"))
    joined = rows.join(classes, "label", "left")
    alone = F.col("label").isNull()
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (alone | chosen).alias("kept"),
        "text_key",
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, one per class, with all their columns."""
    kept = near_duplicates(docs, threshold).filter("kept")
    return kept_rows(docs, F.xxhash64(F.coalesce("text", F.lit(""))), kept, "text_key")
