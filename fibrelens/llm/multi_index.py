"""Hard negatives by an inverted multi-index over integer vectors, exact by certified bounds.

*Index.* Vectors are cut into two halves. Each half has a codebook (k-means over a bounded sample),
and a pair of codewords names a cell. Every row is put into its cell; a cell's rows are kept in
chunks of about ``CHUNK`` rows at most, dealt by a hash, so a cell that holds a third of all rows is
many chunks. Per codeword the largest distance of its rows is its radius.

*Search.* For a query with halves q1, q2 no row of cell (i, j) scores more than

    (q1 . c1[i] + |q1| r1[i]) + (q2 . c2[j] + |q2| r2[j])

Both sums are sorted, and a multi-sequence heap gives the cells by falling bound. Each wanted list
(a *slot*: own or other labels, scores from low to high, the first k) is certified once its k-th
score, or its lowest score, exceeds the bound of every cell not yet visited. So results are exact
(recall 1) whatever the codebooks; these only decide how many cells are read. Bounds are rounded up.

*Rounds.* Queries are dealt in blocks of like first codeword. In a round, a task walks the heaps of
its block until each query met its share of rows, and writes which cells it visits; the visits are
joined with the chunks by cell, scored in matrix products, cut to the first k per slot and merged.
Queries with open slots go on in the next round with 16 times the rows. Vectors without structure
let no bound certify early, and then every query meets every row, once, in blocks.

*Hard negatives.* First the positives are searched, then per positive the rows of other labels in
its window of scores.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part.
Of rows that repeat an id, the one with the smallest (label, vector) takes part. Shorter vectors
count as filled with zeros. Components and scores beyond a long count as its ends. Ties go to the
smaller id. An anchor without rows of its label, or without others, has no result. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, stored

#: Rows aimed at per cell, and most codewords of a half (65,536 cells).
CELL, CODEWORDS = 512, 256
#: About so many rows are in a chunk at most, and so many components (4 MB as long).
CHUNK, CHUNK_VALUES = 4096, 1 << 19
#: Components in the sample that fits the codebooks (at most SAMPLE rows), and rounds of k-means.
SAMPLE_VALUES, SAMPLE, LLOYD = 1 << 22, 20_000, 8
#: Queries in a block, rows that a query meets in the first round, and how that grows by round.
BLOCK, FIRST_ROWS, GROWTH = 128, 1 << 14, 16

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_SLOT = "struct<slot:int, high:long, need:long>"


class Index(NamedTuple):
    """What tasks need to know: centres and radii per half, rows per cell, and the numbers' width."""

    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    dtype: str
    exact: bool
    chunk: int


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector and all of its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == math.inf))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _means(points: np.ndarray, k: int) -> np.ndarray:
    """k-means from the first k points; a codeword that loses all points stays where it is."""
    centres = points[:k].copy()
    for _ in range(LLOYD):
        near, _ = _nearest(points, centres)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword and distance of each point."""
    near = np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, 1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(1))


def _matrix(codes: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix, filled up with zeros."""
    bounds = codes.offsets.to_numpy()
    sizes = np.diff(bounds)
    out = np.zeros((len(codes), width), np.int64)
    row = np.repeat(np.arange(len(codes)), sizes)
    out[row, np.arange(bounds[0], bounds[-1]) - np.repeat(bounds[:-1], sizes)] = codes.flatten().to_numpy()
    return out


def _halves(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = matrix.shape[1] // 2
    return matrix[:, :cut].astype(np.float64), matrix[:, cut:].astype(np.float64)


def _codebooks(items: DataFrame, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of both halves, from a sample of bounded size chosen by a hash of the id."""
    k = min(CODEWORDS, max(1, math.ceil(math.sqrt(n / CELL))))
    size = max(k, min(SAMPLE, SAMPLE_VALUES // max(1, width)))
    sample = items.orderBy(F.xxhash64("vec_id"), "vec_id").select("code").limit(size).toArrow()
    points = _halves(_matrix(sample.column("code").combine_chunks(), width))
    return tuple(_means(half, min(k, len(half))) for half in points)


def _assign(centres, dtype: str):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = centres.value
        width = sum(c.shape[1] for c in book)
        for batch in batches:
            matrix = _matrix(batch.column("code"), width)
            (c1, d1), (c2, d2) = (_nearest(half, c) for half, c in zip(_halves(matrix), book))
            codes = pa.array([row.tobytes() for row in matrix.astype(dtype)], pa.binary())
            columns = [batch.column("vec_id"), batch.column("label"), codes, *map(pa.array, (c1, c2, d1, d2))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "c1", "c2", "d1", "d2"])

    return assign


def bounds(query: np.ndarray, index: Index) -> list[np.ndarray]:
    """Per half, the most that a codeword's rows can add to the score with ``query``, rounded up."""
    out = []
    for half, centres, radii in zip(_halves(query[None]), index.centres, index.radii):
        length = np.sqrt((half * half).sum())
        slack = 1e-9 * length * (np.sqrt((centres * centres).sum(1)) + radii) + 1e-6
        out.append(centres @ half[0] + length * radii + slack)
    return out


def cells_by_bound(upper: list[np.ndarray]) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all cells by falling bound, from a multi-sequence heap."""
    order = [np.argsort(-u, kind="stable") for u in upper]
    first, second = (u[o] for u, o in zip(upper, order))
    done = np.zeros(len(first), np.int64)  # per row of the sorted grid, how many cells were given
    heap = [(-(first[0] + second[0]), 0, 0)]
    while heap:
        bound, a, b = heapq.heappop(heap)
        yield -bound, int(order[0][a]), int(order[1][b])
        done[a] = b + 1
        # A cell enters once its neighbours with a larger bound, left and above, were given.
        if a + 1 < len(first) and done[a + 1] == b:
            heapq.heappush(heap, (-(first[a + 1] + second[b]), a + 1, b))
        if b + 1 < len(second) and (a == 0 or done[a - 1] > b + 1):
            heapq.heappush(heap, (-(first[a] + second[b + 1]), a, b + 1))


def _walk(index, budget: int):
    """Blocks of queries to visits (cell, chunk, queries packed) and to how far each query came."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        for batch in batches:
            for block in batch.column("queries"):
                yield from _walk_block(block.as_py(), known, budget)

    return walk


def _walk_block(block: list[dict], known: Index, budget: int) -> Iterator[pa.RecordBatch]:
    visitors: dict[tuple[int, int], list[int]] = {}
    reached = []
    codes = [np.frombuffer(q["code"], known.dtype) for q in block]
    for at, query in enumerate(block):
        need, met, popped, left = min(s["need"] for s in query["slots"]), 0, 0, -math.inf
        for bound, i, j in cells_by_bound(bounds(codes[at].astype(np.int64), known)):
            bound = max(bound, float(_LOW))
            if popped >= query["popped"]:
                if bound < need or met >= budget:
                    left = bound
                    break
                if known.rows[i, j]:
                    visitors.setdefault((i, j), []).append(at)
                    met += int(known.rows[i, j])
            popped += 1
        reached.append((query["anchor_id"], popped, left))
    rows = []
    for (i, j), who in visitors.items():
        packed = _pack([block[q] for q in who], [codes[q] for q in who])
        rows += [(i, j, chunk, packed, None, None, None) for chunk in range(_chunks(int(known.rows[i, j]), known.chunk))]
    rows += [(None, None, None, None, *one) for one in reached]
    for low in range(0, len(rows), 256):
        columns = zip(*rows[low : low + 256])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PLAN.types)], _PLAN.names)


_PLAN = pa.schema(
    [("c1", pa.int64()), ("c2", pa.int64()), ("chunk", pa.int32()), ("queries", pa.binary()), ("anchor_id", pa.int64()), ("popped", pa.int64()), ("bound", pa.float64())]
)


def _chunks(rows: int, size: int) -> int:
    return -(-rows // size)


def _pack(queries: list[dict], codes: list[np.ndarray]) -> bytes:
    """Ids, labels, slots (query, slot, high, need) and vectors of queries, one after the other."""
    slots = [(q, s["slot"], s["high"], s["need"]) for q, query in enumerate(queries) for s in query["slots"]]
    heads = [len(queries), len(slots), *(q["anchor_id"] for q in queries), *(q["label"] for q in queries)]
    return np.array(heads, np.int64).tobytes() + np.array(slots, np.int64).tobytes() + b"".join(c.tobytes() for c in codes)


def _unpack(packed: bytes, dtype: str) -> tuple[np.ndarray, ...]:
    n, s = np.frombuffer(packed, np.int64, 2)
    ids, labels = np.frombuffer(packed, np.int64, 2 * n, 16).reshape(2, n)
    slots = np.frombuffer(packed, np.int64, 4 * s, 16 + 16 * n).reshape(s, 4)
    return ids, labels, slots, np.frombuffer(packed, dtype, -1, 16 + 16 * n + 32 * s).reshape(n, -1)


def scores(left: np.ndarray, right: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of two integer matrices; those beyond a long count as its ends."""
    if exact:  # every sum fits the 53 bits of a double
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    whole = left.astype(object) @ right.astype(object).T
    return np.array([[min(max(x, _LOW), _HIGH) for x in row] for row in whole], np.int64).reshape(whole.shape)


def _score(index, same: bool, k: int):
    """Joined visits and chunks to the first k rows per query and slot of each chunk."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        for batch in batches:
            for packed, chunk in zip(batch.column("queries"), batch.column("rows")):
                rows = chunk.values
                ids, labels = (rows.field(name).to_numpy() for name in ("vec_id", "label"))
                codes = np.frombuffer(b"".join(rows.field("code").to_pylist()), known.dtype).reshape(len(ids), -1)
                own, own_labels, slots, queries = _unpack(packed.as_py(), known.dtype)
                q, slot, high, need = slots.T
                met = scores(queries, codes, known.exact)[q]
                fit = (own_labels[q, None] == labels) == same
                fit &= (met <= high[:, None]) & (met >= need[:, None]) & (own[q, None] != ids)
                yield _first(met, fit, ids, own[q], slot, k)

    return score


def _first(met: np.ndarray, fit: np.ndarray, ids: np.ndarray, anchors: np.ndarray, slot: np.ndarray, k: int) -> pa.RecordBatch:
    """The k highest fitting scores per line, ties by smaller id."""
    if met.shape[1] > k:
        floor = np.partition(np.where(fit, met, _LOW), -k, axis=1)[:, -k]
        fit = fit & (met >= floor[:, None])
    line, at = np.nonzero(fit)
    order = np.lexsort((ids[at], ~met[line, at], line))  # ~x falls as x rises, also at the ends of a long
    line, at = line[order], at[order]
    rank = np.arange(len(line)) - np.searchsorted(line, line)
    line, at = line[rank < k], at[rank < k]
    columns = [anchors[line], slot[line].astype(np.int32), met[line, at], ids[at]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "slot", "score", "vec_id"])


def _items(rows: DataFrame) -> DataFrame:
    """vec_id, label, code (array of long), one row per id."""
    first = F.min(F.struct(F.col("label").cast("long").alias("label"), "code")).alias("first")
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(first).select("vec_id", "first.label", "first.code")


def _build(items: DataFrame, is_anchor: Column) -> tuple[DataFrame, DataFrame, Index] | None:
    """Chunks of the index, blocks of anchors, and what tasks need to know; None for no rows."""
    spark = items.sparkSession
    # In decimals, as the absolute value of the smallest long is no long.
    peak = F.max(F.array_max(F.transform("code", lambda x: F.abs(x.cast("decimal(20,0)")))))
    n, width, most = items.agg(F.count(F.lit(1)), F.max(F.size("code")), peak).first()
    if not n:
        return None
    width, most = max(1, width), int(most or 0)
    dtype = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    centres = _codebooks(items, n, width)
    schema = "vec_id long, label long, code binary, c1 long, c2 long, d1 double, d2 double"
    rows = stored(items.mapInArrow(_assign(spark.sparkContext.broadcast(centres), dtype), schema), "cells")

    k1, k2 = map(len, centres)
    counted = rows.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2"), F.count_if(is_anchor).alias("anchors"))
    cells = counted.toPandas()  # at most CODEWORDS squared rows
    grid, radii, anchors = np.zeros((k1, k2), np.int64), (np.zeros(k1), np.zeros(k2)), np.zeros(k1, np.int64)
    i, j = cells["c1"].to_numpy(), cells["c2"].to_numpy()
    grid[i, j] = cells["n"]
    np.maximum.at(radii[0], i, cells["d1"].to_numpy())
    np.maximum.at(radii[1], j, cells["d2"].to_numpy())
    np.add.at(anchors, i, cells["anchors"].to_numpy())

    chunk = max(1, min(CHUNK, CHUNK_VALUES // width))
    known = [(int(a), int(b), _chunks(int(grid[a, b]), chunk)) for a, b in zip(i, j)]
    sizes = F.broadcast(spark.createDataFrame(known, "c1 long, c2 long, chunks int"))
    dealt = rows.join(sizes, ["c1", "c2"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    chunks = stored(dealt.groupBy("c1", "c2", "chunk").agg(F.collect_list(F.struct("vec_id", "label", "code")).alias("rows")), "chunks")
    parts = F.array(*(F.lit(max(1, -(-int(a) // BLOCK))) for a in anchors))
    block = F.pmod(F.xxhash64("vec_id"), parts[F.col("c1").cast("int")])
    queries = rows.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "code", F.struct("c1", block.alias("part")).alias("block"))
    exact = width * most * most < 1 << 53
    return chunks, stored(queries, "queries"), Index(centres, radii, grid, dtype, exact, chunk)


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The first k rows per query and slot."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(chunks: DataFrame, queries: DataFrame, slots: DataFrame, known, same: bool, k: int, first_rows: int) -> DataFrame:
    """anchor_id, slot, rank, score, vec_id: the first k rows of every slot (anchor_id, slot, high, low)."""
    spark = slots.sparkSession
    best = spark.createDataFrame([], "anchor_id long, slot int, score long, vec_id long, rank int")
    came = spark.createDataFrame([], "anchor_id long, popped long, bound double")
    budget = first_rows
    while True:
        full = best.groupBy("anchor_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
        need = F.when(F.col("n") >= k, F.greatest("low", "last")).otherwise(F.col("low"))
        state = slots.join(full, ["anchor_id", "slot"], "left").withColumn("need", need).join(came, "anchor_id", "left")
        # A cell whose bound equals the k-th score may hold a tie with a smaller id.
        is_open = F.col("bound").isNull() | (F.col("bound") >= F.col("need"))
        wanted = state.filter(is_open).groupBy("anchor_id").agg(
            F.collect_list(F.struct("slot", "high", "need")).alias("slots"), F.coalesce(F.max("popped"), F.lit(0)).alias("popped")
        )
        members = queries.join(wanted, "anchor_id").groupBy("block")
        blocks = members.agg(F.collect_list(F.struct("anchor_id", "label", "code", "popped", "slots")).alias("queries"))
        schema = "c1 long, c2 long, chunk int, queries binary, anchor_id long, popped long, bound double"
        plan = stored(blocks.select("queries").mapInArrow(_walk(known, budget), schema), "visits")
        moved = plan.filter("anchor_id is not null").select("anchor_id", "popped", "bound")
        if moved.isEmpty():
            return best
        visits = plan.filter("anchor_id is null").select("c1", "c2", "chunk", "queries")
        met = visits.join(chunks, ["c1", "c2", "chunk"]).select("queries", "rows")
        found = met.mapInArrow(_score(known, same, k), "anchor_id long, slot int, score long, vec_id long")
        best = stored(_top(best.drop("rank").unionByName(found), k), "best")
        rest = came.join(moved, "anchor_id", "left_anti")
        came = stored(rest.unionByName(moved), "reached")
        budget *= GROWTH


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    first_rows: int = FIRST_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and code (array of long), ``is_anchor`` is a condition on vec_id. For
    each anchor the ``positives`` first other rows of its label, and for each of them the first
    ``negatives`` rows of other labels with least * p <= 100 * score <= most * p, for its score p.
    """
    spark = rows.sparkSession
    ship(spark)
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    built = _build(stored(_items(rows), "items"), is_anchor)
    if built is None:
        return spark.createDataFrame([], shape)
    chunks, queries, index = built
    known = spark.sparkContext.broadcast(index)

    whole = [F.lit(0).alias("slot"), F.lit(_HIGH).alias("high"), F.lit(_LOW).alias("low")]
    own = _search(chunks, queries, queries.select("anchor_id", *whole), known, True, positives, first_rows)

    def share(percent: int) -> Column:
        return F.col("score").cast("decimal(20,0)") * F.lit(Decimal(percent) / 100).cast("decimal(10,2)")

    windows = own.select(
        "anchor_id", F.col("rank").alias("slot"), F.floor(share(most)).cast("decimal(38,0)").alias("high"), F.ceil(share(least)).cast("decimal(38,0)").alias("low")
    ).filter("low <= high")
    inside = [F.least(F.greatest(F.col(c), F.lit(_LOW).cast("decimal(38,0)")), F.lit(_HIGH).cast("decimal(38,0)")).cast("long").alias(c) for c in ("high", "low")]
    slots = stored(windows.select("anchor_id", "slot", *inside), "windows")
    other = _search(chunks, queries, slots, known, False, negatives, first_rows)
    pairs = own.select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = other.select("anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(named, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and code of the rows that take part."""
    taken = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    return taken.select("vec_id", F.col("label").cast("long").alias("label"), quantised(F.col("embedding"), scale).alias("code"))
