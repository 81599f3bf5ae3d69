"""Scoring texts with a hashed maximum-entropy language model.

Words are lower-cased (A-Z) runs without ASCII white space; every text ends with an end token.
The softmax is factored: first the class of the next word, then the word within its class.

*Classes.* The most frequent words are classes of their own; all others, known or not, fall into
classes by a hash of their last two bytes, so a word that was never seen has a class too.

*Class softmax.* Features of the history are hashed into fixed tables: a bias, the previous word
(bigram), the word before it (skip), and both together (trigram). The corpus is reduced to counts
of (history, class); distributed gradient steps over these counts fit the weights, each step one
Spark job whose tasks return gradients of bounded size. Steps are relative to the expected counts.

*Word softmax.* Within a class a word's only feature is its own identity, whose maximum-entropy
weight is its add-one smoothed log count, with one share for all unseen words of the class. So the
probabilities of all known words and one unknown word per class sum to 1.

Counts of all words come from all training texts. Tasks receive the counts of the most frequent
words (a bounded table) and join the rest, so the vocabulary is never on one machine. Words are
named by 64-bit hashes; a collision among a billion words has a chance of a few percent.

Defined cases: null counts as empty, which is the end token alone. A null doc_id is in no fold,
so it trains. Without training texts N and V are 0 and the classes are equally likely. Repeated
rows train and are scored as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import SPACE_WORDS, Words, mix, pieces, row_counts, row_sums, words
from .shared import ship, stored

#: Words whose counts every task receives, at most (3 MB).
FREQUENT = 200_000
#: Classes; the first SINGLE of them hold one word each.
CLASSES, SINGLE = 128, 40
#: Buckets of the previous word and of the word before it, and how many hold a single word.
NEAR, NEAR_SINGLE = 256, 120
SKIP, SKIP_SINGLE = 64, 24
#: Hashed buckets of the trigram feature.
TRIGRAMS = 4096
STEPS = 20
#: Strength of the prior on the weights of each table.
PRIORS = (0.1, 2.0, 2.0, 12.0)
#: Words of a partition that are counted together before the shuffle.
TOGETHER = 4_000_000

_END = np.uint64(0x2545F4914F6CDD1D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with the end tokens, a hash of each one's last two bytes, first tokens."""
    found = words(data, offsets, SPACE_WORDS)
    first = found.first + np.arange(len(found.first))
    end = first[1:] - 1
    inner = np.ones(int(first[-1]), bool)
    inner[end] = False
    hashes, tails = np.full(int(first[-1]), _END), np.zeros(int(first[-1]), np.int64)
    hashes[inner], tails[inner] = found.hashes, _tail(found)
    return hashes, tails, first


def _tail(found: Words) -> np.ndarray:
    if not len(found.ends):
        return np.zeros(0, np.int64)
    last = found.data[found.ends - 1].astype(np.uint64)
    before = np.where(found.ends - found.starts > 1, found.data[np.maximum(found.ends - 2, 0)], 0).astype(np.uint64)
    return (mix(last << np.uint64(8) | before) >> np.uint64(33)).astype(np.int64)


def _count_words(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        hashes, tails = (np.concatenate(x) for x in zip(*held, strict=True))
        unique, at, n = np.unique(hashes, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(unique.view(np.int64)), pa.array(tails[at]), pa.array(n, pa.int64())], ["word", "tail", "n"]
        )

    for batch in batches:
        for _, _, data, offsets in pieces(batch.column(0)):
            hashes, tails, first = tokens(data, offsets)
            held.append((hashes, tails))
            size += len(hashes)
            if size >= TOGETHER:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Vocabulary:
    """The frequent words, by hash: count and rank by count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        rank = np.empty(len(hashes), np.int64)
        rank[np.lexsort((hashes, -counts))] = np.arange(len(hashes))
        order = np.argsort(hashes)
        self.hashes, self.counts, self.ranks = hashes[order], counts[order], rank[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1 if not held) and rank of each word."""
        if not len(self.hashes):
            return np.full(len(hashes), -1), np.full(len(hashes), 1 << 40)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        held = self.hashes[at] == hashes
        return np.where(held, self.counts[at], -1), np.where(held, self.ranks[at], 1 << 40)


def bucket(ranks: np.ndarray, tails: np.ndarray, n: int, single: int) -> np.ndarray:
    """Own bucket for the ``single`` most frequent words, hashed by the last bytes for the others."""
    return np.where(ranks < single, ranks, single + tails % (n - single))


def histories(ranks: np.ndarray, tails: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of each token's history. Before the first words of a text stands the end token."""
    near = bucket(ranks, tails, NEAR - 1, NEAR_SINGLE)
    skip = bucket(ranks, tails, SKIP - 1, SKIP_SINGLE)
    one, two = np.full(len(ranks), NEAR - 1), np.full(len(ranks), SKIP - 1)
    one[1:], two[2:] = near[:-1], skip[:-2]
    begin = first[:-1]
    one[begin] = NEAR - 1
    two[begin] = SKIP - 1
    after = begin + 1
    two[after[after < len(two)]] = SKIP - 1
    return one * SKIP + two


def _count_histories(vocabulary):
    def count(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            unique, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array((unique // CLASSES).astype(np.int32)), pa.array((unique % CLASSES).astype(np.int32)), pa.array(n, pa.int64())],
                ["history", "class", "n"],
            )

        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                hashes, tails, first = tokens(data, offsets)
                _, ranks = vocabulary.value.find(hashes)
                held.append(histories(ranks, tails, first) * CLASSES + bucket(ranks, tails, CLASSES, SINGLE))
                size += len(hashes)
                if size >= TOGETHER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return count


class Weights:
    """Feature tables of the class softmax: bias, bigram, skip and hashed trigram."""

    def __init__(self):
        self.tables = [np.zeros((n, CLASSES)) for n in (1, NEAR, SKIP, TRIGRAMS)]

    @staticmethod
    def active(history: np.ndarray) -> list[np.ndarray]:
        """The row of each table that a history switches on."""
        trigram = (mix(history.astype(np.uint64)) >> np.uint64(20)).astype(np.int64) % TRIGRAMS
        return [np.zeros(len(history), np.int64), history // SKIP, history % SKIP, trigram]

    def log_probabilities(self, history: np.ndarray) -> np.ndarray:
        total = sum(t[rows] for t, rows in zip(self.tables, self.active(history), strict=True))
        total -= total.max(1, keepdims=True)
        return total - np.log(np.exp(total).sum(1, keepdims=True))

    def update(self, gradient: np.ndarray, expected: np.ndarray) -> None:
        """One step uphill: the gradient (observed minus expected counts, minus the pull of a
        Gaussian prior) relative to what is expected, on the log scale, and shared among the
        features of a history, so that steps don't overshoot."""
        at = 0
        for table, prior in zip(self.tables, PRIORS, strict=True):
            g, e = (x[at : at + len(table)] for x in (gradient, expected))
            table += np.log1p(np.maximum((g - prior * table) / (e + prior), -0.9)) / len(self.tables)
            at += len(table)


def _gradients(weights):
    """Gradient and expected counts of a task's histories, as rows of the stacked feature tables."""

    def step(batches):
        model = weights.value
        sizes = np.cumsum([0, *map(len, model.tables)])
        gradient, expected = np.zeros((sizes[-1], CLASSES)), np.zeros((sizes[-1], CLASSES))
        for batch in batches:
            history = batch.column("history").to_numpy()
            flat, lengths = batch.column("counts").flatten(), batch.column("counts").value_lengths().to_numpy()
            counts = np.zeros((len(history), CLASSES))
            counts[np.repeat(np.arange(len(history)), lengths), flat.field("class").to_numpy()] = flat.field("n").to_numpy()
            p = np.exp(model.log_probabilities(history))
            total = counts.sum(1, keepdims=True)
            for low, rows in zip(sizes, model.active(history), strict=False):
                np.add.at(gradient, low + rows, counts - total * p)
                np.add.at(expected, low + rows, total * p)
        used = np.flatnonzero(expected.any(1))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[used].ravel(), pa.float32()), CLASSES).cast(pa.list_(pa.float32())) for x in (gradient, expected)]
        yield pa.RecordBatch.from_arrays([pa.array(used), *lists], ["row", "gradient", "expected"])

    return step


def train(spark, histories_counted: DataFrame, steps: int = STEPS) -> Weights:
    """Fit the class softmax by ``steps`` distributed gradient steps.

    There are at most NEAR * SKIP histories, so four tasks hold them; each returns at most one
    row per feature of 2 * CLASSES numbers, some 5 MB.
    """
    histories_counted = histories_counted.coalesce(4)
    model, rows = Weights(), sum((1, NEAR, SKIP, TRIGRAMS))
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(model)
        parts = histories_counted.mapInArrow(_gradients(shared), "row long, gradient array<float>, expected array<float>")
        gradient, expected = np.zeros((rows, CLASSES)), np.zeros((rows, CLASSES))
        table = parts.toArrow()
        for total, name in ((gradient, "gradient"), (expected, "expected")):
            np.add.at(total, table["row"].to_numpy(), table[name].combine_chunks().flatten().to_numpy().reshape(-1, CLASSES))
        model.update(gradient, expected)
        shared.destroy()
    return model


def _scores(shared):
    def score(batches):
        vocabulary, log_p, class_total, seen_words = shared.value
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                hashes, tails, first = tokens(data, offsets)
                counts, ranks = vocabulary.find(hashes)
                which = bucket(ranks, tails, CLASSES, SINGLE)
                log_class = log_p[histories(ranks, tails, first), which].astype(np.float64) - class_total[which]
                held = counts >= 0
                rest = np.flatnonzero(~held)
                bounds = np.searchsorted(rest, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(low, high - low),
                        batch.column("doc_id").slice(low, high - low),
                        pa.array(np.diff(first)),
                        pa.array(row_counts(held & (counts > 0), first)),
                        pa.array(row_sums(np.log10(np.maximum(counts, 0) + 1.0), first)),
                        pa.array(row_sums(log_class, first)),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes[rest].view(np.int64))),
                    ],
                    ["row", "doc_id", "n_tokens", "n_held", "log_counts", "log_class", "rest"],
                )

    return score


def _frequent(counts: DataFrame, most: int) -> Vocabulary:
    """The words with at least some count, that count chosen so that at most ``most`` words have it.

    Levels are eighths of a doubling, so at most a few hundred rows decide.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        held += row["words"]
        if held > most:
            break
        least = row["level"]
    if least is None:
        return Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = counts.filter(level >= least).select("word", "n").toPandas()
    return Vocabulary(found["word"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64))


def score_texts(docs: DataFrame, held_out, steps: int = STEPS, frequent: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a Boolean column; rows where it is true are scored but not learned from.
    """
    spark = docs.sparkSession
    ship(spark)
    training = docs.filter(~F.coalesce(held_out, F.lit(False))).select("text")
    counted = training.mapInArrow(_count_words, "word long, tail long, n long")
    counts = stored(counted.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n")), "lm-words")
    vocabulary = _frequent(counts, frequent)
    # Bounded: ``frequent`` words of 24 bytes.
    top = spark.sparkContext.broadcast(vocabulary)

    reduced = training.mapInArrow(_count_histories(top), "history int, class int, n long").groupBy("history", "class").agg(F.sum("n").alias("n"))
    grouped = reduced.groupBy("history").agg(F.collect_list(F.struct("class", "n")).alias("counts"))  # at most CLASSES entries
    model = train(spark, stored(grouped, "lm-histories"), steps)

    # Class totals: for every class its tokens, its known words and one unknown word.
    singles = {int(h): int(r) for h, r in zip(vocabulary.hashes.view(np.int64), vocabulary.ranks, strict=True) if r < SINGLE}
    own = F.create_map(*(F.lit(x) for pair in singles.items() for x in pair))[F.col("word")] if singles else F.lit(None)
    in_class = F.coalesce(own, F.lit(SINGLE) + F.col("tail") % (CLASSES - SINGLE)).cast("int").alias("class")
    totals = counts.groupBy(in_class).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    class_total, n_tokens, n_words = np.ones(CLASSES), 0, 0
    for row in totals:
        class_total[row["class"]] += row["n"] + row["words"]
        n_tokens, n_words = n_tokens + row["n"], n_words + row["words"]
    # Bounded: one number per history and class (8 MB).
    log_p = (model.log_probabilities(np.arange(NEAR * SKIP)) / np.log(10)).astype(np.float32)
    shared = spark.sparkContext.broadcast((vocabulary, log_p, np.log10(class_total), n_words))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {id_type}, n_tokens long, n_held long, log_counts double, log_class double, rest array<long>"
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = stored(numbered.mapInArrow(_scores(shared), schema), "lm-scores")

    rest = scored.select("row", F.explode("rest").alias("word")).join(counts.select("word", "n"), "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more"), F.count("n").alias("known"))
    log_counts = F.col("log_counts") + F.coalesce("more", F.lit(0.0))
    base = log_counts - F.col("n_tokens") * F.log10(F.lit(float(n_tokens + n_words + 1)))
    whole = scored.drop("rest").join(rest, "row", "left")
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_held") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (log_counts + F.col("log_class")).alias("score"),
    )
