"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of two lexicons (a short fixed one and one learned from labels),
how near their words stand to the second person, share of capitals, punctuation rates, signs of
obfuscation (lexicon words only seen after undoing digit and symbol substitutions, words that
mix letters with symbols) and lengths. Neither labels nor other columns are inputs.

Learning uses a bounded sample of labelled rows whose crc32(doc_id) mod 5 is not 0, at most
``SAMPLE`` rows (fewer if there are fewer), taken by a hash of doc_id. A quarter of it yields
the lexicon, a half the trees, a quarter the calibration, so no part judges its own output.
Features are computed by the executors; at most SAMPLE short rows of numbers reach the driver.

Defined cases: null counts as empty; empty texts are scored like any other from all-zero
features. Of several labels for one doc_id the largest counts; null labels are ignored. Without
labelled rows, or with one class only, every score is the share of label 1 (0 without rows).
Rows keep their order and columns in ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import pieces, prefix_hashes, row_counts, row_sums, word_hash, words
from .shared import ship, unused

#: Labelled rows that are learned from, at most.
SAMPLE = 12_000
#: Words of the learned lexicon, at most.
LEXICON = 150
#: Bytes of a stem: inflected and compound words share one.
STEM = 6
TREES, DEPTH, RATE, BINS = 120, 3, 0.1, 32

# General insults, and second-person words of English, French, German and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers trash garbage scum worthless pathetic disgusting clown "
    "ugly fool jerk creep freak coward liar vermin filth idiote imbécile crétin connard débile dégoûtant "
    "dumm dummkopf abschaum wertlos ekelhaft widerlich idiota imbécil estúpido basura asqueroso inútil"
).split()
SECOND_PERSON = "you your yours yourself u ur tu te toi vous ton ta votre du dich dir dein deine ihr euch usted ustedes ti tus".split()

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
# Digits and symbols that stand for letters, undone; such words may also hold '*' for any letter.
_FOLDED = _LETTERS.copy()
for _from, _to in zip("013457@$!|+*", "oieastasiit*", strict=True):
    _FOLDED[ord(_from)] = ord(_to)
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[0, 9, 10, 11, 12, 13, 32]] = 0
NAMES = (
    "log_words word_length fixed_density fixed_hits learned_density learned_hits learned_top learned_sum near_second second_density "
    "stem_density stem_hits stem_top stem_sum capitals capital_words exclamations questions symbols digits repeated_marks mixed_words hidden_hits distinct_share"
).split()


def _with_stars(word: str) -> list[str]:
    """A word, and itself with one inner letter starred."""
    return [word, *(word[:i] + "*" + word[i + 1 :] for i in range(1, len(word) - 1))]


def _hash_set(names: list[str], table: np.ndarray) -> np.ndarray:
    return np.unique(np.array([word_hash(w.encode(), table) for w in names], np.uint64))


def _member(hashes: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(among, hashes), len(among) - 1)
    return among[at] == hashes


def _weights(weights: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their weights."""
    hashes = np.array([word_hash(w, _LETTERS) for w in weights], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array(list(weights.values()))[order]


def _look_up(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weights of the hashes, 0 for others."""
    if not len(table[0]):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(table[0], hashes), len(table[0]) - 1)
    return np.where(table[0][at] == hashes, table[1][at], 0.0)


def _row_top(weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    top = np.zeros(len(first) - 1)
    found = np.flatnonzero(weight)
    np.maximum.at(top, np.searchsorted(first, found, "right") - 1, weight[found])
    return top


@dataclass
class Lexicon:
    """Learned words and stems with their weights, and the fixed words."""

    learned: dict[bytes, float]
    stems: dict[bytes, float]

    def __post_init__(self):
        self.fixed = _hash_set(INSULTS, _LETTERS)
        self.second = _hash_set(SECOND_PERSON, _LETTERS)
        self.word_weights, self.stem_weights = _weights(self.learned), _weights(self.stems)
        names = [w.decode() for w in self.learned]
        self.folded = _hash_set([v for w in {*INSULTS, *names} if len(w) > 3 for v in _with_stars(w)], _FOLDED)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Matrix of the features NAMES, one row per text."""
    plain = words(data, offsets, _LETTERS)
    spaced = words(data, offsets, _SPACED)
    folded = words(data, offsets, _FOLDED)
    n_bytes = np.diff(offsets)
    n_words = np.diff(plain.first)
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(n_bytes, 1)

    fixed = _member(plain.hashes, lexicon.fixed)
    weight = _look_up(plain.hashes, lexicon.word_weights)
    stem = _look_up(prefix_hashes(plain, STEM), lexicon.stem_weights)
    stem[plain.ends - plain.starts < STEM] = 0
    hit, second = fixed | (weight > 0), _member(plain.hashes, lexicon.second)
    near = np.zeros(len(hit), bool)
    marks = np.flatnonzero(second)
    if len(marks):
        i = np.searchsorted(marks, np.arange(len(hit)))
        gap = np.minimum(
            np.abs(marks[np.minimum(i, len(marks) - 1)] - np.arange(len(hit))), np.abs(marks[np.maximum(i - 1, 0)] - np.arange(len(hit)))
        )
        near = hit & (gap <= 5)
    upper = (data >= 65) & (data <= 90)
    letter = _LETTERS[data] != 0
    digit = (data >= 48) & (data <= 57)
    space = _SPACED[data] == 0
    symbol = ~(letter | digit | space)
    mark = (data == 33) | (data == 63)
    doubled = np.zeros(len(data), bool)
    doubled[1:] = mark[1:] & mark[:-1]
    big = np.cumsum(np.concatenate([[0], upper]))
    length = plain.ends - plain.starts
    capital = (big[plain.ends] - big[plain.starts] == length) & (length > 2)
    soft = np.cumsum(np.concatenate([[0], letter]))
    hard = np.cumsum(np.concatenate([[0], symbol | digit]))
    # Words with symbols or digits strictly inside: both ends letters.
    inner = (hard[spaced.ends] - hard[spaced.starts] > 0) & letter[spaced.starts] & letter[spaced.ends - 1] if len(spaced.starts) else np.zeros(0, bool)
    hidden = _member(folded.hashes, lexicon.folded)
    hidden &= soft[folded.ends] - soft[folded.starts] < folded.ends - folded.starts
    row_of = np.repeat(np.arange(len(n_words)), n_words).astype(np.uint64)
    distinct = np.unique((plain.hashes >> np.uint64(24)) | row_of << np.uint64(40)) >> np.uint64(40)
    n_distinct = np.bincount(distinct.astype(np.int64), minlength=len(n_words))

    def bytes_share(flags: np.ndarray) -> np.ndarray:
        return row_counts(flags, offsets) * per_byte

    def words_share(flags: np.ndarray) -> np.ndarray:
        return row_counts(flags, plain.first) * per_word

    learned = row_counts(weight > 0, plain.first)
    return np.column_stack(
        [
            np.log1p(n_words), row_sums(length.astype(float), plain.first) * per_word,
            words_share(fixed), row_counts(fixed, plain.first),
            learned * per_word, learned, _row_top(weight, plain.first), row_sums(weight, plain.first), words_share(near),
            words_share(second), words_share(stem > 0), row_counts(stem > 0, plain.first), _row_top(stem, plain.first), row_sums(stem, plain.first),
            bytes_share(upper), words_share(capital), bytes_share(data == 33), bytes_share(data == 63), bytes_share(symbol),
            bytes_share(digit), bytes_share(doubled), row_counts(inner, spaced.first) * per_word,
            row_counts(hidden, folded.first) * per_word, n_distinct * per_word,
        ]
    )


class BoostedTrees:
    """Boosting with the logistic loss; every tree is a full binary tree over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        binned, margin = self._bin(x), np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][self._leaves(binned, tree)]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray):
        feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS)
        node, ridge = np.zeros(len(binned), int), 1.0
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-3)
            for f in range(binned.shape[1]):
                slot = (node - first) * BINS + binned[:, f]
                g = np.cumsum(np.bincount(slot, gradient, n * BINS).reshape(n, BINS), 1)
                h = np.cumsum(np.bincount(slot, hessian, n * BINS).reshape(n, BINS), 1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain[(h < 0.5) | (all_h - h < 0.5)] = 0
                at = gain.argmax(1)
                better = gain[np.arange(n), at] > best
                best = np.where(better, gain[np.arange(n), at], best)
                feature[first : first + n] = np.where(better, f, feature[first : first + n])
                cut[first : first + n] = np.where(better, at, cut[first : first + n])
            node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = np.bincount(leaf, gradient, 2**DEPTH) / (np.bincount(leaf, hessian, 2**DEPTH) + ridge)
        return feature, cut, RATE * value

    @staticmethod
    def _leaves(binned: np.ndarray, tree) -> np.ndarray:
        feature, cut, _ = tree
        node, rows = np.zeros(len(binned), int), np.arange(len(binned))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        return node - (2**DEPTH - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + sum(t[2][self._leaves(binned, t)] for t in self.trees)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and non-decreasing probabilities to interpolate between.

    Each end block counts one more row of the other class, so that no score is exactly 0 or 1
    on small evidence.
    """
    blocks: list[list[float]] = []
    for m, v in sorted(zip(margin.tolist(), y.tolist(), strict=True)):
        blocks.append([m, v, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            kept = blocks[-1]
            kept[0] = (kept[0] * kept[2] + last[0] * last[2]) / (kept[2] + last[2])
            kept[1] += last[1]
            kept[2] += last[2]
    at = np.array([b[0] for b in blocks])
    rate = np.array([(b[1] + 0.1) / (b[2] + 0.2) for b in blocks])
    return at, np.maximum.accumulate(rate)


@dataclass
class Model:
    lexicon: Lexicon
    trees: BoostedTrees | None
    knots: np.ndarray
    rates: np.ndarray
    constant: float = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.constant)
        margin = self.trees.margin(features(data, offsets, self.lexicon))
        # A trace of the margin orders texts within one level of the calibration.
        return np.clip(np.interp(margin, self.knots, self.rates) + 1e-6 * np.tanh(margin / 8), 0, 1)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _sample_features(lexicon: Lexicon):
    def rows(batches):
        for batch in batches:
            for low, high, data, offsets in pieces(batch.column("text")):
                x = features(data, offsets, lexicon)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
                part = [batch.column(c).slice(low, high - low) for c in ("toxic", "part")]
                yield pa.RecordBatch.from_arrays([*part, flat], ["toxic", "part", "x"])

    return rows


def _informative(seen: DataFrame, n_toxic: int, n_all: int, most: int) -> dict[bytes, float]:
    """Log odds ratios of the ``most`` words or stems that speak most for label 1."""
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("t"), (F.count(F.lit(1)) - F.sum("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_all - n_toxic + 1.0))
    scored = counts.select("word", odds.alias("odds"), "t").filter((F.col("t") >= 3) & (F.col("odds") > 1.5))
    best = scored.orderBy(F.desc(F.col("t") * F.col("odds")), "word").limit(most).collect()
    return {bytes(r["word"]): r["odds"] for r in best}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit lexicon, trees and calibration on at most ``sample`` labelled rows."""
    ship(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").filter(fold(F.col("doc_id"), 5) != 0)
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Bounded: at most ``sample`` rows of two numbers.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Copies of one text count once, or their words would look like signs of toxicity.
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(4))).persist()

    quarter = rows.filter("part = 0")
    n_toxic, n_all = quarter.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    spelled = F.split(F.lower("text"), r"[^a-z\x80-\x{10ffff}]+")
    spoken = quarter.select("toxic", F.transform(F.array_distinct(spelled), lambda w: w.cast("binary")).alias("words"))
    learned = _informative(spoken.select("toxic", F.explode("words").alias("word")).filter("octet_length(word) > 2"), n_toxic, n_all, LEXICON)
    cut = F.array_distinct(F.transform(F.filter("words", lambda w: F.octet_length(w) >= STEM), lambda w: w.substr(1, STEM)))
    lexicon = Lexicon(learned, _informative(spoken.select("toxic", F.explode(cut).alias("word")), n_toxic, n_all, LEXICON // 2))

    table = rows.filter("part > 0").mapInArrow(_sample_features(lexicon), "toxic int, part long, x array<double>").toPandas()
    rows.unpersist()
    y, part = table["toxic"].to_numpy(float), table["part"].to_numpy(int)
    share = float(y.mean()) if len(y) else float(n_toxic / n_all) if n_all else 0.0
    tree_rows, late_rows = part < 3, part == 3
    if not len(y) or len(np.unique(y[tree_rows])) < 2 or not late_rows.any():
        return Model(lexicon, None, np.zeros(0), np.zeros(0), share)
    x = np.array(table["x"].tolist())
    order = np.lexsort((*x.T, y))  # the result does not depend on the order of arrival
    x, y, tree_rows, late_rows = x[order], y[order], tree_rows[order], late_rows[order]
    trees = BoostedTrees(x[tree_rows], y[tree_rows])
    return Model(lexicon, trees, *isotonic(trees.margin(x[late_rows]), y[late_rows]))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and a last column with the score."""
    # Bounded: a lexicon of LEXICON words and TREES small trees.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def score(batches):
        for batch in batches:
            made = [shared.value.scores(data, offsets) for _, _, data, offsets in pieces(batch.column(at))]
            column = pa.array(np.concatenate([np.zeros(0), *made]))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    scored = with_score(docs.select("doc_id", "text"), learn(docs, labels, sample))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    name = unused("_score", docs)
    return with_score(docs, learn(docs, labels, sample), name).filter(F.col(name) < 0.5).drop(name)
