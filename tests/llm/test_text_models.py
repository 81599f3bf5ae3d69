"""Language model, toxicity and tokens: exact parts by brute force, learned parts on held-out rows."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from fibrelens.llm import bpe_automaton, maxent_lm, toxicity_trees
from fibrelens.llm.queries import VOCABULARY
from tests.llm.corpus_helpers import prose

ODD = [None, "", " \t\n", "A b  c", "x" * 100_000, "word " * 30_000, "\x00\x01 é É"]


def held_out(n, rest):
    return toxicity_trees.fold(F.col("doc_id"), n) == rest


@pytest.mark.parametrize("frequent", [5, 100_000])
def test_base_scores_match_brute_force(docs, frequent):
    rows = [(i, prose(i % 40, 60)) for i in range(80)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(3, prose(3, 60)), (None, "no id")]
    got = maxent_lm.score_texts(docs(rows, "row", "word", "n"), held_out(7, 2), steps=3, frequent=frequent).collect()
    cut = lambda t: (t or "").encode().lower().split() + [None]
    train = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in cut(t))
    n, v = sum(train.values()), len(train)
    expected = Counter()
    for i, t in rows:
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in cut(t))
        expected[i, len(cut(t)), sum(train[w] > 0 for w in cut(t)), n, round(base, 3)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == expected
    assert all(r.score < 0 for r in got)


def test_model_beats_unigrams_on_held_out_texts(docs):
    chance = random.Random(1)
    topics = [[prose(1000 * t + i, 1) for i in range(60)] for t in range(3)]
    rows = [(i, " ".join(chance.choice(topics[i % 3]) for _ in range(80))) for i in range(2500)]
    got = maxent_lm.score_texts(docs(rows), held_out(7, 2)).collect()
    late = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in late) > sum(r.base_score for r in late) + 0.05 * sum(r.n_tokens for r in late)


def test_class_softmax_is_normalised():
    model = maxent_lm.Weights()
    for table in model.tables:
        table += np.random.default_rng(1).normal(size=table.shape)
    assert np.allclose(np.exp(model.log_probabilities(np.arange(500))).sum(1), 1)


def test_language_model_without_training_rows(docs):
    assert maxent_lm.score_texts(docs([]), F.lit(False), steps=1).count() == 0
    row = maxent_lm.score_texts(docs([(1, "a b")]), F.lit(True), steps=1).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_tokens_match_the_library(docs):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    chance = random.Random(2)
    parts = ["a", "b", " ", "\n", "the", "ing", "!", "'s", "'", "é", "0", "12", "<|endoftext|>", "<|", "  ", "\t", "==", "aaaa", "日本", "‍", "😀"]
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(50 + i, "".join(chance.choice(parts) for _ in range(chance.randint(0, 60)))) for i in range(400)] + [(7, "twice"), (7, "twice")]
    got = bpe_automaton.tokenize(docs(rows, "ids", "n_tokens"), VOCABULARY, keep_ids=True).collect()
    assert len(got) == len(rows)
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    for r in got:
        text = texts[r.decoded_sha256]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_every_code_point_is_split_as_the_library_does():
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    automaton = bpe_automaton.TokenAutomaton(bpe_automaton.read_vocabulary(VOCABULARY))
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for low in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)} " for c in points[low : low + 4096])
        ends = list(accumulate(map(len, automaton.words(text))))
        assert ends == [span[1] for _, span in library.pre_tokenize_str(text)], hex(points[low])


def test_every_label_is_its_own_path():
    automaton = bpe_automaton.TokenAutomaton(bpe_automaton.read_vocabulary(VOCABULARY))
    assert len(automaton.number) == 50256
    ids = list(range(0, 50256, 7))
    assert automaton.decode(ids) == b"".join(automaton.labels[i] for i in ids).decode("utf-8", "replace")


def toxic_rows(n, seed):
    chance = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(seed * 10_000 + i, chance.randint(10, 80)).split(), chance.random() < 0.3
        if bad:
            for _ in range(chance.randint(1, 4)):
                words.insert(chance.randrange(len(words)), chance.choice(["you idiot", "moron", "zorbish", "zorbify", "st*pid"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(docs, spark):
    rows, labels = toxic_rows(1500, 3)
    odd = [(9000 + i, t) for i, t in enumerate(ODD)] + [(None, "you moron"), (1, rows[1][1])]
    table = spark.createDataFrame([*labels, (2, 0, None), (None, 1, 1), (0, 0, labels[0][2])], "doc_id long, quality int, toxic int")
    got = toxicity_trees.toxicity(docs(rows + odd, "score", "_score", "part"), table).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    late = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in late)
    assert np.mean([r.predicted == truth[r.doc_id] for r in late]) > 0.97
    frame = docs(rows + odd, "score", "_score", "part")
    clean = toxicity_trees.keep_clean(frame, table)
    assert clean.schema == frame.schema
    assert clean.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity_trees.toxicity(docs([(1, "a"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert toxicity_trees.toxicity(docs([]), none).count() == 0
    one = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity_trees.toxicity(docs([(1, "a")]), one).first().score == 0.0


def test_calibration_does_not_decrease():
    chance = np.random.default_rng(4)
    margin = chance.normal(size=500)
    at, rate = toxicity_trees.isotonic(margin, (chance.random(500) < 1 / (1 + np.exp(-margin))).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(rate) >= 0).all() and 0 < rate[0] and rate[-1] < 1


def test_a_piece_takes_little_memory():
    """Features of long rows of text are made of small pieces, with the same results as in one."""
    import tracemalloc

    import pyarrow as pa

    from fibrelens.llm.bytescan import pieces

    texts = [prose(i, 400) for i in range(1200)]
    lexicon = toxicity_trees.Lexicon({b"market": 1.5}, {})
    whole = [toxicity_trees.features(data, offsets, lexicon) for _, _, data, offsets in pieces(pa.array(texts), 1 << 30)]
    tracemalloc.start()
    parts = [toxicity_trees.features(data, offsets, lexicon) for _, _, data, offsets in pieces(pa.array(texts))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 2 << 20 and len(parts) > 4
    assert peak < 60 << 20
    assert np.allclose(np.vstack(parts), np.vstack(whole), rtol=1e-12)
