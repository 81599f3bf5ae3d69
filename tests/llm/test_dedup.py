"""Exact and near de-duplication against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fibrelens.llm import extendible_dedup, weighted_minhash
from tests.llm.corpus_helpers import prose

CLASHING = ("row", "h", "norm", "bucket", "slot", "key", "node", "label", "_key", "_doc", "_own", "samples")


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def exact_rows():
    texts = [None, "", "Same TEXT", "same text", "SAME text", "É", "é", "x" * 200_000, "X" * 200_000, prose(1, 50)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "same text"), (20, "alone"), (20, "alone"), (20, "other")]


def test_exact_groups_match_brute_force(docs):
    rows = exact_rows()
    for capacity in (1, 3, 1000):
        got = extendible_dedup.find_duplicates(docs(rows, *CLASHING), capacity=capacity, max_depth=6).collect()
        assert len(got) == len(rows)
        for r in got:
            group = [(i, t) for i, t in rows if hashlib.sha256(lowered(t).encode()).hexdigest() == r.text_sha256]
            assert r.group_size == len(group)
            assert r.keep_id == max((i for i, _ in group if i is not None), default=None)
        kept = [r for r in got if r.kept]
        assert len(kept) == len({r.text_sha256 for r in got})
        assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_stage_keeps_one_row_per_text(docs):
    frame = docs(exact_rows(), *CLASHING)
    kept = extendible_dedup.drop_duplicates(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    assert sorted(lowered(r.text) for r in rows) == sorted({lowered(t) for _, t in exact_rows()})
    assert {r.doc_id for r in rows if lowered(r.text) == "same text"} == {4}


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"))
    slots = extendible_dedup.directory(keys, capacity=100, max_depth=8).collect()
    assert {r.depth for r in slots} <= {5, 6, 7} and len({r.bucket for r in slots}) > 30
    one = extendible_dedup.directory(keys, capacity=5000, max_depth=8).collect()
    assert {r.depth for r in one} == {0} and len({r.bucket for r in one}) == 1


def test_exact_of_an_empty_table(docs):
    assert extendible_dedup.find_duplicates(docs([])).count() == 0
    assert extendible_dedup.drop_duplicates(docs([])).count() == 0


def bag(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def near_rows():
    rows = []
    for g in range(6):
        base = prose(g, 400).split()
        rows.append((100 * g, " ".join(base)))
        for k in range(1, 9):
            words = list(base)
            for e in range(1 + k % 3):
                words[(37 * k + 61 * e) % 200] = f"edit{g}x{k}x{e}"
            rows.append((100 * g + k, " ".join(words)))
    chain = prose(77, 320).split()
    for k in range(6):  # neighbours are similar, the ends are not
        rows.append((2000 + k, " ".join(chain[18 * k : 18 * k + 220])))
    rows += [(3000 + i, "the same opening line of every note " + prose(500 + i, 12)) for i in range(40)]
    return rows + [(4000, None), (4001, ""), (4002, "!!!"), (4003, "two words"), (4004, "Two, words"), (None, prose(0, 400)), (5, rows[5][1]), (5, rows[5][1])]


def test_near_classes_match_brute_force(docs):
    rows = near_rows()
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            total = sum(bags[i].values()) + sum(bags[j].values()) - shared
            assert not total or not 0.77 < shared / total < 0.83, "the fixture has no borderline pairs"
            if total and shared / total >= 0.8:
                parent[find(i)] = find(j)
    expected = Counter()
    for i in range(len(rows)):
        group = [j for j in range(len(rows)) if find(j) == find(i)]
        smallest = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        expected[rows[i][0], smallest, len(group)] += 1
    got = weighted_minhash.near_duplicates(docs(rows, *CLASHING)).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == expected
    kept = weighted_minhash.drop_near_duplicates(docs(rows, *CLASHING))
    assert kept.count() == len({find(i) for i in range(len(rows))})


def test_samples_agree_with_the_weighted_similarity():
    rows, n = [], 3000
    a = np.arange(1, 400, dtype=np.uint64)
    b = np.arange(80, 500, dtype=np.uint64)
    weight = lambda k: 0.8 + 0.2 * (k.astype(float) % 7) / 7
    for keys in (a, b):
        order = np.argsort(keys)
        rows.append([s[0] for s in weighted_minhash.samples(np.zeros(len(keys), int), keys[order], weight(keys[order]), n)])
    agree = np.mean(np.array(rows[0]) == np.array(rows[1]))
    shared, either = weight(np.intersect1d(a, b)).sum(), weight(np.union1d(a, b)).sum()
    assert abs(agree - shared / either) < 0.03


def test_packed_bags_have_the_similarity_of_their_counts():
    draw = np.random.default_rng(5)
    table = np.linspace(0.8, 1, weighted_minhash.FREQUENCIES).astype(np.float32)
    left, right = ([np.sort(draw.integers(0, 40, n) << 26).astype(np.uint32) for n in sizes] for sizes in ((60, 0, 5, 0), (50, 7, 0, 0)))
    right[0][:] = np.sort(np.append(left[0][:45], right[0][:5]))
    lists = [pa.array([x.view(np.int32).tolist() for x in side], pa.list_(pa.int32())) for side in (left, right)]
    for low, n in ((0, 4), (1, 3)):  # also parts of a batch
        sides = [weighted_minhash._unpacked(side.slice(low, n)) for side in lists]
        got = weighted_minhash.weighted_jaccard(*sides, n, table)
        for k in range(n):
            a, b = Counter(left[low + k].tolist()), Counter(right[low + k].tolist())
            weight = lambda c: sum(m * table[weighted_minhash.frequency_slot(np.array([x], np.uint64))[0]] for x, m in c.items())
            either = weight(a | b)
            assert abs(got[k] - (weight(a & b) / either if either else 0)) < 1e-6


def test_few_pairs_at_the_threshold_are_dropped_by_their_samples():
    least = weighted_minhash.least_agreement(0.8)
    n = weighted_minhash.BANDS * weighted_minhash.ROWS
    below = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least))
    assert 0 < below <= weighted_minhash.MISSED
    assert weighted_minhash.least_agreement(1.0) == n


@pytest.mark.parametrize("others", [1, 30])
def test_a_pair_that_shares_one_bucket_with_other_texts_is_compared(docs, spark, others):
    base = prose(8000, 300).split()
    texts = [" ".join(base), " ".join([*base[:-1], "changed"]), *(prose(8100 + i, 300) for i in range(others))]
    frame = docs(list(enumerate(texts)))
    data = [t.encode() for t in texts]
    nodes = weighted_minhash.bags(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))[3].view(np.int64).tolist()
    n, rows = weighted_minhash.BANDS * weighted_minhash.ROWS, []
    for i, node in enumerate(nodes):  # all in the bucket of the first band; the pair agrees in no other band
        side = [j if j < 3 or (i < 2 and j % 3) else 1000 * (i + 1) + j for j in range(n)]
        rows.append((i, 0, node, side, 296.0))
    signed = spark.createDataFrame(rows, "doc_id long, text_key long, node long, samples array<long>, total double")
    weights = spark.sparkContext.broadcast(np.ones(weighted_minhash.FREQUENCIES, np.float32))
    labels = weighted_minhash.near_duplicate_links(frame, signed, weights, 0.8)
    assert {tuple(r) for r in labels.collect()} == {(node, min(nodes[:2])) for node in nodes[:2]}


def test_later_links_merge_components(spark):
    frame = lambda *pairs: spark.createDataFrame(list(pairs), "a long, b long")
    labels = weighted_minhash._merged(None, frame((1, 2), (3, 4), (4, 5), (7, 8)))
    assert {tuple(r) for r in labels.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (7, 7), (8, 7)}
    more = weighted_minhash._merged(labels, frame((2, 5), (8, 9), (20, 21), (1, 2)))
    found = {r["node"]: r["label"] for r in more.collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}
    assert more.count() == 10
    assert weighted_minhash._merged(more, frame((4, 1))).count() == 10


def test_near_of_an_empty_table(docs):
    assert weighted_minhash.near_duplicates(docs([])).count() == 0
    assert weighted_minhash.drop_near_duplicates(docs([(1, None), (2, None)])).count() == 2


@pytest.mark.parametrize("step", [3, 4096])
def test_block_similarities_equal_those_of_single_pairs(monkeypatch, step):
    monkeypatch.setattr(weighted_minhash, "STEP", step)
    draw = np.random.default_rng(6)
    table = np.linspace(0.8, 1, weighted_minhash.FREQUENCIES).astype(np.float32)
    sides = [[np.sort(draw.integers(0, 30, n) << 27).astype(np.uint32) for n in sizes] for sizes in ((40, 0, 7, 25), (30, 60, 1))]
    left, right = (pa.array([x.view(np.int32).tolist() for x in side], pa.list_(pa.int32())) for side in sides)
    got = weighted_minhash.similarities(left, right, table)
    weight = lambda c: sum(m * table[weighted_minhash.frequency_slot(np.array([x], np.uint64))[0]] for x, m in c.items())
    for i, x in enumerate(sides[0]):
        for j, y in enumerate(sides[1]):
            a, b = Counter(x.tolist()), Counter(y.tolist())
            either = weight(a | b)
            assert abs(got[i, j] - (weight(a & b) / either if either else 0)) < 1e-6


def hot_group():
    """Texts around one base, so heavily edited that most pairs lie on either side of the threshold."""
    base, chance, rows = prose(9000, 160).split(), np.random.default_rng(7), []
    for k in range(120):
        words = list(base)
        for at in chance.choice(160, size=int(chance.integers(1, 9)), replace=False):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
    return rows


def test_hot_buckets_lose_no_link(docs, monkeypatch):
    """Pairs between 0.75 and 0.85 are the rule here; blocks are small, so many are compared."""
    monkeypatch.setattr(weighted_minhash, "BLOCK_NODES", 7)
    rows = hot_group()
    frame = docs(rows)
    table = weighted_minhash.occurrence_weights(frame)
    data = [t.encode() for _, t in rows]
    at, keys, counts, _ = weighted_minhash.bags(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    bags_of = pa.array([np.repeat(keys[at == i] & 0xFFFFFFFF, counts[at == i]).astype(np.uint32).view(np.int32).tolist() for i in range(len(rows))], pa.list_(pa.int32()))
    bags_of = pa.array([sorted(x, key=lambda v: v & 0xFFFFFFFF) for x in bags_of.to_pylist()], pa.list_(pa.int32()))
    alike = weighted_minhash.similarities(bags_of, bags_of, table)
    near = (alike >= 0.8) & ~np.eye(len(rows), dtype=bool)
    assert ((alike > 0.8) & (alike < 0.85)).sum() > 200 and ((alike > 0.75) & (alike < 0.8)).sum() > 200
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_duplicates(frame).collect()}
    assert len(set(label)) > 3
    assert got == dict(enumerate(label))
