"""What the corpus operators leave on disk, shuffle twice or keep in a worker."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from fibrelens.llm import bpe_automaton, extendible_dedup, weighted_minhash
from fibrelens.llm.shared import stored
from tests.llm.corpus_helpers import prose


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("drop", [extendible_dedup.drop_duplicates, weighted_minhash.drop_near_duplicates])
def test_texts_that_stay_are_shuffled_once(docs, no_broadcast, drop):
    texts = [prose(i, 60) for i in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[4] + " x y"), (None, texts[5] + " " + prose(9, 60)), (None, None), (None, None)]
    kept = drop(docs(rows))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("SortMergeJoin")[0]
    assert "Exchange" in plan
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    expected = {(str(i), t or "") for i, t in rows}
    if drop is weighted_minhash.drop_near_duplicates:  # text 4 and its near copy
        expected -= {("4", texts[4])}
    assert got == sorted(expected)


def shuffle_files(spark) -> int:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return manager.getAllBlocks().mkString(" ").count("shuffle_")


def test_a_stored_table_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key)
    table = stored(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    end = time.time() + 10
    while shuffle_files(spark) > before and time.time() < end:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(key) == setting
    assert sorted(r["count"] for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_a_remembered_word_takes_little_memory():
    automaton = bpe_automaton.TokenAutomaton({"ids": {bytes([b]): b for b in range(256)}, "merges": [], "special": {"<end>": 256}})
    chance = random.Random(1)
    text = " ".join("".join(chance.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(20_000))
    tracemalloc.start()
    ids = automaton.encode(text)
    assert ids == list(text.encode()) and automaton.decode(ids) == text
    del ids
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(automaton.paths) > 19_000
    assert held / len(automaton.paths) < 320
    assert automaton.encode_joined("") == ("", []) and automaton.encode_joined("a<end>b") == ("97,256,98", [97, 256, 98])
