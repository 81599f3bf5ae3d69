"""The pipeline against its stages' meaning, stated by brute force."""

import hashlib

import corpus_pipeline
from tests.llm.corpus_helpers import prose
from tests.llm.test_decontamination import brute


def test_each_stage_takes_effect(spark, tmp_path):
    base = [(i, prose(i, 120)) for i in range(60)]
    item = prose(900, 30)
    rows = base + [(100, base[3][1].upper()), (101, base[3][1]), (102, base[5][1].replace(base[5][1].split()[60], "changed", 1))]
    rows += [(103, prose(950, 100) + " " + item + " " + prose(951, 100)), (104, item), (105, None), (106, "")]
    toxic = [(200 + i, prose(400 + i, 40) + " you idiot moron " + prose(700 + i, 10)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + toxic], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i >= 200)) for i, _ in base + toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 3 and 100 are copies of 101, 102 is a near copy of 5, 104 is all benchmark, 105 equals 106.
    expected = {i for i, _ in rows} - {3, 100, 102, 104, 105}
    assert set(got) == expected
    texts = dict(rows)
    same = {i for i in expected if got[i].decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()}
    assert same == expected - {103}
    assert brute([(103, f"{prose(950, 100)}\n{prose(951, 100)}")], [(1, item)])[0][5] is False
