"""The automaton against all windows by brute force."""

import hashlib
import random
import re
from collections import Counter

from fibrelens.llm import decontamination
from tests.llm.corpus_helpers import prose


def cut(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = cut(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def fixture():
    chance = random.Random(5)
    tiny = lambda n: " ".join(chance.choice(["a", "b", "c"]) for _ in range(n))
    items = [(1, prose(1, 40)), (2, prose(2, 12)), (3, "Short ITEM here"), (4, None), (5, "..."), (6, prose(1, 40)), (7, tiny(30)), (10, tiny(25))]
    items += [(8, "é À ñ 1 2 3 4 5 6 7 8"), (1, prose(1, 40))]
    docs = [(1, prose(9, 30) + ", " + prose(1, 40) + " " + prose(8, 20)), (2, " ".join(prose(1, 40).split()[5:14])), (3, None), (4, "")]
    docs += [(5, "x short-item, HERE y"), (6, prose(2, 12).upper()), (7, "É é À ñ 1 2 3 4 5 6 7 8"), (8, prose(3, 5000) + " " + prose(2, 12))]
    docs += [(20 + i, tiny(200)) for i in range(20)] + [(7, "twice"), (7, "twice"), (None, prose(2, 12))]
    return docs, items


def test_windows_match_brute_force(docs, spark):
    rows, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (100_000, 45):
        got = decontamination.contamination(docs(rows, "hits", "items"), bench, block_words=block).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, items), key=repr)


def test_spans_go_and_clean_texts_stay(docs, spark):
    rows, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(rows, "hits", "items")
    cleaned = decontamination.remove_spans(frame, bench, max_coverage=0.9)
    assert cleaned.schema == frame.schema
    assert decontamination.contamination(cleaned, bench).filter("contaminated").count() == 0
    clean = {d: t for (d, t), b in zip(rows, brute(rows, items), strict=True) if not b[5]}
    left = {r.doc_id: r.text for r in cleaned.collect()}
    assert all(left[d] == t for d, t in clean.items())
    assert prose(9, 30) in left[1] and left[1].endswith(prose(8, 20)) and 6 not in left


def test_spans_of_several_blocks_go_as_those_of_one(docs, spark):
    rows, items = fixture()
    one, two = prose(60, 40), prose(61, 40)
    rows += [(50, f"{one} {two} {prose(62, 53)}")]
    for doc, outer, inner in ((51, one.split(), two), (52, two.split(), one)):  # a window that only the inner item's removal joins
        rows.append((doc, f"{prose(63, 60)} {' '.join(outer[:6])} {inner} {' '.join(outer[6:12])} {prose(64, 60)}"))
    bench = spark.createDataFrame([*items, (60, one), (61, two)], "item_id long, text string")
    frame = docs(rows, "bits", "state", "text_left")
    whole = decontamination.remove_spans(frame, bench).collect()
    parts = decontamination.remove_spans(frame, bench, block_words=45)
    assert parts.schema == frame.schema
    assert Counter(parts.collect()) == Counter(whole)
    left = {r.doc_id: r.text for r in whole}
    assert 50 not in left and left[51] == left[52] == f"{prose(63, 60)} \n {prose(64, 60)}"


def test_without_items_or_documents(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_words for r in decontamination.contamination(docs([(1, "a b")]), none).collect()] == [2]
    assert decontamination.contamination(docs([]), none).count() == 0
    assert decontamination.remove_spans(docs([(1, "a b")]), none).first().text == "a b"
