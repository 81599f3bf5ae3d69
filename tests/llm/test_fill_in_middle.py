"""Fill-in-the-middle against slicing in Python, and its round trip."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fibrelens.llm import fill_in_middle
from tests.llm.corpus_helpers import prose

CLASHING = ("n", "form", "output", "_text", "_n", "_cut", "prefix_chars", "a")
TEXTS = [
    None, "", "a", "ab\ncd", "é😀x" * 3, "has <S> mark", "cut<", "<<S", "P>x<", "$1\\2 \r\n\x85  z", "\0 nul",
    "😀" * 50_000, "x\n" * 300_000, prose(1, 200), prose(1, 200), "y" * 255, "y" * 256, "y" * 257,
]


def brute(doc_id, text, marks=("<P>", "<S>", "<M>"), transformed=90, suffix_first=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in marks) or h[2] % 100 >= transformed:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, s, m = (mark + part for mark, part in zip(marks, (text[:a], text[b:], text[a:b])))
    spm = h[3] % 100 < suffix_first
    return n, "spm" if spm else "psm", a, b - a, s + p + m if spm else p + s + m


def rows():
    many = [(100 + i, prose(i, i % 7)) for i in range(300)]
    return [(i, t) for i, t in enumerate(TEXTS)] + many + [(None, "no id"), (3, "ab\ncd"), (3, "other")]


@pytest.mark.parametrize(
    "given", [{}, {"transformed": 100, "suffix_first": 50}, {"transformed": 100, "marks": ("$p\\", "[s", "ä.")}]
)
def test_equals_slicing(docs, given):
    made = fill_in_middle.transform(docs(rows()), **given)
    marks = given.get("marks", fill_in_middle.MARKS)
    got = made.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"), marks)).collect()
    want = sorted(((i, t, *brute(i, t, **given)) for i, t in rows()), key=repr)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == want
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_columns_stay(docs):
    frame = docs(rows()[:5], *CLASHING)
    made = fill_in_middle.transform(frame)
    assert made.columns == [c for c in frame.columns if c not in ("n", "form", "output", "prefix_chars")] + [
        "n", "form", "prefix_chars", "middle_chars", "output",
    ]
    assert all(r._text == r._n == r._cut == r.a == "x" for r in made.collect())


def test_no_shuffle_and_no_python(docs):
    plan = fill_in_middle.transform(docs(rows()[:5]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_bad_marks(docs):
    assert fill_in_middle.transform(docs([])).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.transform(docs([]), marks=("<P>", "<S<", "<M>"))
