"""Host-level quality rules against plain Python."""

import re

import pytest

from fibrelens.llm import host_rules
from tests.llm.corpus_helpers import prose


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines), dup, len(hit)


TEXTS = [
    None, "", " \n\t\r\x0b\x0c ", "one", "a b c", "a b c a b c", "a a a a", "a a a", "A b c a b c",
    "x y\nx y\n\n\nx  y\nx y\r\nx y\r", "é 😀 ü é 😀 ü", "non\xa0break word line \x1c \x85 end", "##$$ <b> & | % *",
    "\0 a \0 a \0 a", prose(1, 60), f"{prose(2, 40)} {prose(2, 40)}", f"{prose(3, 25)}\n" * 6, "w" * 5000,
]


def test_measures_match_brute_force():
    for text in TEXTS:
        assert host_rules.measures((text or "").encode()) == brute(text), text


def test_many_different_words_are_named_anew(monkeypatch):
    words = [b"%d" % (i % 1_100_000) for i in range(1_100_010)]
    assert host_rules.repeated_words(words) == 20
    assert host_rules.repeated_words(words[:1_100_000]) == 0


def expected(rows, limit=host_rules.LIMIT):
    """doc_id -> kept, by the stated formulas."""
    fails, hosts = [], {}
    for _, text, host in rows:
        n_words, chars, symbols, n_lines, dup, rep = brute(text)
        fail = [n_words < 50, rep * 100 > n_words * 50, symbols * 10 > n_words, dup * 10 > n_lines * 3, not 2 * n_words <= chars <= 12 * n_words]
        fails.append(fail)
        if host:
            hosts.setdefault(host, []).append(fail)
    total = sum(map(len, hosts.values()))
    worst = dict.fromkeys(hosts, 0.0)
    for k in range(5):
        counts = {h: (len(f), sum(x[k] for x in f)) for h, f in hosts.items()}
        m = sum(x for _, x in counts.values()) / max(total, 1)
        room = total - sum(n * n for n, _ in counts.values()) / max(total, 1) - (len(hosts) - 1)
        r = 0.0
        if 0 < m < 1 and room > 0:
            spread = sum(n * (x / n - m) ** 2 for n, x in counts.values())
            r = min(max((spread / (m * (1 - m)) - (len(hosts) - 1)) / room, 0), 1)
        for h, (n, x) in counts.items():
            worst[h] = max(worst[h], (m * (1 - r) + x * r) / (1 - r + n * r))
    return [not (f[0] or f[1]) and worst.get(host, 0.0) <= limit for f, (_, _, host) in zip(fails, rows)], worst


def good(i):
    return prose(i, 60)


def corpus():
    """A hot host, a few of usual quality, one of junk with some good texts, one of two rows only."""
    rows = [(i, good(i) if i % 10 else "short", "hot.example") for i in range(120)]
    rows += [(1000 + i, good(i) if i % 8 else None, f"host{i % 5}.example") for i in range(120)]
    rows += [(2000 + i, good(i) if i % 9 == 0 else f"{prose(i, 20)}\n" * 4, "junk.example") for i in range(60)]
    rows += [(3000, "short", "tiny.example"), (3001, good(1), "tiny.example"), (3002, good(2), None), (3003, "short", None)]
    return rows + [(None, good(3), "hot.example"), (5, good(5), "hot.example"), (5, good(5), "hot.example")]


def frame(spark, rows, *extra):
    ddl = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
    return spark.createDataFrame([(i, t, "en", h, 0, *("x" for _ in extra)) for i, t, h in rows], ddl)


def test_verdicts_match_the_formulas(spark):
    rows = corpus()
    kept, worst = expected(rows)
    got = host_rules.judge(frame(spark, rows, "host", "n", "_salt", "kept", "n_words")).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted((str(i), k) for (i, _, _), k in zip(rows, kept))
    assert worst["junk.example"] > 0.5 > worst["tiny.example"]
    assert not any(r.kept for r in got if r.host == "junk.example")
    # A host of two rows, one of them bad, is pulled towards the mean; rows without a host stand alone.
    assert {r.doc_id: r.kept for r in got if r.doc_id in (3001, 3002, 3003)} == {3001: True, 3002: True, 3003: False}


def test_rates_are_shrunk_towards_the_mean(spark):
    rows = host_rules.measured(frame(spark, corpus()))
    hosts = host_rules.host_counts(rows)
    found = host_rules.prior(hosts)
    verdicts = {r.host: r for r in host_rules.host_verdicts(hosts, found).collect()}
    mean = found["short"][0]
    assert mean < verdicts["tiny.example"].short_rate < 0.5
    assert 0 < found["short"][1] < 1 == found["repetitive"][1]


def test_host_of(spark):
    names = {
        "src0": "src0", " SRC0 ": "src0", "https://www.A.example/x?y": "a.example", "http://b.example": "b.example",
        "www.c.example/#z": "c.example", "": None, "  ": None, None: None, "ftp://d:21/x": "d:21",
    }
    rows = spark.createDataFrame([(s,) for s in names], "s string")
    got = rows.select("s", host_rules.host_of(rows.s).alias("h")).collect()
    assert {r.s: r.h for r in got} == names


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, None, "a")], [(1, good(1), "a")]])
def test_small_tables(spark, rows):
    got = host_rules.judge(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == [(i, bool(t)) for i, t, _ in rows]
