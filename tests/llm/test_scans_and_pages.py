"""Secrets, archives, chats and web pages."""

import base64
import gzip
import hashlib
import html
import itertools
import json
import random
import re
import string
import time
from collections import Counter

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from fibrelens.llm import chat_roles, page_differencing, randomness_tests, warc_normaliser
from fibrelens.llm.shared import new_path
from tests.llm.corpus_helpers import prose

PATTERNS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return sorted(found)


def test_pattern_spans_match_brute_force(docs):
    chance = random.Random(8)
    parts = ["password", "PassWD", "token", "api_key", "apikey", "=", ":", " ", '"', "abc", "abcdef1", "AKIA", "AKIA" + "Z9" * 9, "0a1b2c3d" * 3, "é😀", "\n", "secret"]
    rows = [(i, "".join(chance.choice(parts) for _ in range(chance.randint(0, 40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "password=token:abcdefgh"), (903, "x" * 50_000 + " token: 'abcdef'"), (903, "x"), (903, "x")]
    got = randomness_tests.secret_report(docs(rows, "base", "spans", "_whole")).collect()
    expected = Counter()
    for i, text in rows:
        spans = base_spans(text)
        joined = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in spans)
        n = Counter(k for _, k, _ in spans)
        expected[i, n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == expected


def test_random_tokens_are_told_from_words(docs):
    chance = random.Random(9)
    letters = string.ascii_letters + string.digits
    rows, planted = [], {}
    for i in range(200):
        secret = "".join(chance.choice(letters) for _ in range(40))
        long_word = "".join(prose(7000 + i, 12).split())[:36]
        rows.append((i, f"{prose(i, 10)} {long_word} then {secret} and {'abc123' * 6} end"))
        planted[i] = secret
    hits = other = 0
    for r in randomness_tests.secret_report(docs(rows)).collect():
        text = dict(rows)[r.doc_id]
        for span in filter(lambda s: s.startswith("random"), r.spans.split(",")):
            _, s, e = span.split(":")
            hits += text[int(s) : int(e)] == planted[r.doc_id]
            other += text[int(s) : int(e)] != planted[r.doc_id]
    assert hits >= 180 and other <= 10


def test_secrets_of_an_empty_table(docs):
    assert randomness_tests.secret_report(docs([])).count() == 0


PAGE_DDL = "page_id long, url string, html string, digest string, size string"


def page_rows():
    rows = [(i, f"http://h.example/{i}", f"<p>{prose(i % 7, 30)}") for i in range(40)]
    rows += [(50, None, None), (51, "u\r\nX: y", ""), (None, "n", "only"), (None, "n", "only"), (60, "q", "é" * 50_000), (61, "q", "é" * 50_000), (3, "again", rows[3][2])]
    return [(*r, "d", "s") for r in rows]


@pytest.mark.parametrize("least", [0, 100])
def test_archives_give_back_every_page(spark, least):
    rows = page_rows()
    got = warc_normaliser.round_trip(spark.createDataFrame(rows, PAGE_DDL), least).collect()
    expected = Counter()
    for page_id, _, page, *_ in rows:
        payload = (page or "").encode()
        first = min((p for p, _, x, *_ in rows if (x or "").encode() == payload and p is not None), default=None)
        refers = first if len(payload) >= least and first is not None and first != page_id else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected[page_id, len(payload), digest, "response" if refers is None else "revisit", refers] += 1
    assert Counter(tuple(r) for r in got) == expected


def test_index_points_at_members(spark):
    made = warc_normaliser.normalise(warc_normaliser.write_archives(spark.createDataFrame(page_rows(), PAGE_DDL)))
    files, _ = pyarrow.fs.FileSystem.from_uri(new_path(spark, "x"))
    seen = 0
    for row in made.collect():
        data = files.open_input_file(row["path"]).read()
        for line in files.open_input_file(row["index"]).read().splitlines():
            entry = json.loads(line)
            whole = gzip.decompress(data[entry["offset"] : entry["offset"] + entry["length"]])
            assert whole.startswith(b"WARC/1.1\r\nWARC-Type: " + entry["type"].encode())
            seen += 1
    assert seen == len(page_rows())


def test_records_are_read_in_small_pieces():
    whole = b"".join(warc_normaliser.record(str(i), "u", b"x\r\n\r\ny" * i, "D", 6 * i, None) for i in range(30))
    for step in (1, 7, 100_000):
        parts = iter([whole[i : i + step] for i in range(0, len(whole), step)])
        assert b"".join(r for _, r in warc_normaliser.read_records(parts)) == whole
    with pytest.raises(ValueError):
        list(warc_normaliser.read_records(iter([whole[:-40]])))


def test_archives_of_an_empty_table(spark):
    assert warc_normaliser.round_trip(spark.createDataFrame([], PAGE_DDL)).count() == 0


def test_articles_are_whole():
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li>m</ul></nav>
    <div class="ad-banner">buy <div>now</div></div><article><h1>A &amp; B</h1><p>one<br>two <b>three</b>
    <script>if (a < b) "</p>"</script><!-- <p>no</p> --><aside>side</aside><p title="x > y">caf&eacute; &#x41;
    <form><p>mail</p></form><section class="comments"><p>reader</p></section><ul><li>x<li>y</ul></article><footer>f</footer></body>"""
    zones, texts = zip(*page_differencing.lines(page), strict=True)
    assert page_differencing.main_text(list(zones), list(texts), []) == "A & B\n\none two three\n\ncafé A\n\nx\n\ny"


def test_shared_lines_of_neighbours_go(spark):
    page = "<body><p>Site line</p><div><p>{}</p></div><p>Site line</p><p>Imprint</p></body>"
    rows = [(i, f"http://Host.example/a/{i}", page.format(f"own text {i}")) for i in range(6)]
    rows += [(10, None, None), (11, "no url", "<p>alone"), (12, "http://h/1", page.format("x")), (13, "http://h/1?q", page.format("x"))]
    rows += [(20, "http://k/1", "<article><p>Shared article</article>"), (21, "http://k/2", "<article><p>Shared article</article>"), (20, "http://k/1", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS path", "'z' AS text")
    got = sorted((r.page_id, r.text, r.n_chars) for r in page_differencing.extract_main_text(frame).collect())
    want = [(i, f"own text {i}", 10) for i in range(6)] + [(10, "", 0), (11, "alone", 5)]
    whole = "Site line\n\nx\n\nSite line\n\nImprint"
    want += [(12, whole, len(whole)), (13, whole, len(whole)), (20, "", 0), (20, "Shared article", 14), (21, "Shared article", 14)]
    assert got == want


def by_neighbours(rows):
    """Main texts by definition: the last page of the path before and the first one of the path after."""
    cut, order = {}, {}
    for page_id, url, page, salt in rows:
        host, path = re.fullmatch(r"\w+://([^/]*)([^?]*).*", url).groups()
        cut[salt] = [list(x) for x in zip(*page_differencing.lines(page), strict=True)]
        order.setdefault((host, path), []).append((salt, page_id))
    keys, out = sorted(order), []
    for k, key in enumerate(keys):
        near = [max(order[keys[k - 1]])[0]] if k and keys[k - 1][0] == key[0] else []
        near += [min(order[keys[k + 1]])[0]] if k + 1 < len(keys) and keys[k + 1][0] == key[0] else []
        out += [(page_id, page_differencing.main_text(*cut[salt], [cut[n] for n in near])) for salt, page_id in order[key]]
    return sorted(out)


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_ranges_do_not_change_neighbours(spark, ranges):
    page = "<p>Site {}</p><p>own {}</p><p>Top {}</p>"
    rows = [(i, f"http://big.example/{i % 90:03d}", page.format(i % 90 // 2, i, (i % 90 + 1) // 2)) for i in range(180)]
    rows += [(1000 + i, f"http://big.example/045?{i}", page.format(22, 1000 + i, 23)) for i in range(300)]
    rows += [(2000 + i, f"http://h{i}.example/a", page.format(1, i, 1)) for i in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    rows = [tuple(r) for r in frame.select("*", F.xxhash64("page_id", "url", "html")).collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = sorted((r.page_id, r.text) for r in page_differencing.extract_main_text(frame).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == by_neighbours(rows)
    assert all(text == f"own {i}" for i, text in got if 1000 <= i < 2000)


def test_template_lines_within_articles_go(spark):
    page = "<nav>m</nav><article><p>Share this story</p><p>{}</p><p>Read our terms</p></article>"
    rows = [(i, f"http://a.example/{i}", page.format(prose(i, 20))) for i in range(5)]
    rows += [(10 + i, f"http://b.example/{i}", page.format(prose(50, 20))) for i in range(3)]
    rows += [(20, "http://c.example/1", page.format(prose(60, 20))), (21, "http://c.example/2", f"<article><p>{prose(61, 20)}<p>Read our terms</article>")]
    rows += [(22, "http://c.example/3", f"<article><p>{prose(62, 20)}</article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_differencing.extract_main_text(frame).collect()}
    assert all(got[i] == prose(i, 20) for i in range(5))
    assert all(got[10 + i] == f"Share this story\n\n{prose(50, 20)}\n\nRead our terms" for i in range(3))
    assert got[20] == f"Share this story\n\n{prose(60, 20)}"
    assert got[21] == f"{prose(61, 20)}\n\nRead our terms" and got[22] == prose(62, 20)


def test_shared_lines_are_a_longest_common_subsequence():
    chance = random.Random(3)
    for _ in range(200):
        a = [str(x) for x in chance.sample(range(12), 8)]
        b = [str(x) for x in chance.sample(range(12), 8)]
        table = [[0] * 9 for _ in range(9)]
        for i in range(8):
            for j in range(8):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = page_differencing.shared_lines(a, b)
        kept, at = [a[i] for i in sorted(found)], 0
        assert len(found) == table[8][8]
        for line in kept:
            at = b.index(line, at) + 1


def test_very_long_pages():
    page = "<article>" + "<p>line &lt;" * 50_000
    assert page_differencing.main_text(*map(list, zip(*page_differencing.lines(page), strict=True)), []).count("line <") == 50_000
    assert html.unescape("&lt;") == "<"


def chats(n):
    chance, rows = random.Random(6), []
    for c in range(n):
        roles = ["system"] * (c % 3 == 0) + ["user", "assistant"] * 3
        for t, role in enumerate(roles):
            size = {"system": 8, "user": 15, "assistant": 80}[role]
            text = prose(31 * c + t, size) + ("?" if role == "user" and chance.random() < 0.7 else ".")
            rows.append((c, t, role, text))
    return rows


def test_roles_are_recovered_without_markers(spark):
    rows = chats(120)
    masked = [(c, t, None if c % 4 == 0 and t % 2 else role, text) for c, t, role, text in rows]
    got = chat_roles.canonical_turns(spark.createDataFrame(masked, "conv_id long, turn long, role string, text string"))
    truth = {(c, t): role for c, t, role, _ in rows}
    out = got.collect()
    assert len(out) == len(rows)
    assert sum(r.role == truth[r.conv_id, r.turn] for r in out) / len(out) > 0.98
    assert sum(r.recovered_role == truth[r.conv_id, r.turn] for r in out) / len(out) > 0.9


def test_markers_within_a_text_open_turns(spark):
    rows = [*chats(30), (900, 0, "human", "hello\n**Assistant:** hi there\nsecond line\nUser: bye"), (901, None, None, None), (None, 1, "bot", "x"), (902, 1, "user", "a"), (902, 1, "user", "a")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string")
    got = [r for r in chat_roles.canonical_turns(frame).collect() if r.conv_id not in range(30)]
    parts = sorted((r.part, r.role, r.rendered) for r in got if r.conv_id == 900)
    assert parts == [
        (0, "user", "<|user|>\nhello\n<|end|>"),
        (1, "assistant", "<|assistant|>\nhi there\nsecond line\n<|end|>"),
        (2, "user", "<|user|>\nbye\n<|end|>"),
    ]
    assert sum(r.conv_id == 902 for r in got) == 1 and sum(r.conv_id == 901 for r in got) == 1
    assert [r.role for r in got if r.conv_id is None] == ["assistant"]


def long_chats():
    """One long conversation with few marks, one of null turns only, and short ones around them."""
    chance, rows = random.Random(8), []
    for t in range(230):
        role = ("user", "assistant")[t % 2]
        rows.append((7, t, role if t == 0 or chance.random() < 0.1 else None, prose(t, 12 + 40 * (t % 2)) + ("?" if t % 2 == 0 else ".")))
    rows += [(8, None, None, prose(1000 + t, 20)) for t in range(150)] + [(None, t, "user" if t % 2 == 0 else None, prose(t, 9)) for t in range(90)]
    return rows + chats(20)


def worths(spark, rows):
    """Log probability of the roles found, with markers and without, per conversation. (Roles of equal
    probability may be told apart by rounding; every row here is one line.)"""
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model, found, out = chat_roles.learn(frame), {}, {}
    for r in chat_roles.canonical_turns(frame).collect():
        found.setdefault(r.conv_id, {})[r.turn, r.rendered.split("\n")[1]] = (r.role, r.recovered_role)
    for conv in found:
        own = sorted({r for r in rows if r[0] == conv}, key=lambda r: (r[1] or 0, r[2] or "", r[3]))
        assert len(own) == len(found[conv])
        states = [tuple(2 * chat_roles.ROLES.index(x) for x in found[conv][r[1], r[3]]) for r in own]
        lines = chat_roles._Lines([{"role": r[2], "text": r[3]} for r in own])
        for k, scores in enumerate(lines.scores(model)):
            path = [s[k] for s in states]
            steps = sum(model.step[a, b] for a, b in zip(path, path[1:]))
            out[conv, k] = round(float(model.start[path[0]] + steps + sum(scores[i, s] for i, s in enumerate(path))), 6)
    return out


def test_blocks_and_ranges_do_not_change_the_best_path(spark, monkeypatch):
    rows = long_chats()
    monkeypatch.setattr(chat_roles, "BLOCK", 1000)
    whole = worths(spark, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for block in (2, 5, 64):
            monkeypatch.setattr(chat_roles, "BLOCK", block)
            spark.conf.set("spark.sql.shuffle.partitions", str(3 + block % 7))
            assert worths(spark, rows) == whole, block
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_marker_reaches_over_any_number_of_blocks(spark):
    """Only the first turn is marked; the alternation learned elsewhere tells all others."""
    same = lambda t: prose(t, 15) + "."
    rows = [(c, t, ("user", "assistant")[t % 2], same(100 * c + t)) for c in range(40) for t in range(4)]
    rows += [(99, t, "assistant" if t == 0 else None, same(9000 + t)) for t in range(192)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [r for r in chat_roles.canonical_turns(frame).collect() if r.conv_id == 99]
    assert all(r.role == ("assistant", "user")[r.turn % 2] for r in got)


def test_viterbi_is_the_best_of_all_paths():
    chance = random.Random(3)
    counts = {("step", a, b): chance.randint(0, 9) for a in range(3) for b in range(3)}
    counts |= {("seen", a, c): chance.randint(0, 9) for a in range(3) for c in range(chat_roles.CATEGORIES)}
    counts |= {("start", a, 0): a + 1 for a in range(3)} | {("lines", a, k): 3 + a + k for a in range(3) for k in range(2)}
    model = chat_roles.Model(counts)
    for _ in range(12):
        n = 5
        firsts = [True, *(chance.random() < 0.5 for _ in range(n - 1))]
        scores = model.scores([chance.choice((-1, -1, 0, 1, 2)) for _ in range(n)], [chance.randrange(chat_roles.CATEGORIES) for _ in range(n)], firsts)

        def worth(path):
            steps = sum(model.step[a, b] for a, b in zip(path, path[1:]))
            return model.start[path[0]] + steps + sum(scores[i, s] for i, s in enumerate(path))

        best = max(map(worth, itertools.product(range(chat_roles.STATES), repeat=n)))
        assert abs(worth(model.viterbi(scores)) - best) < 1e-6
        cuts = [scores[:2], scores[2:3], scores[3:]]
        parts = [model.transfer(cut) for cut in cuts]
        joined = [s for cut, ends in zip(cuts, model.borders(parts)) for s in model.viterbi(cut, *ends)]
        assert abs(worth(joined) - best) < 1e-6
        assert np.allclose(model.combined(parts), model.transfer(scores))


def test_odd_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_roles.canonical_turns(empty).count() == 0
    rows = [(1, 1, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "a"), (2, None, "bot", None), (2, None, "bot", ""), (3, 5, "system", "x" * 300_000)]
    got = chat_roles.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.role, len(r.rendered)) for r in got if r.conv_id != 3) == [(1, "user", 18), (1, "user", 18), (2, "assistant", 22), (2, "assistant", 22)]
    assert [len(r.rendered) for r in got if r.conv_id == 3] == [300_000 + 19]


@pytest.mark.parametrize(
    "page, want",
    [
        ('<body class="has-sidebar"><article><p>One.</p><p>Two.</p></article></body>', ["One.", "Two."]),
        ('<div class="content with-sidebar"><article><p>One.</p></article><div class="site-sidebar">x</div></div>', ["One."]),
        ('<div class="sidebar-layout"><main><p>One.</p></main></div>', ["One."]),
        ('<article class="post related"><p>One.</p></article>', ["One."]),
        ('<article><p>See <span class="search-term">menus</span> here.</p></article>', ["See menus here."]),
        ('<article><p>One.</p><article class="comment"><p>No.</p></article><div class="share-bar">No.</div></article>', ["One."]),
        ('<div class="sidebar"><article class="card">No.</article></div><article><p>One.</p></article>', ["One."]),
        ("<article><p>One.</p><!-- never closed <p>No.</p>", ["One."]),
        ("<article><p>One.</p><svg/><p>Two.</p><script>no()", ["One.", "Two."]),
        ("<article><p>One &lt; two <b", ["One < two <b"]),
    ],
)
def test_articles_survive_names_of_elements_around_them(page, want):
    assert [text for zone, text in page_differencing.lines(page) if zone == page_differencing.ARTICLE] == want


def test_raw_elements_are_scanned_once():
    for page in ("<svg " * 200_000, "<article><p>a</p>" + "<svg>" * 200_000, "<!--" * 200_000, "<p>" + "<svg " * 200_000):
        start = time.perf_counter()
        page_differencing.lines(page)
        assert time.perf_counter() - start < 2
