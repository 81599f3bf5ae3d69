"""Quality rules judged by host: failures per domain, rates shrunk by an empirical beta prior.

*Measures.* Tasks read every whole text once, one text at a time, and keep a few numbers of it
(``MEASURES``); these are written to the shared folder, and no later step reads a text again.

*Rules.* Each rule is an expression over the numbers. A document that fails a rule of ``BASE``
goes. For all rules the failing documents are counted per host, with a partial step on the map
side, so a host that holds a third of all rows sends one row per map task.

*Prior.* Hosts are taken to draw their failure rates from a beta distribution with mean m and
correlation r of two documents of a host (its two counts are m (1 - r) / r and (1 - m) (1 - r) / r).
Both come from moments over all hosts: m is the share of failing documents, and r follows from the
spread of the hosts' rates beyond what chance alone gives:

    S = sum x^2 / n - N m^2,   r = (S / (m (1 - m)) - (h - 1)) / (N - sum n^2 / N - (h - 1))

for h hosts with n documents of which x fail, N in all. One row of sums per rule comes to the
driver. A host's rate is (m (1 - r) + x r) / (1 - r + n r): a small host stays near the mean, a
large one near its own share. Without spread beyond chance (r = 0) all hosts have the rate m.

*Verdict.* A host whose shrunk rate exceeds the limit for any rule is rejected with all of its
documents. Verdicts are joined back by (host, salt), so a large host's documents are dealt over
several tasks.

Defined cases: null text counts as empty (no words: fails the shortest length). A null or blank
source is no host: such rows are judged by the base rules alone and take no part in the prior.
Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ship, stored

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: Fewest words of a text, and percent of its words that may lie in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of a host's documents that may fail a rule, after shrinking.
LIMIT = 0.5
#: Tasks over which a host's documents are dealt for the join with its verdict.
SALTS = 16
#: Words in a repeated window.
WINDOW = 3

_BASE = {
    "short": f"n_words < {LEAST_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
}
#: Failing conditions by rule; those of _BASE also decide on a document by itself.
RULES = _BASE | {
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside any window of three that occurs twice or more. Windows are compared exactly."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    key = codes[: n - WINDOW + 1]
    for i in range(1, WINDOW):
        # Naming the prefixes anew keeps the product below 2**63 whatever the number of words.
        _, key = np.unique(key, return_inverse=True) if len(ids) >= 1 << 20 else (None, key)
        key = key * len(ids) + codes[i : n - WINDOW + 1 + i]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[at] > 1
    hit = np.zeros(n, bool)
    for i in range(WINDOW):
        hit[i : n - WINDOW + 1 + i] |= again
    return int(hit.sum())


def measures(text: bytes) -> tuple[int, ...]:
    """The numbers of MEASURES of one text in UTF-8."""
    words = text.split()  # at ASCII white space, which is SPACES
    lines = [line for line in text.split(b"\n") if line.strip()]
    points = int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))
    spaces = sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    return len(words), points - spaces, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = np.array([measures(t.as_py() or b"") for t in texts], np.int64).reshape(-1, len(MEASURES))
        columns = [pa.array(found[:, i]) for i in range(len(MEASURES))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *columns], ["doc_id", "host", *MEASURES])


def host_of(source: Column) -> Column:
    """The host within a URL, else the text itself; lower case, without 'www.'; null if blank."""
    name = F.regexp_replace(F.lower(F.trim(source.cast("string"))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(name, r"[/?#].*$", ""), r"^www\.", ""), F.lit(""))


def measured(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, host and MEASURES, one row per row of ``docs``."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{name} long" for name in MEASURES)
    texts = docs.select("doc_id", host_of(F.col(source)).alias("host"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_measure, f"doc_id {kind}, host string, {numbers}")


def host_counts(rows: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """host, n and the number of failing documents per rule."""
    fails = [F.count_if(F.expr(condition)).alias(name) for name, condition in rules.items()]
    return rows.filter("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *fails)


def prior(hosts: DataFrame, rules: dict[str, str] = RULES) -> dict[str, tuple[float, float]]:
    """Mean and correlation of the beta prior per rule."""
    sums = [F.count(F.lit(1)).alias("_hosts"), F.sum("n").alias("_n"), F.sum(F.col("n").cast("double") ** 2).alias("_nn")]
    for name in rules:
        x = F.col(name).cast("double")
        sums += [F.sum(x).alias(f"{name}_x"), F.sum(x * x / F.col("n")).alias(f"{name}_xx")]
    row = hosts.agg(*sums).first()
    return {name: _moments(row._hosts, row._n, row._nn, row[f"{name}_x"], row[f"{name}_xx"]) for name in rules}


def _moments(h: int, n: int | None, nn: float, x: float, xx: float) -> tuple[float, float]:
    if not n:
        return 0.0, 0.0
    m = x / n
    chance, room = m * (1 - m), n - nn / n - (h - 1)
    if chance <= 0 or room <= 0:
        return m, 0.0
    spread = (xx - n * m * m) / chance - (h - 1)
    return m, min(max(spread / room, 0.0), 1.0)


def host_verdicts(
    hosts: DataFrame, found: dict[str, tuple[float, float]], limit: float = LIMIT
) -> DataFrame:
    """host, n, the shrunk rate per rule, and ``host_kept``."""
    rates = {}
    for name, (m, r) in found.items():
        rates[f"{name}_rate"] = (F.lit(m * (1 - r)) + F.col(name) * F.lit(r)) / (F.lit(1 - r) + F.col("n") * F.lit(r))
    shown = hosts.select("host", "n", *(rate.alias(name) for name, rate in rates.items()))
    return shown.withColumn("host_kept", F.greatest(*(F.col(name) for name in rates), F.lit(0.0)) <= limit)


def judge(docs: DataFrame, source: str = "source", limit: float = LIMIT, rules: dict[str, str] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, host, MEASURES, base_failed, host_kept, kept."""
    rows = stored(measured(docs, source), "measures")
    hosts = stored(host_counts(rows, rules), "hosts")
    verdicts = host_verdicts(hosts, prior(hosts, rules), limit).select("host", "host_kept")
    dealt = verdicts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", *MEASURES), F.lit(SALTS)).cast("int"))
    joined = salted.join(dealt, ["host", "_salt"], "left").withColumn("host_kept", F.coalesce("host_kept", F.lit(True)))
    failed = F.expr(" or ".join(f"({condition})" for condition in _BASE.values()))
    kept = joined.withColumn("base_failed", failed)
    return kept.select("doc_id", "host", *MEASURES, "base_failed", "host_kept", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
