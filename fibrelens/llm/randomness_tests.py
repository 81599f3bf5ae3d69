"""Secret scans: fixed patterns, and a randomness test battery for what has no fixed form.

Candidates are runs of at least 20 characters of the base64 alphabets. For each, the encoding is
inferred (the smallest alphabet that holds all its characters), and three tests ask whether it
looks drawn at random from that alphabet:

- chi-squared uniformity of the characters,
- the runs test of characters in the lower and upper half of the alphabet,
- the serial correlation of neighbouring characters.

Fisher's rule combines the three p-values. A token is reported when its combined p-value reaches
the threshold of its length band. The threshold controls the false discovery rate: ordinary
tokens, which hold letters only, serve as decoys; in each band it is the least value at which
the decoys that pass are at most a share Q of the tokens with digits that pass. Short tokens,
on which the tests have little power, so face a stricter threshold than long ones, and tokens
below 80 bits of capacity are left out. Histograms of fixed size decide the thresholds, so no
task sees all candidates.

Only DataFrame functions are used; a text is processed whole, in its own row.

Defined cases: null counts as empty and has no spans. Spans count code points, end exclusive,
and are ordered by start, then kind (assign, access, hex, random). A candidate that overlaps a
pattern's span is not reported again. Without candidates there are no random spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

KINDS = ("assign", "access", "hex", "random")
#: Share of false discoveries aimed at.
Q = 0.05
LEAST_LENGTH, LEAST_BITS, BINS = 20, 80, 50

# The three patterns. A failing match of `assign` uses up its characters; runs of
# the other two are maximal, so their least lengths are part of the pattern.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}"

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the smallest alphabet to the largest; the last holds every candidate.
ENCODINGS = [
    ("[0-9a-f]+", _DIGITS + "abcdef"),
    ("[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("[A-Z2-7]+=*", _UPPER + "234567"),
    ("[0-9a-z]+", _DIGITS + _LOWER),
    ("[0-9A-Z]+", _DIGITS + _UPPER),
    ("[0-9A-Za-z]+", _DIGITS + _UPPER + _LOWER),
    ("[0-9A-Za-z+/]+=*", _UPPER + _LOWER + _DIGITS + "+/"),
    (".*", _UPPER + _LOWER + _DIGITS + "-_+/="),
]


def _places(text: Column, pattern: str, matches: Column) -> Column:
    """Start and end of each match: what lies between the matches gives their distances."""
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("own")))
    nothing = F.lit(0).cast("int")
    start = F.struct(nothing.alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + x["own"]
        return F.struct(e.alias("at"), F.concat(acc["found"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("found"))

    walked = F.aggregate(steps, start, step, lambda acc: acc["found"])
    return F.when(F.size(matches) > 0, walked).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, within 1e-7 (a rational approximation for z >= 0)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _battery(token: Column, alphabet: Column) -> Column:
    """(p, bits): combined p-value of a token, and its capacity in bits.

    Sums over the characters are taken in one pass each; a token is at most as long as its text.
    """
    bare = F.rtrim(token, F.lit("="))
    k = F.char_length(alphabet).cast("double")

    def stats(values: Column) -> Column:
        n = F.size(values).cast("double")
        start = F.struct(
            F.lit(-1).alias("last"), F.lit(0).alias("runs"), F.lit(0).alias("high"),
            F.lit(0.0).alias("sum"), F.lit(0.0).alias("square"), F.lit(0.0).alias("cross"), F.lit(0.0).alias("ends"),
        )

        def step(a: Column, v: Column) -> Column:
            up = (v >= k / 2).cast("int")
            changed = (a["last"] < 0) | ((a["last"] >= k / 2).cast("int") != up)
            x = v.cast("double")
            return F.struct(
                v.alias("last"), (a["runs"] + changed.cast("int")).alias("runs"), (a["high"] + up).alias("high"),
                (a["sum"] + x).alias("sum"), (a["square"] + x * x).alias("square"),
                (a["cross"] + F.when(a["last"] >= 0, a["last"] * x).otherwise(0.0)).alias("cross"),
                F.when(a["last"] < 0, x).otherwise(a["ends"]).alias("ends"),
            )

        def finish(a: Column) -> Column:
            mean = a["sum"] / n
            spread = F.greatest(a["square"] - n * mean * mean, F.lit(1e-9))
            linked = a["cross"] - mean * (2 * a["sum"] - a["ends"] - a["last"]) + (n - 1) * mean * mean
            z_serial = (linked / spread + 1 / n) * F.sqrt(n)
            high = a["high"].cast("double")
            pairs = 2 * high * (n - high)
            variance = F.greatest(pairs * (pairs - n) / (n * n * F.greatest(n - 1, F.lit(1.0))), F.lit(1e-9))
            z_runs = (a["runs"] - (pairs / n + 1)) / F.sqrt(variance)
            return F.struct(z_serial.alias("serial"), z_runs.alias("runs"))

        return F.aggregate(values, start, step, finish)

    def judged(values: Column) -> Column:
        n = F.size(values).cast("double")
        counts = F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda w: w == v)).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        z_even = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * F.greatest(n - 1, F.lit(1.0)) / n)

        def fisher(s: Column) -> Column:
            floor = F.lit(1e-300)
            tails = [_upper_tail(z_even), 2 * _upper_tail(F.abs(s["runs"])), 2 * _upper_tail(F.abs(s["serial"]))]
            half = sum((-F.log(F.greatest(t, floor)) for t in tails[1:]), -F.log(F.greatest(tails[0], floor)))
            return F.struct(
                F.least(F.exp(-half) * (1 + half + half * half / 2), F.lit(1.0)).alias("p"), (n * F.log2(k)).alias("bits")
            )

        return _let(stats(values), fisher)

    places = F.transform(F.split(bare, ""), lambda c: (F.instr(alphabet, c) - 1).cast("int"))
    return _let(places, judged)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _alphabet(token: Column) -> Column:
    chosen = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        chosen = F.when(token.rlike(f"^(?:{pattern})$"), F.lit(letters)).otherwise(chosen)
    return chosen


def find_spans(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` but the text, and ``base`` and ``tokens``: the pattern spans
    (s, kind, e) and the judged candidates (s, e, n, p, decoy)."""
    others = [c for c in docs.columns if c != "text"]
    text = F.col("_whole")
    rows = docs.select(*others, F.coalesce("text", F.lit("")).alias("_whole"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": CANDIDATE}
    rows = rows.select("*", *(F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in patterns.items()))
    values = F.when(F.size("_assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)))
    rows = rows.select("*", values.alias("_values"), *(_places(text, p, F.col(f"_{k}")).alias(f"_{k}_at") for k, p in patterns.items()))

    def spans(places: Column, kind: int) -> Column:
        return F.transform(places, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))

    long_enough = F.filter(F.arrays_zip(F.col("_assign_at").alias("at"), F.coalesce("_values", F.array().cast("array<string>")).alias("v")), lambda x: F.char_length(x["v"]) >= 6)
    assign = F.transform(long_enough, lambda x: x["at"])
    base = F.array_sort(F.concat(spans(assign, 0), spans(F.col("_access_at"), 1), spans(F.col("_hex_at"), 2)))
    rows = rows.select(*others, base.alias("base"), "_token", "_token_at")

    def judge(x: Column) -> Column:
        token, at = x["t"], x["at"]

        def keep(alphabet: Column) -> Column:
            return _let(
                _battery(token, alphabet),
                lambda b: F.struct(
                    at["s"].alias("s"), at["e"].alias("e"), (at["e"] - at["s"]).alias("n"), b["p"].alias("p"), b["bits"].alias("bits"),
                    (~token.rlike("[0-9]")).alias("decoy"), (~token.rlike("[A-Za-z]")).alias("numeric"),
                ),
            )

        return _let(_alphabet(token), keep)

    def free(x: Column) -> Column:
        return ~F.exists("base", lambda b: (b["s"] < x["at"]["e"]) & (b["e"] > x["at"]["s"])) & x["t"].rlike("[^=_+/-]")

    open_tokens = F.filter(F.arrays_zip(F.col("_token").alias("t"), F.col("_token_at").alias("at")), free)
    rows = rows.select(*others, "base", open_tokens.alias("_open"))
    judged = F.filter(F.transform("_open", judge), lambda x: (x["bits"] >= LEAST_BITS) & ~x["numeric"])
    return rows.select(*others, "base", judged.alias("tokens"))


def band(length: Column) -> Column:
    """Length band: thirds of a doubling."""
    return F.floor(F.log2(length.cast("double")) * 3).cast("int")


def thresholds(found: DataFrame, q: float = Q) -> dict[int, int]:
    """Least p-value bin that passes, per length band that has one. At most BINS rows per band."""
    x = F.col("x")
    bins = F.least(F.floor(x["p"] * BINS), F.lit(BINS - 1)).cast("int")
    counts = found.select(F.explode("tokens").alias("x")).groupBy(band(x["n"]).alias("band"), bins.alias("bin"))
    table: dict[int, list[tuple[int, int, int]]] = {}
    for row in counts.agg(F.sum(x["decoy"].cast("int")).alias("decoys"), F.count(F.lit(1)).alias("all")).collect():
        table.setdefault(row["band"], []).append((row["bin"], row["decoys"], row["all"] - row["decoys"]))
    least = {}
    for which, rows in table.items():
        decoys = targets = 0
        for at, d, t in sorted(rows, reverse=True):
            decoys, targets = decoys + d, targets + t
            if targets and decoys <= q * targets and at > 0:
                least[which] = at
    return least


def secret_spans(docs: DataFrame, q: float = Q) -> DataFrame:
    """All columns of ``docs`` but the text, with ``base`` and ``spans``: arrays of (s, kind, e)."""
    others = [c for c in docs.columns if c != "text"]
    found = stored(find_spans(docs), "secret-spans")
    least = thresholds(found, q)
    limits = F.create_map(*(F.lit(x) for pair in least.items() for x in pair)) if least else F.create_map().cast("map<int,int>")

    def passes(x: Column) -> Column:
        limit = F.try_element_at(limits, band(x["n"]))
        return ~x["decoy"] & F.coalesce(F.floor(x["p"] * BINS) >= limit, F.lit(False))

    added = F.transform(F.filter("tokens", passes), lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("kind"), x["e"].alias("e")))
    return found.select(*others, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["s"], x["e"])), ",")


def secret_report(docs: DataFrame, q: float = Q) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secret_spans(docs.select("doc_id", "text"), q)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
