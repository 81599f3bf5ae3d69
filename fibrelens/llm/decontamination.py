"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words become one automaton; a document's words are streamed through it, and the
length of the longest match that ends at each word is tracked. A span is hit where a match
reaches the window length, or covers a whole item that is shorter. Hit spans are removed; a
document whose hit share exceeds the coverage limit goes as a whole.

An automaton holds a block of items with a bounded number of words. More items than one block
holds are answered block by block: a fixed query set against all rows. A single item longer
than a block is cut into overlapping parts, which keeps every window.

Words that no item holds cannot be in a match, so only runs of known words are streamed; runs
too short for any window are skipped without loss.

Defined cases: null or empty texts have no words and are clean. Items without words are
ignored. Repeated items (equal item_id) count once. Rows keep all their columns, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import ALNUM_WORDS, pieces, row_counts, words
from .shared import ship, stored, unused

WINDOW = 10
#: Item words per automaton: about 100 MB in a Python worker.
BLOCK_WORDS = 100_000
#: A document goes when more than this share of its words is hit.
MAX_COVERAGE = 0.5
#: States of a document while spans are removed.
FRESH, CHANGED, SETTLED, DROPPED = range(4)

_ITEM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_words(text: str | None) -> list[bytes]:
    return _ITEM_WORD.findall((text or "").encode().lower())


class SuffixAutomaton:
    """All substrings of several word sequences. ``items[s]`` names the items that hold a window
    which state s represents; ``short[s]`` lists the lengths of whole short items ending there."""

    def __init__(self, sequences: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str, int]] = []
        for name, sequence in sequences:
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if at + 1 >= window:
                    ends.append((last, name, window))
            if 0 < len(sequence) < window:
                ends.append((last, name, len(sequence)))
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        for state, name, n in ends:
            state = self._shrink(state, n)
            if n == window:
                self.windows.setdefault(state, set()).add(name)
            else:
                held = self.short.setdefault(state, [])
                for length, names in held:
                    if length == n:
                        names.add(name)
                        break
                else:
                    held.append((n, {name}))
        self.least = min((n for _, _, n in ends), default=window)

    def _extend(self, last: int, word: int) -> int:
        """Append a word after the state ``last``; returns the state of the longer sequence."""
        following = self.next[last].get(word)
        if following is not None:
            return following if self.length[following] == self.length[last] + 1 else self._split(last, word, following)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, word, target)
        return new

    def _state(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        """Give the shorter sequences of ``target`` that come through ``at`` a state of their own."""
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _shrink(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a sequence that ends in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, run: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end position, length, items) of every window that ends within ``run``."""
        state = matched = 0
        for at, word in enumerate(run):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= self.window:
                state_of = self._shrink(state, self.window)
                if names := self.windows.get(state_of):
                    yield at + 1, self.window, names
            if self.short:
                up = state
                while up > 0:
                    for length, names in self.short.get(up, ()):
                        if length <= matched:
                            yield at + 1, length, names
                    up = self.link[up]


class Block(NamedTuple):
    """Items of one automaton, which every Python worker builds once."""

    key: str
    sequences: list[tuple[str, list[bytes]]]
    window: int

    def automaton(self) -> SuffixAutomaton:
        if self.key not in _built:
            if len(_built) >= 2:
                _built.clear()
            _built[self.key] = SuffixAutomaton(self.sequences, self.window)
        return _built[self.key]


_built: dict[str, SuffixAutomaton] = {}


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items in blocks of at most ``block_words`` words; at least one block, if an empty one."""
    held: list[tuple[str, list[bytes]]] = []
    count, full = 0, 0
    for row in benchmark.select("item_id", "text").distinct().toLocalIterator():
        sequence = item_words(row["text"])
        for at in range(0, max(1, len(sequence) - window + 1), block_words - window + 1):
            part = sequence[at : at + block_words]
            if held and count + len(part) > block_words:
                yield Block(uuid.uuid4().hex, held, window)
                held, count, full = [], 0, full + 1
            if part:
                held.append((str(row["item_id"]), part))
                count += len(part)
    if held or not full:
        yield Block(uuid.uuid4().hex, held, window)


class _Scan:
    """Hit flags and items of the texts of a column."""

    def __init__(self, automaton: SuffixAutomaton):
        known, self.automaton = list(automaton.vocabulary), automaton
        joined = np.frombuffer(b"".join(known), np.uint8)
        bounds = np.cumsum([0, *map(len, known)])
        hashes = words(joined, bounds, ALNUM_WORDS).hashes
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.sorted = known

    def column(self, column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray, object, np.ndarray, dict[int, set[str]]]]:
        """Per piece: first row, row after the last, bytes, offsets, words, hit flags, items per row."""
        for low, high, data, offsets in pieces(column):
            found = words(data, offsets, ALNUM_WORDS)
            flags = np.zeros(len(found.hashes), bool)
            items: dict[int, set[str]] = {}
            if len(self.hashes) and len(flags):
                near = np.minimum(np.searchsorted(self.hashes, found.hashes), len(self.hashes) - 1)
                known = self.hashes[near] == found.hashes
                cut = np.zeros(len(flags) + 1, bool)
                cut[found.first] = True
                begins, stops = known.copy(), known.copy()
                begins[1:] &= ~known[:-1] | cut[1:-1]
                stops[:-1] &= ~known[1:] | cut[1:-1]
                begin, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                for i, j in zip(*(x[stop - begin >= self.automaton.least].tolist() for x in (begin, stop)), strict=True):
                    run = [self._exact(found, k, int(self.ids[near[k]])) for k in range(i, j)]
                    for end, n, names in self.automaton.hits(run):
                        flags[i + end - n : i + end] = True
                        items.setdefault(int(np.searchsorted(found.first, i, "right")) - 1, set()).update(names)
            yield low, high, data, offsets, found, flags, items

    def _exact(self, found, k: int, word: int) -> int:
        """The word's number, after comparing its bytes, or -1."""
        return word if self.sorted[word] == found.data[found.starts[k] : found.ends[k]].tobytes() else -1


def _report(block: Block):
    def scan(batches):
        scanner = _Scan(block.automaton())
        for batch in batches:
            ids = batch.column(0)
            for low, high, _, _, found, flags, items in scanner.column(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, high - low),
                        pa.array(np.diff(found.first), pa.int64()),
                        pa.array(row_counts(flags, found.first), pa.int64()),
                        pa.array([sorted(items.get(i, ())) for i in range(high - low)], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "n_hit", "items"],
                )

    return scan


def _digest(batches):
    for batch in batches:
        rows = batch.to_pydict()
        names = [sorted(set(x)) for x in rows["items"]]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                batch.column("n_hit"),
                pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                pa.array([n > 0 for n in rows["n_hit"]]),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    With several blocks the documents carry their hit flags from one block to the next, so a
    word that two blocks hit counts once.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = list(blocks(benchmark, window, block_words))
    counts = f"doc_id {id_type}, n_words long, n_hit long, items array<string>"
    out = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    docs = docs.select("doc_id", "text")
    if len(found) == 1:
        return docs.mapInArrow(_report(found[0]), counts).mapInArrow(_digest, out)
    for block in found:
        docs = _marked(docs, block)
    return docs.mapInArrow(_count_marks, counts).mapInArrow(_digest, out)


def _marked(docs: DataFrame, block: Block) -> DataFrame:
    """Add one block's hits: ``hits`` holds a bit per word, ``items`` the items so far."""
    fields = [f for f in docs.schema if f.name not in ("hits", "items")]
    schema = T.StructType([*fields, T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])

    def scan(batches):
        scanner = _Scan(block.automaton())
        for batch in batches:
            earlier = batch.schema.names
            for low, high, _, _, found, flags, items in scanner.column(batch.column("text")):
                part = batch.slice(low, high - low)
                old_bits = part.column("hits").to_pylist() if "hits" in earlier else [None] * (high - low)
                old_items = part.column("items").to_pylist() if "items" in earlier else [[]] * (high - low)
                bits, names = [], []
                for i in range(high - low):
                    own = flags[found.first[i] : found.first[i + 1]]
                    if old_bits[i] is not None:
                        own = own | np.unpackbits(np.frombuffer(old_bits[i], np.uint8), count=len(own)).astype(bool)
                    bits.append(np.packbits(own).tobytes())
                    names.append(sorted({*old_items[i], *items.get(i, ())}))
                kept = [part.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))], [f.name for f in schema]
                )

    return docs.mapInArrow(scan, schema)


def _count_marks(batches):
    for batch in batches:
        for low, high, data, offsets in pieces(batch.column("text")):
            found = words(data, offsets, ALNUM_WORDS)
            bits = batch.column("hits").slice(low, high - low).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low),
                    pa.array(np.diff(found.first), pa.int64()),
                    pa.array([int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in bits], pa.int64()),
                    batch.column("items").slice(low, high - low),
                ],
                ["doc_id", "n_words", "n_hit", "items"],
            )


def clean_text(data: bytes, found, flags: np.ndarray, base: int = 0) -> str:
    """The text without its hit spans; each span and what lies between its words becomes a line end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    out, at = [], 0
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        out.append(data[at : found[0][first] - base])
        at = found[1][last - 1] - base
    out.append(data[at:])
    return b"\n".join(out).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without their contaminated spans, clean ones unchanged, with the same columns.

    ``text`` loses every hit word, and ``n_chars`` (if there) follows it. Removal is repeated
    until no window of any item is left. A document with a hit share above ``max_coverage`` is
    dropped; the share counts the hits of all blocks in the text as it came.
    """
    spark = docs.sparkSession
    ship(spark)
    found = list(blocks(benchmark, window, block_words))
    if len(found) == 1:
        return docs.mapInArrow(_removal(found[0], max_coverage, docs.columns.index("text"), docs.columns), docs.schema)
    text, left, state = (unused(name, docs) for name in ("text_left", "bits", "state"))
    rows = docs.withColumn(text, F.col("text")).withColumn(state, F.lit(FRESH))
    done = None
    while True:
        for block in found:
            rows = _flagged(rows, block, text, left)
        rows = stored(rows.mapInArrow(_cut_marks(text, left, state, max_coverage), rows.drop(left).schema), "spans")
        over = rows.filter(F.col(state) == SETTLED)
        done = over if done is None else done.union(over)
        rows = rows.filter(F.col(state) == CHANGED)
        if rows.isEmpty():
            break
    fields = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        same = F.col("text").eqNullSafe(F.col(text))
        fields["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.char_length(text).cast(kind))
    return done.select(*(fields.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def _flagged(docs: DataFrame, block: Block, text: str, bits: str) -> DataFrame:
    """Add one block's hits in ``text`` to ``bits``, a bit per word, or null as long as none is hit."""
    names = [c for c in docs.columns if c != bits]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(bits, T.BinaryType())])

    def scan(batches):
        scanner = _Scan(block.automaton())
        for batch in batches:
            for low, high, _, _, found, flags, items in scanner.column(batch.column(text)):
                part = batch.slice(low, high - low)
                marks = part.column(bits).to_pylist() if bits in batch.schema.names else [None] * (high - low)
                for i in items:
                    own = flags[found.first[i] : found.first[i + 1]]
                    if marks[i] is not None:
                        own = own | np.unpackbits(np.frombuffer(marks[i], np.uint8), count=len(own)).astype(bool)
                    marks[i] = np.packbits(own).tobytes()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(marks, pa.binary())], [*names, bits])

    return docs.mapInArrow(scan, schema)


def _cut_marks(text: str, bits: str, state: str, max_coverage: float):
    """Cut the marked words. Fresh documents above the coverage go; the state tells which changed."""

    def scan(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c != bits]
            for low, high, data, offsets in pieces(batch.column(text)):
                part = batch.slice(low, high - low)
                found = words(data, offsets, ALNUM_WORDS)
                texts, states = part.column(text).to_pylist(), part.column(state).to_pylist()
                for row, mark in enumerate(part.column(bits).to_pylist()):
                    if mark is None:
                        states[row] = SETTLED
                        continue
                    i, j = found.first[row], found.first[row + 1]
                    own = np.unpackbits(np.frombuffer(mark, np.uint8), count=j - i).astype(bool)
                    if states[row] == FRESH and own.mean() > max_coverage:
                        states[row] = DROPPED
                        continue
                    raw = data[offsets[row] : offsets[row + 1]].tobytes()
                    texts[row] = clean_text(raw, (found.starts[i:j], found.ends[i:j]), own, offsets[row])
                    states[row] = CHANGED
                new = {text: pa.array(texts, part.column(text).type), state: pa.array(states, part.column(state).type)}
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in names], names)

    return scan


def _removal(block: Block, max_coverage: float, text_at: int, names: list[str]):
    def scan(batches):
        scanner = _Scan(block.automaton())
        for batch in batches:
            for low, high, data, offsets, found, flags, items in scanner.column(batch.column(text_at)):
                part = batch.slice(low, high - low)
                if not items:
                    yield part
                    continue
                texts, keep = part.column(text_at).to_pylist(), np.ones(high - low, bool)
                for row in items:
                    i, j = found.first[row], found.first[row + 1]
                    own = flags[i:j]
                    if own.mean() > max_coverage:
                        keep[row] = False
                        continue
                    raw = data[offsets[row] : offsets[row + 1]].tobytes()
                    text = clean_text(raw, (found.starts[i:j], found.ends[i:j]), own, offsets[row])
                    while (again := next(scanner.column(pa.array([text]))))[6]:
                        text = clean_text(text.encode(), (again[4].starts, again[4].ends), again[5])
                    texts[row] = text
                columns = list(part.columns)
                columns[text_at] = pa.array(texts, part.schema.field(text_at).type)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    own = columns[at].to_pylist()
                    for row in items:
                        own[row] = len(texts[row] or "")
                    columns[at] = pa.array(own, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))

    return scan
