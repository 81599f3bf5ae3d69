"""Byte-level BPE by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens; its state is the last token read, and an arc v leaves state t when
the merges leave t and v apart. Compiling goes through the merges in order. The gadget of the
merge x y takes the arcs y away from all states that end in an x not yet consumed, wherever y
starts the following token, and adds the arc xy. Whether an arc is taken away depends only on
the right spine of t and the left spine of v, with the merge rank at which each part of a spine
is consumed, so the gadgets are kept as these spine tables, and an arc's row is filled on first
use. The rule for equal ranks is the leftmost-first order of merging.

A pre-split word has exactly one path through the automaton whose labels spell it. It is found
from left to right: the longest label first, shorter ones after a missing arc, and positions
without a way on are marked dead, so the work is linear in the word for a bounded label length.

Defined cases: a null text counts as empty and gives no tokens. The special tokens of the
vocabulary file are recognised in the text, as the tokenizers library does by default. Words
of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import ship

# Fixed value: the split pattern of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pattern for texts of letters below U+0250, with the classes spelled out.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
# Code points that newer Unicode tables call letters or numbers, but not those of the
# tokenizers library, which leave them unassigned; for the split they are neither.
UNASSIGNED = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_LATER = "".join("-".join(chr(int(c, 16)) for c in span.split("-")) for span in UNASSIGNED.split())
HAS_UNASSIGNED = re.compile(f"[{_LATER}]").search
#: The split for texts with such code points.
PINNED_SPLIT = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{_LATER}]|[^\s\p{{L}}\p{{N}}])").replace(r"\p{L}+", rf"(?:(?![{_LATER}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{_LATER}])\p{{N}})+")
BEYOND_LATIN = re.compile(r"[^\0-\u024f]").search
#: Words whose path a Python worker remembers in each of two generations, each path as one text of decimal ids.
REMEMBERED = 200_000
#: Arcs that a Python worker remembers.
ARCS = 2_000_000
#: Longer words are walked each time.
REMEMBERED_LENGTH = 40


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable bytes stand for themselves,
    the others take the letters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> dict:
    """Tokens, merges and special tokens of a vocabulary file, all as bytes."""
    with open(path, encoding="utf-8") as source:
        content = json.load(source)
    letters = byte_letters()
    as_bytes = lambda word: bytes(letters[c] for c in word)
    model = content["model"]
    special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
    merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
    return {
        "ids": {as_bytes(w): i for w, i in model["vocab"].items() if w not in special},
        "merges": [(as_bytes(x), as_bytes(y)) for x, y in merges],
        "special": special,
    }


class TokenAutomaton:
    def __init__(self, vocabulary: dict):
        self.ids: dict[bytes, int] = vocabulary["ids"]
        self.special: dict[str, int] = vocabulary["special"]
        self.labels: dict[int, bytes] = {i: w for w, i in self.ids.items()}
        self.labels |= {i: w.encode() for w, i in self.special.items()}
        self.never = len(vocabulary["merges"]) + 1
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        # Spines: parts at a token's right (left) end, innermost last, with the rank that consumes them.
        self.right: dict[bytes, list[tuple[bytes, int]]] = {}
        self.left: dict[bytes, list[tuple[bytes, int]]] = {}
        for word in self.ids:
            if len(word) == 1:
                self._add(word, None, 0)
        for rank, (x, y) in enumerate(vocabulary["merges"]):
            self._gadget(x, y, rank)
        self.number = {word: self.ids[word] for word in self.right}
        self.word_of = {i: word for word, i in self.number.items()}
        self.length = {i: len(word) for word, i in self.number.items()}
        self.shorter = {i: self._prefix(word) for word, i in self.number.items()}
        self.trie: dict[int, int] = {}
        self.accepts: list[int] = [-1]
        for word, i in self.number.items():
            self._insert(word, i)
        self.longest = max(map(len, self.number), default=1)
        self.arcs: dict[int, bool] = {}
        self.paths: dict[str, str] = {}
        self.older: dict[str, str] = {}
        cut = "|".join(regex.escape(w) for w in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({cut})") if cut else None
        self.split = regex.compile(SPLIT).findall
        self.pinned_split = regex.compile(PINNED_SPLIT).findall
        self.latin_split = re.compile(LATIN_SPLIT).findall

    def _add(self, word: bytes, parts: tuple[bytes, bytes] | None, rank: int) -> None:
        end = [(word, self.never)]
        self.right[word] = end + ([s if s[1] <= rank else (s[0], rank) for s in self.right[parts[1]]] if parts else [])
        self.left[word] = end + ([s if s[1] <= rank else (s[0], rank) for s in self.left[parts[0]]] if parts else [])

    def _gadget(self, x: bytes, y: bytes, rank: int) -> None:
        """Add the arc xy, and let the pair x y take part in blocking arcs from here on."""
        if (x, y) in self.ranks or x not in self.right or y not in self.left:
            return
        # A label whose own parts an earlier merge would tear apart is never produced.
        reachable = x + y not in self.right and not self._blocked(x, y, rank)
        self.ranks[x, y] = rank
        if reachable:
            self._add(x + y, (x, y), rank)

    def _blocked(self, t: bytes, v: bytes, before: int) -> bool:
        ranks = self.ranks
        for x, x_gone in self.right[t]:
            for y, y_gone in self.left[v]:
                k = ranks.get((x, y))
                if k is not None and k < before and k < x_gone and k <= y_gone:
                    return True
        return False

    def _prefix(self, word: bytes) -> int | None:
        for n in range(len(word) - 1, 0, -1):
            if word[:n] in self.number:
                return self.number[word[:n]]
        return None

    def _insert(self, word: bytes, label: int) -> None:
        node = 0
        for byte in word:
            step = node << 8 | byte
            node = self.trie.get(step, 0)
            if not node:
                node = self.trie[step] = len(self.accepts)
                self.accepts.append(-1)
        self.accepts[node] = label

    def _longest_label(self, word: bytes, at: int) -> int:
        step, accepts, node, label = self.trie.get, self.accepts, 0, -1
        for byte in word[at : at + self.longest] if at or len(word) > self.longest else word:
            node = step(node << 8 | byte)
            if node is None:
                break
            if accepts[node] >= 0:
                label = accepts[node]
        return label

    def _fill(self, t: int, v: int) -> bool:
        if len(self.arcs) > ARCS:
            self.arcs.clear()
        known = self.arcs[t << 20 | v] = not self._blocked(self.word_of[t], self.word_of[v], self.never)
        return known

    def arc(self, t: int, v: int) -> bool:
        """Whether the automaton has the arc v in state t."""
        known = self.arcs.get(t << 20 | v)
        return self._fill(t, v) if known is None else known

    def walk(self, word: bytes) -> list[int]:
        """The labels of the word's path, as ids."""
        if word in self.number:
            return [self.number[word]]
        length, n = self.length, len(word)
        path: list[int] = []
        dead: set[int] = set()
        at, label = 0, self._longest_label(word, 0)
        while True:
            end = at + length[label]
            if end not in dead and (not path or self.arc(path[-1], label)):
                path.append(label)
                if end == n:
                    return path
                at, label = end, self._longest_label(word, end)
                continue
            while (shorter := self.shorter[label]) is None:
                dead.add(at)
                label = path.pop()
                at -= length[label]
            label = shorter

    def _path(self, word: str) -> str:
        found = self.older.get(word)
        if found is None:
            found = ",".join(map(str, self.walk(word.encode())))
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.paths) >= REMEMBERED:
                self.older, self.paths = self.paths, {}
            self.paths[word] = found
        return found

    def words(self, text: str) -> list[str]:
        """The pre-split words of a text without special tokens."""
        if not BEYOND_LATIN(text):
            return self.latin_split(text)
        return self.pinned_split(text) if HAS_UNASSIGNED(text) else self.split(text)

    def _paths(self, text: str) -> Iterable[str]:
        known, path = self.paths.get, self._path
        parts = self.cut.split(text) if self.cut and any(w in text for w in self.special) else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield str(self.special[part])
            else:
                yield from [known(w) or path(w) for w in self.words(part)]

    def encode(self, text: str) -> list[int]:
        return self.encode_joined(text)[1]

    def encode_joined(self, text: str) -> tuple[str, list[int]]:
        """Decimal ids joined by commas, and the ids."""
        joined = ",".join(self._paths(text))
        return joined, list(map(int, joined.split(","))) if joined else []

    def decode(self, ids: Iterable[int]) -> str:
        """Emit the arc labels; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class Compiled:
    """A vocabulary that each Python worker compiles once."""

    def __init__(self, vocabulary: dict):
        self.vocabulary = vocabulary
        self.key = hashlib.sha256(repr(sorted(vocabulary.items())).encode()).hexdigest()

    def automaton(self) -> TokenAutomaton:
        if self.key not in _compiled:
            _compiled.clear()
            _compiled[self.key] = TokenAutomaton(self.vocabulary)
        return _compiled[self.key]


_compiled: dict[str, TokenAutomaton] = {}


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tokenize(docs: DataFrame, vocabulary_path: str, keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids``
    also the ids and the decoded text."""
    spark = docs.sparkSession
    ship(spark)
    # Bounded: one vocabulary file, about 1.5 MB of merges and ids.
    shared = spark.sparkContext.broadcast(Compiled(read_vocabulary(vocabulary_path)))
    fields = [
        docs.schema["doc_id"],
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def encode(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            rows = []
            for value in batch.column(1):
                joined, ids = automaton.encode_joined(value.as_py() or "")
                decoded = automaton.decode(ids)
                rows.append((len(ids), _sha(joined), _sha(decoded), *((ids, decoded) if keep_ids else ())))
            columns = list(zip(*rows, strict=True)) or [()] * (len(fields) - 1)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], [f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(encode, T.StructType(fields))
