"""Fill-in-the-middle rows, cut by a counted-quantifier pattern per row.

A unit is one code point, ``(?s:.)``. ``regexp_count`` gives a text's number n of units: blocks of
256 units first, then the units of what is left, so a long text makes few matches. Two hashes of
the document's id choose the cuts a <= b, each from 0 to n. The row's own pattern

    \\A ( unit{a}+ ) ( unit{b-a}+ ) ( unit*+ ) \\z

has counted possessive groups: each takes its units in one walk and never gives one back, so a match
is linear in the text. One match captures prefix, middle and suffix, and its replacement text puts
them in order with their marks. ``restore`` undoes it, again with one match.

All of it is column functions: no shuffle, no Python worker, nothing kept beyond the row.

Defined cases: a null or empty text is plain and stays the empty text. A text that holds a mark is
plain, since it could not be cut apart again. A null id is hashed as an empty id. Rows that repeat
an id are cut at the same shares of their texts. Cuts may meet or lie at either end, so any part may
be empty. Other columns of any name are not touched. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
UNIT = "(?s:.)"
#: Units that one match takes while counting.
BLOCK = 256
#: Percent of texts that are transformed, and of these that start with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Put before an id when its numbers are drawn.
SEED = "1:"


def units(text: Column) -> Column:
    """Number of code points, counted by matches."""
    block = f"{UNIT}{{{BLOCK}}}+"
    rest = F.regexp_replace(text, F.lit(block), F.lit(""))
    return F.regexp_count(text, F.lit(block)).cast("long") * BLOCK + F.regexp_count(rest, F.lit(UNIT))


def drawn(doc_id: Column, i: int, seed: str = SEED) -> Column:
    """The i-th number of a document, 0 to 2**32 - 1: the i-th 8 digits of a hash of its id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _literal(mark: str) -> str:
    """``mark`` as a replacement text, in which backslash and dollar sign stand for themselves."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def _quoted(mark: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in mark)


def transform(
    docs: DataFrame,
    marks: tuple[str, str, str] = MARKS,
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with n, form ('psm', 'spm' or 'plain'), prefix_chars, middle_chars and output.

    Columns of these names that ``docs`` has already are replaced; all others stay. Of ``marks``,
    each must start with a character that no mark has anywhere else (see ``restore``).
    """
    if any(mark[0] in "".join(m[1:] for m in marks) for mark in marks) or len({*marks}) < 3:
        raise ValueError("marks must differ and start with a character that no mark has further on")
    text, n, cut = (unused(name, docs) for name in ("_text", "_n", "_cut"))
    body = F.col(text)
    h = [drawn(F.col("doc_id"), i, seed) for i in range(4)]
    marked = [F.contains(body, F.lit(mark)) for mark in marks]
    plain = (F.col(n) == 0) | marked[0] | marked[1] | marked[2] | (h[2] % 100 >= transformed)
    ends = [h[i] % (F.col(n) + 1) for i in range(2)]
    counted = docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(n, units(body))
    chosen = counted.withColumn(
        cut,
        F.struct(
            F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm").alias("form"),
            F.least(*ends).alias("a"),
            F.abs(ends[0] - ends[1]).alias("c"),
        ),
    )
    a, c, form = (F.col(f"{cut}.{name}") for name in ("a", "c", "form"))
    groups = [F.concat(F.lit(f"({UNIT}{{"), count.cast("string"), F.lit("}+)")) for count in (a, c)]
    pattern = F.concat(F.lit("\\A"), *groups, F.lit(f"({UNIT}*+)\\z"))
    p, s, m = map(_literal, marks)
    order = F.when(form == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    cut_text = F.when(form == "plain", body).otherwise(F.regexp_replace(body, pattern, order))
    given = {
        "n": F.col(n),
        "form": form,
        "prefix_chars": F.when(form != "plain", a),
        "middle_chars": F.when(form != "plain", c),
        "output": cut_text,
    }
    kept = [f"`{name}`" for name in docs.columns if name.lower() not in given]
    return chosen.select(*kept, *(value.alias(name) for name, value in given.items()))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text out of ``output`` and ``form`` alone.

    The first occurrence of a mark is the one that was put in: the text holds none, and no mark can
    begin inside another, as a mark's first character is nowhere else in a mark. Nor can text before
    a mark begin one that the mark completes, which would need that character inside it.
    """
    p, s, m = map(_quoted, marks)

    def parts(first: str, second: str, order: str) -> Column:
        pattern = f"\\A{first}((?s:.)*?){second}((?s:.)*?){m}((?s:.)*+)\\z"
        return F.regexp_replace(output, F.lit(pattern), F.lit(order))

    return F.when(form == "psm", parts(p, s, "$1$3$2")).when(form == "spm", parts(s, p, "$2$3$1")).otherwise(output)
