"""Operator 13, fill-in-middle transformation by counted quantifiers.

``regexp_count`` gives a text's units.  Hashes of its id choose the two cuts
``a <= b``, and a pattern made for the row, ``(unit{a}+)(unit{b-a}+)(rest)``,
captures prefix, middle and suffix in one match; the replacement puts them in
the order of the row's form.  The counted groups are possessive: the regular
expression engine runs through the units in a loop and never goes back into
one, so a text of a million lines needs neither stack nor retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle; a unit is a line with its end.
MARKS = ("<P>", "<S>", "<M>")
LINE = r"[^\n]*\n|[^\n]+"


def _check_marks(marks: tuple[str, str, str]) -> None:
    """A mark's first character occurs nowhere else in the marks, so no mark can arise where a text
    without marks meets one."""
    for m in marks:
        if not m or any(m[0] in other[1:] for other in marks):
            raise ValueError("a mark's first character may start marks only")
    if any(x != y and x.startswith(y) for x in marks for y in marks) or len(set(marks)) < 3:
        raise ValueError("no mark may start with another one")


def _plain(s: str) -> str:
    """``s`` as a replacement without references."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def id_hash(id_: Column, seed: int, part: int) -> Column:
    """The ``part``-th (from 1) group of eight hex digits of sha256("seed:id") as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * part - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7,
                   rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n, form, prefix_chars, middle_chars, output.

    * ``unit``: a pattern whose matches follow one another from the start of any text; ``n`` counts them.
      Characters behind the last unit belong to the suffix.
    * Cuts lie after the smaller and the larger of h1 % (n + 1) and h2 % (n + 1) units.
    * ``form``: ``plain`` (the text unchanged, lengths null) if the text is empty or holds a mark, or if
      h3 % 100 >= ``rate``; else ``spm`` if h4 % 100 < ``spm``, else ``psm``.
    * A null text counts as empty; a null id is hashed as an empty one; rows that share an id share the
      hashes.  An empty table gives an empty result.  Other columns are not read.

    Scale: a narrow plan without a shuffle; each row costs one count and one match.
    """
    _check_marks(marks)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h = [id_hash(F.col("doc_id"), seed, i) for i in (1, 2, 3, 4)]
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    d = d.withColumn("n", F.regexp_count("text", F.lit(unit)).cast("long"))
    d = d.withColumn("form", F.when((F.length("text") == 0) | marked | (h[2] % 100 >= rate), "plain")
                     .when(h[3] % 100 < spm, "spm").otherwise("psm"))
    x, y = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    d = d.withColumn("a", F.least(x, y)).withColumn("b", F.greatest(x, y))
    pattern = F.format_string(rf"(?s)\A((?:{unit.replace('%', '%%')}){{%d}}+)((?:{unit.replace('%', '%%')}){{%d}}+)(.*)\z",
                              F.col("a"), F.col("b") - F.col("a"))
    p, s, m = map(_plain, marks)
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    d = d.withColumn("output", F.when(F.col("form") == "plain", F.col("text"))
                     .otherwise(F.regexp_replace("text", pattern, order)))
    prefix, middle, _ = parts(F.col("output"), F.col("form"), marks)
    return d.select("doc_id", "text", "n", "form", F.length(prefix).cast("long").alias("prefix_chars"),
                    F.length(middle).cast("long").alias("middle_chars"), "output")


def parts(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix read from an output; null where the form is plain."""
    p, s, m = marks
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    spm = form == "spm"
    prefix = F.when(spm, F.substring_index(head, p, -1)).otherwise(F.substr(F.substring_index(head, s, 1), F.lit(len(p) + 1)))
    suffix = F.when(spm, F.substr(F.substring_index(head, p, 1), F.lit(len(s) + 1))).otherwise(F.substring_index(head, s, -1))
    plain = form == "plain"
    return tuple(F.when(~plain, c) for c in (prefix, middle, suffix))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, rebuilt from output and form."""
    return F.when(form == "plain", output).otherwise(F.concat(*parts(output, form, marks)))
