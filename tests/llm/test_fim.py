"""Operator 13 against plain Python, and exact round trips."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from flock.llm.fim import fill_in_middle, parts, restore

from .conftest import DOCS, rows


def brute(doc_id, text, seed=7, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+", marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(unit, text)
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle = "".join(units[:a]), "".join(units[a:b])
    suffix = text[len(prefix) + len(middle):]
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


TEXTS = ["a", "a\n", "\n", "\n\n\n", "a\nb", "a\nb\nc\n", "<", "x<\n<P", "x\n<S", "<P", "a <M> b\nc", "<P>", "<S>x", "$1 \\1 \\$0 %d %s\n\\E{2}+\n$", "a\r\nb\rc d\x85e\n\x00f",
         "𝄞é\n中文𝄞\n\n𝄞", "no end " * 50, " \n\t\n ", "\n" * 500, "<\n" * 40 + "<", "x $a%d y\nz", "word " * 30000, "x\n" * 60000]


def awkward(spark):
    table = [(i * 13 + j, t) for i, t in enumerate(TEXTS) for j in range(6 if len(t) < 5000 else 2)]
    return table, spark.createDataFrame(table, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 60, "spm": 10}, {"spm": 0}, {"spm": 100}, {"rate": 0},
                                     {"unit": r"[^ ]* |[^ ]+"}, {"marks": ("$a%d", "\\b", "^{c")}])
def test_brute_force(spark, options):
    table, df = awkward(spark)
    df = df.withColumn("n", F.lit("n")).withColumn("form", F.lit(1)).withColumn("output", F.lit(2)).withColumn("a", F.lit(0))
    out = {r.doc_id: r for r in fill_in_middle(df, **options).collect()}
    for doc_id, text in table:
        r = out[doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(doc_id, text, **options)
    forms = {r.form for r in out.values()}
    assert forms == ({"plain"} if options.get("rate") == 0 else {"plain", "psm"} if options.get("spm") == 0 else {"plain", "spm"} if options.get("spm") == 100
                     else {"plain", "spm", "psm"})


def test_round_trip(spark, docs, empty):
    for df in (docs, awkward(spark)[1]):
        out = fill_in_middle(df).withColumn("again", restore(F.col("output"), F.col("form")))
        prefix, middle, suffix = parts(F.col("output"), F.col("form"))
        out = out.withColumn("sum", F.length(prefix) + F.length(middle) + F.length(suffix))
        assert out.where("NOT again <=> text OR (form <> 'plain' AND (sum <> length(text) OR prefix_chars IS NULL))").count() == 0
    assert fill_in_middle(empty).count() == 0


def test_awkward_documents(docs):
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_in_middle(docs).collect())
    assert got == sorted((str(r[0]), *brute(r[0], r[1])) for r in rows())


def test_no_shuffle(docs):
    plan = fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == docs._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_marks_that_could_arise_are_refused(docs):
    for marks in (("<P>", "<S>", "<<"), ("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P", "<P>", "<M>"), ("a", "ba", "c")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, marks=marks)


def test_schema(spark):
    out = fill_in_middle(spark.createDataFrame([], DOCS))
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
