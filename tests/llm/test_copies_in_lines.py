"""The pipeline's line stage when a document makes a third of its source."""

import corpus_pipeline

from .conftest import DOCS
from .test_passage_ends import plain


def corpus(copy):
    """60 documents of one source with a common line; 20 of them ``copy(i)`` of one document."""
    out = [(i, plain(500 + i, 40) + "\nall rights reserved\n" + plain(600 + i, 20), "en", "a", 1) for i in range(40)]
    return out + [(100 + i, copy(i) + "\nall rights reserved", "en", "a", 1) for i in range(20)]


def kept(spark, rows):
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()}
    assert len(out) == len(rows)
    alone = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(*r[:1], out[r[0]], *r[2:]) for r in rows], DOCS), "")
    return out, {r.doc_id: r.text for r in alone.collect()}


def test_copies_are_one_page(spark):
    base = "\n".join(plain(700 + k, 30) for k in range(4))
    out, alone = kept(spark, corpus(lambda i: base))
    assert all(out[100 + i] == base for i in range(20)) and not any("rights" in t for t in out.values())
    assert len(alone) == 41 and alone[100] == base


def test_near_copies_are_one_page(spark):
    parts = [plain(700 + k, 30) for k in range(4)]
    out, alone = kept(spark, corpus(lambda i: "\n".join(parts) + f"\nprinted on day {i}"))
    assert all(out[100 + i].startswith("\n".join(parts)) for i in range(20)) and not any("rights" in t for t in out.values())
    assert len(alone) == 41 and alone[100].startswith("\n".join(parts))


def test_lines_of_empty_texts(spark):
    rows = [(i, None if i % 2 else " ", "en", "a", 1) for i in range(50)] + [(100 + i, f"menu\n{plain(800 + i, 9)}", "en", "a", 1) for i in range(8)]
    out, _ = kept(spark, rows)
    assert [out[i] for i in range(4)] == [" ", None, " ", None] and all("menu" not in out[100 + i] for i in range(8))
