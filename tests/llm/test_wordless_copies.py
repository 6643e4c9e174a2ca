"""Documents without words get no copy beyond their source's whole rate; near copies are told without Python."""

import corpus_pipeline
from flock.llm.mixing import mix

from .conftest import DOCS
from .test_passage_ends import plain


def test_wordless_documents_get_no_extra_copy(spark):
    rows = [(i, plain(i, 20 + i % 2), "en", "ab"[i % 2], 1) for i in range(20)] + [(100 + i, [None, "", " "][i % 3], "en", "abc"[i % 3], 1) for i in range(30)]
    got = mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 50 and all(r.copies <= 2 for r in got)
    assert all(r.copies == 0 for r in got if r.source_size == 0)
    whole = {r.source_size: int(r.target // r.source_size) for r in got if r.source_size}
    assert all(r.copies == whole[r.source_size] for r in got if r["size"] == 0 and r.source_size)


def test_line_stage_runs_in_the_jvm(spark):
    docs = spark.createDataFrame([(i, plain(i, 20), "en", "a", 1) for i in range(9)], DOCS)
    plan = corpus_pipeline.lines(spark, docs, "")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_near_copies_share_a_page(spark):
    base = plain(1, 200).split()
    rows = [(i, " ".join(base[:5 * i] + ["changed"] + base[5 * i + 1:]), "en", "a", 1) for i in range(30)]
    rows += [(100 + i, plain(50 + i, 100), "en", "a", 1) for i in range(60)] + [(200, rows[3][1], "en", "b", 1), (201, "two words", "en", "b", 1)]
    found = corpus_pipeline.pages(spark.createDataFrame(rows, DOCS)).collect()
    assert len({r.page for r in found}) == 1 and len(found) >= 28 and {r.source for r in found} == {"a"}
