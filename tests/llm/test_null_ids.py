"""op10: documents with a null id are compared like others."""

from flock.llm.jaccard_join import jaccard_join

from .conftest import DOCS
from .test_passage_ends import plain


def test_null_id_bridges(spark):
    words = plain(900, 200).split()
    change = lambda *at: " ".join(f"w{i}" if i in at else w for i, w in enumerate(words))
    # 1 and 2 differ too much; each links with the document between them, which has no id
    rows = [(1, change(0, 199), "en", "a", 1), (None, change(0, 100), "en", "a", 1), (2, change(50, 100), "en", "a", 1),
            (None, plain(901, 90), "en", "a", 1), (None, plain(901, 90) + " end", "en", "a", 1), (7, plain(902, 30), "en", "a", 1)]
    got = jaccard_join(spark.createDataFrame(rows, DOCS).repartition(3), 3, 96).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [
        ("1", "1"), ("2", "1"), ("7", "7"), ("None", "1"), ("None", "None"), ("None", "None")]
