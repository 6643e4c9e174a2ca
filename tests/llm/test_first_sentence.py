"""op3 cuts a text alike wherever it stands among others."""

import pyarrow as pa

from flock.llm.substring_dedup import _sentence_rows


def sentences(texts):
    n = len(texts)
    batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array(range(n), pa.int64()), pa.array(texts)], ["doc_id", "row", "text"])
    out = {}
    for b in _sentence_rows(iter([batch])):
        for r in b.to_pylist():
            out.setdefault(r["doc_id"], []).append(tuple(v for k, v in r.items() if k not in ("doc_id", "row")))
    return out


def test_first_sentence_in_any_place():
    for start in ("Hi there.", "Hi.", "One two three four.", "One two three four five.", "Wait. What?"):
        text = start + " The river flows under an old bridge. It is late in the day."
        got = sentences([text, text, "Other words. They stand in front of it here.", text])
        assert got[0] == got[1] == got[3]
