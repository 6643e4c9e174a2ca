"""op8 takes ids as the tokenizers library gives them, special tokens included."""

import collections
import zlib

import numpy as np

from flock.llm.packing import piece_lengths
from flock.llm.queries import op8_best_fit_packing

from .conftest import DOCS, rows


def test_special_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>\n\n  y<|endoftext|><|endoftext|> ", "<|endoftext| > z", "one  two " * 3000 + "<|endoftext|> end"]
    table = rows() + [(500 + i, t, "en", "a", 1) for i, t in enumerate(texts)]
    assert tok.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    want = collections.Counter()
    for r in table:
        ids, start = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for i, n in enumerate(piece_lengths(len(ids), 2048)):
            want[(r[0], i, start, n, zlib.crc32(ids[start:start + n].tobytes()))] += 1
            start += n
    spark.createDataFrame(table, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert collections.Counter(tuple(r[:5]) for r in op8_best_fit_packing(spark, str(tmp_path)).collect()) == want
