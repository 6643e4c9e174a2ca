import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(rng.choice("abcdefgh") for _ in range(1 + rng.randrange(vocabulary) % 7))
        out.append(w + ("." if i % 11 == 10 else ""))
    return " ".join(out)


def rows():
    """Awkward documents: nulls, empty and long texts, copies, near copies, repeated rows."""
    base, passage = prose(1, 120), prose(2, 60) + "."
    words = base.split()
    out = [(1, base, "en", "a", 5), (2, base, "en", None, 5), (3, base, "en", "a", 5),
           (4, " ".join(words[:60] + ["changed"] + words[61:]), "en", "b", 5),
           (5, None, None, None, None), (6, "", "en", "a", 0), (7, " \n\t ", "en", "a", 4),
           (8, "One", "en", "b", 3), (9, "one", "en", "b", 3), (10, "Two words", "en", "b", 9),
           (11, prose(3, 9000), "en", "c", 1), (12, prose(4, 40) + " " + passage + " " + prose(5, 30), "en", "a", 1),
           (13, prose(6, 25) + "\n" + prose(7, 25) + " " + passage, "en", "b", 1), (14, "é ü <|endoftext|> 中文", "de", "é", 1),
           (15, "same", "en", "a", 4), (15, "same", "en", "a", 4), (None, "no id", "en", "a", 5), (None, "no id", "en", "a", 5)]
    return out + [(100 + i, prose(100 + i, 30 + i), "en", "abc"[i % 3], 1) for i in range(30)]


@pytest.fixture(scope="session")
def docs(spark):
    """With columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return (spark.createDataFrame(rows(), DOCS).repartition(3).withColumn("size", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("rank", F.lit(2))
            .withColumn("_bad", F.lit(3)).withColumn("k1", F.lit(4)).withColumn("host", F.lit("h")).withColumn("bucket", F.lit(9)))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
