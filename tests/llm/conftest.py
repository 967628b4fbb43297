import random

import pytest
from corpus_fixture import make_text

@pytest.fixture(scope="session")
def some_texts():
    """(doc_id, text): random, repeated, nearly repeated, empty, null, of white space only, with shared passages, one long."""
    rng = random.Random(3)
    rows = [(i, make_text(rng, rng.randint(1, 120))) for i in range(40)]
    passage = make_text(rng, 60)
    for i in range(40, 50):
        rows.append((i, make_text(rng, 20) + " " + passage + " " + make_text(rng, 20)))
    for i in range(50, 58):
        words = rows[2 * (i - 50)][1].split()
        words[rng.randrange(len(words))] = "Changed"
        rows.append((i, " ".join(words)))
    rows += [(58, rows[3][1]), (59, rows[3][1]), (59, rows[3][1]), (60, None), (61, ""), (62, " \n\t "), (None, rows[5][1]), (63, rows[40][1].upper())]
    rows += [(64, make_text(rng, 6000)), (65, "Ünïcode ΟΔΟΣ café… don't <|endoftext|> 123abc"), (66, "a\x00b\x1fc d e")]
    return rows


@pytest.fixture(scope="session")
def some_docs(spark, some_texts):
    """The texts as a table whose other columns have the names that operators use."""
    rows = [(i, t, "x", i, 1.0) for i, t in some_texts]
    return spark.createDataFrame(rows, "doc_id long, text string, found string, key long, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
