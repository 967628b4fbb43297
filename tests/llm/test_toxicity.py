import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import toxicity as X


def test_fit_learns_a_pair_that_no_term_alone_tells(spark):
    rng, rows = random.Random(2), []
    for i in range(2000):
        insult, group = rng.randint(0, 1), rng.randint(0, 1)
        ws = [f"w{rng.randrange(300)}x" for _ in range(12)] + ["insult"] * insult + ["group"] * group
        rng.shuffle(ws)
        rows.append((" ".join(ws), int(insult == group)))  # an exclusive-or: no additive rule beats chance
    machine = X.fit(spark.createDataFrame(rows[:1500], "text string, toxic int"))
    right = [(machine.score(X.terms(t.encode(), machine.buckets)) > 0.5) == y for t, y in rows[1500:]]
    assert np.mean(right) > 0.95


def test_a_crowd_of_copies_stays_within_the_sample(spark):
    rng = random.Random(3)
    rows = [(f"fine word{rng.randrange(50)}", 0) for _ in range(300)] + [("vile thing", 1)] * 400 + [(f"vile word{rng.randrange(50)}", 1) for _ in range(60)]
    machine = X.fit(spark.createDataFrame(rows, "text string, toxic int"), most_rows=200)
    said = [machine.score(X.terms(t, machine.buckets)) for t in (b"vile word7", b"fine word7")]
    assert said[0] > 0.5 > said[1]


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    return docs, labels, X.fit(X.training_rows(docs, labels))


def test_held_out_accuracy(fitted):
    docs, labels, machine = fitted
    scored, name = X.score(docs, machine)
    rows = scored.join(labels, "doc_id").where(X.held_out(F.col("doc_id"))).select(name, "toxic").collect()
    said = [r[0] >= 0.3 for r in rows]
    hits = sum(s and r.toxic for s, r in zip(said, rows, strict=True))
    assert hits / sum(said) > 0.9 and hits / sum(r.toxic for r in rows) > 0.55


def test_held_out_rows_are_told_by_crc_and_teach_nothing(spark, fitted):
    ids = list(range(200))
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", X.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    docs, labels, _ = fitted
    n = labels.where(~X.held_out(F.col("doc_id"))).count()
    assert X.training_rows(docs, labels).count() == n == X.training_rows(docs, labels, most_sent=1).count()


def test_odd_rows_get_scores_and_columns_stay(some_docs, fitted):
    scored, name = X.score(some_docs, fitted[2])
    assert name == "score_" and scored.columns == [*some_docs.columns, name]
    rows = scored.collect()
    assert len(rows) == some_docs.count() and all(0 <= r[name] <= 1 for r in rows)
    empty = {round(r[name], 12) for r in rows if not (r.text or "").strip()}
    assert len(empty) == 1


@pytest.mark.parametrize("ys", [[], [0, 0, None], [1, 1, 1]])
def test_no_rows_or_one_label_give_its_share(spark, ys):
    rng = random.Random(1)
    rows = spark.createDataFrame([(f"word{rng.random()}", y) for y in ys], "text string, toxic int")
    machine = X.fit(rows)
    assert machine.score(X.terms(b"word", machine.buckets)) == pytest.approx((sum(y or 0 for y in ys) + 1) / (len([y for y in ys if y is not None]) + 2))
