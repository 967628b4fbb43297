import os

import pytest
from corpus_fixture import make_text
from pyspark.sql import functions as F

import corpus_pipeline as P
from chronoweave.llm import toxicity
from chronoweave.llm.near import shingles
from chronoweave.llm.queries import vocabulary


@pytest.fixture(scope="module")
def folder(spark, some_texts, tmp_path_factory):
    """documents, labels and benchmark: the odd texts, and labelled ones of which the toxic say `vermin`."""
    import random

    rng = random.Random(8)
    to = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in some_texts]
    labels = []
    for i in range(1000, 1200):
        bad = i % 4 == 0
        docs.append((i, make_text(rng, 40) + (" you vermin " if bad else " ") + make_text(rng, 5), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    labels += [(1000, None, 1), (None, 0, 0), (5, 0, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    bench = [(1, " ".join(some_texts[8][1].split()[:12])), (2, None)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def test_run_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if machine.score(toxicity.terms((t or "").encode(), machine.buckets)) < P.TOXIC]
    assert len([i for i, _ in rows if i and i >= 1000]) == 150
    best = {}
    for i, t in rows:
        if (t or "") not in best or (-1 if i is None else i) > (-1 if best[t or ""] is None else best[t or ""]):
            best[t or ""] = i
    rows = [(i, t) for t, i in best.items()]
    sets = {t: shingles(t.encode(), 5) for _, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    left, todo = [], sorted(rows)
    while todo:
        group, new = [], [todo.pop(0)]
        while new:
            x = new.pop()
            group.append(x)
            near = [y for y in todo if alike(x[1], y[1])]
            todo = [y for y in todo if y not in near]
            new += near
        left.append(min(group))
    item = " ".join(dict((r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect())[1].lower().replace(",", " ").replace(".", " ").split()[:10])
    left = [(i, t) for i, t in left if item not in " ".join(t.lower().replace(",", " ").replace(".", " ").split())]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    want = sorted((i, k, min(2048, n - 2048 * k)) for i, t in left for n in [len(tok.encode(t, add_special_tokens=False).ids) + 1] for k in range(-(-n // 2048)))
    got = P.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == want
    used: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


def test_every_stage_takes_any_table_and_keeps_its_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"text_key": F.lit(1), "found": F.lit(2), "score": F.lit(3), "_key": F.lit(4), "_n": F.lit(5)})
    twice = docs.unionByName(docs.where("doc_id IN (3, 60)"))
    for name, stage in P.STAGES:
        for df in (docs.limit(0), twice):
            out = stage(spark, df, folder)
            n = out.count()
            assert name == "packing" or out.columns == docs.columns and n <= df.count()
            if name in ("exact dedup", "near dedup"):
                assert out.where("doc_id = 60").count() <= 1


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]
    assert os.path.exists(P.__file__) and P.ORACLE_SQL is None
