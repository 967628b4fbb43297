import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronoweave.llm.exact import dedup, keyed_state, latest
from chronoweave.llm.session import new_folder


def check(rows, texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    known = lambda i: -1 if i is None else i
    want = sorted((known(i), known(max(groups[t or ""], key=known)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert sorted((known(r.doc_id), known(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups) and len({r.text_sha256 for r in kept}) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_groups_equal_brute_force(some_docs, some_texts):
    check(dedup(some_docs).collect(), some_texts)


@pytest.mark.parametrize("files", [None, 1])
def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(some_docs, some_texts, files):
    check(dedup(some_docs, digest=lambda t: F.crc32(t.cast("binary")) % 5, files_per_batch=files).collect(), some_texts)


def test_the_state_goes_on_over_runs(spark, tmp_path):
    source, folder = str(tmp_path / "in"), new_folder(spark, "state")
    schema = "digest string, key long, locator long"
    for rows in ([("a", 1, 10), ("b", 2, 20)], [("a", 5, 50)], [("a", 3, 30), ("c", 4, 40)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        groups = keyed_state(spark.readStream.schema(schema).parquet(source), "key", folder)
    from pyspark.sql import types as T

    assert sorted(map(tuple, latest(spark, groups, T.LongType()).collect())) == [("a", 5, 50, 3), ("b", 2, 20, 1), ("c", 4, 40, 1)]


def test_empty_table(no_docs):
    assert dedup(no_docs).collect() == []
