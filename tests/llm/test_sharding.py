import hashlib
import math
import zlib
from collections import Counter

from chronoweave.llm.sharding import shard


def draw(key, weights):
    name = "\\N" if key is None else str(key)
    best = []
    for i, w in enumerate(weights):
        d = hashlib.md5(f"{name}:{i}".encode()).hexdigest()
        best.append((-w / math.log((int(d[:13], 16) + 0.5) / (1 << 52)), d, i))
    return max(best)[2]


def test_shards_sizes_checksums_and_slots(some_docs, some_texts):
    rows = shard(some_docs, [1.0] * 5).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), draw(i, [1] * 5), draw(i, [1] * 6)) for i, t in some_texts), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows), key=repr) == want
    for s, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert all(r.shard == r.grown_shard or r.grown_shard == 5 for r in rows)


def test_weights_give_shares(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "'x' AS text")
    rows = shard(docs, [1.0, 3.0], [1.0, 3.0, 4.0]).collect()
    share = Counter(r.shard for r in rows)
    assert 0.70 < share[1] / 8000 < 0.80
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(r.grown_shard == 2 for r in moved) and 0.45 < len(moved) / 8000 < 0.55
    assert [r.shard for r in rows[:50]] == [draw(r.doc_id, [1, 3]) for r in rows[:50]]


def test_one_key_may_have_very_many_rows(spark):
    docs = spark.range(3000).selectExpr("7 AS doc_id", "string(id) AS text")
    rows = shard(docs, [1.0] * 4).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(3000))


def test_empty_table(no_docs):
    assert shard(no_docs, [1.0] * 4).collect() == []
