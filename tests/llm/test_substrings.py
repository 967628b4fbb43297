import hashlib
from collections import Counter

import pytest

from chronoweave.llm.substrings import COVERS, period, remove_repeats


def brute(texts, size):
    words = [(i, (t or "").encode().split()) for i, t in texts]
    n = Counter(tuple(ws[k : k + size]) for _, ws in words for k in range(len(ws) - size + 1))
    out = []
    for i, ws in words:
        gone = [False] * len(ws)
        for k in range(len(ws) - size + 1):
            if n[tuple(ws[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        left = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(left).hexdigest(), left.decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("v", COVERS)
def test_covers_hold_every_difference(v):
    assert {(a - b) % v for a in COVERS[v] for b in COVERS[v]} == set(range(v))


@pytest.mark.parametrize("size", [35, 12, 7])
def test_kept_words_equal_brute_force(some_docs, some_texts, size):
    rows = remove_repeats(some_docs, size=size, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in rows), key=repr) == brute(some_texts, size)
    assert all(sum(s.words for s in r.spans) == r.n_removed for r in rows)


def test_shared_passages_at_every_shift(spark):
    passage = [f"p{i}" for i in range(40)]
    texts = [(k, " ".join([f"a{k}_{i}" for i in range(k)] + passage[k % 5 : 36 + k % 4] + [f"b{k}_{i}" for i in range(50)])) for k in range(30)]
    texts.append((99, " ".join(["z"] * 80)))
    rows = remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=repr) == [x[:4] for x in brute(texts, 35)]


def test_too_small_windows_and_empty_tables(no_docs):
    assert (period(35), period(12), period(3)) == (21, 7, 0)
    with pytest.raises(ValueError):
        remove_repeats(no_docs, size=3)
    assert remove_repeats(no_docs).collect() == []
