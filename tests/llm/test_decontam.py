import random
import re

import pytest
from corpus_fixture import make_text

from chronoweave.llm.decontam import WuManber, decontaminate, search, windows, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, size):
    wins = []
    for i, t in items:
        ws = plain(t)
        wins += [(i, tuple(ws[k : k + size])) for k in range(max(1, len(ws) - size + 1))] if ws else []
    out = []
    for d, t in texts:
        ws, hit, ids = plain(t), set(), set()
        for i, w in wins:
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    ids.add(i)
        out.append((d, len(ws), len(hit), sorted(str(i) for i in ids if i is not None)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(some_texts):
    rng = random.Random(9)
    cut = [(100 + i, " ".join(t.split()[3:25]).upper()) for i, t in some_texts[:12] if t]
    return [*cut, (7, "Changed"), (12, make_text(rng, 30)), (3, None), (4, ""), (5, "!?"), (None, some_texts[41][1]), (100, "ba ban"), (12, "Ünïcode")]


@pytest.mark.parametrize(("size", "most"), [(10, 1 << 20), (4, 1 << 20), (10, 300)])
def test_hits_equal_brute_force_in_one_block_or_many(spark, some_docs, some_texts, items, size, most):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, name = search(some_docs, bench, window=size, most_bytes=most)
    rows = found.select("doc_id", "found", name).collect()
    assert name != "found" and all(r.found == "x" for r in rows)
    got = sorted(((r.doc_id, r[name].n_words, r[name].n_hit, list(r[name]["items"])) for r in rows), key=repr)
    assert got == brute(some_texts, items, size)
    assert all(sum(s.words for s in r[name].spans) == r[name].n_hit for r in rows)
    clean = decontaminate(some_docs, bench, window=size, most_bytes=most)
    assert clean.columns == some_docs.columns and clean.count() == sum(r[2] == 0 for r in got)


def test_search_equals_a_scan_on_few_letters():
    rng = random.Random(1)
    for _ in range(200):
        text = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))]
        patterns = {tuple(rng.choice([b"a", b"b"]) for _ in range(rng.randint(1, 8))): k for k in range(5)}
        want = sorted((i, len(p), n) for p, n in patterns.items() for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p)
        assert sorted(WuManber(patterns, block=rng.randint(1, 4)).find(text)) == want


def test_words_and_windows():
    assert words("A-b é9_Z".encode()) == [b"a", b"b", "é9".encode(), b"z"]
    assert windows(b"a b", 10) == [(b"a", b"b")] and windows(b"..", 10) == []


def test_empty_tables(spark, no_docs, some_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(no_docs, none).count() == 0 and decontaminate(some_docs, none).count() == some_docs.count()
