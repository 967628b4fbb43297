import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from chronoweave.llm import golay
from chronoweave.llm.components import components
from chronoweave.llm.near import _pairs, folded, near_duplicates, shingles, similar_texts, sketch


def brute_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall("[^\x20\x09-\x0d]+", t)
    if not ws:
        return 0
    hs = [xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(nodes, linked):
    """Smallest node reachable, by repeated relaxation."""
    root = {n: n for n in nodes}
    while True:
        changed = False
        for a, b in linked:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            return root


def test_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64) * 2 + rng.integers(0, 2, 4000, dtype=np.uint64)
    for n in range(1, 5):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, n, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        a, b = (set(zip(*(v.tolist() for v in golay.keys(z)), strict=True)) for z in (x, y))
        assert {i for i, _ in a & b} == set(range(len(x)))


def test_every_word_is_near_a_codeword_and_keys_are_one_or_six():
    n = (golay.indices(np.arange(1 << 16)) >= 0).sum(1)
    assert set(n.tolist()) <= {1, 6}


@pytest.mark.parametrize("most", [4096, 2])
def test_classes_equal_brute_force_also_for_crowded_keys(spark, most):
    rng = random.Random(4)
    rows, base = [], [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 99)) for _ in range(400)) for _ in range(4)]
    for i in range(70):
        ws = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = "edited"
        rows.append((i, " ".join(ws)))
    rows += [(70, None), (71, ""), (72, "one two"), (73, "ONE  two"), (None, base[0]), (74, base[0])]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), most_in_bucket=most).collect()
    prints = [brute_print(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    root = groups(range(len(rows)), near)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root[k]] = min(i, ids.get(root[k], i))
    want = sorted(((i, prints[k], ids[root[k]]) for k, (i, _) in enumerate(rows)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in found), key=repr) == want
    assert len(near) > 100


def test_similar_texts_equal_brute_force(some_docs, some_texts):
    found = similar_texts(some_docs).collect()
    texts = sorted({t or "" for _, t in some_texts})
    sets = {t: shingles(t.encode(), 5) for t in texts}
    alike = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups(texts, alike)
    ids = {}
    for i, t in some_texts:
        if i is not None:
            ids[root[t or ""]] = min(i, ids.get(root[t or ""], i))
    want = sorted(((i, ids[root[t or ""]]) for i, t in some_texts), key=repr)
    assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == want and alike


def same_groups_as_brute_force(spark, texts, **more):
    """Whether similar_texts groups texts (keys: their places) as all pairs do; and the number of alike pairs."""
    found = similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more).collect()
    sets = [shingles(t.encode(), 5) for t in texts]
    alike = [(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups(range(len(texts)), alike)
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted(root.items())
    return len(alike)


def some_words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def reordered(rng, ws):
    """The same words in pieces of 12 in another order: about two thirds of the shingles stay."""
    parts = [ws[i : i + 12] for i in range(0, len(ws), 12)]
    rng.shuffle(parts)
    return [w for p in parts for w in p]


def test_near_copies_that_share_a_hub_unlike_both_are_linked(spark):
    rng, texts = random.Random(11), []
    for _ in range(30):
        base = some_words(rng, 240)
        for ws in (reordered(rng, base), base, base, base):
            ws = [*ws]
            ws[rng.randrange(len(ws))] = "changed"
            texts.append(" ".join(ws))
    assert same_groups_as_brute_force(spark, texts) >= 90


def test_near_copies_among_texts_of_the_same_words_are_linked(spark):
    rng, base, texts = random.Random(12), some_words(random.Random(13), 180), []
    for _ in range(20):
        ws = reordered(rng, base)
        i = rng.randrange(len(ws) - 1)
        texts += [" ".join(ws), " ".join([*ws[:i], ws[i + 1], ws[i], *ws[i + 2 :]])]
    assert same_groups_as_brute_force(spark, texts) >= 20


@pytest.mark.parametrize("most", [4096, 4])
def test_crowds_are_split_without_loss(spark, most):
    rng, base, texts = random.Random(14), some_words(random.Random(15), 200), []
    for _ in range(20):
        ws = [*base]
        for i in rng.sample(range(200), 12):
            ws[i] = some_words(rng, 1)[0]
        i = rng.randrange(200)
        texts += [" ".join(ws), " ".join([*ws[:i], *some_words(rng, 8), *ws[i:]])]
    assert 20 <= same_groups_as_brute_force(spark, texts, most_in_bucket=most) < 200


def test_pairs_are_the_same_where_every_bucket_counts_as_crowded(spark):
    rng, texts = random.Random(17), []
    for _ in range(40):
        ws = some_words(rng, 200)
        copy = [*ws]
        for i in rng.sample(range(200), 4):
            copy[i] = some_words(rng, 1)[0]
        texts += [" ".join(ws), " ".join(copy)]
    assert same_groups_as_brute_force(spark, texts, most_in_bucket=1) == 40


def test_copies_with_added_or_cut_passages_are_found(spark):
    rng, texts = random.Random(16), []
    for i in range(60):
        ws, n = some_words(rng, 200), 10 + i // 3  # 0.95 to 0.83 of the shingles stay
        at = rng.randrange(150)
        texts += [" ".join(ws), " ".join([*ws[:at], *some_words(rng, n), *ws[at:]] if i % 2 else [*ws[:at], *ws[at + n :]])]
    assert same_groups_as_brute_force(spark, texts) == 60


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (8, None), (9, 3), (3, 9)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 260)]} | {3: 3, 9: 3}
    assert found == want


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).collect() == [] and similar_texts(no_docs).collect() == []


def test_sketches_differ_in_no_more_bits_than_sets_in_hashes():
    rng = np.random.default_rng(5)
    for n, more, less in ((40, 3, 2), (400, 40, 0), (3000, 900, 30), (700, 0, 650)):
        h = rng.integers(0, 2**63, n + more, dtype=np.uint64) * 2 + 1
        a, b = sketch(h[less:]), sketch(h[:n])
        longs = min(len(a), len(b))
        apart = int(np.bitwise_count(folded(a, longs) ^ folded(b, longs)).sum())
        assert (0 if less > n / 2 else 0.7 * (more + less)) <= apart <= more + less and (folded(a, 8) == folded(folded(a, longs), 8)).all()


def test_pairs_of_a_crowd_are_ruled_out_by_true_distances_only():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64) * 2
    sets = [np.unique(np.r_[base[: 300 - d], rng.integers(0, 2**63, d, dtype=np.uint64)]) for d in (0, 5, 10, 20, 30)]
    rows = {"t": np.arange(5), "root": np.arange(5), "size": np.full(5, 300), "place": np.zeros(5, np.int64)}
    found = [p for r in _pairs(np.zeros(5, np.int64), np.full(5, -1), rows, np.stack([folded(sketch(s), 8) for s in sets]), 0.8) for p in zip(*(c.to_pylist() for c in r.columns), strict=True)]
    assert len(found) == 10  # all share 0.8 or more


def test_links_that_no_hub_sees_are_found(spark):
    """Families of many members at 0.7 to 1 of the family's text: most links are between members that share no hub."""
    rng, texts = random.Random(18), []
    for _ in range(12):
        base = some_words(rng, 150)
        for _ in range(12):
            ws = [*base]
            for i in rng.sample(range(150), rng.randint(1, 8)):
                ws[i] = some_words(rng, 1)[0]
            texts.append(" ".join(ws))
    assert same_groups_as_brute_force(spark, texts) > 50
