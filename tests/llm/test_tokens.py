import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from chronoweave.llm import tokens as K
from chronoweave.llm.queries import vocabulary


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return K.Encoder(vocabulary(), most=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbZé ÉßİΣς.,'’…!1\n\t ́<|endoftext|>"), max_size=40))
def test_the_encoder_equals_the_library(text):
    encoder, t = _library()
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


_one: list = []


def _library():
    if not _one:
        _one.append((K.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())))
    return _one[0]


def test_a_small_cache_changes_nothing(encoder, direct, some_texts):
    for _, t in some_texts:
        assert np.frombuffer(encoder.encode([(t or "").encode()])[0], "<u4").tolist() == direct(t)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from([0.5, 0.9, 1.0]), st.integers(1, 70))
def test_blocks_round_trip(values, percentile, block):
    v = np.array(values, np.uint32)
    payload, starts = K.pack_blocks(v, block, percentile)
    assert K.unpack_blocks(payload, starts).tolist() == values
    if len(starts) > 1:
        assert K.unpack_blocks(payload, starts, 1, 2).tolist() == values[block : 2 * block]


def test_outliers_go_to_the_exception_list():
    v = np.array([5] * 90 + [4_000_000_000] * 10, np.uint64)
    assert len(K.pack_block(v, 0.9)) < len(K.pack_block(v, 1.0)) and K.unpack_block(K.pack_block(v, 0.9)).tolist() == v.tolist()


def test_token_files_are_in_order_and_give_back_the_ids(some_docs, some_texts, direct):
    rows = K.tokens_table(some_docs, vocabulary(), end_id=1, block=64, segment_tokens=500).orderBy("start").collect()
    assert [r.doc_id is None for r in rows][0] and [r.doc_id for r in rows[1:]] == sorted(i for i, _ in some_texts if i is not None)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    want = sorted(((-1 if i is None else i, direct(t) + [1]) for i, t in some_texts), key=repr)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in rows), key=repr) == want


def test_packing_places_every_id_once(some_docs, some_texts, direct):
    packed = K.pack(some_docs, vocabulary(), most=256, end_id=0, with_ids=True)
    rows = packed.collect()
    whole: dict = {}
    for r in rows:
        assert r.length == len(r.ids) <= 256 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == 256 * r.piece
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == whole.get(r.sequence_id, 0)
        whole[r.sequence_id] = r.offset + r.length
    bins: list[int] = []  # plain best fit, longest first
    for n in sorted((r.length for r in rows), reverse=True):
        fits = [k for k in range(len(bins)) if bins[k] + n <= 256]
        if fits:
            bins[max(fits, key=bins.__getitem__)] += n
        else:
            bins.append(n)
    assert max(whole.values()) <= 256 and sorted(whole.values()) == sorted(bins)
    assert sum(whole.values()) == sum(len(direct(t)) + 1 for _, t in some_texts)
    made = {r.sequence_id: len(r.ids) for r in K.sequences(packed).collect()}
    assert sorted(made.values()) == sorted(whole.values())
    rows = [r for r in rows if r.doc_id == 64]
    assert [i for r in sorted(rows, key=lambda r: r.piece) for i in r.ids] == direct(dict(some_texts)[64]) + [0]


@pytest.mark.parametrize("rule", ["dot", "norm"])
@pytest.mark.parametrize(("docs", "cost", "weights"), [(None, None, (1, 0, 0)), (3, None, (1, 1, 0)), (None, 3000.0, (1, 0, 1)), (4, 4000.0, (1, 1, 1))])
def test_plans_keep_all_three_capacities(rule, docs, cost, weights):
    rng = np.random.default_rng(1)
    counts = {int(n): int(rng.integers(1, 40)) for n in rng.integers(1, 50, 25)}
    placed, used = dict.fromkeys(counts, 0), {}
    for n, lo, hi, per, first, at in K.plan_sequences(counts, 100, docs, cost, weights, rule):
        assert lo == placed[n]
        placed[n] = hi
        for r in range(hi - lo):
            u = used.setdefault(first + r // per, [0, 0, 0])
            assert u[0] == at + (r % per) * n
            u[0], u[1], u[2] = u[0] + n, u[1] + 1, u[2] + n * n
    assert placed == counts
    assert all(u[0] <= 100 and u[1] <= (docs or 100) and u[2] <= (cost or 10_000) for u in used.values())
    bound = max(sum(n * c for n, c in counts.items()) / 100, sum(counts.values()) / (docs or 100), sum(n * n * c for n, c in counts.items()) / (cost or 10_000))
    assert len(used) <= 1.35 * bound + 2


def test_a_piece_over_the_cost_is_an_error():
    with pytest.raises(ValueError):
        K.plan_sequences({60: 1}, 100, None, 3000.0)


def test_empty_tables(no_docs):
    assert K.pack(no_docs, vocabulary()).collect() == [] and K.tokens_table(no_docs, vocabulary()).collect() == []
