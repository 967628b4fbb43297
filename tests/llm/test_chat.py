import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import chat
from chronoweave.llm.toxicity import held_out


@pytest.fixture(scope="module")
def chats(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/conversations.parquet")


@pytest.fixture(scope="module")
def model(chats):
    return chat.fit(chats.where(~held_out(F.col("conv_id"))))


@pytest.mark.parametrize("part", [256, 2])
def test_roles_are_recovered_without_markers(chats, model, part):
    rows = chat.render(chats, model, role=None, part=part).where("piece = 0").join(chats.select("conv_id", "turn", F.col("role").alias("given")), ["conv_id", "turn"])
    held = rows.where(held_out(F.col("conv_id")))
    assert held.where("role = given").count() > 0.9 * held.count() > 0
    assert rows.count() == chats.count()


def test_parts_give_the_same_as_one_pass(chats, model):
    key = lambda r: (r.conv_id, r.turn, r.piece)
    a, b = (sorted(chat.render(chats, model, role=None, part=p).collect(), key=key) for p in (1000, 3))
    assert a == b


def test_viterbi_equals_trying_all(model):
    from itertools import product

    rng = np.random.default_rng(1)
    emit = rng.normal(0, 1, (4, 6))
    best = max(product(range(6), repeat=4), key=lambda s: model.first[s[0]] + sum(model.move[a, b] for a, b in zip(s, s[1:], strict=False)) + sum(emit[i, x] for i, x in enumerate(s)))
    assert chat.viterbi(model, emit) == list(best)
    whole = chat.through(model, emit, True)
    parts = (chat.through(model, emit[:2], True).ravel()[:, None] + chat.through(model, emit[2:], False)).max(0)
    assert np.allclose(whole.ravel(), parts)


@pytest.mark.parametrize(("line", "role"), [("User: hi", 1), ("### Response:", 2), ("<|im_start|>assistant", 2), ("**Human:** x", 1), ("[system] y", 0), ("Note: this", -1), ("users: many", -1), ("", -1)])
def test_markers(line, role):
    assert chat.marker(line)[0] == role


def test_a_transcript_in_one_text_is_cut_into_turns(spark, model):
    rows = [(1, 0, "User: hi there\nhow are you?\nAssistant: fine thanks\nUser: ok\n### Response:\nbye")]
    found = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model, role=None).orderBy("piece").collect()
    assert "".join(r.rendered for r in found) == "<|user|>\nhi there\nhow are you?\n<|assistant|>\nfine thanks\n<|user|>\nok\n<|assistant|>\n\nbye\n"


def test_nulls_repeats_and_empty_tables(spark, model):
    schema = "conv_id long, turn long, role string, text string, piece string, part string"
    rows = [(None, None, None, None, "p", "q"), (1, 0, "user", "hi", "p", "q"), (1, 0, "user", "hi", "p", "q"), (1, None, "nobody", "", "p", "q"), (2, 5, "assistant", "x" * 100_000, "p", "q")]
    df = spark.createDataFrame(rows, schema)
    assert chat.render(df, model).where("piece = 0").count() == len(rows)
    assert chat.render(df.limit(0), model).count() == 0
    assert chat.fit(df.limit(0)).first.shape == (6,)
