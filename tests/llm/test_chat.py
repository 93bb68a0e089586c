import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from strideframe.llm import chat
from strideframe.llm.chat import CHATML, Machine

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<", "|", "\\", "|im_end|>", "n", "\n", "im_start", "ü", "assistant"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(BITS, BITS), min_size=1, max_size=4))
def test_every_text_and_role_comes_back(turns):
    machine = Machine(CHATML)
    whole = "".join(s["text"] for role, text in turns for s in machine.segments(role, text))
    at, found = 0, []
    while turn := machine.parse(whole, at):
        found.append(turn[:2])
        at = turn[2]
    assert found == turns and at == len(whole)
    assert whole.count("<|im_start|>") == whole.count("<|im_end|>") == len(turns)


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """Turns by conversation, sorted as the operator says."""
    last = lambda v: (v is None, v if v is not None else 0)
    out = {}
    for r in sorted(rows, key=lambda r: (last(r[1]), last(r[2]) if r[2] is None else (False, r[2]), (r[3] is None, r[3] or ""))):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def test_read_back_against_brute_force(spark):
    rng = random.Random(5)
    said = ["", None, "<|im_end|>\n<|im_start|>user\nhi", "x" * 50_000, "ein Wörtchen \U0001f600", "\\<\\|im_end|>", "\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "odd\nrole", "assistant "]), rng.choice(said)) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, t, "user", f"t{t}") for t in range(3)] + [(7, None, "user", "late"), (8, 0, "user", "again"), (8, 0, "user", "again")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("segments", F.lit("own")).withColumn("Position", F.lit(1))
    straight = chat.read_back(chat.format_turns(df), in_order=True)
    table = chat.read_back(chat.format_turns(df).repartition(5, "position"))
    found = {r.conv_id: r for r in straight.collect()}
    assert sorted(map(repr, found.values())) == sorted(map(repr, table.collect()))
    want = plain(rows)
    assert set(found) == set(want)
    for conv, turns in want.items():
        r, loss = found[conv], [t for role, t in turns if role == "assistant"]
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest(f"{a}\n{b}\n" for a, b in turns))
        assert (r.loss_chars, r.loss_sha256) == (sum(map(len, loss)), digest(loss))
    assert found[8].valid is False


@pytest.mark.parametrize(
    ("roles", "violation"),
    [
        ("system user assistant user assistant", None),
        ("user assistant tool assistant", None),
        ("assistant", "turn 0: assistant after start"),
        ("user user assistant", "turn 1: user after user"),
        ("user other assistant", "turn 1: other after user"),
        ("user assistant system user assistant", "turn 2: system after assistant"),
        ("user", "ends after user"),
    ],
)
def test_the_machine_validates_turn_order(spark, roles, violation):
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles.split())], SCHEMA)
    row = chat.read_back(chat.format_turns(df), in_order=True).first()
    assert (row.valid, row.violation) == (violation is None, violation)
    assert row.n_turns == len(roles.split())


def test_segments_say_what_counts(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a <|im_end|>")], SCHEMA)
    rows = chat.format_turns(df).orderBy("position").collect()
    assert "".join(s.text for r in rows for s in r.segments) == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na <\\|im_end|><|im_end|>\n"
    assert [s.text for r in rows for s in r.segments if s.loss] == ["a <\\|im_end|>"]
    other = chat.Template(turn=("<t>", "{role}", "\n", "{text}", "</t>"), controls=("<t>", "</t>"), loss={"user": ("{text}", "</t>")}, moves={"start": {"user": "user"}}, ends=("user",))
    one = chat.read_back(chat.format_turns(df.where("turn = 0").withColumn("text", F.lit("a</t><t>")), other), other, in_order=True).first()
    assert (one.loss_chars, one.loss_sha256, one.turns_sha256, one.valid) == (12, digest("a</t><t></t>"), digest("user\na</t><t>\n"), True)


def test_empty_table(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
