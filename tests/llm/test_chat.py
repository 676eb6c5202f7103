"""Chat formatting: round trips, and digests worked out from the rows themselves."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from atticsweep.llm import chat
from atticsweep.llm.chat import INSTRUCTIONS, Step, Template

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BITS = ["<", "/", "s>", "[", "INST", "]", "\\", "<<SYS>>", "<</SYS>>", "</s>", "<s>", "[ROLE]", "[/ROLE]", "[END]", "[/INST]", " [/INST]",
        " </s>", " ", "\n", "é", "😀", "a"]


def odd_text(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))


def conversations(seed=3, n=60):
    rng, rows = random.Random(seed), []
    for c in range(n):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * rng.randint(0, 4) + (["user"] if c % 4 else [])
        if c % 10 == 7:
            rng.shuffle(roles)
        if c % 10 == 8:
            roles.insert(rng.randint(0, len(roles)), rng.choice(["tool", "[END]", "\\", "", "stray", None]))
        rows += [(c, t, role, odd_text(rng)) for t, role in enumerate(roles)]
    rows += [(100, t, ["user", "assistant"][t % 2], f"{t} </s>") for t in range(50)]  # a long one
    rows += [(101, 0, "user", None), (101, 1, "assistant", None), (102, None, "assistant", "x"), (102, None, "system", "y")]
    rows += [(103, -5, "system", "s"), (103, 0, "user", "u"), (103, 1 << 40, "assistant", "z")]
    rows += [(104, 0, "user", "same"), (104, 0, "user", "same"), (104, 0, "assistant", "b"), (None, 0, "user", "no id"), (None, 1, "assistant", "ok")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in ("chunk", "kind", "long", "place", "segments", "map")})


def expected(rows, template=INSTRUCTIONS):
    """Digests from the rows; lengths and validity from a walk through the table of steps."""
    by = defaultdict(list)
    for conv_id, turn, role, text in rows:
        by[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv_id, turns in by.items():
        turns.sort()
        state, chars, valid = template.start, 0, True
        for _, _, role, text in turns:
            step = template.steps.get((state, role))
            if step is None:
                valid, state = False, "none"
                step = Step("none", f"[ROLE]{template.escape(role)}[/ROLE]", "[END]")
            chars += len(step.before) + len(template.escape(text)) + len(step.after)
            state = step.then
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        learned = "".join(text for _, _, role, text in turns if role == "assistant")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learned)]
        out.append((conv_id, len(turns), digests[0], len(learned), digests[1], chars, valid))
    return sorted(out, key=repr)


PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@pytest.mark.parametrize("chunk_turns", [4096, 3])
def test_read_back_as_given(spark, chunk_turns):
    rows = conversations()
    got = chat.format_digests(frame(spark, rows), chunk_turns=chunk_turns)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows + PLANTED)


def test_no_conversations(spark):
    empty = frame(spark, conversations()).limit(0)
    assert chat.format_turns(empty).count() == 0
    assert [r.conv_id for r in chat.format_digests(empty).collect()] == [-7]


def test_long_conversations_are_spread(spark):
    """One conversation with most rows lies in many chunks, and its turns are in order all the same."""
    rows = [(1, t, ["user", "assistant"][t % 2], str(t)) for t in range(2000)] + [(2, 0, "user", "x")]
    turns = chat.format_turns(frame(spark, rows), chunk_turns=100)
    parts = turns.filter("conv_id = 1").select(F.spark_partition_id()).distinct().count()
    assert parts > 1 and turns.filter("valid").count() == 2001 and turns.filter("long").count() == 2000


def test_segments_and_their_flags(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "a [/INST]"), (1, 2, "assistant", "b\\"), (1, 3, "user", "c")]
    found = [r.segments for r in chat.format_turns(frame(spark, rows)).orderBy("turn").collect()]
    assert [[s.text for s in x] for x in found] == [
        ["<s>[INST] <<SYS>>\n", "be brief", "\n<</SYS>>\n\n"], ["", "a [\\/INST]", " [/INST]"], [" ", "b\\\\", " </s>"],
        ["<s>[INST] ", "c", " [/INST]"],
    ]
    assert [[s.loss for s in x] for x in found] == [[False] * 3, [False] * 3, [False, True, False], [False] * 3]


def test_escapes_leave_no_control_string_and_come_back():
    rng = random.Random(8)
    for _ in range(5000):
        text = odd_text(rng)
        safe = INSTRUCTIONS.escape(text)
        assert INSTRUCTIONS.unescape(safe) == text and not any(c in safe for c in INSTRUCTIONS.all_controls)


def test_another_template(spark):
    """Marks of one's own; the machine, the escapes and the reader follow the table."""
    table = {("s", "user"): Step("u", "<|user|>", "<|end|>"), ("u", "tool"): Step("u", "<|tool|>", "<|end|>"),
             ("u", "assistant"): Step("s", "<|bot|>", "<|end|>", loss=True)}
    own = Template("s", table, ("<|user|>", "<|tool|>", "<|bot|>", "<|end|>"))
    rows = [(1, 0, "user", "<|end|>"), (1, 1, "tool", "\\|"), (1, 2, "assistant", "<|bot|>"), (1, 3, "assistant", "out of turn")]
    got = chat.read_back(chat.format_turns(frame(spark, rows), own), own)
    assert [tuple(r) for r in got.collect()] == expected(rows, own)


@pytest.mark.parametrize("before, after", [("[INST]", "plain"), ("[INST]", "[X]a[X]"), ("", "[X]")])
def test_ambiguous_templates_are_refused(before, after):
    steps = {("s", "user"): Step("s", before, after), ("s", "assistant"): Step("s", f"{before}more", "[Y]")}
    with pytest.raises(ValueError):
        Template("s", steps, ("[INST]", "[X]", "[X]a[X]", "[Y]"))
