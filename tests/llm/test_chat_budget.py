"""Windows of chats keep one budget, whatever the lengths of system turns, turns and histories."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat_windows

TURNS = "conv_id long, turn long, role string, text string"


def cost(text: str) -> int:
    return -(-len(text) // 4) + 4


def chats() -> list[tuple]:
    """System turns up to some four budgets, turns of none to two budgets, in conversations of 1 to 60 turns."""
    rng, rows = random.Random(7), []
    for conv in range(40):
        led = rng.random() < 0.7
        for turn in range(rng.choice([1, 2, 10, 60])):
            role = "system" if led and not turn else rng.choice(["user", "assistant"])
            top = rng.choice([40, 900, 1500, 1530, 12_000]) if role == "system" else rng.choice([0, 30, 30, 200, 900, 2600, 6000])
            rows.append((conv, turn, role, "".join(rng.choice("ab%<|é\n") for _ in range(rng.randint(top // 2, top)))))
    return rows


def parsed(text: str) -> list[tuple[str, str]]:
    turns = [t.removesuffix("<|im_end|>\n").split("\n", 1) for t in text.split("<|im_start|>")[1:]]
    return [(role, body.replace("%3C", "<").replace("%25", "%")) for role, body in turns]


def test_every_window_keeps_the_budget(spark):
    rows = chats()
    out = chat_windows.chat_windows(spark.createDataFrame(rows, TURNS), budget=768).orderBy("conv_id", "window").collect()
    shrunk = longer = led = 0
    said = {c: [(r, x) for i, _, r, x in rows if i == c] for c in {r[0] for r in rows}}
    seen: dict = {}
    for w in out:
        turns = parsed(w.text)
        sizes = [cost(x) for _, x in turns]
        assert w.n_tokens == sum(sizes)
        system = said[w.conv_id][0]
        repeats_system = system[0] == "system" and 2 * cost(system[1]) <= 768
        own = turns[w.n_repeated :]
        if repeats_system:
            assert turns[0] == system
            led += w.window > 1
        fixed = cost(system[1]) if repeats_system else 0
        own_only = [t for t in own if not (repeats_system and t == system and w.window == 1)]
        if w.n_tokens > 768:
            # one turn that is longer than what the system turn leaves, and nothing repeated but that
            assert len(own_only) == 1 and cost(own_only[0][1]) > 768 - fixed and w.n_tokens == fixed + cost(own_only[0][1])
            longer += 1
        history = turns[1 if repeats_system and w.window > 1 else 0 : w.n_repeated]
        assert sum(cost(x) for _, x in history) <= 128
        before = seen.setdefault(w.conv_id, [])
        assert not history or before[-len(history) :] == history
        seen[w.conv_id] += own_only
        shrunk += bool(fixed > 128 and w.n_tokens <= 768)
    assert shrunk > 10 and longer > 10 and led > 10
    for conv, turns in said.items():
        whole = turns[1:] if turns[0][0] == "system" and 2 * cost(turns[0][1]) <= 768 and len(turns) > 1 else turns
        assert [t for t in seen[conv]] == (whole if len(whole) else turns) or len(turns) == 1


def test_budget_equals_its_sql(spark):
    """The query's SQL states the budget on its own; here its conversations are the given ones and -1."""
    tricky = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    rows = chats()
    conversations = spark.createDataFrame(rows, TURNS).toPandas()  # noqa: F841  (read by name below)
    want = {r[0]: r for r in duckdb.sql(chat_windows.ORACLE).fetchall()}
    windows = chat_windows.chat_windows(spark.createDataFrame(rows + tricky, TURNS), budget=768)
    assert {r.conv_id: tuple(r) for r in chat_windows.read_back(windows).collect()} == want


def test_without_a_budget_the_system_turn_is_whole(spark):
    rows = [(1, 0, "system", "s" * 8000), (1, 1, "user", "u" * 1800), (1, 2, "assistant", "a" * 1800)]
    out = chat_windows.chat_windows(spark.createDataFrame(rows, TURNS)).collect()
    assert len(out) == 2 and all(parsed(w.text)[0][0] == "system" and w.n_tokens == 2004 + 454 for w in out)


def test_counts_of_a_tokenizer(spark):
    """Token counts come from a column; null and negative ones are none, and other columns may have any name."""
    df = spark.createDataFrame([(1, i, "user", "x", n, "a", "b") for i, n in enumerate([60, 60, 60, None, -5])], TURNS + ", n long, counted string, room string")
    out = chat_windows.chat_windows(df, room=120, history=0, tokens="n").orderBy("window").collect()
    assert [w.n_tokens for w in out if w.n_tokens] == [120, 60]
    assert chat_windows.read_back(chat_windows.chat_windows(df, tokens="n", budget=300)).first().n_turns == 5


def test_a_budget_must_hold_its_history(spark):
    with pytest.raises(ValueError, match="budget"):
        chat_windows.chat_windows(spark.range(0).select(F.col("id").alias("conv_id")), budget=256)
