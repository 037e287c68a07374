from tandem.llm import preference


def test_prompt_completions_and_masks(spark):
    turns = [
        ("p", 0, 0, "user", "hi"), ("p", 0, 1, "assistant", "yes"), ("p", 1, 0, "user", "hi"), ("p", 1, 1, "assistant", "nö"), ("p", 1, 2, "user", "why"), ("p", 1, 3, "assistant", ""),
        ("same", 0, 0, "user", "a"), ("same", 1, 0, "user", "a"), ("half", 0, 0, "user", "a"), ("nulls", 0, 0, None, None), ("nulls", 1, 0, "user", "x"), ("nulls", 1, None, "user", "y"), (None, 0, 0, "user", "z"),
        ("ties", 0, 0, "b", "t"), ("ties", 0, 0, "a", "t"), ("ties", 1, 0, "a", "t"), ("ties", 1, 0, "b", "t"), ("ties", 1, 0, "b", "t"),
    ]
    df = spark.createDataFrame([(*t, "x") for t in turns], "pair string, side int, turn long, role string, text string, prompt string")
    got = {r.pair: r for r in preference.format_pairs(df).collect()}
    assert set(got) == {"p", "same", "nulls", "ties"}
    r = got["p"]
    assert r.prompt_turns == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n" and r.chosen == "<|im_start|>assistant\nyes<|im_end|>\n"
    assert [r.chosen[a:b] for a, b in r.chosen_mask] == ["yes<|im_end|>"] and [r.rejected[a:b] for a, b in r.rejected_mask] == ["nö<|im_end|>", "<|im_end|>"]
    assert got["same"].prompt_turns == 1 and got["same"].chosen == got["same"].rejected == "" and got["same"].chosen_mask == []
    assert got["nulls"].prompt_turns == 0 and got["nulls"].chosen == "<|im_start|>\n<|im_end|>\n"
    assert got["ties"].prompt_turns == 2 and got["ties"].rejected.count("im_start") == 1
    assert preference.format_pairs(df.limit(0)).count() == 0
    c = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([("x", 1, 2)], "pair string, chosen long, rejected long")
    assert preference.format_pairs(preference.tagged(c, pairs)).first().prompt_turns == 1


def test_a_very_long_conversation(spark):
    n = 5000
    turns = [("p", side, i, ("user", "assistant")[i % 2], f"t{i}" if i < n - 1 else f"end {side}", "x") for side in (0, 1) for i in range(n)] + [("q", side, 0, "assistant", "z" * 1_000_000 + str(side), "x") for side in (0, 1)]
    df = spark.createDataFrame(turns, "pair string, side int, turn long, role string, text string, at string")
    got = {r.pair: r for r in preference.format_pairs(df).collect()}
    assert got["p"].prompt_turns == n - 1 and [got["p"].chosen[a:b] for a, b in got["p"].chosen_mask] == ["end 0<|im_end|>"]
    assert got["q"].prompt_turns == 0 and [(b - a) for a, b in got["q"].rejected_mask] == [1_000_001 + len("<|im_end|>")]
