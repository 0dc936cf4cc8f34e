import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from loreforge.llm.chat import chat_digests, escape, format_chats, loss_tokens, op2_chat_formatting, parse, render, unescape

PIECES = st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "</s>", "<s>", "[INST]", "[/INST]", "INST]", "[/ANSWER]", "[TURN ", "] ", " ", "ok", "é", "日", "\n", "[SYS]", "/SYS]", "<\\s>"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(PIECES)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.none(), PIECES), PIECES), max_size=6))
def test_round_trip(turns):
    assert parse("".join(render(r, t)[0] for r, t in turns)) == turns


def test_loss_tokens():
    ends = np.array([3, 3, 7, 10, 12])
    assert loss_tokens(ends, np.array([[4, 8], [10, 11]])).tolist() == [False, False, True, True, True]
    assert not loss_tokens(ends, np.empty((0, 2), np.int64)).any()


def digest(turns):
    """turns: (role, text) in order."""
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def want(rows):
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n is not None, n or 0, r is not None, r or "", t is not None, t or "", r, t))
    return {c: digest([x[-2:] for x in sorted(v, key=lambda x: x[:6])]) for c, v in by.items()}


def test_fixture(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "  two  spaces </s> é日本\n\n"), (1, 2, "assistant", ""), (1, 3, None, "x"), (2, 0, "assistant", None), (2, None, "tool", "[TURN "), (None, 0, "assistant", "no id")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 7)) for i in range(200)]
    rows += [(4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (4, 0, "user", "b"), (5, 0, "assistant", "long " * 30000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, run int").repartition(3)
    for most in (200_000, 300):
        out = format_chats(df, run_chars=most)
        assert {r.conv_id: tuple(r)[1:5] for r in chat_digests(out).collect()} == want(rows)
        for r in out.collect():
            assert len(r.ids) == len(r.loss)
    assert chat_digests(format_chats(df.limit(0))).count() == 0


def test_runs_have_the_ids_of_the_whole(spark):
    texts = ["</s>", "<s>", " lead", "trail \n", "", "é日本", "a<", "\n\n", "[/INST]</s>", "don't", "12345", "  "]
    rows = [(1, i, ["user", "assistant", "system", "tool"][i % 4], texts[i * 7 % 12] + texts[i * 5 % 12]) for i in range(120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, runs = (sorted(format_chats(df, run_chars=n).collect(), key=lambda r: r.run) for n in (10**6, 40))
    assert len(whole) == 1 and len(runs) > 50
    assert whole[0].ids == [i for r in runs for i in r.ids] and whole[0].loss == [i for r in runs for i in r.loss]
    assert whole[0].formatted == "".join(r.formatted for r in runs)


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    told = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", told), (-1, 1, "assistant", told)]
    got = {r.conv_id: tuple(r)[1:5] for r in op2_chat_formatting(spark, small).collect()}
    assert got == want(rows)
