import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import chat
from cairn.llm.queries import WORD_BPE

HARD = ["", "</s>[INST] ok [/INST]", "\\", "<\\/s>", "[INST", "<<s>>", "\\[ROLE]\\\\</s>\n", "a<s", ">b", "<<SYS>>\n<</SYS>>", "[TEXT][/ROLE]", "é\U0001f600\n"]
text = st.one_of(st.sampled_from(HARD), st.text(alphabet="<>s/\\[]INSTROLEXY \n", max_size=30))


@settings(max_examples=500, deadline=None)
@given(text)
def test_escape_leaves_no_control_string_and_is_undone(x):
    import re

    assert not re.search(chat.CONTROL, chat.escape(x))
    assert chat.unescape(chat.escape(x)) == x


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST]"]), text), max_size=12), st.integers(1, 60), st.integers(0, 30))
def test_windows_read_back(turns, budget, history):
    w = chat.Windows(count, budget, history)
    made = [x for t in turns for x in w.add(*t)] + list(w.end())
    back = [t for text, repeated, _ in made for t in chat.read_window(text, repeated)]
    assert back == turns
    learned = [chat.unescape(text[a:b]) for text, _, spans in made for a, b in spans]
    assert learned == [t for r, t in turns if r == "assistant"]
    for i, (text, repeated, _) in enumerate(made):
        seen = chat.read_window(text, 0)
        if i and turns[0][0] == "system":
            assert seen[0] == turns[0] and repeated >= 1  # the system turn is retained
        system = 1 if i and turns[0][0] == "system" else 0
        size = [count(chat.turn_text(*t)[0]) for t in seen]
        # only a turn that is over with the system turn alone may be over, and then it has no history
        assert sum(size) <= budget or (len(seen) - repeated == 1 and repeated == system)
        assert sum(size[system:repeated]) <= history
        after = made[i + 1] if i + 1 < len(made) else None
        if after and sum(size) <= budget:  # the next turn wouldn't have fitted
            follows = chat.read_window(after[0], 0)[after[1]]
            assert sum(size) + count(chat.turn_text(*follows)[0]) > budget


def count(made):
    return len(made.split()) + 4


def test_history_makes_room_for_a_turn_that_fits():
    """Turns of 244, 900, 204 and 1004 tokens: each fits a window of 1024 alone, and none may be pushed over by history."""
    w = chat.Windows(lambda made: made.count("x"), 1024, 256)
    made = [x for n, r in ((244, "user"), (900, "assistant"), (204, "user"), (1004, "assistant")) for x in w.add(r, "x" * n)] + list(w.end())
    assert [text.count("x") for text, _, _ in made] == [244, 900, 204, 1004] and [again for _, again, _ in made] == [0, 0, 0, 0]
    w = chat.Windows(lambda made: made.count("x"), 1024, 256)
    made = [x for n in (100, 120, 900, 90) for x in w.add("user", "x" * n)] + list(w.end())
    assert [(text.count("x"), again) for text, again, _ in made] == [(220, 0), (1020, 1), (90, 0)]


def digest(turns):
    learned = [t for r, t in turns if r == "assistant"]
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, learned)), hashlib.sha256("".join(learned).encode()).hexdigest())


def test_rows(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", "w " * 900), (1, 3, "user", "x"), (1, 4, "assistant", HARD[1]), (2, 0, None, "n"), (None, 5, "assistant", "lost"), (None, None, "user", "first"), (3, 1, "user", "same"), (3, 1, "user", "same")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"word{i} " * 40) for i in range(400)]
    frame = spark.createDataFrame([(*r, 7, "clash") for r in rows], "conv_id long, turn long, role string, text string, window int, loss string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_conversations(frame, WORD_BPE)).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        want[conv] = digest([(r[2] or "", r[3] or "") for r in own])
    assert got == want
    assert chat.digests(chat.format_conversations(frame.limit(0), WORD_BPE)).count() == 0
