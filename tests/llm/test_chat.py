import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.llm import chat

T = chat.TEMPLATE
HARD = "a<[]>\\/sINST \n</s>[INST] \\\\<<SYS>>é\U0001f600"


@settings(max_examples=300)
@given(st.text(HARD, max_size=40), st.sampled_from(["system", "user", "assistant", "", "tool", "x<]\\[>> ", "ROLE"]))
def test_escaping_is_reversible_and_hides_controls(text, role):
    (opening, _), (body, loss), (close, _) = T.segments(role, text)
    assert T.unescaped(body) == text and chat.role_of(opening) == role and loss == (role == "assistant")
    # outside escapes no text holds a sign that starts a control string
    rest = body
    while "\\" in rest:
        at = rest.index("\\")
        rest = rest[:at] + rest[at + 2 :]
    assert not set(rest) & set(T.openers)


def test_machine():
    def run(*roles):
        s = "start"
        for r in roles:
            s = T.next_state(s, r)
        return s in T.final

    assert run("user", "assistant") and run("system", "user", "assistant", "user", "assistant")
    assert not any([run("assistant"), run("user"), run("user", "user", "assistant"), run("system", "assistant"), run("user", "assistant", "system", "user", "assistant"), run("tool", "user", "assistant"), run()])


ROWS = [
    (1, 1, "assistant", "yes <s>"), (1, 0, "user", "hi [INST]"), (2, 0, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (3, None, "tool", "x"),
    (None, 0, "user", "u"), (None, 1, "assistant", "a" * 300_000), (4, 0, "user", "q"), (4, 1, "user", "q"), (4, 2, "assistant", "r"), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "\\"),
] + [(6, i, "user" if i % 2 == 0 else "assistant", f"t{i}<") for i in range(25_000)]


def test_conversations(spark):
    df = spark.createDataFrame([(*r, "c", 1) for r in ROWS], "conv_id long, turn long, role string, text string, state string, segment int")
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.format_chats(df.repartition(4))).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5, 6}
    for c, row in got.items():
        turns = sorted(((t if t is not None else -1), r or "", x or "") for i, t, r, x in ROWS if i == c)
        spoken = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(s for _, r, x in turns for s, _ in T.segments(r, x))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert row[:5] == (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(spoken), digest(spoken), len(whole))
    assert {c: r[5] for c, r in got.items()} == {None: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: False if len(ROWS) % 2 else True}
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0
