import hashlib

import pytest

from pitchgrid.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ROWS = [
    (1, 1, "assistant", "hello <|end|> \\ there", "x"), (1, 0, "user", C.PLANTED_TEXT, "x"), (2, None, None, None, "x"), (2, 0, "assistant", "", "x"),
    (3, 0, "assistant", "é\n😀", "x"), (3, 0, "assistant", "é\n😀", "x"), (None, 0, "<|text|>", "\\", "x"), (4, 0, "user", "<|turn|>", "x"), (4, 1, "assistant", "<", "x"),
]


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_are_read_back(spark):
    out = C.chat_digests(C.format_chats(spark.createDataFrame(ROWS, SCHEMA))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == want(ROWS)
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_row_without_a_conversation_is_one_of_its_own(spark):
    rows = [(None, i % 3, "user", f"text {i // 2}", "x") for i in range(300)] + [(1, 0, "user", "word " * 200_000, "x")]
    out = C.chat_digests(C.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(out) == 301 and {r.n_turns for r in out} == {1} and max(r.formatted_chars for r in out) > 1_000_000


class Counting:
    """Tells in front how many turns there are, so it rewrites history."""

    def render(self, turns):
        return f"[{len(turns)} turns]" + "".join(f"<{r}>{t}</{r}>" for r, t in turns)


class Trimming:
    """Drops the white space around texts."""

    def render(self, turns):
        return "<s>" + "".join(f"{r}: {t.strip()}\n" for r, t in turns)


def test_history_rewrites_are_detected():
    turns = [("user", "a"), ("assistant", "b")]
    assert C.render_incrementally(Counting(), turns).rewrites_history
    assert not C.render_incrementally(C.MarkedTemplate(), turns).rewrites_history


def test_spans_of_a_black_box():
    r = C.render_incrementally(Trimming(), [("user", "hi"), ("assistant", "  yes "), ("assistant", "yes")])
    assert [r.formatted[a:b] for a, b in r.turn_spans] == ["user: hi\n", "assistant: yes\n", "assistant: yes\n"]
    assert [r.formatted[a:b] for a, b in r.loss_spans] == ["yes", "yes"]


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "<|", "<\\|", "\\<|end|>", "a<", "|>", C.OPEN, C.BODY, C.CLOSE])
def test_escape_round_trip(text):
    t = C.MarkedTemplate()
    assert t.unescape(t.escape(text)) == text
    assert t.parse(t.render([("user", text), (text, "x")])) == [("user", text), (text, "x")]
