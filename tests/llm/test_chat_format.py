import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import chat_format
from touchline.llm.common import stored

HARD = ["\\", "###", "</turn>", "### User: ", "#", "\n", "</tu", "rn>", "a", "### \"x\": ", "\\###", "😀", " "]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "a\"b%", "", "###", "x\n"]),
                          st.lists(st.sampled_from(HARD), max_size=8).map("".join)), max_size=5))
@settings(max_examples=400, deadline=None)
def test_any_conversation_parses_back(turns):
    rendered = "".join(chat_format.render(*turn)[0] for turn in turns)
    assert [t[:2] for t in chat_format.parse(rendered)] == turns


def test_plain_texts_stay_as_they_are():
    assert chat_format.render("user", "a \\ b # c")[0] == "### User: a \\ b # c\n</turn>\n"


@pytest.mark.parametrize("text", ["x", "### User: open", "### User: a\n</turn>", "### User: a</turn>\n", "### Nobody: a\n</turn>\n"])
def test_other_texts_are_refused(text):
    with pytest.raises(chat_format.Malformed):
        chat_format.parse(text)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_and_edges(spark):
    rows = [
        (1, 1, "assistant", "\\### Assistant: </turn> ok", "extra"), (1, 0, "user", None, "extra"),
        (2, 0, "assistant", "é😀", ""), (2, 1, "assistant", "", ""), (None, 0, None, "no one", ""),
        (3, 5, "tool", "t", ""), (3, 5, "tool", "t", ""), (4, None, "user", "x" * 200_000, ""),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    formatted = stored(chat_format.format_chats(frame), "test-chats")
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    one = got[1]
    assert one.turns_sha256 == digest("user\n\nassistant\n\\### Assistant: </turn> ok\n")
    assert (one.n_turns, one.loss_chars, one.loss_sha256) == (2, 26, digest("\\### Assistant: </turn> ok"))
    assert (got[2].loss_chars, got[2].loss_sha256) == (2, digest("é😀"))
    assert got[3].n_turns == 2 and got[3].turns_sha256 == digest("tool\nt\ntool\nt\n")
    assert got[None].turns_sha256 == digest("\nno one\n") and got[4].formatted_chars == 200_000 + len("### User: \n</turn>\n")
    text = "".join(r.rendered for r in formatted.where("conv_id = 1").orderBy("seq").collect())
    assert len(text) == one.formatted_chars
    assert chat_format.format_chats(frame.limit(0)).count() == 0
    assert chat_format.read_back(formatted.limit(0)).count() == 0
