import hashlib
import random

import public_tokenizers as P

from tidewatch.llm import chat_format as chat

PATH = P.path("byte_bpe_50k.tiktoken")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(2)
    bits = [*chat.CONTROLS, "\\", "<", "s>", "[", "/INST]", "x", " ", "<\\s>", "[\\\\INST]", "<<", "SYS>>"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROLS)


def test_conversations_read_back(spark):
    rows = [
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
        (1, 2, "assistant", None), (1, 0, "system", "être"), (1, 1, "user", ""), (1, 3, "assistant", "two\nlines" + "z" * 50_000),
        (2, 0, "tool<s>", "日本"), (2, 0, "tool<s>", "日本"), (2, 1, None, "a"), (None, 1, "user", "q"), (None, None, "assistant", "first"), (3, 0, "assistant", "a"), (3, 1, "assistant", "b"),
    ]
    turns = spark.createDataFrame([(*r, 5, b"x") for r in rows], "conv_id long, turn long, role string, text string, lead int, ids binary")
    formatted = chat.format_conversations(turns, PATH, P.PATTERN)
    got = {r.conv_id: r for r in chat.read_back(formatted, PATH, P.PATTERN).collect()}
    assert set(got) == {-7, 1, 2, 3, None}
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert got[-7].formatted_chars == len("[INST]<\\/s>[\\INST] ok [\\/INST][/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>")
    assert chat.read_back(chat.format_conversations(turns.limit(0), PATH, P.PATTERN), PATH, P.PATTERN).count() == 0
