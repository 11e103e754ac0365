import hashlib

from kgjobs.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, formatted string"
ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "assistant", "there"), (1, 3, "user", None),
    (2, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "user", "<\\/s>[\\\\INST][AND]<s>"), (2, 2, "assistant", ""),
    (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "assistant", "a"), (3, 5, "user", "a"),
    (4, 0, None, "no role"), (5, 0, "ro[INST]le", "日本🙂é"), (None, 0, "assistant", "alone"),
    (6, 0, "assistant", "x\n" * 20_000),
]


def brute(rows, loss_role="assistant"):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == loss_role)
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "other") for r in ROWS], SCHEMA)
    got = chat.chat_digest(chat.format_chats(df)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(ROWS)
    assert len(got) == 7


def test_merges_and_escapes(spark):
    df = spark.createDataFrame([(*r, "other") for r in ROWS], SCHEMA)
    text = {r.conv_id: r.formatted for r in chat.format_chats(df).collect()}
    assert text[1] == "<s>user[INST]hello[/INST]</s><s>assistant[INST]hi[AND]there[/INST]</s><s>user[INST][/INST]</s>"
    assert text[2].count("</s>") == text[2].count("<s>") == 2  # those in texts are escaped


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.chat_digest(chat.format_chats(df)).collect() == []


def test_many_turns_cross_blocks(spark):
    """Offsets run on from block to block, in code points and in bytes."""
    n = 3 * chat.BLOCK + 7
    rows = [(k % 2, k // 2, ("user", "assistant")[k // 2 % 3 != 0], f"<s>日{k}🙂" * (k % 4)) for k in range(2 * n)]
    rows += [(2, k, "assistant", "x") for k in range(chat.BLOCK)]
    formatted = chat.format_chats(spark.createDataFrame([(*r, "other") for r in rows], SCHEMA)).cache()
    got = chat.chat_digest(formatted).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    for r in formatted.collect():
        raw, texts = r.formatted.encode(), [t for c, _, role, t in sorted(rows, key=lambda x: x[:2]) if c == r.conv_id and role == "assistant"]
        cut = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert cut == [raw[s.byte_start : s.byte_start + s.byte_length].decode() for s in r.loss_spans] == [t.replace("<s>", "<\\s>") for t in texts]
