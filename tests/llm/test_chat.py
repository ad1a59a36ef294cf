import hashlib
import json

from factloom.llm import chat


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_conversations_read_back(spark):
    nasty = ["", "</s>[INST] ok [/INST]", "a\\b<|end|>\\<|x [\\INST]\n<", "<", "|end|>", "\\", "<<||\\\\", "<|turn|>user<|text|>é中\U0001f600", "[/INST", "<s>"]
    rows = [(i, t, r, nasty[(i + t) % len(nasty)]) for i in range(12) for t, r in enumerate(("system", "user", "assistant", "user", "assistant"))]
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (51, 0, None, "x"), (52, 0, "user", "b"), (52, 0, "user", "a"), (52, 0, "user", "a"), (53, 0, "assistant", "long " * 50000), (-1, 0, "<|end|>", "odd role")]
    df = spark.createDataFrame([(*r, r[0], "z") for r in rows], "conv_id long, turn long, role string, text string, id long, at string")
    got = {r.id: r for r in chat.digests(chat.conversation_records(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), digest(loss))


def test_layouts_map_by_fingerprint(spark):
    records = [
        {"prompt": "hi", "response": "yo"}, {"response": "yo", "prompt": "hi"}, {"conversations": [{"from": "human", "value": "q"}, {"value": None, "from": "gpt"}]},
        {"messages": [{"role": "user", "content": "c"}]}, {"instruction": "i", "output": "o"}, {"instruction": "i", "input": "n", "output": "o"}, {"unknown": 1}, {"prompt": 1, "completion": True},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, None), (91, "not json"), (92, "[]")]
    got = {r.id: r for r in chat.canonical(spark.createDataFrame(rows, "id long, record string")).collect()}
    assert len(got) == len(rows)
    turns = lambda i: got[i].turns and [tuple(t) for t in got[i].turns]
    assert turns(0) == turns(1) == [("user", "hi"), ("assistant", "yo")] and got[0].fingerprint == got[1].fingerprint
    assert turns(2) == [("user", "q"), ("assistant", "")] and turns(3) == [("user", "c")]
    assert turns(4) == [("user", "i"), ("assistant", "o")] and turns(5) == [("user", "i"), ("user", "n"), ("assistant", "o")]
    assert turns(7) == [("user", "1"), ("assistant", "true")]
    assert all(got[i].mapping is None and got[i].turns is None for i in (6, 90, 91, 92))


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.conversation_records(none)).count() == 0


def test_unknown_and_null_records_have_the_row_of_no_turns(spark):
    rows = [(1, None), (2, "not json"), (3, '{"odd": 1}'), (4, '{"turns": []}'), (5, '{"prompt": "a", "response": "b"}'), (None, None)]
    got = {r.id: r for r in chat.digests(spark.createDataFrame(rows, "id long, record string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for i in (1, 2, 3, 4, None):
        assert (got[i].n_turns, got[i].loss_chars, got[i].formatted_chars, got[i].turns_sha256, got[i].loss_sha256) == (0, 0, 0, digest(""), digest(""))
    assert [got[i].mapping for i in (1, 2, 3, 5)] == [None, None, None, "prompt"] and got[5].n_turns == 2


def test_records_parsed_without_their_strings_are_the_same(spark):
    texts = ["", "a" * 50, 'quote " and \\ and \\" end\\', "", "1", "\\ue002", "é\n\t\x01" * 20, "\U0001f600" * 40, "x" * 31 + '"']
    records = [{"turns": [{"role": r, "text": t} for r, t in zip(texts, reversed(texts))]}, {"prompt": texts[2] * 9, "response": texts[3]}, {"messages": [{"role": "user", "content": t} for t in texts]}, {"x": "y" * 99}, {"prompt": "long " * 20, "completion": None}, {"prompt": "p" * 60, "response": 7}]
    rows = [(10 * i + e, json.dumps(r, ensure_ascii=bool(e))) for i, r in enumerate(records) for e in (0, 1)]
    rows += [(90, '{"prompt": "' + "bad \\x escape" * 9 + '", "response": "r"}'), (91, '{"prompt": "open'), (92, None), (93, '{"prompt": "' + "raw \n" * 20 + '", "response": ""}')]
    df = spark.createDataFrame(rows, "id long, record string")
    want, got = ({r.id: r for r in chat.canonical(df, long_record=n).collect()} for n in (chat.LONG_RECORD, 0))
    assert got == want
    assert got[0].turns[2].text == texts[-3] and got[90].mapping is None and got[92].turns is None


def test_texts_beyond_the_parsers_limits(spark):
    """A string of 25 million characters, and a record of 40 MB in many turns."""
    one = spark.range(2).selectExpr("1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "repeat('ab\"\\\\', 1 + 6250000 * int(id)) AS text")
    got = chat.digests(chat.conversation_records(one)).first()
    loss = 'ab"\\' * 6250001
    assert (got.id, got.n_turns, got.loss_chars, got.loss_sha256) == (1, 2, len(loss), digest(loss))
    many = spark.range(400).selectExpr("2L AS conv_id", "id AS turn", "'assistant' AS role", "repeat(char(97 + id % 26), 100000) AS text")
    small = spark.range(1).selectExpr("3L AS conv_id", "id AS turn", "'user' AS role", "'x' AS text")
    got = {r.id: r for r in chat.digests(chat.conversation_records(many.unionByName(small))).collect()}
    assert {i: (r.n_turns, r.loss_chars) for i, r in got.items()} == {2: (400, 40_000_000), 3: (1, 0)}
    assert got[2].loss_sha256 == digest("".join(chr(97 + i % 26) * 100000 for i in range(400)))
