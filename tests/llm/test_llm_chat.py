import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import chat

TEXT = st.lists(st.sampled_from(["a", "\\", "<turn>", "</turn>", "\n", "l", "<", "é", "🙂"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), TEXT), TEXT), max_size=5))
def test_formatting_is_reversible_and_the_mask_is_the_assistants(turns):
    text, mask = chat.format_turns(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[s:e]) for s, e in mask] == [t for r, t in turns if r == "assistant"]
    assert text.count("<turn>") == len(turns) == text.count("</turn>")


def test_layouts_become_the_same_turns(spark):
    pair = [("user", "hi"), ("assistant", "yo")]
    cases = [
        ({"messages": [{"role": "user", "content": "hi"}, {"content": "yo", "role": "assistant"}]}, "messages", pair),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "conversations", pair),
        ({"completion": "yo", "prompt": "hi"}, "prompt", pair), ({"question": "hi", "answer": "yo"}, "question", pair),
        ({"prompt": "hi", "response": "yo"}, "response", pair), ({"instruction": "hi", "output": "yo"}, "instruction", pair),
        ({"instruction": "a", "input": "b", "output": "yo", "system": None}, "instruction", [("user", "a\n\nb"), ("assistant", "yo")]),
        ({"instruction": {"system": "s", "user": "hi"}, "output": {"text": "yo"}}, "nested", [("system", "s"), *pair]),
        ({"messages": []}, "messages", []), ({"other": 1}, None, None), ([1], None, None), ("not json", None, None), (None, None, None)]
    rows = [(i, None if c is None else c if isinstance(c, str) else json.dumps(c), "x") for i, (c, _, _) in enumerate(cases)]
    out = chat.convert(spark.createDataFrame(rows, "id long, record string, formatted string"), "id", "record").collect()
    for r in out:
        _, name, turns = cases[r.key]
        assert r.mapping == name
        assert (None if r.formatted is None else chat.parse(r.formatted)) == turns
    assert chat.path_hash(chat.paths({"a": [{"b": 1}, {"c": 2}]})) == chat.path_hash({"a", "a[]", "a[].b", "a[].c"})


def test_turn_tables_come_back(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (2, 1, "user", "b"), (2, 0, "system", "a"), (2, 2, "assistant", "c </turn>"),
            (3, 0, None, "x"), (3, 0, None, "x"), (4, 0, "assistant", "only")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.convert(chat.records_of_turns(t), "conv_id", "record")).collect()}
    for conv in (1, 2, 3, 4):
        turns = [(r or "", x or "") for _, _, r, x in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[conv])[1:5] == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    assert chat.convert(chat.records_of_turns(t.where("false")), "conv_id", "record").count() == 0


def test_records_that_cannot_be_formatted_end_no_job(spark):
    deep = "[" * 100_000 + "]" * 100_000
    rows = [(1, deep), (2, '{"prompt": "a", "completion": "\\ud800"}'), (3, '{"prompt": ' + deep + ', "completion": "x"}'), (4, '{"prompt": "a", "completion": "b"}'),
            (5, '{"\\ud800": 1}')]
    out = {r.key: r for r in chat.convert(spark.createDataFrame(rows, "id long, record string"), "id", "record").collect()}
    assert [out[i].formatted is None for i in range(1, 6)] == [True, True, True, False, True]
    assert out[2].fingerprint == out[4].fingerprint and out[2].mapping is None and out[5].fingerprint
