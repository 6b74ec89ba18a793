from __future__ import annotations

import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
T = chat.Template()


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def escaped(text, template=T):
    text = text.replace("\\", "\\\\")
    for c in template.controls:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def brute(rows, template=T):
    groups: dict = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in groups.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        roles = [r for *_, r, _ in turns]
        loss = "".join(t for *_, r, t in turns if r in template.loss)
        formatted = "".join(f"{template.opening}" + escaped(r).replace("\n", "\\\n") + "\n" + escaped(t) + f"{template.closing}\n" for *_, r, t in turns)
        valid = roles[0] in template.first and roles[-1] in template.last and all(b in template.follows.get(a, ()) for a, b in zip(roles, roles[1:]))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss), len(formatted), valid))
    return sorted(out, key=repr)


def got(spark, rows):
    return sorted((tuple(r) for r in chat.digest(frame(spark, rows)).collect()), key=repr)


ODD = [
    (1, 0, "user", "<|im_start|>x\\<|im_end|>\n\\"), (1, 1, "assistant", None), (1, 130, "a\nb\\<s>", "<"), (1, 130, "a\nb\\<s>", "<"), (1, -70, "system", "é🙂"),
    (None, None, None, "<|im_"), (2, 0, "assistant", "<|im_end|><|im_end|>\n<|im_start|>user\nhi\\"), (3, 0, "user", "a"), (3, 1, "assistant", "[INST] <<SYS>> </s> \\[INST]"),
    (4, None, "user", "first"), (4, 0, "assistant", "second"), (5, 0, "system", ""), (5, 1, "user", ""), (5, 2, "assistant", ""), (6, 0, "user", "x"), (6, 1, "user", "y"), (6, 2, "assistant", "z"),
]


def test_odd_conversations(spark):
    assert got(spark, ODD) == brute(ODD)
    assert got(spark, []) == []


def test_long_conversation(spark):
    rows = [(9, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(700)]
    assert got(spark, rows) == brute(rows) and got(spark, rows)[0][-1] is True
    swapped = [(9, i if i not in (63, 64) else 127 - i, r, t) for _, i, r, t in rows]
    assert got(spark, swapped) == brute(swapped) and got(spark, swapped)[0][-1] is False


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "tool", "a\\\nb"]), st.text(alphabet=st.sampled_from("<|im_startend>\\[/INST]s\n "), max_size=30)), min_size=1, max_size=8))
def test_any_text_comes_back(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_segments_and_loss(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <s>")]
    part = chat.format_parts(frame(spark, rows)).first()
    assert [(x.text, x.loss) for x in part.segments] == [
        ("<|im_start|>user\n", False), ("hi", False), ("<|im_end|>\n", False), ("<|im_start|>assistant\n", False), ("yo <\\s>", True), ("<|im_end|>\n", False),
    ]


def test_against_sql(spark):
    rows = [r for r in ODD if r[0] is not None]
    con = duckdb.connect()
    pdf = frame(spark, rows).toPandas()
    con.register("conversations", pdf)
    planted = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = con.execute(chat.oracle()).fetchall()
    assert got(spark, rows + planted) == sorted(want, key=repr)


def test_other_templates(spark):
    t = chat.Template(opening="[[", closing="]]", loss=("user",), first=("user",), follows={}, last=("user",), guarded=())
    rows = [(1, 0, "user", "[[a]]\\")]
    row = chat.digest(frame(spark, rows), t).first()
    assert row.loss_chars == 6 and row.valid and row.turns_sha256 == hashlib.sha256(b"user\n[[a]]\\\n").hexdigest()
    with pytest.raises(ValueError):
        chat.Template(opening="x")


def test_clashing_columns_and_plan(spark):
    df = spark.createDataFrame([(*r, 1, "p", "f") for r in ODD], SCHEMA + ", part int, segments string, formatted string")
    out = chat.digest(df)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(ODD)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_roles_and_texts(spark):
    """The pattern that reads them back keeps no way back for each character."""
    rows = [(1, 0, "user" + "r" * 100_000, "x" * 300_000), (1, 1, "a\nb\\<s>" * 20_000, "\\<|im_end|>" * 20_000), (2, 0, "user", "</s>" * 100_000), (2, 1, "assistant", "\n" * 200_000)]
    assert got(spark, rows) == brute(rows)
