"""Formatted conversations, read back."""

import hashlib
import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gradeframe.llm.chat_format import BEGIN, END, NEXT, escaped, format_report, formatted, read_loss, read_turns, sums_before, unescaped

SCHEMA = "conv_id long, turn long, role string, text string, turns int, id int"
ODD = ["\\", "#", "##", "###", "<next>", "</turn>", "</turn>\n", "\n", ": ", ":", "User", "Assistant", "### Assistant: ", "é", "😀", "<", "n", "/", " ", "\x00"]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((turn is not None, turn or 0), role or "", text or "") for c, turn, role, text in rows if c == conv)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        lines = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        out[conv] = (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def report(spark, rows):
    data = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA).repartition(3)
    return {r[0]: tuple(r)[1:5] for r in format_report(data).collect()}


def test_template(spark):
    rows = [(1, 1, "user", "Hi"), (1, 0, "system", "Be brief."), (1, 2, "assistant", "Hello"), (1, 3, "assistant", "there"), (1, 4, "tool", "é")]
    row = formatted(spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)).first()
    assert row["formatted"] == ("### System: Be brief.</turn>\n### User: Hi</turn>\n"
                                "### Assistant: Hello<next>there</turn>\n### tool: é</turn>\n")
    raw = row["formatted"].encode()
    assert [raw[s["start"]:s["end"]].decode() for s in row["loss_spans"]] == ["Hello", "there"]


def test_reads_back_what_was_there(spark):
    rnd = random.Random(5)
    rows = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    roles = ["user", "assistant", "system", "User", "a: b", "", None, "Assistant", "</turn>\n", "\\User", "x:"]
    for conv in range(60):
        for turn in range(rnd.randint(1, 9)):
            text = "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 12)))
            rows.append((conv, turn, rnd.choice(roles[:3] * 3 + roles), rnd.choice([text, text, None, ""])))
    # Missing and equal turn numbers, repeated rows, rows without a conversation.
    rows += [(100, None, "user", "b"), (100, None, "user", "a"), (100, 1, "user", "c"), (100, 1, "assistant", "c"), (100, 1, "user", "c")]
    rows += [(None, 0, "user", "x"), (None, 0, "assistant", None)]
    assert report(spark, rows) == expected(rows)


def test_long_conversations(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"turn {i} é<next>") for i in range(5000)]
    assert report(spark, rows) == expected(rows)
    data = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    out = formatted(data).select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t["text"] for t in out["turns"]] == [r[3] for r in rows]
    assert out["loss"] == "".join(r[3] for r in rows if r[2] == "assistant")


def test_empty_table(spark):
    data = spark.createDataFrame([], SCHEMA)
    assert formatted(data).collect() == [] and format_report(data).collect() == []


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 255, 256, 257, 513, 3000)]
    for row in spark.createDataFrame(rows, "v array<long>").select("v", sums_before(F.col("v")).alias("sums")).collect():
        assert row["sums"] == [sum(row["v"][:i]) for i in range(len(row["v"]))]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=15).map("".join), min_size=1, max_size=40))
def test_no_text_holds_control_strings(spark, texts):
    data = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"))
    for row in data.select("t", "e", unescaped(F.col("e")).alias("u")).collect():
        assert row["u"] == row["t"]
        assert all(mark not in row["e"] for mark in (BEGIN.strip(), NEXT, END.strip()))


def test_expressions_only(spark):
    data = spark.createDataFrame([], SCHEMA)
    plan = format_report(data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
