import random

import pytest
from pyspark.sql import functions as F

from cellgauge.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string"


#: A template with other marks, made of characters that patterns treat specially.
BRACES = chat.Template(
    (chat.Role("user", "Q.", False, ("bot", "user")), chat.Role("bot", "A*", True, ("user",), may_end=True)),
    starts=("user",), opening="{{(", after=")}} ", lead="$", closing="[end]", tail="",
)


def formatted(spark, rows, template=chat.Template()):
    made = chat.format_chat(spark.createDataFrame(rows, TURNS), template)
    read, loss = chat.read_chat(F.col("formatted"), template), chat.loss_text(F.col("segments"), template)
    return made.select("*", read.alias("read"), loss.alias("loss")).collect()


@pytest.mark.parametrize("template", [chat.Template(), chat.CHATML, BRACES])
def test_any_text_comes_back(spark, template):
    rng = random.Random(8)
    marks = [*template.controls, template.close, template.opening, template.mark("x"), *[template.mark(r.label) for r in template.roles]]
    bits = [*marks, *[m[: len(m) // 2] for m in marks], "###", "#", "</turn>", " </turn>\n", "\\", "### Assistant: ", "### [x]: ", "]", "[", ": ", "\n", " ", "a", "é", "<", "$1"]
    roles = ["user", "assistant", "bot", "system", "tool", "User", "a]b", "\\", "", "x\ny"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choices(bits, k=rng.randint(0, 8)))) for c in range(300) for t in range(rng.randint(1, 5))]
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role, text))
    got = formatted(spark, rows, template)
    trained = {r.name for r in template.roles if r.loss}
    assert {r.conv_id: [tuple(t) for t in r["read"]] for r in got} == want
    for r in got:
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role in trained)
        assert "".join(s.text for s in r.segments) == r.formatted
        assert all(not s.loss for s in r.segments[0::3]) and all(not s.loss for s in r.segments[2::3])


@pytest.mark.parametrize("roles, error", [
    ("system user assistant", None), ("user assistant user assistant", None), ("assistant user", 0), ("user user assistant", 1),
    ("user assistant user", 3), ("system assistant", 1), ("user tool assistant", 1), ("user assistant system", 2), ("system", 1),
])
def test_turn_order(spark, roles, error):
    row, = formatted(spark, [(1, i, r, "x") for i, r in enumerate(roles.split())])
    assert (row.valid, row.error_turn) == (error is None, error)


def test_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "a"), (1, 1, None, "a"), (None, 0, "user", "q"), (None, None, "assistant", "first"), (2, 0, "assistant", "x" * 100_000)]
    by = {r.conv_id: r for r in formatted(spark, rows)}
    assert [tuple(t) for t in by[1]["read"]] == [("user", ""), ("", "a"), ("", "a")]
    assert [tuple(t) for t in by[None]["read"]] == [("assistant", "first"), ("user", "q")]
    assert by[2].loss == "x" * 100_000 and not by[2].valid
    df = spark.createDataFrame(rows, TURNS).withColumn("segments", F.lit(1)).withColumn("turns", F.lit(2))
    assert chat.format_chat(df).count() == 3
    assert chat.format_chat(df.limit(0)).count() == 0


def test_other_templates(spark):
    row, = formatted(spark, [(1, 0, "user", "a <|im_end|> b"), (1, 1, "assistant", "c")], chat.CHATML)
    assert row.formatted == "<|im_start|>user\na \\<|im_end|> b\n<|im_end|>\n<|im_start|>assistant\nc\n<|im_end|>\n" and row.valid
    row, = formatted(spark, [(1, 0, "user", "x"), (1, 1, "user", "[end]"), (1, 2, "bot", "{{(")], BRACES)
    assert row.formatted == "{{(Q.)}} x$[end]{{(Q.)}} \\[end]$[end]{{(A*)}} \\{{($[end]" and row.valid
    for wrong in ({"lead": ""}, {"closing": " "}, {"opening": "a\\b"}):
        with pytest.raises(ValueError):
            chat.Template(**wrong)


def test_the_query_keeps_the_machine(spark, sf):
    from cellgauge.llm.queries import QUERIES

    plan = QUERIES["op2_chat_formatting"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "allowed" in plan and "user\nassistant" in plan.replace("\\n", "\n")


def test_a_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(20_000)]
    made = chat.format_chat(spark.createDataFrame(rows, TURNS).repartition(4))
    row = made.select("valid", F.size("segments").alias("n"), F.length("formatted").alias("chars")).first()
    assert row.valid and row.n == 60_000
