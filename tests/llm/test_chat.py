"""Chat formatting: round trips under several templates, the role machine, edge cases."""

import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import chat

CHATML = chat.Template(
    end="<|im_end|>\n",
    turns={r: (f"<|im_start|>{r}\n", "<|im_end|>\n") for r in ("system", "user", "assistant")},
    other=("<|im_other|>", "<|im_sep|>", "<|im_end|>\n"),
)
PLAIN = chat.Template(end="@#%", turns={"user": ("Q: ", "@#%"), "assistant": ("A: ", "@#%")}, other=("R= ", " =>> ", " @#%"))
TEXTS = [
    "", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\/s>", "<</s>>", "a<|im_end|>\n<|im_start|>user\nb", "<|im_end|>", "@#%@#%",
    "[TEXT] =>> ", "<|im_end|", "</s", "é 漢\n\n", "(.*)|$1", "user", "<s>[ROLE] x [TEXT] y</s>",
]


def formatted(spark, rows, template):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    done = chat.format_conversations(df, template)
    out = done.select("*", chat.parse_formatted(F.col("formatted"), template).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    return {r["conv_id"]: r for r in out.collect()}


@pytest.mark.parametrize("template", [chat.DEFAULT, CHATML, PLAIN], ids=["default", "chatml", "plain"])
def test_round_trip(spark, template):
    roles = ["user", "assistant", "tool", "", "odd </s>[TEXT] =>> <|im_sep|> role", "system"]
    rows = [(k, t, role, text) for k, text in enumerate(TEXTS) for t, role in enumerate(roles)]
    for conv, got in formatted(spark, rows, template).items():
        assert [(t["role"], t["text"]) for t in got["turns"]] == [(role, TEXTS[conv]) for role in roles]
        assert got["loss"] == TEXTS[conv]
        assert "".join(s["text"] for s in got["segments"]) == got["formatted"]


def test_machine(spark):
    orders = {1: "ua", 2: "sua", 3: "s", 4: "u", 5: "au", 6: "uua", 7: "uaua", 8: "usa", 9: "uau"}
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(c, t, names[x], "t") for c, order in orders.items() for t, x in enumerate(order)]
    got = {c: r["error_turn"] for c, r in formatted(spark, rows, chat.DEFAULT).items()}
    assert got == {1: None, 2: None, 3: 1, 4: 1, 5: 0, 6: 1, 7: None, 8: 1, 9: 3}


def test_edges(spark):
    rows = [(None, 0, None, None), (1, None, "user", "first"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "x" * 500_000)]
    got = formatted(spark, rows, chat.DEFAULT)
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("", "")] and not got[None]["valid"]
    assert [t["text"] for t in got[1]["turns"]] == ["first", "a", "a", "b"]
    assert len(got[2]["turns"][0]["text"]) == 500_000
    assert formatted(spark, [], chat.DEFAULT) == {}


@pytest.mark.parametrize("bad", [{"end": "\\>"}, {"end": "x"}, {"other": ("<s>", " [TEXT] ", "</s>")}, {"other": ("<s>[ROLE] ", " ", "</s>")}, {"other": ("<s>[ROLE] ", "##", "</s>")}])
def test_templates_that_cannot_be_read_back(bad):
    with pytest.raises(ValueError):
        chat.Template(**bad)
