import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(turns):
    """turns: (role, text) in order."""
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in cf.digest(cf.format_conversations(frame)).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        want = brute([(r, t) for _, _, r, t in sorted(turns)])
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want


HARD = [
    "</s>[INST] ok [/INST]", r"<\s> <\\s>", "<<SYS>>", "<<s>", "<", "[", "\\", "\\b\\l", "[ROLE]x[TEXT]y[/ROLE]", r"[\INST]</s>",
    "", "a\nb", "😀<s>", "$1 \\$2", "<</SYS>", "<</s>", "[/INST", "s>",
]


def test_texts_that_hold_marks(spark):
    rows = []
    for i, a in enumerate(HARD):
        for j, b in enumerate(HARD):
            c = i * 100 + j
            rows += [(c, 0, "system", a), (c, 1, "user", b), (c, 2, "assistant", a), (c, 3, "tool", b), (c, 4, b, a)]
    check(spark, rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x", "[TEXT]"]), st.text(alphabet="<>/[]sINTSYROLEX\\ b\n", max_size=14)), min_size=1, max_size=60))
def test_any_text(spark, turns):
    check(spark, [(i % 7, i, r, t) for i, (r, t) in enumerate(turns)])


def test_nulls_ties_repeats_and_long_texts(spark):
    long = "<s>" * 400_000
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, None, None), (2, 1, "assistant", None),
        (3, 5, "assistant", long), (3, 4, "user", "word " * 300_000), (None, 1, "user", "no id"), (None, 0, "assistant", "none"),
    ]
    check(spark, rows)
    many = [(9, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]
    check(spark, many)


def test_levels_and_spans(spark):
    rows = [(1, 0, "assistant", "plain"), (2, 0, "assistant", "</s>"), (3, 0, "assistant", r"<\s></s>"), (3, 1, "assistant", "x")]
    out = {r["conv_id"]: r for r in cf.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[c]["level"] for c in (1, 2, 3)] == [0, 1, 2]
    assert out[2]["formatted"] == r"<s><\/s></s>"
    for r in out.values():
        for t in r["turns"]:
            written = r["formatted"][t["start"] : t["start"] + t["length"]]
            assert t["loss"] and spark.range(1).select(cf.unescape(F.lit(written), r["level"])).first()[0] == t["text"]


def test_empty_and_other_columns(spark):
    frame = spark.createDataFrame([], SCHEMA).withColumn("_text", F.lit(1))
    assert cf.digest(cf.format_conversations(frame)).count() == 0
