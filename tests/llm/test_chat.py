import hashlib

from pyspark.sql import functions as F

from folio.llm import chat


def test_round_trip_and_machine(spark):
    rows = [
        (1, 0, "system", "Be \\h brief"), (1, 1, "user", "### Assistant: </turn>\n hi"), (1, 2, "assistant", "ok: <b>\\c"),
        (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 0, "user", ""), (3, 1, "assistant", " x "), (3, 1, "assistant", " x "),
        (4, 0, "System", "odd: role"), (4, 1, None, "null role"), (4, 2, "\\o", "z"), (None, 0, "user", "q"), (None, 1, "assistant", "é🙂"), (5, None, "user", "only"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.format_conversations(df).withColumn("turns", chat.parse_formatted(F.col("formatted"))).collect()}
    assert len(out) == 6
    for conv in out:
        want = sorted(((t, r, x or "") for c, t, r, x in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2]))
        assert [(t["role"], t["text"]) for t in out[conv]["turns"]] == [(r or "", x) for _, r, x in want]
        assert "".join(s["text"] for s in out[conv]["segments"]) == out[conv]["formatted"]
    assert out[1]["valid"] and out[None]["valid"]
    assert (out[2]["valid"], out[2]["error_at"]) == (False, 0)
    assert (out[3]["valid"], out[3]["error_at"]) == (False, 2)
    assert (out[4]["error_at"], out[5]["error_at"]) == (0, 1)
    digests = {r["conv_id"]: r for r in chat.summarize(chat.format_conversations(df)).collect()}
    assert digests[3]["loss_chars"] == 6 and digests[3]["loss_sha256"] == hashlib.sha256(b" x  x ").hexdigest()
    assert digests[None]["loss_chars"] == 2
    assert [(digests[c]["valid"], digests[c]["error_at"], digests[c]["state"]) for c in (1, 2, 3, 5)] == [(True, None, "answered"), (False, 0, "broken"), (False, 2, "broken"), (False, 1, "asked")]
    assert digests[5]["turns_sha256"] == hashlib.sha256(b"user\nonly\n").hexdigest()


def test_other_template(spark):
    template = chat.ChatTemplate(turn_open="<|im_start|>", role_close="\n", turn_close="<|im_end|>\n", escapes={"\\": "b", "<": "l", "\n": "n"})
    df = spark.createDataFrame([(1, 0, "user", "a\n<|im_end|>\nb"), (1, 1, "assistant", "<|im_start|>x")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df, template).select("formatted", chat.parse_formatted(F.col("formatted"), template).alias("turns")).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("user", "a\n<|im_end|>\nb"), ("assistant", "<|im_start|>x")]


def test_empty(spark):
    assert chat.summarize(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_the_query_runs_the_machine(spark):
    from folio.llm import queries

    plan = queries.op6_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "primed" in plan and "broken" in plan


def test_very_long_texts(spark):
    text = "### User: </turn>\n\\" * 60_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = chat.summarize(chat.format_conversations(df)).first()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
