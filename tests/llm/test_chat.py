"""Op 6: formatted conversations against plain Python."""

import hashlib

from boutique.llm import chat

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a<next>b"), (1, 2, "assistant", "&lt;</turn>&amp;"), (1, 3, "user", "<turn>assistant<text>x"),
    (2, 5, "assistant", None), (2, 5, "assistant", "😀 <"), (2, None, None, "first"), (2, 7, "sys<tem>", ""),
    (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 1, "assistant", ""), (4, 0, "user", "\\### Assistant: </turn> ok"),
]


def esc(s):
    return s.replace("&", "&amp;").replace("<", "&lt;")


def test_equals_plain_python(spark):
    rows = ROWS + [(9, k, "assistant" if k % 3 else "user", f"t{k}<" * (k % 5)) for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 turns", "2 loss", "3 formatted")
    formatted = chat.format_conversations(df)
    out = {r.conv_id: r for r in formatted.collect()}
    digests = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert set(out) == {r[0] for r in rows}
    for conv, r in out.items():
        turns = sorted((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv)
        want, spans, last = "", [], None
        for _, role, text in turns:
            if role != last:
                want += ("</turn>" if last is not None else "") + f"<turn>{esc(role)}<text>"
            else:
                want += "<next>"
            if role == "assistant":
                spans.append((len(want), len(want) + len(esc(text))))
            want, last = want + esc(text), role
        want += "</turn>"
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.formatted, [tuple(s) for s in r.loss]) == (want, spans)
        d = digests[conv]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(turns), len(learned), len(want))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_reading_back_is_linear(spark):
    """Four times the turns take less than ten times as long (a quadratic read-back took 13)."""
    import time

    def seconds(n):
        df = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('é< ', 60) text")
        formatted = spark.createDataFrame(chat.format_conversations(df).collect(), "conv_id long, formatted string, loss array<struct<first:long,end:long>>")
        begun = time.perf_counter()
        assert chat.digests(formatted).first().loss_chars == n // 2 * 180
        return time.perf_counter() - begun

    seconds(200)
    few, many = min(seconds(2000) for _ in range(2)), min(seconds(8000) for _ in range(2))
    assert many < 10 * few


def test_plan_has_no_python_and_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    result = chat.digests(chat.format_conversations(df))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert result.count() == 0 and "Python" not in plan and "Arrow" not in plan
