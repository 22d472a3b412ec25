import hashlib

from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import chat


@given(st.lists(st.tuples(st.text("a>\\\n#<turn/ "), st.text("a>\\\n#<turn/ ")), max_size=4))
def test_round_trip(turns):
    formatted = "".join(chat.render(*x) for x in turns)
    assert [(role, chat.unescape(formatted[a:b])) for role, a, b in chat.read_back(formatted)] == turns
    assert [chat.unescape(formatted[a:b]) for a, b in chat.loss_mask(formatted, "a")] == [text for role, text in turns if role == "a"]


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        k: (len(v), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in v).encode()).hexdigest(), sum(len(t) for r, t in v if r == "assistant"), hashlib.sha256("".join(t for r, t in v if r == "assistant").encode()).hexdigest(), sum(len(chat.render(*x)) for x in v))
        for k, v in out.items()
    }


def test_messages(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "é" * 9001), (2, 0, "assistant", None), (3, 1, None, "x"), (3, 0, "user", ""), (None, 0, "user", "n"), (1, 2, "user", "same"), (1, 2, "user", "same"), (-7, 0, "assistant", r"\### Assistant: </turn> ok")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("event", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = {r[0]: tuple(r)[1:] for r in chat.fold(chat.log_of_messages(df)).collect()}
    assert got == brute(rows)
    assert chat.fold(chat.log_of_messages(df.limit(0))).count() == 0


def test_events(spark):
    log = [(1, 0, "delta", None, "lost"), (1, 1, "open", "user", "hel"), (1, 2, "delta", None, "lo"), (1, 3, "open", "assistant", "bad"), (1, 4, "regenerate", None, None), (1, 5, "delta", None, "go"), (1, 6, "delta", None, None), (1, 7, "delta", None, "od"), (1, 8, "open", "user", "x"), (1, 9, "retract", None, None), (1, 10, "open", "user", "y"), (1, 11, "edit", None, "z"), (1, 12, "odd", None, "q")]
    df = spark.createDataFrame(log, "conv_id bigint, seq int, event string, role string, text string")
    found = chat.fold(df, keep_text=True).first()
    formatted = found["formatted"]
    assert [(role, formatted[a:b]) for role, a, b in chat.read_back(formatted)] == [("user", "hello"), ("assistant", "good"), ("user", "z")]
    assert [formatted[m["begin"] : m["end"]] for m in found["loss_mask"]] == ["good"] and found["loss_chars"] == 4


def test_long_texts_take_time_in_proportion(spark):
    """Ten times the text takes about ten times as long, and comes back whole."""
    import time

    from pyspark.sql import functions as F

    took = {}
    for n in (10_000, 800_000, 8_000_000):
        df = spark.createDataFrame([(1, 0, "assistant")], "conv_id bigint, turn bigint, role string").withColumn("text", F.repeat(F.lit("aé\n😀b"), n // 5))
        began = time.time()
        r = chat.fold(chat.log_of_messages(df)).first()
        took[n] = time.time() - began
        assert r.loss_chars == n and r.loss_sha256 == hashlib.sha256(("aé\n😀b" * (n // 5)).encode()).hexdigest()
    assert took[8_000_000] < 25 * took[800_000] + 5
