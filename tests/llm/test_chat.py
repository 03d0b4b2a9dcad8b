"""Chat formatting against a plain fold, a plain template and round trips."""

import hashlib

import pytest
from compare import connection, rows_of, rows_of_sql
from pyspark.sql import functions as F

from provenant.llm import chat, registry

LOG = "conv_id bigint, message bigint, seq bigint, kind string, role string, text string"
ROWS = "conv_id bigint, turn bigint, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "[\\INST] [\\\\/INST] <\\s>", "[", "<", "\\", "[[INST]", "</s", "", "a\n[SYS]\r\n", "[NAMED] [AS] [/AS] [/NAMED]", "é[INST]𝔸", " </s> ", "<s>" * 50, "[" + "\\" * 2000]


def plain_fold(events):
    """A message is said, changed and taken back, event by event."""
    messages = {}
    for conv, message, seq, kind, role, text in sorted(set(events), key=lambda e: (e[2], e[3], e[5] or "", e[4] or "")):
        m = messages.setdefault((conv, message), {"began": seq, "role": None, "first": role or "", "text": "", "gone": False})
        if kind == "start" and m["role"] is None:
            m["role"] = role or ""
        if kind in ("start", "edit"):
            m["text"] = text or ""
        elif kind == "delta":
            m["text"] += text or ""
        elif kind == "regenerate":
            m["text"] = ""
        m["gone"] |= kind == "delete"
    return sorted((conv, m["began"], m["first"] if m["role"] is None else m["role"], m["text"]) for (conv, _), m in messages.items() if not m["gone"])


def test_fold_is_a_plain_fold(spark):
    events = [
        (1, 1, 1, "start", "user", "Hi"), (1, 1, 2, "delta", None, " there"), (1, 2, 3, "start", "assistant", ""), (1, 2, 4, "delta", None, "wrong"), (1, 2, 5, "regenerate", None, None),
        (1, 2, 6, "delta", None, "ri"), (1, 2, 8, "delta", None, "ght"), (1, 1, 7, "edit", None, "Hello"), (1, 2, 8, "delta", None, "ght"), (1, 3, 9, "start", "user", "gone"), (1, 3, 10, "delete", None, None),
        (2, 1, 1, "delta", "user", "no start"), (2, 1, 2, "delta", None, None), (2, 2, 2, "start", None, "x"), (2, 2, 3, "edit", None, ""), (2, 2, 4, "delta", None, "y"),
    ]
    found = chat.fold(spark.createDataFrame(events, LOG).repartition(3))
    assert sorted((r.conv_id, r.began, r.role, r.text) for r in found.collect()) == plain_fold(events)


def test_order_of_arrival_does_not_matter(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"{NASTY[(c + t) % len(NASTY)]} word" * (t * 40)) for c in range(5) for t in range(6)]
    log = chat.as_log(spark.createDataFrame(rows, ROWS)).persist()
    one = chat.fold(log).groupBy("conv_id", "role", "text").count()
    other = chat.fold(log.orderBy(F.rand(1)).repartition(7)).groupBy("conv_id", "role", "text").count()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    log.unpersist()


def test_escapes_are_reversible_and_hide_control_strings(spark):
    import re

    rows = spark.createDataFrame([(x,) for x in NASTY + [a + b for a in NASTY[:9] for b in NASTY[:9]]], "t string")
    for r in rows.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not re.search(r"\[/?(INST|SYS|AS)\]|\[NAMED\]|</?s>", r.e)


def expected(rows):
    by, out = {}, {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_odd_conversations(spark):
    rows = [(c, t, r, x) for c, r in enumerate(["system", "user", "assistant", "tool", "[NAMED] x", None, ""]) for t, x in enumerate([*NASTY, None])]
    rows += [(100, 1, "user", "same")] * 3 + [(100, 1, "assistant", "tie"), (100, None, "user", "no turn"), (None, 1, "assistant", "no id"), (101, 5, "assistant", "a" * 300_000 + "</s>"), (102, 1, "user", None)]
    frame = spark.createDataFrame(rows, ROWS).withColumn("EVENTS", F.lit(1)).withColumn("message", F.lit(2)).withColumn("seq", F.lit(3))
    read = chat.read_back(chat.render(chat.fold(chat.as_log(frame)))).persist()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(read).collect()}
    assert got == expected(rows)
    assert {r.formatted for r in read.filter("conv_id = 102").collect()} == {"<s>[INST]  [/INST]"}
    read.unpersist()


def test_format_is_the_template(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Say </s>"), (1, 2, "assistant", "</s>"), (1, 3, "tool", "ok")]
    found = chat.render(chat.fold(chat.as_log(spark.createDataFrame(rows, ROWS)))).first()
    assert found.formatted == "[SYS] Be brief. [/SYS]<s>[INST] Say <\\/s> [/INST] <\\/s> </s>[AS] tool [NAMED] ok [/AS]"
    assert [tuple(m) for m in found.mask] == [(15, 0, 7), (19, 0, 8), (1, 5, 5), (20, 0, 6)]


def test_a_wrong_mask_is_an_error(spark):
    rendered = chat.render(chat.fold(chat.as_log(spark.createDataFrame([(1, 0, "assistant", "x")], ROWS))))
    with pytest.raises(Exception, match="loss mask"):
        chat.read_back(rendered.withColumn("mask", F.expr("transform(mask, m -> named_struct('skip', m.skip, 'learn', m.learn + 1, 'rest', m.rest))"))).collect()


def test_empty_table(spark):
    assert chat.digests(chat.read_back(chat.render(chat.fold(chat.as_log(spark.createDataFrame([], ROWS)))))).collect() == []


def test_query_is_its_sql(spark):
    data = "/root/testdata/sf0.001"
    assert rows_of(registry.op12_chat_format(spark, data)) == rows_of_sql(connection(data), chat.oracle_sql())
