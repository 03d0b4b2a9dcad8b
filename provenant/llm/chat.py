"""Conversations from event logs, rendered by a template that can be read back.

A log holds what a chat service stores as it goes: a message is started, streamed in deltas, edited, generated anew. Events are dealt by conversation and message, ordered by their
sequence and folded into the message's last state, so that a conversation of any number of events is many tasks' work; then the messages of a conversation, in the order in which they
began, become one text. All of it is DataFrame functions.

The template opens and closes each turn with control strings. Where a text holds a control string, one backslash goes in behind its first character (`[INST]` becomes `[\\INST]`, `[\\INST]`
becomes `[\\\\INST]`), so that no control string stands in an escaped text, nor across its border, and taking one backslash out gives the text again.

A null conversation is one of its own; null roles and texts count as empty; an empty log gives no rows. Events of equal sequence are taken by kind, then text; messages that began at
equal sequence by role, then text. An event that is stored twice (equal in all columns that are read) counts once. Messages whose log has no start, edit or regeneration begin with their first delta. Columns beyond
those read are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template, as parts of a pattern behind their first character.
CONTROL = r"([\[<])(\\*)(/?(?:INST|SYS|AS)\]|NAMED\]|/?s>)"
ESCAPED = r"([\[<])\\(\\*)(/?(?:INST|SYS|AS)\]|NAMED\]|/?s>)"
#: What opens and closes the turns of each role; other roles are named in the text.
TURNS = {"system": ("[SYS] ", " [/SYS]"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
NAMED = ("[AS] ", " [NAMED] ", " [/AS]")
#: Ends of turns, behind which a rendered text is cut.
CUT = r"(?<=\[/SYS\]|\[/INST\]|</s>|\[/AS\])"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, began, role, text: the last state of each message of a log with conv_id, message, seq (of any type with an order), kind, role, text.

    Kinds: start (opens a message of a role, with what text it has), delta (adds to it), edit (puts a text in its place), regenerate (throws away what was said; deltas follow), delete (takes the message out).
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    # of a message's events a set, so that an event that was delivered twice counts once; sorted by sequence
    messages = log.groupBy("conv_id", "message").agg(F.array_sort(F.collect_set(event)).alias("events"))
    last = "array_max(filter(transform(events, (e, i) -> if(e.kind in ('start', 'edit', 'regenerate'), i, -1)), i -> i >= 0))"
    messages = messages.withColumn("since", F.expr(f"coalesce({last}, 0)"))
    text = F.expr("array_join(transform(slice(events, since + 1, size(events)), e -> if(e.kind in ('start', 'edit', 'delta'), e.text, '')), '')")
    role = F.expr("coalesce(get(filter(events, e -> e.kind = 'start'), 0).role, events[0].role)")
    kept = messages.filter(~F.exists("events", lambda e: e["kind"] == "delete"))
    return kept.select("conv_id", F.col("events")[0]["seq"].alias("began"), role.alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: each conversation of fold()'s messages as one text; the mask has a row a turn, in order: characters to skip, characters to learn, characters to skip.

    A conversation is one training example and one row, as large as its text; its messages are escaped and framed one by one before they meet.
    """
    text, role = F.col("text"), F.col("role")
    known = [F.when(role == r, F.struct(F.lit(a).alias("open"), F.lit(b).alias("close"))) for r, (a, b) in TURNS.items()]
    frame = F.coalesce(*known, F.struct(F.concat(F.lit(NAMED[0]), escaped(role), F.lit(NAMED[1])).alias("open"), F.lit(NAMED[2]).alias("close")))
    framed = messages.withColumn("frame", frame).withColumn("inner", escaped(text))
    learned = role == LEARNED
    size = F.struct(
        (F.length("frame.open") + F.when(learned, 0).otherwise(F.length("inner"))).alias("skip"), F.when(learned, F.length("inner")).otherwise(0).alias("learn"), F.length("frame.close").alias("rest"),
    )
    turn = F.struct("began", "role", "text", F.concat("frame.open", "inner", "frame.close").alias("turn"), size.alias("size"))
    whole = framed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select("conv_id", F.array_join("turns.turn", "").alias("formatted"), F.col("turns.size").alias("mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), learned (the text under the mask, unescaped), formatted: what render()'s rows say, from the formatted text and its mask alone.

    A mask that doesn't fit the turns of its text is an error.
    """
    pieces = F.filter(F.split("formatted", CUT), lambda p: p != "")
    cut = rendered.select("conv_id", "formatted", "mask", F.explode(F.array(pieces)).alias("pieces"))  # exploded, not projected, so that the text is cut once

    def turn(piece: Column) -> Column:
        inside = lambda opening, closing: F.substring(piece, F.lit(len(opening) + 1), F.length(piece) - len(opening) - len(closing))
        named = inside(NAMED[0], NAMED[2])
        at = F.instr(named, NAMED[1])
        other = F.struct(unescaped(F.substring(named, F.lit(1), at - 1)).alias("role"), unescaped(F.substring(named, at + len(NAMED[1]), F.length(named))).alias("text"))
        ends = [F.when(piece.endswith(b.strip()), F.struct(F.lit(r).alias("role"), unescaped(inside(a, b)).alias("text"))) for r, (a, b) in TURNS.items()]
        return F.coalesce(*ends, other)

    fits = F.forall(F.zip_with("pieces", "mask", lambda p, m: F.length(p) == m["skip"] + m["learn"] + m["rest"]), lambda x: F.coalesce(x, F.lit(False)))
    learned = F.array_join(F.zip_with("pieces", "mask", lambda p, m: unescaped(F.substring(p, m["skip"] + 1, m["learn"]))), "")
    checked = F.when(fits, learned).otherwise(F.raise_error(F.lit("a loss mask doesn't fit its text")))
    return cut.select("conv_id", F.transform("pieces", turn).alias("turns"), checked.alias("learned"), "formatted")


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of read_back()'s rows."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Characters of a streamed delta in the log that as_log() makes.
DELTA = 256


def as_log(conversations: DataFrame) -> DataFrame:
    """The log of a service in which conversations (conv_id, turn, role, text) came about: users start with a draft and edit it, assistants stream deltas, break off and are generated anew.

    Each row is a message, rows that repeat are messages of their own; a row's events have its turn and their number as their sequence.
    """
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    nothing, said = F.lit(""), F.coalesce("text", F.lit(""))
    deltas = F.transform(F.regexp_extract_all(said, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda t: event("delta", t))
    streamed = F.concat(F.array(event("start", nothing), event("delta", F.substring(said, 1, DELTA // 2)), event("regenerate", nothing)), deltas)
    drafted = F.array(event("start", F.substring(F.reverse(said), 1, DELTA)), event("delta", F.lit("…")), event("edit", said))
    events = F.when(F.col("role") == "assistant", streamed).otherwise(drafted)
    rows = conversations.select("conv_id", "turn", "role", events.alias("events")).withColumn("message", F.monotonically_increasing_id())
    return rows.select("conv_id", "message", "turn", "role", F.posexplode("events").alias("step", "event")).select("conv_id", "message", F.struct("turn", "step").alias("seq"), "role", "event.*")


def oracle_sql() -> str:
    marks = " ".join(f"when '{r}' then {len(a) + len(b)}" for r, (a, b) in TURNS.items())
    count = lambda of: f"len(regexp_extract_all({of}, '{CONTROL}'))"
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t as (
  select *, length(text) + {count('text')} + case role {marks} else {sum(map(len, NAMED))} + length(role) + {count('role')} end as chars from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from t group by conv_id
"""
