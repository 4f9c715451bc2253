"""Linking tool calls with their results in conversations; DataFrame functions only.

Calls and results meet in a hash join by (conv_id, call_id). A call stands after all calls it depends on: its rank is
the larger of (its own turn, 0) and (rank of a dependency, one more hop). Dependencies that point back in time change
nothing, so only the stretches of turns that references forward span are ranked, by peeling: a call gets its rank once
all it needs there have theirs. That ends by itself, and the calls that are left are on a loop or behind one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, running_sum

#: Turns in a bucket of the numbering, so that a very long conversation is many tasks.
BUCKET_TURNS = 10_000

#: For each tool its arguments: name, kind (as SQL names the kind of a variant) and whether a call must give it.
Schema = dict[str, tuple[tuple[str, str, bool], ...]]

#: The tools that the registered query knows.
CHAT_TOOLS: Schema = {
    "set_context": (("text", "STRING", True),),
    "ask": (("text", "STRING", True), ("words", "BIGINT", True)),
}


def argument_error(tool: Column, arguments: Column, schemas: Schema) -> Column:
    """Null if ``arguments`` (JSON text) fit the tool's schema, else what is wrong first."""
    parsed = F.try_parse_json(arguments)
    given = F.coalesce(F.json_object_keys(F.when(parsed.isNotNull(), arguments)), F.array().cast("array<string>"))
    out = F.lit("unknown tool")
    for name, fields in schemas.items():
        known = F.array(*[F.lit(f[0]) for f in fields]).cast("array<string>")
        wrong = F.when(F.size(F.array_except(given, known)) > 0, F.concat(F.lit("unknown argument "), F.array_min(F.array_except(given, known))))
        for field, kind, required in reversed(fields):
            value = F.try_variant_get(parsed, F.lit(f"$.{field}"), "variant")
            here = F.array_contains(given, field)
            shown = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
            bad = here & (shown != kind)
            if kind == "BIGINT":  # a number without a fraction is an integer however it is written
                number = F.try_variant_get(parsed, F.lit(f"$.{field}"), "double")
                whole = shown.rlike("^(DECIMAL|DOUBLE|FLOAT)") & F.coalesce(number == F.floor(number), F.lit(False))
                bad = bad & ~whole
            wrong = F.when(bad, F.lit(f"{field} is not {kind}")).otherwise(wrong)
            if required:
                wrong = F.when(~here, F.lit(f"{field} is missing")).otherwise(wrong)
        shape = F.when(~F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False)), "arguments are not an object")
        out = F.when(tool == name, F.when(parsed.isNull(), "arguments are not JSON").otherwise(F.coalesce(shape, wrong))).otherwise(out)
    return out


def stretches(calls: DataFrame, ahead: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, stretch): the calls at turns that references forward span; overlapping spans are one.

    ``ahead``: conv_id, turn and needs_turn of each reference forward. No reference forward leaves a stretch.
    """
    none = F.lit(None).cast(calls.schema["call_id"].dataType)
    ends = [
        ahead.groupBy("conv_id", F.col(column).alias("turn"))
        .agg((F.count(F.lit(1)) * sign).alias("step"))
        .select("conv_id", "turn", none.alias("call_id"), F.lit(kind).alias("kind"), "step")
        for column, kind, sign in (("turn", 0, 1), ("needs_turn", 2, -1))
    ]
    between = calls.select("conv_id", "turn", "call_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("step"))
    points = ends[0].unionByName(ends[1]).unionByName(between)
    keyed = points.withColumn("conv_key", F.col("conv_id").cast("string")).withColumn("turn_bucket", F.floor(F.col("turn") / BUCKET_TURNS))
    order = [F.asc("turn"), F.asc("kind"), F.asc("call_id")]
    inside = running_sum(keyed, "conv_key", "turn_bucket", order, F.col("step"), "open")
    opens = ((F.col("kind") == 0) & (F.col("open") == 0)).cast("long")
    numbered = running_sum(inside, "conv_key", "turn_bucket", order, opens, "stretch")
    return numbered.where("kind = 1 and open > 0").select("conv_id", "call_id", "turn", "stretch")


def ordered(calls: DataFrame, links: DataFrame) -> DataFrame:
    """``calls`` with ``ready`` and ``hops``, their rank in the conversation, and ``looped``: on a loop or behind one.

    ``links`` (conv_id, call_id, turn, needs) may name calls that do not exist; those ask for nothing. Rounds are as
    many as the longest chain of needs inside a stretch and, where there are loops, behind them.
    """
    key = ["conv_id", "call_id"]
    needed = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("needs_turn"))
    pairs = materialise(links.distinct().join(needed, ["conv_id", "needs"]), "needs")
    ahead = pairs.where("needs_turn >= turn")
    if ahead.isEmpty():
        return calls.withColumn("ready", F.col("turn")).withColumn("hops", F.lit(0)).withColumn("looped", F.lit(False))
    placed = materialise(stretches(calls, ahead), "stretches")
    theirs = placed.select("conv_id", F.col("call_id").alias("needs"), F.col("stretch").alias("needs_stretch"))
    inner = materialise(
        pairs.join(placed.select(*key, "stretch"), key).join(theirs, ["conv_id", "needs"]).where("stretch = needs_stretch").select(*key, "needs"), "inner"
    )
    ranks = placed.select(*key, F.col("turn").alias("ready"), F.lit(0).alias("hops"), F.lit(False).alias("done"))
    while True:
        source = ranks.select("conv_id", F.col("call_id").alias("needs"), F.col("ready").alias("r"), (F.col("hops") + 1).alias("h"), "done")
        asked = inner.join(source, ["conv_id", "needs"]).groupBy(*key).agg(F.max(F.struct("r", "h")).alias("asked"), F.min("done").alias("met"))
        own = F.struct(F.col("ready").alias("r"), F.col("hops").alias("h"))
        new = ranks.join(asked, key, "left").withColumn("moved", ~F.col("done") & F.coalesce("met", F.lit(True)))
        best = F.when(F.col("moved"), F.greatest(own, F.coalesce("asked", own))).otherwise(own)
        ranks = materialise(
            new.withColumn("best", best).select(
                *key, F.col("best.r").alias("ready"), F.col("best.h").alias("hops"), (F.col("done") | F.col("moved")).alias("done"), "moved"
            ),
            "ranks",
        )
        if ranks.where("moved").isEmpty():
            break
    stuck = fresh = materialise(ranks.where(~F.col("done")).select(*key), "stuck")
    while not fresh.isEmpty():
        behind = pairs.join(fresh.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"]).select(*key).distinct()
        fresh = materialise(behind.join(stuck, key, "left_anti"), "behind")
        stuck = materialise(stuck.unionByName(fresh), "stuck")
    return (
        calls.join(ranks.select(*key, "ready", "hops"), key, "left")
        .join(stuck.withColumn("looped", F.lit(True)), key, "left")
        .withColumn("ready", F.coalesce("ready", "turn"))
        .withColumn("hops", F.coalesce("hops", F.lit(0)))
        .withColumn("looped", F.coalesce("looped", F.lit(False)))
    )


def link(calls: DataFrame, results: DataFrame, schemas: Schema) -> DataFrame:
    """One row per call, and one per result without a call: conv_id, call_id, step, status, error, message.

    ``calls``: conv_id, call_id, turn, tool, arguments (JSON text), needs (array of call_id). ``results``: conv_id,
    call_id, content. Of several calls or results with the same identifier the first by turn, then by text, counts.
    ``step`` numbers a conversation's calls from 0 in an order that respects ``needs`` (null for a result without a
    call). ``status``: ok, invalid (see ``error``), no_result, no_call, loop (calls that need each other, and calls that
    need such a call, at once or through others). ``message`` is canonical JSON: keys by UTF-16 code units as in RFC 8785,
    no spaces, a decimal without zeros at its end; a number with an exponent is a double and keeps its point. Rows with a
    null conv_id or call_id are not linked and are left out. Empty inputs give an empty result; extra columns are ignored.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = F.min(F.struct("turn", "tool", "arguments", "needs"))
    unique = calls.where(named).groupBy("conv_id", "call_id").agg(first.alias("c")).select("conv_id", "call_id", "c.*")
    unique = materialise(unique.withColumn("turn", F.coalesce("turn", F.lit(0)).cast("long")), "calls")
    answers = results.where(named).groupBy("conv_id", "call_id").agg(F.min(F.struct("content")).alias("answer"))
    links = unique.select("conv_id", "call_id", "turn", F.explode("needs").alias("needs"))
    ranked = ordered(unique, links).withColumn("conv_key", F.col("conv_id").cast("string")).withColumn("turn_bucket", F.floor(F.col("ready") / BUCKET_TURNS))
    stepped = running_sum(
        ranked, "conv_key", "turn_bucket", [F.asc("ready"), F.asc("hops"), F.asc("turn"), F.asc("call_id")], F.lit(1).cast("long"), "step"
    )
    both = stepped.join(answers, ["conv_id", "call_id"], "full_outer")
    error = F.when(F.col("tool").isNull() & F.col("arguments").isNull() & F.col("step").isNull(), F.lit(None)).otherwise(
        argument_error(F.coalesce("tool", F.lit("")), F.coalesce("arguments", F.lit("")), schemas)
    )
    judged = both.withColumn("error", error)
    status = (
        F.when(F.col("step").isNull(), "no_call")
        .when(F.col("looped"), "loop")
        .when(F.col("error").isNotNull(), "invalid")
        .when(F.col("answer").isNull(), "no_result")
        .otherwise("ok")
    )
    message = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"),
            F.col("call_id").alias("id"),
            F.col("answer.content").alias("result"),
            F.col("tool").alias("tool"),
        )
    )
    return judged.select("conv_id", "call_id", "step", status.alias("status"), "error", message.alias("message"))


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chat: a system turn sets the context, a user turn asks, and an assistant turn is the
    result of the turn before it.

    Chat has no tool calls of its own, so what links them is made from the number of words w of a question, that every
    part of ``link`` has work: by w modulo 4, a question needs the next question (0: a reference forward, and a loop
    where that one needs it in turn), the two turns before (1), or nothing. By w modulo 9 its arguments lack the words
    (0), give them as text (1), have a field that no schema knows (2), or are right.

    As in the query's SQL, rows of other roles (a tool turn, say) or without a role are neither calls nor results. A row
    with a null turn has no call_id, and ``link`` leaves it out as it does one with a null conv_id. Of several calls or
    of several results with one (conv_id, call_id), the first by ``link``'s rule counts.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")

    def call(turn: Column) -> Column:
        return F.concat(F.lit("call_"), turn.cast("string"))

    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    alone = F.to_json(F.struct(text.alias("text")))
    ask = (
        F.when(words % 9 == 0, alone)
        .when(words % 9 == 1, F.to_json(F.struct(text.alias("text"), words.cast("string").alias("words"))))
        .when(words % 9 == 2, F.to_json(F.struct(F.lit("x").alias("note"), text.alias("text"), words.alias("words"))))
        .otherwise(F.to_json(F.struct(text.alias("text"), words.alias("words"))))
    )
    turn = F.col("turn")
    needs = F.when(words % 4 == 0, F.array(call(turn + 2))).when(words % 4 == 1, F.array(call(turn - 1), call(turn - 2)))
    is_system = F.col("role") == "system"
    calls = rows.where(F.col("role").isin("system", "user")).select(
        "conv_id",
        call(turn).alias("call_id"),
        "turn",
        F.when(is_system, "set_context").otherwise("ask").alias("tool"),
        F.when(is_system, alone).otherwise(ask).alias("arguments"),
        F.coalesce(F.when(~is_system, needs), F.array().cast("array<string>")).alias("needs"),
    )
    results = rows.where(F.col("role") == "assistant").select("conv_id", call(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
