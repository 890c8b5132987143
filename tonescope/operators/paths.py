"""Tool-call paths: argument coercion, canonical form, handle expansion and path matching.

Calls are rows (run_id, idx, tool, args, handle) with `args` a JSON object text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonescope.operators.ordered import BLOCK, number_rows
from tonescope.schema import (ARGUMENT_CHOICES, BOOLEAN_ARGUMENTS, DEFAULT_ARGUMENTS,
                              HANDLE_ARGUMENTS, INTEGER_ARGUMENTS, NON_ACTIONABLE,
                              REQUIRED_ARGUMENTS, SET_ARGUMENTS, TOOL_ARGUMENTS)
from tonescope.session import cut_lineage

REFERENCES = ["ref", "ref_a", "ref_b"]
CALL_BLOCK = 256  # consecutive step numbers whose calls are resolved in one row


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Replace columns by computed ones, evaluated once.

    The values pass through a one-row generator, so later filters read them instead of repeating
    the (long) expressions inside every predicate.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def arguments(calls: DataFrame) -> DataFrame:
    """One row per argument: key, `value` as JSON text and its `kind`."""
    fields = F.try_parse_json("args").cast("map<string,variant>")
    spread = calls.select("*", F.explode_outer(fields).alias("key", "value"))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    return _settled(spread, value=F.to_json("value"), kind=kind)


def _text(value: Column) -> Column:
    """The content of a JSON string literal."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def _quoted(value: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def coerced(args: DataFrame) -> DataFrame:
    """Argument types repaired, choices untouched: '3' to 3, 'true' to true, 'none' to null."""
    said = F.lower(F.trim(_text(F.col("value"))))
    is_text = F.col("kind") == "STRING"
    whole = F.col("key").isin(INTEGER_ARGUMENTS)
    flag = F.col("key").isin(BOOLEAN_ARGUMENTS)
    value = (F.when(whole & is_text & said.rlike(r"^-*[0-9]+$"), said)
             .when(whole & F.col("value").rlike(r"^-?[0-9]+\.0+$"),
                   F.regexp_replace("value", r"\.0+$", ""))
             .when(flag & is_text & said.isin("true", "false"), said)
             .when(is_text & said.isin("none", "null"), F.lit("null")).otherwise(F.col("value")))
    kind = (F.when(value == "null", "VOID").when(value.isin("true", "false"), "BOOLEAN")
            .when(value.rlike("^-?[0-9]+$"), "BIGINT").otherwise(F.col("kind")))
    return _settled(args, value=value, kind=kind)


def _is_default() -> Column:
    tests = [(F.col("tool") == t) & (F.col("key") == k) & (F.col("value") == v)
             for (t, k), v in DEFAULT_ARGUMENTS.items()]
    return reduce(Column.__or__, tests)


def canonical_value(non_actionable=NON_ACTIONABLE) -> Column:
    """A value without what can differ and still mean the same.

    Whole numbers lose their fraction, sets of labels are trimmed, sorted and distinct with the
    shorthand spelled out, and a single label equals a list of one.
    """
    one = F.array(_text(F.col("value")))
    many = F.from_json("value", "array<string>")
    labels = F.transform(F.when(F.col("kind") == "ARRAY", many).otherwise(one),
                         lambda x: F.trim(x))
    spelled = F.flatten(F.transform(labels, lambda x: F.when(
        (F.col("key") == "exclude") & (x == "non_actionable"),
        F.array(*[F.lit(n) for n in non_actionable])).otherwise(F.array(x))))
    as_set = F.to_json(F.array_sort(F.array_distinct(spelled)))
    number = F.regexp_replace("value", r"\.0+$", "")
    return (F.when(F.col("kind").isin("VOID", "BOOLEAN"), F.col("value"))
            .when(F.col("value").rlike(r"^-?[0-9.]"), number)
            .when(F.col("key").isin(SET_ARGUMENTS), as_set)
            .otherwise(_quoted(F.trim(F.coalesce(_text(F.col("value")), F.col("value"))))))


def _nodes(calls: DataFrame) -> DataFrame:
    """Each call as text with a mark where a handle has to be expanded, and its handles."""
    args = arguments(calls.select("run_id", "idx", "tool", "args", "handle"))
    is_ref = F.col("key").isin(REFERENCES)
    piece = F.when(is_ref, F.concat(F.lit("<"), F.col("key"), F.lit(">"))).otherwise(
        canonical_value())
    entry = F.when(F.col("key").isNotNull() & (is_ref | ~_is_default()),
                   F.struct("key", piece.alias("piece")))
    handles = [F.max(F.when(F.col("key") == r, _text(F.col("value")))).alias(r)
               for r in REFERENCES]
    grouped = args.groupBy("run_id", "idx", "tool", "handle").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), *handles)
    body = F.array_join(F.transform("entries", lambda e: F.concat(
        _quoted(e["key"]), F.lit(":"), e["piece"])), ",")
    text = F.concat(F.lit('{"args":{'), body, F.lit('},"tool":'), _quoted(F.col("tool")),
                    F.lit("}"))
    return grouped.select("run_id", "idx", "handle", text.alias("text"), *REFERENCES)


def _mark(key: Column) -> Column:
    return F.concat(F.lit("\u0001"), key, F.lit("\u0001"))


def _marks(text="text") -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("\u0001([^\u0001]+)\u0001"), F.lit(1)))


def _filled(df: DataFrame, keys, answers: DataFrame) -> DataFrame:
    """The texts with every mark replaced by its answer (run_id, mark, answer)."""
    asked = df.select(*keys, "text", F.explode(_marks()).alias("mark"))
    found = asked.join(answers, ["run_id", "mark"]).groupBy(*keys).agg(
        F.first("text").alias("text"), F.collect_list(F.struct("mark", "answer")).alias("_a"))
    return found.select(*keys, F.aggregate(
        "_a", F.col("text"), lambda acc, x: F.replace(acc, _mark(x["mark"]), x["answer"])).alias("text"))


def canonical_calls(calls: DataFrame, block: int = CALL_BLOCK) -> DataFrame:
    """(run_id, idx, signature): every handle replaced by the latest earlier call that produced it, recursively.

    The calls of a run are cut into blocks of `block` step numbers. Inside a block they are resolved in their order, each from
    the finished text of its makers, so a call is one row however long its chain is. A handle of an earlier block leaves a mark
    (block and handle) in the text; only marks go on, distinct ones, one equi-join on (run_id, handle) per block that a chain
    goes back. A handle nobody produced is kept as unresolved.
    """
    slot = F.floor(F.col("idx") / block)
    nodes = _nodes(calls)
    shape = f"array<struct<idx:{nodes.schema['idx'].dataType.simpleString()},handle:string,text:string>>"

    def resolved(done, x):
        def made_by(handle):
            return F.try_element_at(F.filter(done, lambda d: d["handle"] == handle), F.lit(-1))["text"]

        text = x["text"]
        for name in REFERENCES:
            made = made_by(x[name])
            open_ = _mark(F.concat_ws(":", F.col("slot"), x[name]))
            text = F.when(x[name].isNull(), text).otherwise(F.replace(text, F.lit(f"<{name}>"), F.coalesce(made, open_)))
        return F.concat(done, F.array(F.struct(x["idx"].alias("idx"), x["handle"].alias("handle"), text.alias("text"))))

    own = F.array_sort(F.collect_list(F.struct("idx", "handle", "text", *REFERENCES)))
    local = cut_lineage(nodes.groupBy("run_id", slot.alias("slot")).agg(own.alias("p")).select(
        "run_id", "slot", F.inline(F.aggregate("p", F.array().cast(shape), resolved))))
    is_open = F.contains("text", F.lit("\u0001"))
    makers = local.where("handle IS NOT NULL").select("run_id", "handle", F.col("slot").alias("made_in"), F.col("idx").alias("at"),
                                                      F.col("text").alias("answer"))

    def looked_up(df):
        marks = df.select("run_id", F.explode(_marks()).alias("mark")).distinct()
        asked = marks.withColumns({"slot": F.substring_index("mark", ":", 1).cast("bigint"),
                                   "handle": F.expr("substr(mark, instr(mark, ':') + 1)")})
        found = asked.join(makers, ["run_id", "handle"]).where("made_in < slot").groupBy("run_id", "mark").agg(
            F.max_by("answer", "at").alias("answer"))
        nobody = F.concat(F.lit('{"unresolved_ref":'), _quoted(F.col("handle")), F.lit("}"))
        return asked.join(found, ["run_id", "mark"], "left").select(
            "run_id", "mark", F.coalesce("answer", nobody).alias("text"))

    done = local.where(~is_open).select("run_id", "idx", F.col("text").alias("signature"))
    waiting = local.where(is_open).select("run_id", "idx", "text")
    if waiting.isEmpty():
        return done
    answers = cut_lineage(looked_up(waiting))
    while not answers.where(is_open).isEmpty():
        still = answers.where(is_open)
        filled = _filled(still.withColumnRenamed("mark", "stands_for"), ["run_id", "stands_for"],
                         looked_up(still).withColumnRenamed("text", "answer"))
        answers = cut_lineage(answers.where(~is_open).unionByName(filled.withColumnRenamed("stands_for", "mark")))
    told = _filled(waiting, ["run_id", "idx"], answers.withColumnRenamed("text", "answer"))
    return done.unionByName(told.withColumnRenamed("text", "signature"))


def work_steps(steps: DataFrame) -> DataFrame:
    """Validated analysis steps, numbered within the run: the path that is compared to gold."""
    kept = steps.where((F.col("status") == "ok") & (F.col("tool") != "answer"))
    return number_rows(kept.withColumn("_block", F.expr(f"idx div {BLOCK}")), ["run_id"], "_block",
                       ["idx"], "position").drop("_block")


def path_matches(paths: DataFrame, gold: DataFrame) -> DataFrame:
    """(run_id, path_match): whether the path equals its task's gold path, step by step.

    Compared as rows (position, signature), so no path is ever collected into one value. A task
    without gold gives NULL.
    """
    sizes = gold.groupBy("task_id").agg(F.count("*").alias("gold_steps"))
    lengths = paths.groupBy("run_id", "task_id").agg(F.count("position").alias("steps"))
    hits = (paths.join(gold, ["task_id", "position", "signature"], "left_semi")
            .groupBy("run_id").agg(F.count("*").alias("hits")))
    joined = lengths.join(sizes, "task_id", "left").join(hits, "run_id", "left")
    same = (F.col("steps") == F.col("gold_steps")) & (
        F.coalesce("hits", F.lit(0)) == F.col("gold_steps"))
    return joined.select("run_id", "task_id", "steps", "gold_steps",
                         F.when(F.col("gold_steps").isNotNull(), same).alias("path_match"))


def readable_calls(calls: DataFrame) -> DataFrame:
    """(run_id, idx, call): `tool(key='value', ...)`, keys in order.

    Defaults are left out, but for rank's top_k: 3 is its default and None asks for the whole ranking, so it is always
    shown; a log drops arguments passed as None, so a rank call without it gets `top_k=None` back.
    """
    def shown(kind, value):
        single = F.concat(F.lit("'"), _text(value), F.lit("'"))
        return (F.when(kind == "STRING", single).when(kind == "VOID", "None").when(value == "true", "True")
                .when(value == "false", "False")
                .when(kind.isin("DECIMAL", "DOUBLE") & ~value.rlike("[.eE]"), F.concat(value, F.lit(".0")))
                .otherwise(value))

    texts = F.concat(F.lit("["), F.array_join(F.transform(
        F.from_json("value", "array<string>"), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    value = F.when(F.col("kind") == "ARRAY", texts).otherwise(shown(F.col("kind"), F.col("value")))
    hidden = _is_default() & (F.col("key") != "top_k")
    entry = F.when(F.col("key").isNotNull() & ~hidden, F.struct("key", F.concat_ws("=", "key", value).alias("said")))
    restored = F.when((F.col("tool") == "rank") & ~F.exists("_e", lambda e: e["key"] == "top_k"), F.concat(
        "_e", F.array(F.struct(F.lit("top_k").alias("key"), F.lit("top_k=None").alias("said"))))).otherwise(F.col("_e"))
    said = F.array_join(F.transform(F.array_sort(restored), lambda e: e["said"]), ", ")
    return (arguments(calls).groupBy("run_id", "idx", "tool").agg(F.collect_list(entry).alias("_e"))
            .select("run_id", "idx", F.concat("tool", F.lit("("), said, F.lit(")")).alias("call")))


def _member(pairs) -> Column:
    """Whether (tool, key) is one of a small fixed list."""
    tests = [(F.col("tool") == t) & F.col("key").isin(list(keys)) for t, keys in pairs if keys]
    return reduce(Column.__or__, tests)


def argument_audit(calls: DataFrame) -> DataFrame:
    """Every rule a logged call breaks, one row each: (run_id, idx, rule, detail).

    Rules: unknown tool, unknown argument, wrong type, value outside its choices, missing
    argument, a handle never issued before the call, and a handle of the wrong kind.
    """
    known = F.col("tool").isin(list(TOOL_ARGUMENTS))
    base = calls.where(F.col("tool").isNotNull())

    def finding(condition, rule, detail):
        return F.when(condition, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))

    def listed(df, *findings):
        found = F.array_compact(F.array(*findings))
        return df.select("run_id", "idx", F.inline(found))

    # rules about the call as a whole
    none = F.array().cast("array<string>")
    required = F.create_map(*[x for t, keys in REQUIRED_ARGUMENTS.items() for x in (
        F.lit(t), F.array(*[F.lit(k) for k in keys]))])
    absent = F.array_except(F.coalesce(required[F.col("tool")], none),
                            F.coalesce(F.json_object_keys("args"), none))
    missing = F.transform(absent, lambda k: F.struct(F.lit("missing_argument").alias("rule"),
                                                     k.alias("detail")))
    whole = base.select("run_id", "idx", F.inline(F.concat(missing, F.array_compact(
        F.array(finding(~known, "unknown_tool", F.col("tool")))))))

    # rules about one argument; handles are looked up by an equi-join in the same pass
    args = coerced(arguments(base.where(known).drop("handle"))).where(F.col("key").isNotNull())
    given = F.col("kind") != "VOID"
    is_set = F.col("key").isin(SET_ARGUMENTS)
    bad_type = given & ((F.col("key").isin(INTEGER_ARGUMENTS) & (F.col("kind") != "BIGINT"))
                        | (F.col("key").isin(BOOLEAN_ARGUMENTS) & (F.col("kind") != "BOOLEAN"))
                        | (is_set & ~F.col("kind").isin("STRING", "ARRAY"))
                        | (F.col("key").isin([k for _, k in ARGUMENT_CHOICES])
                           & (F.col("kind") != "STRING")))
    outside = reduce(Column.__or__, [
        (F.col("tool") == t) & (F.col("key") == k) & (F.col("kind") == "STRING")
        & ~_text(F.col("value")).isin(choices) for (t, k), choices in ARGUMENT_CHOICES.items()])
    kinds = F.create_map(*[F.lit(x) for t, refs in HANDLE_ARGUMENTS.items()
                           for r, prefix in refs.items() for x in (f"{t}.{r}", prefix)])
    is_ref = F.col("key").isin(REFERENCES)
    used = args.withColumns({
        "handle": F.when(is_ref, _text(F.col("value"))),
        "wanted": F.when(is_ref, kinds[F.concat_ws(".", "tool", "key")])})
    made = (base.where("handle IS NOT NULL AND status = 'ok'").groupBy("run_id", "handle")
            .agg(F.min("idx").alias("made_at")))
    checked = used.join(made, ["run_id", "handle"], "left")
    allowed = _member(TOOL_ARGUMENTS.items())
    form = (F.when(~allowed, "unknown_argument").when(bad_type, "wrong_type")
            .when(outside, "not_a_choice"))
    issued = F.col("made_at").isNotNull() & (F.col("made_at") < F.col("idx"))
    origin = (F.when(is_ref & ~issued, "handle_not_issued")
              .when(is_ref & ~F.startswith("handle", "wanted"), "wrong_handle_kind"))
    single = listed(checked, *[F.when(r.isNotNull(), F.struct(
        r.alias("rule"), F.col("key").alias("detail"))) for r in (form, origin)])
    return whole.unionByName(single)


def repeated_calls(calls: DataFrame) -> DataFrame:
    """Calls whose tool and arguments already occurred earlier in the same run.

    The earliest occurrence comes from an aggregate, so even a call repeated very often is never
    gathered in one task.
    """
    same = F.coalesce(F.to_json(F.try_parse_json("args")), F.lit("{}"))
    keyed = calls.where(F.col("tool").isNotNull()).withColumn("_args", same)
    first = keyed.groupBy("run_id", "tool", "_args").agg(F.min("idx").alias("first_idx"))
    return (keyed.join(first, ["run_id", "tool", "_args"])
            .where(F.col("idx") > F.col("first_idx")).select("run_id", "idx", "tool", "first_idx"))
