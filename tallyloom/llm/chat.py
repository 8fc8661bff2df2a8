"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON (SQL functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, shared_table

#: Tools' arguments: field -> (type, required). Types are JSON's: string, integer, number, boolean, array, object.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
_VARIANT = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments (JSON text) of a call: a sorted array, empty if they fit the tool's schema."""
    value = F.try_parse_json(arguments)
    out = F.when(name.isNull(), F.array(F.lit("no tool")))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            path = "$." + field
            found = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            missing = F.try_variant_get(value, path, "variant").isNull() | (found == "VOID")
            checks.append(F.when(missing, F.lit(f"{field}: missing") if required else F.lit(None)).when(~found.rlike(f"^{_VARIANT[kind]}$"), F.lit(f"{field}: not {kind}")))
        unknown = F.transform(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*[F.lit(f) for f in fields]).cast("array<string>")), lambda k: F.concat(k, F.lit(": unknown")))
        listed = F.array_sort(F.concat(F.filter(F.array(*checks).cast("array<string>"), lambda c: c.isNotNull()), unknown))
        bad = F.when(value.isNull() | ~F.schema_of_variant(value).rlike("^OBJECT<"), F.array(F.lit("not an object"))).otherwise(listed)
        out = out.when(name == tool, bad)
    return out.otherwise(F.array(F.lit("unknown tool")))


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no white space; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def quoted(name: str) -> Column:
    """The JSON text of a string column: that of a structure of it, less {"v": and }."""
    return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.expr(f"substring(to_json(struct({name} as v)), 6, length(to_json(struct({name} as v))) - 6)"))


def _rounds(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv, call and level by depth: 0 without dependencies, else one above the highest; rounds end when none is added."""
    left = shared_table(edges.select("conv", "call", "needs").distinct(), "chat-edges")
    blocked = left.select("conv", "call").distinct()
    done = shared_table(calls.join(blocked, ["conv", "call"], "left_anti").select("conv", "call", F.lit(0).alias("level")), "chat-levels")
    new = done
    while not new.isEmpty():
        ready = left.join(done.select("conv", F.col("call").alias("needs"), "level"), ["conv", "needs"], "left").groupBy("conv", "call").agg(
            F.min(F.col("level").isNotNull()).alias("all"), (F.max("level") + 1).alias("level")
        )
        new = shared_table(ready.where("all").drop("all").join(done, ["conv", "call"], "left_anti"), "chat-levels")
        done = shared_table(done.union(new.select("conv", "call", "level")), "chat-levels")
    return done


def _jumps(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """The same where no call needs more than one other: pointers to what a call needs are doubled, so rounds follow the depth's logarithm.

    A pointer that still leads on when it has jumped over more calls than there are ends in a cycle.
    """
    most = calls.count()
    needed = edges.select("conv", "call", F.col("needs").alias("up"))
    table = shared_table(calls.select("conv", "call").join(needed, ["conv", "call"], "left").withColumn("level", F.col("up").isNotNull().cast("int")), "chat-jumps")
    reach = 1
    while reach <= most and not table.where("up is not null").isEmpty():
        far = table.select("conv", F.col("call").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        step = table.join(far, ["conv", "up"], "left").select("conv", "call", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        step = shared_table(step, "chat-jumps")
        discard(table)
        table, reach = step, 2 * reach
    return table.where("up is null").select("conv", "call", "level")


def _levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """conv, call and level of the calls that can be ordered: doubled pointers, and rounds by depth only in conversations with a call that needs several."""
    several = shared_table(edges.groupBy("conv", "call").agg(F.countDistinct("needs").alias("n")).where("n > 1").select("conv").distinct(), "chat-several")
    simple = _jumps(calls.join(several, "conv", "left_anti"), edges.select("conv", "call", "needs").distinct().join(several, "conv", "left_anti"))
    if several.isEmpty():
        return simple
    return simple.unionByName(_rounds(calls.join(several, "conv", "left_semi"), edges.join(several, "conv", "left_semi")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call and for each result that no call takes: conv, call, level, at, status, problems, json.

    ``calls`` has conv, call (its identifier), at (its place), name, arguments (JSON text) and needs (identifiers of
    calls whose results it uses); ``results`` has conv, call and content. Calls and results are hash-joined by
    conversation and identifier. (level, at) is a topological order of a conversation: level is the longest chain of
    needs below a call. json is canonical: keys sorted, no white space, arguments as a value if they parse.

    status: linked, no result, no call, repeated (an identifier with two calls or results or more; the first call by place and
    the least content keep it, the rest are rows of their own, exact copies too), cycle (its needs can't be met; level 0). Defined
    cases: a null conversation or identifier links with nothing; needs that name no call are ignored, a call that needs itself
    is a cycle; empty tables give no rows. Other columns are not read.
    """
    whole = ["at", "name", "arguments", "needs"]
    numbered = calls.select("conv", "call", *whole)
    known = "conv is not null and call is not null"
    counted = shared_table(numbered.where(known).groupBy("conv", "call", *whole).agg(F.count(F.lit(1)).alias("m")), "chat-counted")
    kept = shared_table(counted.groupBy("conv", "call").agg(F.min(F.struct(*whole)).alias("s")).select("conv", "call", "s.*"), "chat-calls")
    contents = shared_table(results.where(known).groupBy("conv", "call", "content").agg(F.count(F.lit(1)).alias("m")), "chat-contents")
    answers = contents.groupBy("conv", "call").agg(F.min("content").alias("content"), F.lit(True).alias("answered"))
    edges = kept.select("conv", "call", F.explode("needs").alias("needs")).join(kept.select("conv", F.col("call").alias("needs")), ["conv", "needs"])
    levels = _levels(kept, shared_table(edges, "chat-needs"))
    status = F.when(F.col("kept").isNull(), "no call").when(F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "no result").otherwise("linked")
    linked = kept.withColumn("kept", F.lit(True)).join(answers.hint("shuffle_hash"), ["conv", "call"], "full_outer").join(levels, ["conv", "call"], "left")
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    place = calls.schema["at"].dataType
    # How many copies of a row are left when one of them is kept.
    same = lambda cols, own: F.expr(" and ".join(f"{c} <=> {own}.{c}" for c in cols))
    others = counted.join(kept.select("conv", "call", F.struct(*whole).alias("k")), ["conv", "call"])
    others = others.withColumn("m", F.col("m") - same(whole, "k").cast("int")).where("m > 0").select("conv", "call", "at", "name", "arguments", none("content"), F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    more = contents.join(answers.select("conv", "call", F.struct("content").alias("k")), ["conv", "call"])
    more = more.withColumn("m", F.col("m") - same(["content"], "k").cast("int")).where("m > 0").select("conv", "call", none("at", place), none("name"), none("arguments"), "content", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    repeated = others.drop("col").union(more.drop("col")).select("*", F.lit(0).alias("level"), F.lit("repeated").alias("status"))
    loose = numbered.where(f"not ({known})").select("conv", "call", "at", "name", "arguments", none("content"), F.lit(0).alias("level"), F.lit("no result").alias("status"))
    loose_results = results.where(f"not ({known})").select("conv", "call", none("at", place), none("name"), none("arguments"), "content", F.lit(0).alias("level"), F.lit("no call").alias("status"))
    rows = linked.select("conv", "call", "at", "name", "arguments", "content", F.coalesce("level", F.lit(0)).alias("level"), status.alias("status")).union(repeated).union(loose).union(loose_results)
    bad = F.when((F.col("status") == "no call") | (F.col("status") == "repeated") & F.col("name").isNull() & F.col("arguments").isNull(), F.array().cast("array<string>")).otherwise(problems(F.col("name"), F.col("arguments"), schemas))
    json = F.concat(F.lit('{"arguments":'), F.when(F.col("arguments").isNull(), F.lit("null")).otherwise(F.coalesce(canonical("arguments"), quoted("arguments"))), F.lit(',"content":'), quoted("content"), F.lit(',"id":'), quoted("call"), F.lit(',"name":'), quoted("name"), F.lit("}"))
    return rows.select("conv", "call", "level", "at", "status", bad.alias("problems"), json.alias("json"))


#: Turns of people as calls of one tool.
REPLY = {"reply": {"prompt": ("string", True), "turn": ("integer", True)}}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """User turns as calls, assistant turns as results of the turn before them, and all other turns as they are.

    The conversations hold no tool calls, so their kinds are made from the numbers of conversation and turn: most calls need the user turn
    before them, in every third conversation the one after them (places are no order there), in every seventh, from the second on, pairs
    need each other; some calls have broken arguments or name an unknown tool.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    name = lambda t: F.concat(conv.cast("string"), F.lit("-"), t.cast("string"))
    kind = (conv + turn) % 11
    needs = F.when(conv % 7 == 2, F.when(F.floor(turn / 2) % 2 == 0, turn + 2).otherwise(turn - 2)).when(conv % 3 == 0, turn + 2).otherwise(turn - 2)
    arguments = (
        F.when(kind == 3, F.to_json(F.struct(turn.cast("string").alias("turn"), F.col("text").alias("prompt"))))
        .when(kind == 5, F.to_json(F.struct("turn", F.col("text").alias("prompt"), F.lit(True).alias("extra"))))
        .when(kind == 7, F.to_json(F.struct("turn")))
        .when(kind == 9, F.concat(F.lit("turn "), turn.cast("string")))
        .otherwise(F.to_json(F.struct("turn", F.col("text").alias("prompt"))))
    )
    calls = conversations.where("role = 'user'").select(
        conv.alias("conv"), name(turn).alias("call"), turn.alias("at"), F.when((conv + turn) % 13 == 4, "search").otherwise("reply").alias("name"), arguments.alias("arguments"), F.array(name(needs)).alias("needs"),
    )
    results = conversations.where("role = 'assistant'").select(conv.alias("conv"), name(turn - 1).alias("call"), F.col("text").alias("content"))
    return calls, results, conversations.where("role is null or role not in ('user', 'assistant')")


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """Every turn of the table: calls with their results, results without a call, and turns of other roles (status message)."""
    calls, results, others = turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    out = link_tool_calls(calls, results, REPLY)
    out = out.select(F.col("conv").alias("conv_id"), F.col("call").alias("call_id"), "level", "at", "status", F.size("problems").alias("n_problems"), "json")
    json = F.concat(F.lit('{"content":'), quoted("text"), F.lit(',"role":'), quoted("role"), F.lit("}"))
    return out.union(others.select("conv_id", F.lit(None).cast("string"), F.lit(0), "turn", F.lit("message"), F.lit(0), json))


OP7_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, conv_id || '-' || turn AS call_id, turn AS "at", text, (conv_id + turn) % 11 AS kind, CASE WHEN (conv_id + turn) % 13 = 4 THEN 'search' ELSE 'reply' END AS name,
    conv_id || '-' || CASE WHEN conv_id % 7 = 2 THEN CASE WHEN (turn // 2) % 2 = 0 THEN turn + 2 ELSE turn - 2 END WHEN conv_id % 3 = 0 THEN turn + 2 ELSE turn - 2 END AS needs FROM conversations WHERE role = 'user'),
l(call_id, level) AS (SELECT call_id, 0 FROM c WHERE needs NOT IN (SELECT call_id FROM c) UNION ALL SELECT c.call_id, level + 1 FROM c JOIN l ON c.needs = l.call_id),
r AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, MIN(text) AS content, COUNT(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
a AS (SELECT *, CASE kind WHEN 3 THEN '{"prompt":' || TO_JSON(text)::VARCHAR || ',"turn":"' || "at" || '"}' WHEN 5 THEN '{"extra":true,"prompt":' || TO_JSON(text)::VARCHAR || ',"turn":' || "at" || '}' WHEN 7 THEN '{"turn":' || "at" || '}'
    WHEN 9 THEN '"turn ' || "at" || '"' ELSE '{"prompt":' || TO_JSON(text)::VARCHAR || ',"turn":' || "at" || '}' END AS arguments FROM c)
SELECT COALESCE(a.conv_id, r.conv_id) AS conv_id, COALESCE(a.call_id, r.call_id) AS call_id, COALESCE(level, 0)::INTEGER AS level, "at",
    CASE WHEN a.call_id IS NULL THEN 'no call' WHEN level IS NULL THEN 'cycle' WHEN r.n IS NULL THEN 'no result' ELSE 'linked' END AS status,
    CASE WHEN a.call_id IS NOT NULL AND (name = 'search' OR kind IN (3, 5, 7, 9)) THEN 1 ELSE 0 END::INTEGER AS n_problems,
    '{"arguments":' || COALESCE(arguments, 'null') || ',"content":' || COALESCE(TO_JSON(r.content)::VARCHAR, 'null') || ',"id":' || TO_JSON(COALESCE(a.call_id, r.call_id))::VARCHAR
        || ',"name":' || COALESCE('"' || name || '"', 'null') || '}' AS json
FROM a FULL OUTER JOIN r ON a.conv_id = r.conv_id AND a.call_id = r.call_id LEFT JOIN l ON l.call_id = a.call_id
UNION ALL SELECT conv_id, NULL, 0, turn, 'message', 0, '{"content":' || COALESCE(TO_JSON(text)::VARCHAR, 'null') || ',"role":' || COALESCE(TO_JSON(role)::VARCHAR, 'null') || '}' FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
