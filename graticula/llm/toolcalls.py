"""Chat formatting: tool-call linking.

Calls and results are joined by (conversation, identifier), put into topological order of what they depend on, their arguments are validated
against the tool's schema, and each call becomes one canonical JSON object. All of it is relational. In conversations where no call depends on more than one
other, an ordering round is a join over pointers whose length doubles, so a chain of n calls takes log n rounds; in others a round places all calls
whose dependencies are placed, so there are as many rounds as the longest chain of such a conversation has calls.

Defined cases: a call without result has a null result; results without a call are reported apart (`orphans`); repeated identifiers count
once, by the smallest position, with `copies`; a missing dependency is ignored; calls on or after a cycle have a null level;
calls or results of one turn are ordered by what they hold; arguments that are no JSON object fail validation and are kept as a JSON string; null conversations or identifiers link nothing;
very long texts and conversations are handled by columns and joins; an empty table gives an empty result; further columns do not take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graticula.llm.common import written

#: JSON types by the names that Spark gives the types of variants.
JSON_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}


def errors(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with the arguments (JSON text), as an array of short strings in a fixed order; empty if they are valid.

    schemas: by tool {"properties": {key: JSON type}, "required": [keys]}; other keys are not allowed.
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        checks = []
        for key, kind in sorted(schema["properties"].items()):
            part = F.try_variant_get(value, f"$['{key}']", "variant")
            there = F.array_contains(F.json_object_keys(arguments), key)
            wrong = there & ~F.coalesce(F.schema_of_variant(part).rlike(JSON_TYPES[kind]), F.lit(False))
            checks.append(F.when(wrong, F.lit(f"{key}: not {kind}")))
            if key in schema.get("required", ()):
                checks.append(F.when(~there, F.lit(f"{key}: missing")))
        extra = F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, schema["properties"])))
        found = F.concat(F.array_compact(F.array(*checks)), F.transform(F.array_sort(extra), lambda k: F.concat(k, F.lit(": not allowed"))))
        out = F.when(name == tool, F.when(is_object, found).otherwise(F.array(F.lit("not an object")))).otherwise(out)
    return out


def levels(calls: DataFrame, max_rounds: int = 64) -> DataFrame:
    """conv_id, call_id, level: the length of the longest chain of dependencies below a call; calls: distinct, with after (array of ids).

    In conversations whose calls have at most one dependency each, pointers are doubled. In others calls whose dependencies are all placed are placed,
    round by round; they don't hold up the rest.
    """
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("parent"))
    known = calls.select("conv_id", F.col("call_id").alias("parent"))
    edges = written(edges.join(known, ["conv_id", "parent"], "left_semi").select("conv_id", "call_id", "parent"), "call-edges")
    branching = edges.groupBy("conv_id", "call_id").count().filter("count > 1").select("conv_id").distinct()
    branching = written(branching, "branching-conversations")
    nodes = calls.select("conv_id", "call_id")
    if branching.isEmpty():
        return _doubled(nodes, edges, max_rounds)
    plain = _doubled(nodes.join(branching, "conv_id", "left_anti"), edges.join(branching, "conv_id", "left_anti"), max_rounds)
    return plain.unionByName(_placed(nodes.join(branching, "conv_id", "left_semi"), edges.join(branching, "conv_id", "left_semi")))


def _doubled(nodes: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """Levels where each call has one dependency at most: rounds grow with the logarithm of the longest chain."""
    up = written(nodes.join(edges, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "parent", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("level")), "call-levels")
    for _ in range(max_rounds):
        if up.filter("parent is not null").isEmpty():
            break
        over = up.select("conv_id", F.col("call_id").alias("parent"), F.col("parent").alias("next"), F.col("level").alias("more"))
        new = up.join(over, ["conv_id", "parent"], "left").select("conv_id", "call_id", F.col("next").alias("parent"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        new = written(new, "call-levels")
        left, before = new.filter("parent is not null").count(), up.filter("parent is not null").count()
        up = new
        if left == before:  # only cycles keep all their pointers
            break
    return up.select("conv_id", "call_id", F.when(F.col("parent").isNull(), F.col("level")).alias("level"))


def _placed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Levels of any graph: a round for each call of the longest chain."""
    placed = written(nodes.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")), "call-levels")
    while True:
        done = placed.select("conv_id", F.col("call_id").alias("parent"), "level")
        state = edges.join(done, ["conv_id", "parent"], "left").groupBy("conv_id", "call_id")
        ready = state.agg(F.max("level").alias("top"), F.count_if(F.col("level").isNull()).alias("open")).filter("open = 0")
        new = ready.join(placed, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", (F.col("top") + 1).alias("level"))
        new = written(new, "call-levels")
        if new.isEmpty():
            break
        placed = written(placed.union(new), "call-levels")
    return nodes.join(placed, ["conv_id", "call_id"], "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each distinct call: conv_id, call_id, turn, copies, level, position, result_turn, results, errors and json.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (ids that it depends on); results: conv_id, call_id, turn, content.
    position: the call's place in its conversation, by level, then turn, then id; null-level calls last.
    """
    first = F.min(F.struct("turn", "name", "arguments", "after")).alias("c")
    one = calls.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(first, F.count("*").alias("copies"))
    one = written(one.select("conv_id", "call_id", "copies", "c.*"), "calls")
    answer = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("results"))
    linked = one.join(levels(one), ["conv_id", "call_id"]).join(answer, ["conv_id", "call_id"], "left")
    # the place of a call is the calls on lower levels before it: (conversation, level) counts, then a rank in the level
    count = linked.groupBy("conv_id", "level").agg(F.count("*").alias("n"))
    by_level = Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last())
    count = count.select(F.col("conv_id").alias("cc"), F.col("level").alias("cl"), (F.sum("n").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("below"))
    ranked = linked.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "level").orderBy("turn", "call_id")))
    placed = ranked.join(count, (F.col("conv_id") == F.col("cc")) & F.col("level").eqNullSafe(F.col("cl")))
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    quoted = lambda c: F.substring(F.to_json(F.struct(c.alias("v"))), 6, 2147483640)  # noqa: E731  {"v":X} without its head, with its last brace
    bare = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_replace(quoted(c), r"\}$", ""))
    json = F.concat(
        F.lit('{"arguments":'), canonical, F.lit(',"id":'), bare(F.col("call_id")), F.lit(',"name":'), bare(F.col("name")), F.lit(',"result":'), bare(F.col("r.content")), F.lit("}")
    )
    return placed.select(
        "conv_id", "call_id", "turn", "copies", "level", (F.col("below") + F.col("k") - 1).alias("position"), F.col("r.turn").alias("result_turn"), F.coalesce("results", F.lit(0)).alias("results"),
        F.array_join(errors(F.col("name"), F.col("arguments"), schemas), "; ").alias("errors"), json.alias("json"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call of the conversation has."""
    return results.join(calls.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")


#: The one tool of the query below.
REPLY = {"reply": {"properties": {"chars": "integer", "text": "string"}, "required": ["chars", "text"]}}


BLOCK = 1000


def last_before(rows: DataFrame, wanted: Column, name: str) -> DataFrame:
    """rows (conv_id, turn) with the last turn before theirs, in their conversation, of a row that is wanted.

    Runs of turns are windows of their own, and carry their last such turn on: a long conversation is many tasks' work.
    """
    rows = rows.withColumn("__block", F.floor(F.col("turn") / BLOCK)).withColumn("__turn", F.when(wanted, F.col("turn")))
    blocks = rows.groupBy("conv_id", "__block").agg(F.max("__turn").alias("__last"))
    blocks = blocks.withColumn("__carried", F.max("__last").over(Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    blocks = blocks.select(F.col("conv_id").alias("__conv"), F.col("__block").alias("__of"), "__carried")
    earlier = Window.partitionBy("conv_id", "__block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("__inner", F.max("__turn").over(earlier))
    same = inner["conv_id"].eqNullSafe(blocks["__conv"]) & inner["__block"].eqNullSafe(blocks["__of"])
    return inner.join(blocks, same, "left").withColumn(name, F.coalesce("__inner", "__carried")).drop("__block", "__turn", "__conv", "__of", "__carried", "__inner")


def as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results: a user's turn calls `reply` and depends on the last user's turn before it; an
    assistant's turn is a result of the last user's turn before it. Rows of one turn are copies of one call; null turns are left out."""
    user = F.col("role") == "user"
    rows = last_before(conversations.filter("turn is not null"), user, "asked")
    name = lambda c: F.concat(F.lit("call-"), c.cast("string"))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("chars")))
    calls = rows.filter(user).select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"),
        F.when(F.col("asked").isNull(), F.array().cast("array<string>")).otherwise(F.array(name(F.col("asked")))).alias("after"),
    )
    results = rows.filter("role = 'assistant' and asked is not null")
    return calls, results.select("conv_id", name(F.col("asked")).alias("call_id"), "turn", F.col("text").alias("content"))


def op4_linked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return link(calls, results, REPLY).select("conv_id", "call_id", "turn", "copies", "level", "position", "result_turn", "results", "errors", "json")


QUERIES = {"op4_linked_calls": op4_linked_calls}
ORACLES = {
    "op4_linked_calls": """
WITH t AS (
  SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked
  FROM conversations WHERE turn IS NOT NULL
), calls AS (
  SELECT conv_id, 'call-' || turn AS call_id, turn, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS level, count(*) AS copies,
    arg_min(coalesce(text, ''), '{"text":' || to_json(coalesce(text, '')) || ',"chars":' || length(coalesce(text, ''))) AS text
  FROM t WHERE role = 'user' AND conv_id IS NOT NULL GROUP BY conv_id, turn
), results AS (
  SELECT conv_id, 'call-' || asked AS call_id, min(turn) AS result_turn, first(text ORDER BY turn, text NULLS FIRST) AS content, count(*) AS results
  FROM t WHERE role = 'assistant' AND asked IS NOT NULL GROUP BY conv_id, asked
)
SELECT c.conv_id, c.call_id, c.turn, c.copies, c.level, c.level AS position, r.result_turn, coalesce(r.results, 0) AS results, '' AS errors,
  '{"arguments":{"chars":' || length(c.text) || ',"text":' || to_json(c.text) || '},"id":"' || c.call_id || '","name":"reply","result":'
  || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json
FROM calls c LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
"""
}
