"""Chat formatting: linking of tool calls and results (DataFrame and SQL only).

Calls and results meet in a hash join by conversation and call id, keys that
no two calls share, so a conversation that holds a large part of all rows is
spread like any other. Dependencies between calls (the ``after`` argument) are
ordered by pointer doubling: a call's level is its distance from one that waits
for nothing; calls in a cycle have none. Arguments are parsed once as variants and checked
against the tools' schemas by expressions built from them. The canonical form
is one JSON object per call, keys sorted, no blanks.

Defined cases: calls without a conversation or id are left out, as is a null
result id; a call without a result has status ``no_result``; of several calls
with one id the first (by turn, then index) counts, and of several results the
first is taken; arguments that are no JSON object (null included) are the error
``not_an_object``; a dependency that no call of the conversation has is the
error ``unknown_dependency`` and does not delay the call; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroll.llm.common import saved

# Tools by name; each parameter has a type, and may be required or restricted.
# The catalogue is an argument of the operator, not data: it becomes expressions.
TOOLS = {
    "search": {"query": {"type": "string", "required": True},
               "limit": {"type": "integer", "required": True},
               "after": {"type": "string"}},
    "convert": {"value": {"type": "integer", "required": True},
                "unit": {"type": "string", "required": True, "enum": ["km", "kg", "s"]},
                "after": {"type": "string"}},
    "lookup": {"key": {"type": "string", "required": True},
               "after": {"type": "string"}},
}

# What schema_of_variant calls the JSON types.
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN",
          "number": "BIGINT|DOUBLE|DECIMAL.*", "object": "OBJECT.*", "array": "ARRAY.*"}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _parameter_errors(name: str, rule: dict) -> list[Column]:
    """Error messages (or null) of one parameter of the parsed arguments."""
    at = _quoted(f"$['{name}']")
    present = F.array_contains("keys", name)
    kind = F.expr(f"schema_of_variant(try_variant_get(parsed, {at}, 'variant'))")
    right = kind.rlike(f"^({_TYPES[rule['type']]})$")
    out = [F.when(present & ~F.coalesce(right, F.lit(False)), F.lit(f"type:{name}"))]
    if rule.get("required"):
        out.append(F.when(~present, F.lit(f"missing:{name}")))
    if rule.get("enum"):
        value = F.expr(f"try_variant_get(parsed, {at}, 'string')")
        out.append(F.when(present & right & ~value.isin(rule["enum"]), F.lit(f"enum:{name}")))
    return out


def argument_errors(tools: dict) -> Column:
    """Sorted error messages of a call, from its tool, parsed arguments and keys."""
    out = None
    for tool, rules in tools.items():
        checks = [e for p, rule in rules.items() for e in _parameter_errors(p, rule)]
        extra = F.transform(F.array_except("keys", F.array(*[F.lit(p) for p in rules])),
                            lambda k: F.concat(F.lit("unknown:"), k))
        found = F.array_sort(F.array_compact(F.concat(F.array(*checks), extra)))
        out = F.when(F.col("tool") == tool, found) if out is None else out.when(
            F.col("tool") == tool, found)
    unknown = F.array(F.lit("unknown_tool"))
    by_tool = out.otherwise(unknown) if out is not None else unknown
    return F.when(F.col("keys").isNull(), F.array(F.lit("not_an_object"))).otherwise(by_tool)


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the least by ``order`` and then by its other columns."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    picked = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return picked.select(*keys, "r.*")


def topological_levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without a dependency, else one more than the call
    waited for; calls that wait in a cycle, or for one, have no row.

    ``edges`` has at most one row (conv_id, call_id, dep) for each call. Calls point to
    what they wait for, and each round doubles the reach of the pointers, so there are
    as many rounds as the longest chain has binary digits. A call has arrived when its
    pointer is at one that waits for nothing; a round in which none arrives leaves only
    those that wait for a cycle. Each round is a table of its own, and only the last
    is part of the result's plan.
    """
    keys = ["conv_id", "call_id"]
    jumps = saved(edges.select(*keys, F.col("dep").alias("at"), F.lit(1).cast("long").alias("level"),
                               F.lit(False).alias("arrived")), "call-jumps-0")
    open_before, turn = -1, 0
    while True:
        turn += 1
        onward = jumps.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"),
                              F.col("level").alias("more"), F.col("arrived").alias("ahead"))
        step = jumps.where(~F.col("arrived")).join(
            onward.hint("shuffle_hash"), ["conv_id", "at"], "left").select(
            *keys, F.coalesce("next", "at").alias("at"),
            (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"),
            F.coalesce("ahead", F.lit(True)).alias("arrived"))
        jumps = saved(jumps.where("arrived").unionByName(step), f"call-jumps-{turn}")
        still_open = jumps.where(~F.col("arrived")).count()
        if still_open in (0, open_before):
            break
        open_before = still_open
    first = calls.join(edges.select(*keys), keys, "left_anti").select(
        *keys, F.lit(0).cast("long").alias("level"))
    return first.unionByName(jumps.where("arrived").select(*keys, "level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """One row per call.

    ``calls``: conv_id, turn, index, call_id, tool, arguments (JSON text).
    ``results``: conv_id, turn, call_id, content.
    Returns conv_id, call_id, turn, tool, level, status, errors and canonical.
    """
    keys = ["conv_id", "call_id"]
    calls = _first(calls.select("conv_id", "turn", "index", "call_id", "tool", "arguments")
                   .where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()),
                   keys, ["turn", "index"])
    parsed = calls.withColumn("parsed", F.expr("try_parse_json(arguments)")).withColumn(
        "keys", F.when(F.expr("schema_of_variant(parsed) LIKE 'OBJECT%'"),
                       F.json_object_keys("arguments")))
    checked = saved(parsed.select(
        *keys, "turn", "tool", argument_errors(tools).alias("errors"),
        F.when(F.col("keys").isNotNull(), F.expr("to_json(parsed)")).alias("arguments"),
        F.when(F.col("keys").isNotNull(),
               F.expr("try_variant_get(parsed, '$.after', 'string')")).alias("dep")),
        "tool-calls")
    # A dependency must be a call of the same conversation.
    wanted = checked.where(F.col("dep").isNotNull()).select(*keys, "dep")
    have = checked.select("conv_id", F.col("call_id").alias("dep"))
    edges = saved(wanted.join(have.hint("shuffle_hash"), ["conv_id", "dep"]), "tool-edges")
    levels = topological_levels(checked.select(*keys), edges)
    dangling = wanted.join(edges.select(*keys), keys, "left_anti").select(
        *keys, F.lit(True).alias("dangling"))
    answers = _first(results.select("conv_id", "call_id", "turn", "content")
                     .where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()),
                     keys, ["turn"])
    answers = answers.select(*keys, F.lit(True).alias("answered"), "content")
    rows = (checked.join(answers.hint("shuffle_hash"), keys, "left")
            .join(levels, keys, "left").join(dangling, keys, "left"))
    errors = F.concat(F.col("errors"), F.when(
        F.coalesce("dangling", F.lit(False)), F.array(F.lit("unknown_dependency")))
        .otherwise(F.array().cast("array<string>")))
    status = (F.when(F.col("level").isNull(), "cycle").when(F.size(errors) > 0, "invalid")
              .when(F.col("answered").isNull(), "no_result").otherwise("ok"))
    tail = F.to_json(F.struct(F.col("call_id").alias("id"), F.col("tool").alias("name"),
                              F.col("content").alias("result")))
    canonical = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")),
                         F.lit(","), F.substring(tail, 2, 2**31 - 1))
    return rows.select(*keys, "turn", "tool", F.col("level").cast("int").alias("level"),
                       status.alias("status"), F.array_join(errors, ",").alias("errors"),
                       canonical.alias("canonical"))


def derived_messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results by rule from the turns of ``conversations``, which
    hold plain prose: an assistant's turn is a call, the user's turn after it
    the result. Some break a schema, wait for an earlier call or go astray."""
    conv, turn = F.col("conv_id"), F.col("turn")
    size = F.length(F.coalesce("text", F.lit("")))
    mark = conv * 7 + turn
    call_id = F.concat(F.lit("c"), conv, F.lit("-"), turn)
    tool = F.element_at(F.array(F.lit("search"), F.lit("convert"), F.lit("lookup")),
                        ((conv + turn) % 3 + 1).cast("int"))
    limit = F.when(mark % 11 == 0, F.lit('"many"')).otherwise((size % 50 + 1).cast("string"))
    unit = F.when(mark % 13 == 0, F.lit("parsec")).otherwise(
        F.element_at(F.array(F.lit("km"), F.lit("kg"), F.lit("s")), (size % 3 + 1).cast("int")))
    after = F.when((turn >= 3) & (F.floor(turn / 2) % 3 != 0), F.concat(
        F.lit(', "after": "c'), conv, F.lit("-"), turn - 2, F.lit('"'))).otherwise(F.lit(""))
    extra = F.when(mark % 19 == 0, F.lit(', "note": null')).otherwise(F.lit(""))
    key = F.when(mark % 17 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"key": "k'), size % 97, F.lit('", ')))
    arguments = (F.when(tool == "search", F.concat(
        F.lit('{"query": "q'), size % 1000, F.lit('", "limit": '), limit, after, extra, F.lit("}")))
        .when(tool == "convert", F.concat(
            F.lit('{"value": '), size, F.lit(', "unit": "'), unit, F.lit('"'), after, extra,
            F.lit("}")))
        .otherwise(F.concat(F.lit("{"), key, F.lit('"after": '), F.when(
            turn >= 3, F.concat(F.lit('"c'), conv, F.lit("-"), turn - 2, F.lit('"')))
            .otherwise(F.lit('"none"')), extra, F.lit("}"))))
    calls = conversations.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.lit(0).alias("index"), call_id.alias("call_id"), tool.alias("tool"),
        arguments.alias("arguments"))
    stray = F.when((conv + turn) % 23 == 0, F.lit("x")).otherwise(F.lit("c"))
    results = conversations.where((F.col("role") == "user") & (turn > 0)).select(
        "conv_id", "turn", F.concat(stray, conv, F.lit("-"), turn - 1).alias("call_id"),
        F.col("text").alias("content"))
    return calls, results


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*derived_messages(
        spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE_OP3 = r"""
WITH RECURSIVE base AS (
  SELECT *, conv_id * 7 + turn AS mark, length(coalesce(text, '')) AS size,
         ['search', 'convert', 'lookup'][(conv_id + turn) % 3 + 1] AS tool,
         'c' || conv_id || '-' || turn AS call_id,
         'c' || conv_id || '-' || (turn - 2) AS prior
  FROM conversations WHERE role = 'assistant'),
named AS (
  SELECT *, CASE WHEN tool = 'lookup' THEN CASE WHEN turn >= 3 THEN prior ELSE 'none' END
                 WHEN turn >= 3 AND (turn // 2) % 3 <> 0 THEN prior END AS dep
  FROM base),
calls AS (
  SELECT *, '{' || CASE WHEN dep IS NULL THEN '' ELSE '"after":"' || dep || '",' END AS head,
         CASE WHEN mark % 19 = 0 THEN '"note":null,' ELSE '' END AS note
  FROM named),
formed AS (
  SELECT *, CASE tool
      WHEN 'search' THEN head || '"limit":' || CASE WHEN mark % 11 = 0 THEN '"many"'
           ELSE (size % 50 + 1)::VARCHAR END || ',' || note || '"query":"q' || (size % 1000) || '"}'
      WHEN 'convert' THEN head || note || '"unit":"' || CASE WHEN mark % 13 = 0 THEN 'parsec'
           ELSE ['km', 'kg', 's'][size % 3 + 1] END || '","value":' || size || '}'
      ELSE rtrim(head || CASE WHEN mark % 17 = 0 THEN '' ELSE '"key":"k' || (size % 97) || '",' END
           || note, ',') || '}' END AS arguments,
    [
      CASE WHEN tool = 'convert' AND mark % 13 = 0 THEN 'enum:unit' END,
      CASE WHEN tool = 'lookup' AND mark % 17 = 0 THEN 'missing:key' END,
      CASE WHEN tool = 'search' AND mark % 11 = 0 THEN 'type:limit' END,
      CASE WHEN mark % 19 = 0 THEN 'unknown:note' END,
      CASE WHEN dep IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM named o WHERE o.conv_id = calls.conv_id AND o.call_id = calls.dep)
        THEN 'unknown_dependency' END] AS errors
  FROM calls),
levels AS (
  SELECT conv_id, call_id, 0 AS level FROM formed
  WHERE dep IS NULL OR list_contains(errors, 'unknown_dependency')
  UNION ALL
  SELECT f.conv_id, f.call_id, l.level + 1 FROM formed f JOIN levels l
    ON f.conv_id = l.conv_id AND f.dep = l.call_id),
results AS (
  SELECT conv_id, CASE WHEN (conv_id + turn) % 23 = 0 THEN 'x' ELSE 'c' END
         || conv_id || '-' || (turn - 1) AS call_id, text
  FROM conversations WHERE role = 'user' AND turn > 0)
SELECT f.conv_id, f.call_id, f.turn, f.tool, l.level,
       CASE WHEN list_count(errors) > 0 THEN 'invalid' WHEN r.call_id IS NULL THEN 'no_result'
            ELSE 'ok' END AS status,
       coalesce(array_to_string(errors, ','), '') AS errors,
       '{"arguments":' || arguments || ',"id":"' || f.call_id || '","name":"' || tool || '"'
       || CASE WHEN r.text IS NULL THEN '' ELSE ',"result":' || to_json(r.text)::VARCHAR END
       || '}' AS canonical
FROM formed f JOIN levels l USING (conv_id, call_id) LEFT JOIN results r USING (conv_id, call_id)
"""
