"""Chat formatting: tool calls linked to their results, ordered, checked and written out.

Every message stays a row of its own: calls, results and whatever is neither. Calls and
results meet in a hash join on their identifiers, each side counted by identifier first, so
that many results of many calls under one identifier are not multiplied. A call's place is
how many calls it depends on, one after the other, found by doubling: every round each call
looks at what its present ancestor depends on, so long chains need few rounds. Arguments are
checked against the schema of the tool and written as canonical JSON (RFC 8785): keys in
order, no white space, every number in its shortest form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.tables import stored
from logloom.session import prepare

#: Types of JSON values a schema can ask for.
KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


def positions(calls: DataFrame) -> DataFrame:
    """``call_id, position`` of distinct calls: 0 for one that depends on no other.

    ``calls`` has ``call_id, after``, the call it depends on (or null). A call that depends
    on an unknown one starts anew at 0; calls on a circle, or behind one, have no position.
    """
    known = calls.groupBy("call_id").agg(F.min("after").alias("after"))
    parents = known.select(F.col("call_id").alias("after"))
    state = stored(
        known.join(parents.withColumn("there", F.lit(1)), "after", "left").select(
            "call_id",
            F.when(F.col("there") == 1, F.col("after")).alias("ancestor"),
            F.coalesce("there", F.lit(0)).cast("long").alias("position"),
        ),
        "calls",
    )
    rounds = state.count().bit_length() + 1
    for _ in range(rounds):
        if state.where("ancestor IS NOT NULL").isEmpty():
            break
        beyond = state.select(
            F.col("call_id").alias("ancestor"),
            F.col("ancestor").alias("next"),
            F.col("position").alias("more"),
        )
        state = stored(
            state.join(beyond, "ancestor", "left").select(
                "call_id",
                F.col("next").alias("ancestor"),
                (F.col("position") + F.coalesce("more", F.lit(0))).alias("position"),
            ),
            "calls",
        )
    return state.select(
        "call_id", F.when(F.col("ancestor").isNull(), F.col("position")).alias("position")
    )


def problem(arguments: str, schema: dict[str, str]) -> Column:
    """What is wrong with a column of argument JSON: the first of the schema's fields, in
    order, that is missing or of another type; null if all are as they should be."""
    parsed = F.try_parse_json(F.col(arguments))
    found = F.lit(None).cast("string")
    for name in sorted(schema, reverse=True):
        value = F.try_variant_get(parsed, f"$['{name}']", "variant")
        kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        found = (
            F.when(value.isNull() | F.is_variant_null(value), f"{name} is required")
            .when(~kind.isin(*KINDS[schema[name]]), f"{name} must be {schema[name]}")
            .otherwise(found)
        )
    return F.when(
        parsed.isNull() | ~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")),
        "arguments must be an object",
    ).otherwise(found)


def _number(token: Column) -> Column:
    """The text of a JSON number in the shortest form that gives the same double: plain from
    1e-6 up to 1e21, with an exponent outside."""
    value = token.cast("double")
    forms = [F.format_string(f"%.{places}e", value) for places in range(17)]
    shortest = F.coalesce(*[F.when(form.cast("double") == value, form) for form in forms])

    def part(group: int) -> Column:
        return F.regexp_extract(shortest, r"^-?([0-9])\.?([0-9]*?)0*e([+-][0-9]+)$", group)

    digits, point = F.concat(part(1), part(2)), part(3).cast("int") + 1
    size, power = F.length(digits), F.abs(point - 1).cast("string")
    plain = (
        F.when((size <= point) & (point <= 21), F.rpad(digits, point, "0"))
        .when(
            (point > 0) & (point <= 21),
            F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, size)),
        )
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(
            F.concat(
                part(1), F.when(size > 1, F.concat(F.lit("."), part(2))).otherwise(""),
                F.when(point < 1, "e-").otherwise("e+"), power,
            )
        )
    )
    return (
        F.when(token.rlike("^-?[1-9][0-9]{0,14}$"), token)
        .when(value == 0, "0")
        .otherwise(F.coalesce(F.concat(F.when(value < 0, "-").otherwise(""), plain), token))
    )


def _escapes(text: Column) -> Column:
    """JSON text whose control characters are written with small letters."""
    small = text
    for letter in "ABCDEF":
        small = F.regexp_replace(small, r"(?<!\\)((?:\\\\)*\\u00[01])" + letter, "$1" + letter.lower())
    return F.when(text.contains(r"\u00"), small).otherwise(text)


def canonical(json: str) -> Column:
    """A column of JSON text in canonical form, null where it is no JSON."""
    # A variant keeps its keys in order and is written without white space.
    written = F.to_json(F.try_parse_json(F.col(json)))
    tokens = F.regexp_extract_all(
        written, F.lit(r'"(?:[^"\\]|\\.)*+"|-?[0-9][0-9.eE+-]*|[^"0-9-]++'), F.lit(0)
    )
    texts = F.transform(
        tokens, lambda token: F.when(token.rlike("^[-0-9]"), _number(token)).otherwise(token)
    )
    return _escapes(F.array_join(texts, ""))


def _quoted(column: str) -> Column:
    """A column of text as JSON, null as ``null``."""
    listed = F.to_json(F.array(F.col(column)))
    inside = listed.substr(F.lit(2), F.length(listed) - 2)
    return F.when(F.col(column).isNull(), "null").otherwise(_escapes(inside))


#: What :func:`link` adds; a column of the caller with such a name is replaced.
ADDED = ("position", "status", "calls", "results", "error", "json")


def link(messages: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """Every message with its place, its link, the check of its arguments and canonical JSON.

    ``messages`` has ``role, call_id, after, tool, arguments, content`` and may have more
    columns, which stay. A row with a ``tool`` is a call of it, with JSON ``arguments``; one
    of role ``tool`` without one is a result; any other is a message of its role. Adds:

    - ``position`` of the call, for a result that of its call; null without one;
    - ``status``: ``answered`` or ``unanswered`` calls, ``linked`` results or those with
      ``no call``, and ``message``;
    - ``calls`` and ``results`` with the row's ``call_id``, 0 for messages;
    - ``error``, null unless it is a call whose arguments the schema of the tool refuses;
    - ``json``.

    A null ``call_id`` links nothing. Every row stays, repeated calls and results too; null
    contents are written as ``null``; a repeated key in arguments counts with its last value;
    an empty table gives no rows. Columns that are called like an added one are replaced.
    """
    # Repeated keys are read alike in every session.
    prepare(messages.sparkSession)
    own = [c for c in messages.columns if c.lower() not in ADDED]
    kind = F.when(F.col("tool").isNotNull(), "call").when(F.col("role") == "tool", "result")
    rows = messages.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
        F.coalesce(kind, F.lit("message")).alias("kind"),
        *[F.col(c).cast("string").alias(c) for c in ("role", "call_id", "after", "tool", "arguments", "content")],
    )
    named = rows.where("call_id IS NOT NULL AND kind <> 'message'")
    counts = named.groupBy("call_id").agg(
        F.count_if(F.col("kind") == "call").alias("calls"),
        F.count_if(F.col("kind") == "result").alias("results"),
    )
    places = positions(named.where("kind = 'call'").select("call_id", "after"))
    # Read from files, so that a join can split the rows of one identifier.
    known = stored(counts.join(places, "call_id", "left"), "known")
    known = known.withColumnRenamed("call_id", "name")
    same = (F.col("kind") != "message") & (F.col("call_id") == F.col("name"))

    error = F.lit("unknown tool")
    for tool, schema in sorted(schemas.items()):
        error = F.when(F.col("tool") == tool, problem("arguments", schema)).otherwise(error)

    def written(**values: Column) -> Column:
        pairs = [
            piece for key, value in sorted(values.items())
            for piece in (F.lit(f'"{key}":'), value, F.lit(","))
        ]
        return F.concat(F.lit("{"), *pairs[:-1], F.lit("}"))

    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    place = F.coalesce(F.col("position").cast("string"), F.lit("null"))
    name = _quoted("call_id")
    json = (
        F.when(
            is_call,
            written(
                arguments=F.coalesce(canonical("arguments"), F.lit("null")),
                id=name, name=_quoted("tool"), position=place,
            ),
        )
        .when(is_result, written(content=_quoted("content"), id=name, position=place))
        .otherwise(written(content=_quoted("content"), role=_quoted("role")))
    )
    return (
        rows.join(known, same, "left")
        .withColumn("calls", F.coalesce("calls", F.lit(0)).cast("long"))
        .withColumn("results", F.coalesce("results", F.lit(0)).cast("long"))
        .withColumn(
            "status",
            F.when(is_call, F.when(F.col("results") > 0, "answered").otherwise("unanswered"))
            .when(is_result, F.when(F.col("calls") > 0, "linked").otherwise("no call"))
            .otherwise("message"),
        )
        .withColumn("error", F.when(is_call, error))
        .withColumn("json", json)
        .select(*[F.col(f"row.`{c}`").alias(c) for c in own], *ADDED)
    )


# --- conversations -------------------------------------------------------------------

#: The one tool of the conversations: a user's turn calls it, the assistant's answers.
REPLY = {"reply": {"prompt": "string", "turn": "integer"}}


def messages_of(conversations: DataFrame) -> DataFrame:
    """Messages of a table of turns ``conv_id, turn, role, text``, one for every row.

    A user's turn is a call of ``reply`` that depends on the call two turns before; an
    assistant's turn is the result of the call in the turn before it; other roles, null too,
    are messages. A null text is an argument that is missing, or null content. Without a
    conversation or turn a call or result has no identifier.
    """
    turn, is_user = F.col("turn"), F.col("role") == "user"
    is_reply = F.col("role") == "assistant"

    def name(turn: Column) -> Column:
        # Null without a conversation or a turn.
        return F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    return conversations.select(
        "conv_id",
        "turn",
        F.when(is_reply, "tool").otherwise(F.col("role")).alias("role"),
        F.when(is_user, name(turn)).when(is_reply, name(turn - 1)).alias("call_id"),
        F.when(is_user, name(turn - 2)).alias("after"),
        F.when(is_user, "reply").alias("tool"),
        F.when(is_user, F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))).alias("arguments"),
        F.when(~F.coalesce(is_user, F.lit(False)), F.col("text")).alias("content"),
    )


ORACLE = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text,
         CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_turn
  FROM conversations),
places AS (
  SELECT DISTINCT conv_id, turn, CAST(0 AS BIGINT) AS position FROM turns c
  WHERE role = 'user' AND NOT EXISTS (
    SELECT 1 FROM turns b WHERE b.role = 'user' AND b.conv_id = c.conv_id AND b.turn = c.turn - 2)
  UNION ALL
  SELECT DISTINCT c.conv_id, c.turn, p.position + 1 FROM places p
  JOIN turns c ON c.role = 'user' AND c.conv_id = p.conv_id AND c.turn = p.turn + 2),
known AS (
  SELECT conv_id, call_turn, count(*) FILTER (role = 'user') AS calls,
         count(*) FILTER (role = 'assistant') AS results
  FROM turns WHERE conv_id IS NOT NULL AND call_turn IS NOT NULL GROUP BY ALL),
linked AS (
  SELECT t.*, t.conv_id || '-' || t.call_turn AS call_id, p.position,
         coalesce(k.calls, 0) AS calls, coalesce(k.results, 0) AS results,
         coalesce(CAST(to_json(text) AS VARCHAR), 'null') AS quoted
  FROM turns t LEFT JOIN known k ON k.conv_id = t.conv_id AND k.call_turn = t.call_turn
  LEFT JOIN places p ON p.conv_id = t.conv_id AND p.turn = t.call_turn),
written AS (
  SELECT *, coalesce('"' || call_id || '"', 'null') AS name,
         coalesce(CAST(position AS VARCHAR), 'null') AS place FROM linked)
SELECT conv_id, turn, role, call_id, position, calls, results,
  CASE WHEN role = 'user' THEN CASE WHEN results > 0 THEN 'answered' ELSE 'unanswered' END
       WHEN role = 'assistant' THEN CASE WHEN calls > 0 THEN 'linked' ELSE 'no call' END
       ELSE 'message' END AS status,
  CASE WHEN role = 'user' AND text IS NULL THEN 'prompt is required'
       WHEN role = 'user' AND turn IS NULL THEN 'turn is required' END AS error,
  CASE WHEN role = 'user' THEN concat('{"arguments":{',
         CASE WHEN text IS NOT NULL THEN '"prompt":' || quoted END,
         CASE WHEN text IS NOT NULL AND turn IS NOT NULL THEN ',' END,
         '"turn":' || turn, '},"id":', name, ',"name":"reply","position":', place, '}')
       WHEN role = 'assistant' THEN concat('{"content":', quoted, ',"id":', name, ',"position":', place, '}')
       ELSE concat('{"content":', quoted, ',"role":', coalesce('"' || role || '"', 'null'), '}') END AS json
FROM written
"""
