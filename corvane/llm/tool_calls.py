"""Chat formatting: links tool calls to results, orders them topologically, validates arguments, writes canonical JSON.

A message is a call (with an identifier, a tool, JSON arguments and maybe identifiers of the calls it comes after), a
result (with a call's identifier) or plain text.  Identifiers belong to their conversation.  Calls and results are
hash-joined by (conversation, identifier).  The dependencies of a conversation form a graph: a call stands behind all
calls it follows, a result behind its call.  A call's depth is one more than the greatest of those it follows, its place
the latest turn of all of them; both are raised along the links until nothing changes, by joins and maxima over all
conversations at once, so no conversation is gathered in one task.  Where every call follows one other at most, paths are
doubled instead, and a chain of n calls takes log2(n) joins.  Messages already in order stay in order: `order_key`
(latest turn, depth, own turn) sorts a conversation as a struct of whole numbers.

Defined cases: of calls (or results) with one identifier in a conversation the first by turn counts, the others are
'duplicate'; results without a call are 'orphan', calls without a result 'pending', messages without identifier
'unlinked'; calls on a cycle, or behind one, are 'cycle' and keep their own turn; an unknown predecessor is passed over;
null arguments are invalid for a tool with a schema; null content stays null and empty content empty; texts of any
length are kept whole; what is nested deeper than MAX_DEPTH is 'too deep' and written as null; a null conversation is one of its own; repeated rows
are duplicates of each other; an empty table gives an empty table; extra columns are passed over, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import discard, stored

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
MAX_DEPTH = 200
#: The keywords of a schema that are checked, and those that say nothing on validity.
KEYWORDS = frozenset("type enum const minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength pattern required properties additionalProperties items minItems maxItems anyOf oneOf allOf".split())
ANNOTATIONS = frozenset("title description default examples $schema $id $comment".split())


def number(value: float) -> str:
    """A double as canonical JSON writes it (shortest digits; exponents from 1e21 and below 1e-6)."""
    if value == 0:
        return "0"
    digits, exponent = repr(abs(value)), 0
    if "e" in digits:
        digits, exponent = digits.split("e")[0], int(digits.split("e")[1])
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + exponent
    digits = whole + part
    cut = len(digits) - len(digits.lstrip("0"))
    digits, point = digits[cut:].rstrip("0"), point - cut
    n = len(digits)
    if n <= point <= 21:
        out = digits + "0" * (point - n)
    elif 0 < point <= 21:
        out = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{point - 1:+d}"
    return "-" + out if value < 0 else out


def canonical(value, depth: int = 0) -> str:
    """JSON without spaces, with keys in the order of their UTF-16 code units, plain UTF-8, and numbers as doubles; integers that no double holds are kept whole."""
    if depth > MAX_DEPTH:
        raise RecursionError
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k], depth + 1)}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(canonical(x, depth + 1) for x in value) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("no JSON number")
        return number(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return number(float(value)) if abs(value) >= 10**21 and abs(value) < 10**300 and int(float(value)) == value else str(value)
    out = json.dumps(value, ensure_ascii=False)
    out.encode()  # lone surrogates can't be stored
    return out


def _same(a, b) -> bool:
    """Equality of JSON values: true is not 1, but 1.0 is."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
    return isinstance(value, _TYPES[kind])


def unsupported(schema) -> str | None:
    """The first keyword of a schema that `violation` does not know."""
    if isinstance(schema, bool):
        return None
    for k in sorted(schema):
        if k not in KEYWORDS and k not in ANNOTATIONS:
            return k
        inner = schema[k]
        parts = inner.values() if k == "properties" else inner if k in ("anyOf", "oneOf", "allOf") else [inner] if k in ("items", "additionalProperties") else []
        for part in parts:
            if found := unsupported(part):
                return found
    return None


#: Keywords by the form that their values have to have.
_SIZES, _NUMBERS = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"), ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")


def malformed(schema, at: str = "$") -> str | None:
    """What is wrong with a schema itself, so that it is said before anything runs: names of types, patterns, numbers, and forms."""
    if isinstance(schema, bool):
        return None
    if not isinstance(schema, dict):
        return f"{at} is no schema"
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    for k, inner in schema.items():
        here = f"{at}.{k}"
        if k == "type":
            kinds = inner if isinstance(inner, list) else [inner]
            if not kinds or not all(isinstance(x, str) and (x in _TYPES or x == "integer" or x == "number") for x in kinds):
                return f"{here} names an unknown type"
        elif k == "pattern":
            try:
                re.compile(inner)
            except (re.error, TypeError):
                return f"{here} is no pattern"
        elif k in _SIZES and not (isinstance(inner, int) and not isinstance(inner, bool) and inner >= 0):
            return f"{here} is no size"
        elif k in _NUMBERS and not (number(inner) and (k != "multipleOf" or inner > 0)):
            return f"{here} is no number"
        elif k == "required" and not (isinstance(inner, list) and all(isinstance(x, str) for x in inner)):
            return f"{here} is no list of names"
        elif k == "enum" and not isinstance(inner, list):
            return f"{here} is no list"
        elif k == "uniqueItems" and not isinstance(inner, bool):
            return f"{here} is not true or false"
        elif k == "properties":
            if not isinstance(inner, dict):
                return f"{here} is no object"
        elif k in ("anyOf", "oneOf", "allOf") and not (isinstance(inner, list) and inner):
            return f"{here} is no list of schemas"
        parts = inner.items() if k == "properties" else enumerate(inner) if k in ("anyOf", "oneOf", "allOf") else [("", inner)] if k in ("items", "additionalProperties") else []
        for name, part in parts:
            if found := malformed(part, f"{here}.{name}" if name != "" else here):
                return found
    return None


def violation(value, schema, at: str = "$") -> str | None:
    """The first violation of a JSON schema; see KEYWORDS for what is checked."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: not allowed"
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return f"{at}: not {' or '.join(kinds)}"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value) or value <= schema.get("exclusiveMinimum", -math.inf) or value >= schema.get("exclusiveMaximum", math.inf):
            return f"{at}: out of range"
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        return f"{at}: not in enum"
    if "const" in schema and not _same(value, schema["const"]):
        return f"{at}: not the constant"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"{at}: length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{at}: pattern"
    if isinstance(value, dict):
        fields, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        for k in schema.get("required", ()):
            if k not in value:
                return f"{at}: lacks {k}"
        for k in sorted(value):
            if k not in fields and others is False:
                return f"{at}: unknown {k}"
            if found := violation(value[k], fields.get(k, others), f"{at}.{k}"):
                return found
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return f"{at}: length"
        for i, x in enumerate(value):
            if found := violation(x, schema.get("items", True), f"{at}[{i}]"):
                return found
    for k, fits in (("allOf", lambda n, of: n == of), ("anyOf", lambda n, of: n > 0), ("oneOf", lambda n, of: n == 1)):
        if k in schema and not fits(sum(violation(value, x, at) is None for x in schema[k]), len(schema[k])):
            return f"{at}: {k}"
    return None


def checked(tool: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[object, str | None]:
    """Parsed arguments and what is wrong with them."""
    try:
        value = json.loads(arguments) if arguments is not None else None
        canonical(value)
    except RecursionError:
        return None, "$: too deep"
    except (ValueError, UnicodeEncodeError):
        return None, "$: no JSON"
    if tool not in schemas:
        return value, "$: unknown tool"
    return value, violation(value, schemas[tool])


_SERIALISE = "conv_id {conv}, turn bigint, kind string, call_id string, status string, at_turn bigint, depth bigint, valid boolean, error string, json string"


def _serialise(schemas: dict[str, dict]):
    for name, schema in schemas.items():
        if found := malformed(schema):
            raise ValueError(f"the schema of {name} can not be used: {found}")
        if found := unsupported(schema):
            raise ValueError(f"the schema of {name} has the keyword {found}, which is not supported")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, error, out = [], [], []
            for kind, call_id, tool, arguments, content in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("kind", "call_id", "tool", "arguments", "content"))):
                message = {"content": content, "role": {"call": "assistant", "result": "tool"}.get(kind, kind)}
                wrong, calls = None, ""
                if kind == "call":
                    value, wrong = checked(tool, arguments, schemas)
                    # the arguments stand at the depth of their own, so that whatever `checked` takes can be written
                    calls = f',"tool_calls":[{{"function":{{"arguments":{canonical(value)},"name":{canonical(tool)}}},"id":{canonical(call_id)},"type":"function"}}]'
                elif kind == "result":
                    message["tool_call_id"] = call_id
                valid.append(wrong is None if kind == "call" else None)
                error.append(wrong)
                out.append(canonical(message)[:-1] + calls + "}")
            names = ["conv_id", "turn", "kind", "call_id", "status", "at_turn", "depth"]
            made = [pa.array(valid, pa.bool_()), pa.array(error, pa.string()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *made], [*names, "valid", "error", "json"])

    return run


def _chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth, at_turn and cycle, where every call follows one other at most: by pointer doubling.  edges: id, to."""
    at = stored(nodes.join(edges, "id", "left").select("id", "turn", F.col("turn").alias("at_turn"), F.col("to").alias("ptr"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("bigint").alias("depth")), "chain")
    n = at.count()
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        if at.where("ptr IS NOT NULL").limit(1).count() == 0:
            break
        up = at.select(F.col("id").alias("u_id"), F.col("at_turn").alias("u_turn"), F.col("ptr").alias("u_ptr"), F.col("depth").alias("u_depth"))
        longer = stored(at.join(up, F.col("ptr") == F.col("u_id"), "left").select(
            "id", "turn", F.greatest("at_turn", "u_turn").alias("at_turn"), F.col("u_ptr").alias("ptr"), (F.col("depth") + F.coalesce("u_depth", F.lit(0))).alias("depth")), "chain")
        discard(at)
        at = longer
    cycle = F.col("ptr").isNotNull()
    return at.select("id", F.when(cycle, 0).otherwise(F.col("depth")).alias("depth"), F.when(cycle, F.col("turn")).otherwise(F.col("at_turn")).alias("at_turn"), cycle.alias("cycle"))


def _layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth, at_turn and cycle of any graph, layer by layer: a call is placed once all calls that it follows are.

    edges: id, to.  The calls never placed are on a cycle or behind one.  A round for each layer, and a join for each.
    """
    counts = edges.groupBy("id").agg(F.count("*").alias("waits"))
    open_ = stored(nodes.join(counts, "id", "left").select("id", "turn", F.coalesce("waits", F.lit(0)).alias("waits"), F.col("turn").alias("at_turn"), F.lit(0).cast("bigint").alias("depth")), "open")
    done, rounds = None, 0
    while True:
        ready = stored(open_.where("waits = 0").select("id", "depth", "at_turn"), "layer")
        if ready.limit(1).count() == 0:
            break
        told = edges.join(ready.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.max("at_turn").alias("t"))
        still = stored(open_.where("waits > 0").join(told, "id", "left").select(
            "id", "turn", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), F.greatest("at_turn", "t").alias("at_turn"), F.greatest(F.col("depth"), F.col("d") + 1).alias("depth")), "open")
        discard(open_)
        open_, done, rounds = still, ready if done is None else done.unionAll(ready), rounds + 1
        if rounds % 16 == 0:  # keeps the plan short
            done = stored(done, "layers")
    stuck = open_.select("id", F.lit(0).cast("bigint").alias("depth"), F.col("turn").alias("at_turn"), F.lit(True).alias("cycle"))
    return stuck if done is None else done.select("id", "depth", "at_turn", F.lit(False).alias("cycle")).unionAll(stuck)


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each message: link status, place (order_key sorts a conversation), validity and canonical JSON.

    messages: conv_id (of any type), turn, kind ('call', 'result' or a role), call_id, after (an identifier or an array of them), tool,
    arguments, content.
    """
    serialise = _serialise(schemas)
    rows = messages.select("conv_id", "turn", "kind", "call_id", "after", "tool", "arguments", "content")
    if not messages.schema["after"].dataType.typeName() == "array":
        rows = rows.withColumn("after", F.when(F.col("after").isNotNull(), F.array("after")))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "messages")
    linked = rows.where(F.col("call_id").isNotNull()).withColumn("id", F.struct(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNull().alias("none"), "call_id"))
    first = F.min(F.struct("turn", "row")).alias("first")
    calls = linked.where("kind = 'call'").groupBy("id").agg(first).select("id", F.col("first.turn").alias("turn"), F.col("first.row").alias("call_row"))
    results = linked.where("kind = 'result'").groupBy("id").agg(first).select("id", F.col("first.row").alias("result_row"))
    calls = stored(calls.join(results.hint("shuffle_hash"), "id", "left"), "calls")
    to = F.explode(F.array_distinct("after"))
    edges = linked.select("row", "id", to.alias("to_id")).where(F.col("to_id").isNotNull()).join(calls.select(F.col("call_row").alias("row")), "row", "left_semi")
    edges = edges.select("id", F.struct(F.col("id.conv").alias("conv"), F.col("id.none").alias("none"), F.col("to_id").alias("call_id")).alias("to"))
    edges = stored(edges.join(calls.select(F.col("id").alias("to")), "to", "left_semi").select("id", "to"), "edges")
    branches = edges.groupBy("id").count().where("count > 1").limit(1).count()
    places = (_layers if branches else _chains)(calls.select("id", "turn"), edges)
    nodes = calls.drop("turn").join(places, "id").select(F.col("id").alias("n_id"), "call_row", "result_row", F.col("depth").alias("n_depth"), F.col("at_turn").alias("n_turn"), "cycle")
    mine = F.when(F.col("kind").isin("call", "result") & F.col("call_id").isNotNull(), F.struct(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNull().alias("none"), "call_id"))
    keyed = rows.withColumn("m_id", mine)
    both = keyed.where(F.col("m_id").isNotNull()).join(nodes, F.col("m_id") == F.col("n_id"), "left")
    plain = keyed.where(F.col("m_id").isNull())  # these meet nothing, and would all come to one task
    both = both.unionAll(plain.select("*", *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns)))
    is_call, is_result = F.col("kind").eqNullSafe("call"), F.col("kind").eqNullSafe("result")
    status = (
        F.when(~(is_call | is_result), "message").when(F.col("call_id").isNull(), "unlinked").when(F.col("n_id").isNull(), "orphan")
        .when(is_call & (F.col("row") != F.col("call_row")) | is_result & (F.col("row") != F.col("result_row")), "duplicate")
        .when(F.col("cycle"), "cycle").when(F.col("result_row").isNull(), "pending").otherwise("linked")
    )
    placed = both.select("conv_id", "turn", "kind", "call_id", F.coalesce(status, F.lit("message")).alias("status"),
        F.greatest("turn", F.coalesce("n_turn", "turn")).alias("at_turn"), (2 * F.coalesce("n_depth", F.lit(0)) + F.when(is_result, 1).otherwise(0)).cast("bigint").alias("depth"), "tool", "arguments", "content")
    return placed.mapInArrow(serialise, _SERIALISE.format(conv=dict(rows.dtypes)["conv_id"])).withColumn("order_key", F.struct("at_turn", "depth", "turn"))


#: The tool of the query over `conversations`: a user turn asks, the next assistant turn answers.
ASK = {"ask": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 1_000_000}}}}


def from_conversations(turns: DataFrame) -> DataFrame:
    """Messages of plain turns: a user turn is a call of `ask` that comes after the user turn two before; the assistant turn behind it is its result."""
    ident = lambda k: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - k).cast("string"))
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    return turns.select(
        "conv_id", "turn", F.when(user, "call").when(reply, "result").otherwise(F.col("role")).alias("kind"), F.when(user, ident(0)).when(reply, ident(1)).alias("call_id"), F.when(user, ident(2)).alias("after"),
        F.when(user, "ask").alias("tool"), F.when(user, F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt")))).alias("arguments"), F.when(user, None).otherwise(F.col("text")).alias("content"))
