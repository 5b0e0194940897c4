"""Chat formatting with tool-call linking.

Messages carry tool calls and results as tagged JSON in their text:

    <tool_call>{"id": "c1", "name": "search", "arguments": {"q": "x"}}</tool_call>
    <tool_result>{"id": "c1", "content": ...}</tool_result>

Calls and results of one conversation are hash-joined on their identifier; the
k-th result with an identifier answers the k-th call with it.  An argument
``{"$ref": "c1"}`` makes a call depend on the result of call ``c1``.  A message
must follow every message it depends on.  Its place is the pair (order_turn,
order_level): order_turn is the largest turn among it and everything it depends
on, order_level its depth among dependencies; sorting a conversation by that
pair, then by turn, is a topological order that keeps turns in place wherever
they already agree with it.  Arguments are validated against the tool's JSON
schema, and every message is serialised as canonical JSON: keys sorted, no
spaces, shortest numbers.

One row per message: links and dependencies are joins, and only conversations
in which a message comes before what it depends on are ordered at all.  The
dependencies of one of them go to one task where they are at most
``GROUP_EDGES``; longer ones are ordered in rounds over all tasks.

Edge cases: a null text is an empty message; a null role is the empty string.
Tagged text that is not a JSON object with a string ``id`` stays part of the
message and counts as malformed, and so does JSON nested more than ``MAX_DEPTH``
deep.  Bytes that are not UTF-8 count as U+FFFD; half of a surrogate pair stays
the escape that it was in the JSON.  Messages on a dependency cycle, or depending
on one, follow only what does not, and are marked ``cycle``.  A null
conversation links nothing; a message without a turn stays without, and moves
no other.  Repeated rows are messages of their own.  An empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import in_slices, look_up, settle

#: Nesting of JSON that is read; deeper text is left as it is.
MAX_DEPTH = 200
_HALVES = re.compile("[\ud800-\udfff]")
_TAG = re.compile(r"<(tool_call|tool_result)>(.*?)</\1>", re.DOTALL)
_KINDS = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def _canonical(value):
    """Numbers that are whole become integers, so 1.0 and 1 are written alike; no NaN or infinity."""
    if isinstance(value, float):
        if not math.isfinite(value):
            return None
        return int(value) if value.is_integer() and abs(value) < 1 << 53 else value
    if isinstance(value, dict):
        return {k: _canonical(v) for k, v in value.items()}
    return [_canonical(v) for v in value] if isinstance(value, list) else value


def _written(text: str) -> str:
    """Halves of surrogate pairs, which UTF-8 lacks, as escapes."""
    return _HALVES.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical_json(value) -> str:
    return _written(json.dumps(_canonical(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _too_deep(value) -> bool:
    level = [value]
    for _ in range(MAX_DEPTH):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return False
    return True


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, (int, float)))
    return kind in _KINDS and isinstance(value, _KINDS[kind])


def schema_errors(value, schema: Mapping, at: str = "$") -> list[str]:
    """What is wrong with ``value`` under a JSON schema's type, enum, const, properties, required,
    additionalProperties, items, minimum, maximum, minLength, maxLength, minItems, maxItems and pattern.

    A ``{"$ref": id}`` stands for a value not yet known and fits any schema.
    """
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool)
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: misses {k}" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            extra = schema.get("additionalProperties", True)
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
            elif extra is False:
                out.append(f"{at}: unknown {k}")
            elif isinstance(extra, Mapping):
                out += schema_errors(value[k], extra, f"{at}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), Mapping):
        for i, x in enumerate(value):
            out += schema_errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: out of range")
    for kind, name in ((str, "Length"), (list, "Items")):
        if isinstance(value, kind) and not schema.get(f"min{name}", 0) <= len(value) <= schema.get(f"max{name}", len(value)):
            out.append(f"{at}: bad length")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: no match")
    return out


def _references(value) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return {value["$ref"]}
        return set().union(*(_references(v) for v in value.values())) if value else set()
    return set().union(*(_references(v) for v in value)) if isinstance(value, list) and value else set()


def parse_message(role: str, text: str, schemas: Mapping[str, Mapping]) -> tuple[list[dict], list[dict], int, str]:
    """(calls, results, malformed tags, canonical JSON) of one message."""
    calls, results, malformed, plain, at = [], [], 0, [], 0
    spoken_calls, spoken_results = [], []
    for m in _TAG.finditer(text):
        try:
            body = json.loads(m.group(2))
        except (ValueError, RecursionError):
            body = None
        if not isinstance(body, dict) or not isinstance(body.get("id"), str) or _too_deep(body):
            malformed += 1
            continue
        plain.append(text[at : m.start()])
        at = m.end()
        if m.group(1) == "tool_call":
            arguments = body.get("arguments", {})
            name = body.get("name")
            schema = schemas.get(name) if isinstance(name, str) else None
            errors = ["unknown tool"] if schema is None else schema_errors(arguments, schema)
            calls.append({"id": _written(body["id"]), "needs": sorted(map(_written, _references(arguments))), "errors": list(map(_written, errors))})
            spoken_calls.append({"arguments": arguments, "id": body["id"], "name": name})
        else:
            results.append({"id": _written(body["id"])})
            spoken_results.append({"content": body.get("content"), "id": body["id"]})
    plain.append(text[at:])
    message = {"content": "".join(plain), "role": role}
    if spoken_calls:
        message["tool_calls"] = spoken_calls
    if spoken_results:
        message["tool_results"] = spoken_results
    return calls, results, malformed, canonical_json(message)


def _parse(schemas: Mapping[str, Mapping]):
    call_type = pa.list_(pa.struct([("id", pa.string()), ("needs", pa.list_(pa.string())), ("errors", pa.list_(pa.string()))]))
    result_type = pa.list_(pa.struct([("id", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            made = [parse_message(r or "", t or "", schemas) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            calls, results, malformed, spoken = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "turn", "role")),
                    pa.array(calls, call_type),
                    pa.array(results, result_type),
                    pa.array(malformed, pa.int64()),
                    pa.array(spoken, pa.string()),
                ],
                ["conv_id", "turn", "role", "calls", "results", "malformed", "message"],
            )

    return parse


_SCHEMA = (
    "conv_id long, turn long, role string, calls array<struct<id:string,needs:array<string>,errors:array<string>>>, "
    "results array<struct<id:string>>, malformed long, message string"
)


#: Dependencies of one conversation that one task orders by itself; longer conversations are ordered in rounds, to the same result.
GROUP_EDGES = 200_000


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, id, turn, node, at, ...)`` with k, each row's number from 1 among those of its conversation and identifier.

    Ranges of the sorted rows are numbered by themselves, so one identifier may
    fill many of them; then each range's first identifier moves on by what
    earlier ranges hold of it.  That table has fewer rows than there are ranges.
    """
    place = ["turn", "node", "at"]
    ranged = rows.repartitionByRange("conv_id", "id", *place).withColumn("_range", F.spark_partition_id())
    local = settle(ranged.withColumn("k", F.row_number().over(Window.partitionBy("_range", "conv_id", "id").orderBy(*place))))
    held = local.groupBy("conv_id", "id", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("conv_id", "id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = held.withColumn("_on", F.sum("_n").over(earlier)).where("_on is not null").select("conv_id", "id", "_range", "_on")
    joined = local.join(F.broadcast(moved), ["conv_id", "id", "_range"], "left")
    return joined.withColumn("k", F.col("k") + F.coalesce("_on", F.lit(0))).drop("_range", "_on")


def _placed(edges: pa.Table) -> pa.Table:
    """(node, order_turn, order_level, cycle) of one conversation's edges."""
    place, follows, waits = {}, defaultdict(list), Counter()
    for row in edges.select(["before", "before_turn", "after", "after_turn"]).to_pylist():
        place[row["before"]], place[row["after"]] = (row["before_turn"], 0), (row["after_turn"], 0)
        follows[row["before"]].append(row["after"])
        waits[row["after"]] += 1
    ready = [node for node in place if not waits[node]]
    for node in ready:  # grows
        turn, level = place[node]
        for later in follows[node]:
            if turn is not None and place[later][0] is not None:
                place[later] = max(place[later], (turn, level + 1))
            waits[later] -= 1
            if not waits[later]:
                ready.append(later)
    turns, levels = zip(*place.values(), strict=True)
    return pa.table(
        {"node": pa.array(place, pa.int64()), "order_turn": pa.array(turns, pa.int64()), "order_level": pa.array(levels, pa.int64()), "cycle": pa.array([waits[n] > 0 for n in place])}
    )


def _placed_in_rounds(edges: DataFrame) -> DataFrame:
    """What ``_placed`` gives, for conversations of any length.

    Each round places the messages whose dependencies all have their place, so
    there are as many as the longest chain has steps.  What is left when a round
    places none lies on or behind a cycle.
    """
    ends = [edges.select(F.col(e).alias("node"), F.col(f"{e}_turn").alias("order_turn")) for e in ("before", "after")]
    waits = edges.groupBy(F.col("after").alias("node")).agg(F.count("*").alias("waits"))
    order = settle(
        ends[0].unionByName(ends[1]).distinct().join(waits, "node", "left")
        .select("node", "order_turn", F.lit(0).cast("long").alias("order_level"), F.coalesce("waits", F.lit(0)).alias("waits"))
    )
    counts = settle(edges.groupBy("before").agg(F.count("*").alias("_n")))
    pairs = edges.select("before", "after")
    while not order.where("waits = 0").isEmpty():
        here = order.where("waits = 0").select(F.col("node").alias("before"), F.col("order_turn").alias("t"), (F.col("order_level") + 1).alias("l"))
        asked = look_up(pairs, here, ["before"], counts=counts).groupBy(F.col("after").alias("node")).agg(F.count("*").alias("n"), F.max(F.struct("t", "l")).alias("asked"))
        later = (F.col("asked.t") > F.col("order_turn")) | ((F.col("asked.t") == F.col("order_turn")) & (F.col("asked.l") > F.col("order_level")))
        order = settle(
            order.join(asked, "node", "left").select(
                "node",
                F.when(later, F.col("asked.t")).otherwise(F.col("order_turn")).alias("order_turn"),
                F.when(later, F.col("asked.l")).otherwise(F.col("order_level")).alias("order_level"),
                F.when(F.col("waits") == 0, -1).otherwise(F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"),
            )
        )
    return order.select("node", "order_turn", "order_level", (F.col("waits") > 0).alias("cycle"))


def _ordered(edges: DataFrame) -> DataFrame:
    """(node, order_turn, order_level, cycle) of the nodes of ``edges(conv_id, before, before_turn, after, after_turn)``."""
    long = settle(edges.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_EDGES).select("conv_id"))
    short = edges.join(long, "conv_id", "left_anti").groupBy("conv_id").applyInArrow(_placed, "node long, order_turn long, order_level long, cycle boolean")
    if long.isEmpty():
        return short
    return short.unionByName(_placed_in_rounds(settle(edges.join(long, "conv_id", "left_semi"))))


def link_tool_calls(messages: DataFrame, schemas: Mapping[str, Mapping] | None = None) -> DataFrame:
    """One row per row of ``messages(conv_id, turn, role, text)``.

    Columns: conv_id, turn, role, order_turn, order_level, n_calls, n_results,
    n_answered (calls with a result), n_orphans (results without a call),
    n_invalid (calls whose arguments break their schema, or of unknown tools),
    errors, malformed, status and message (canonical JSON).
    """
    readable = [F.make_valid_utf8(F.col(c).cast("string")).alias(c) for c in ("role", "text")]
    source = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *readable)
    rows = settle(source.mapInArrow(_parse(dict(schemas or {})), _SCHEMA).withColumn("node", F.monotonically_increasing_id()))
    talks = rows.where("conv_id is not null")
    calls = talks.select("conv_id", "turn", "node", F.posexplode("calls").alias("at", "call"))
    calls = _numbered(calls.select("conv_id", "turn", "node", "at", "call.id", "call.needs"))
    results = talks.select("conv_id", "turn", "node", F.posexplode("results").alias("at", "result"))
    results = _numbered(results.select("conv_id", "turn", "node", "at", "result.id"))
    answers = results.select("conv_id", "id", "k", F.col("node").alias("result_node"), F.col("turn").alias("result_turn"))
    linked = settle(calls.join(answers, ["conv_id", "id", "k"]).select("conv_id", "id", "k", "needs", "node", "turn", "result_node", "result_turn"))

    answered = linked.groupBy("node").agg(F.count("*").alias("n_answered"))
    matched = linked.groupBy(F.col("result_node").alias("node")).agg(F.count("*").alias("n_matched"))
    follows = linked.select("conv_id", F.col("node").alias("before"), F.col("turn").alias("before_turn"), F.col("result_node").alias("after"), F.col("result_turn").alias("after_turn"))
    first = linked.where("k = 1").select("conv_id", F.col("id").alias("need"), F.col("result_node").alias("before"), F.col("result_turn").alias("before_turn"))
    needs = calls.select("conv_id", F.col("node").alias("after"), F.col("turn").alias("after_turn"), F.explode("needs").alias("need"))
    needs = look_up(needs, first, ["conv_id", "need"])
    edges = settle(follows.unionByName(needs.select("conv_id", "before", "before_turn", "after", "after_turn")).where("before <> after").distinct())
    late = edges.where("after_turn <= before_turn").select("conv_id").distinct()
    out = rows.join(answered, "node", "left").join(matched, "node", "left")
    if late.isEmpty():  # every turn already follows what it depends on
        out = out.withColumns({"order_turn": F.col("turn"), "order_level": F.lit(0).cast("long"), "cycle": F.lit(False)})
    else:
        out = out.join(_ordered(settle(edges.join(late, "conv_id", "left_semi"))), "node", "left").withColumns(
            {"order_turn": F.coalesce("order_turn", "turn"), "order_level": F.coalesce("order_level", F.lit(0)), "cycle": F.coalesce("cycle", F.lit(False))}
        )
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    problems = F.flatten(F.transform("calls", lambda c: c["errors"]))
    out = out.withColumns(
        {
            "n_calls": F.size("calls").cast("long"),
            "n_results": F.size("results").cast("long"),
            "n_answered": count("n_answered"),
            "n_orphans": F.size("results").cast("long") - count("n_matched"),
            "n_invalid": F.size(F.filter("calls", lambda c: F.size(c["errors"]) > 0)).cast("long"),
            "errors": F.array_join(problems, "; "),
        }
    )
    bad = F.concat_ws(
        ",",
        F.when(F.col("cycle"), "cycle"),
        F.when(F.col("malformed") > 0, "malformed"),
        F.when(F.col("n_invalid") > 0, "invalid"),
        F.when(F.col("n_answered") < F.col("n_calls"), "unanswered"),
        F.when(F.col("n_orphans") > 0, "orphan"),
    )
    return out.select(
        "conv_id", "turn", "role", "order_turn", "order_level", "n_calls", "n_results", "n_answered", "n_orphans", "n_invalid", "errors", "malformed",
        F.when(bad == "", "ok").otherwise(bad).alias("status"), "message",
    )
