"""Tool-call linking: join calls with results, order them topologically, validate and serialise.

Input rows are messages of groups (conversations): group, turn, kind ('call' or 'result'), call_id,
name and arguments (JSON text) of a call, content of a result, depends_on (ids of calls whose results
a call needs).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut

#: Arguments nested more deeply than this are not read.
MAX_DEPTH = 200
#: Decimal digits of an integer.
MAX_DIGITS = 4000
#: Groups of more calls are ordered by joins, not in a task's memory.
GROUP_CALLS = 200_000
#: Stands for no turn in comparisons.
FIRST = -(1 << 63)
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no white space and no escapes but those that are needed; whole floats as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and math.isfinite(x) and x == int(x) and abs(x) < 2**53 else x

    return escaped(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def escaped(text: str) -> str:
    """Surrogates without a partner, which UTF-8 does not have, as \\u escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


class Unreadable(ValueError):
    """JSON that is beyond the limits of what is read."""


def number_of(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise Unreadable("number out of range")
    return value


def integer_of(text: str) -> int:
    if len(text) > MAX_DIGITS:
        raise Unreadable("number out of range")
    return int(text)


def no_constant(name: str):
    raise ValueError(name)


def depth_of(text: str) -> int:
    """Levels of nesting of a JSON text."""
    depth = most = 0
    for bracket in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text, re.DOTALL):
        first = bracket[0][0]
        if first in "[{":
            depth += 1
            most = max(most, depth)
        elif first in "]}":
            depth -= 1
    return most


def parsed(text: str):
    if len(text) > MAX_DEPTH and depth_of(text) > MAX_DEPTH:
        raise Unreadable("nested too deeply")
    return json.loads(text, parse_constant=no_constant, parse_float=number_of, parse_int=integer_of)


def equal(a, b) -> bool:
    """As JSON values: 1 and 1.0 are equal, 1 and true are not."""
    return canonical(a) == canonical(b)


def is_type(value, name: str) -> bool:
    if name in ("number", "integer"):
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (name == "number" or value.is_integer()))
    return isinstance(value, TYPES[name])


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What in value does not fit the schema (type, enum, const, required, properties, additionalProperties,
    items, minItems, maxItems, minLength, maxLength, pattern, minimum, maximum)."""
    kinds = schema.get("type")
    if kinds is not None and not any(is_type(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    out = []
    if "enum" in schema and not any(equal(value, v) for v in schema["enum"]):
        out.append(f"{at}: enum")
    if "const" in schema and not equal(value, schema["const"]):
        out.append(f"{at}: const")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: additional" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list):
        out += [f"{at}: {k}" for k, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", len(value)))) if bad]
        if "items" in schema:
            for i, v in enumerate(value):
                out += problems(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value))), ("pattern", "pattern" in schema and not re.search(schema["pattern"], value))) if bad]
    if is_type(value, "number"):
        out += [f"{at}: {k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    return out


def checked(text: str | None, schema: dict | None) -> tuple[object, list[str]]:
    """The arguments and what is wrong with them; arguments that cannot be read stay text."""
    if schema is None:
        return text, ["$: unknown tool"]
    try:
        value = parsed(text or "")
    except Unreadable as limit:
        return text, [f"$: {limit}"]
    except ValueError:
        return text, ["$: not JSON"]
    return value, [escaped(p) for p in problems(value, schema)]


def kahn(calls: list[tuple]) -> Iterator[tuple[str, int | None, int, bool]]:
    """(call_id, at, depth, cyclic) of the calls (call_id, turn, done, depends_on) of one group, whose ids differ.

    A call sorts at its turn, or behind the last result of what it depends on where that is later. Calls
    that are never free of open dependencies lie on or behind a cycle."""
    known = {c[0]: i for i, c in enumerate(calls)}
    needs = [{known[n] for n in c[3] or () if n in known} - {i} for i, c in enumerate(calls)]
    open_, behind = [len(n) for n in needs], [[] for _ in calls]
    for i, n in enumerate(needs):
        for j in n:
            behind[j].append(i)
    least = [(FIRST if c[1] is None else c[1], 0) for c in calls]
    free = [i for i, n in enumerate(open_) if not n]
    while free:
        i = free.pop()
        call_id, _, done, _ = calls[i]
        at, depth = least[i]
        yield call_id, None if at == FIRST else at, depth, False
        ready = (done, 1) if done is not None and done > at else (at, depth + 2)
        for j in behind[i]:
            open_[j] -= 1
            least[j] = max(least[j], ready)
            if not open_[j]:
                free.append(j)
    for i, n in enumerate(open_):
        if n:
            yield calls[i][0], calls[i][1], 0, True


def in_order(calls: DataFrame, results: DataFrame, group_calls: int = GROUP_CALLS) -> DataFrame:
    """calls (group, call_id, turn, depends_on) with at, depth and cyclic, such that (at, depth) sorts a call behind
    the results of the calls it depends on, and in turn order where that already holds; cyclic tells calls
    that lie on or behind a cycle, which keep their turn.

    The calls of a group come to a task sorted and are ordered there. Groups of more than group_calls
    calls are not held by a task; they are ordered by joins, a step of the longest chain each round.
    """
    last = results.groupBy("group", "call_id").agg(F.max("turn").alias("done"))
    base = cut(calls.join(last.hint("shuffle_hash"), ["group", "call_id"], "left").select("group", "call_id", "turn", "done", "depends_on"))
    sizes = cut(base.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > group_calls))
    large = not sizes.isEmpty()
    group_type = base.schema["group"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, made = [], None, []
        for batch in batches:
            for name, *call in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != group:
                    made.extend((group, *x) for x in kahn(held))
                    held, group = [], name
                    if len(made) > 10_000:
                        yield _ordered(made, batch)
                        made = []
                held.append(tuple(call))
        made.extend((group, *x) for x in kahn(held))
        if made:
            yield _ordered(made, batch)

    few = base.join(sizes, "group", "left_anti") if large else base
    ordered = few.repartition("group").sortWithinPartitions("group").mapInArrow(run, f"`group` {group_type}, call_id string, at bigint, depth int, cyclic boolean")
    if large:
        ordered = ordered.unionByName(relaxed(base.join(F.broadcast(sizes), "group")))  # at most total / group_calls rows
    return ordered


def _ordered(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
    types = [like.schema.field(0).type, pa.string(), pa.int64(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["group", "call_id", "at", "depth", "cyclic"])


def relaxed(base: DataFrame) -> DataFrame:
    """As kahn, for groups beyond a task's memory: each round moves calls behind their dependencies. A call that moved
    more often than its group has calls (n) is cyclic."""
    needs = cut(base.select("group", "call_id", F.explode("depends_on").alias("need")).where("need <> call_id").distinct())
    start = F.struct(F.coalesce("turn", F.lit(FIRST)).alias("at"), F.lit(0).alias("depth"))
    keys, moved = base.select("group", "call_id", "turn", "done", "n", start.alias("order"), F.lit(False).alias("cyclic")), True
    while moved:
        after = F.struct(F.col("order.at").alias("at"), (F.col("order.depth") + 1).alias("depth"))
        ready = keys.select("group", F.col("call_id").alias("need"), F.when(F.col("done") > F.col("order.at"), F.struct(F.col("done").alias("at"), F.lit(0).alias("depth"))).otherwise(after).alias("ready"), F.col("cyclic").alias("bad"))
        behind = F.struct(F.col("ready.at").alias("at"), (F.col("ready.depth") + 1).alias("depth"))
        pushed = needs.join(ready, ["group", "need"]).groupBy("group", "call_id").agg(F.max(behind).alias("least"), F.bool_or("bad").alias("bad"))
        both = keys.join(pushed, ["group", "call_id"], "left")
        step = (F.col("least") > F.col("order")) & ~F.col("cyclic")
        bad = F.col("cyclic") | F.coalesce("bad", F.lit(False)) | F.coalesce(step & (F.col("least.depth") > 2 * F.col("n")), F.lit(False))
        changed = F.coalesce(step, F.lit(False)) | (bad != F.col("cyclic"))
        next_ = cut(both.select("group", "call_id", "turn", "done", "n", F.when(step, F.col("least")).otherwise(F.col("order")).alias("order"), bad.alias("cyclic"), changed.alias("step")))
        moved = not next_.where("step").isEmpty()
        keys = next_.drop("step")
    return keys.select("group", "call_id", F.when(F.col("cyclic"), F.col("turn")).otherwise(F.nullif(F.col("order.at"), F.lit(FIRST))).alias("at"), F.when(F.col("cyclic"), 0).otherwise(F.col("order.depth")).cast("int").alias("depth"), "cyclic")


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per pair of call and result: group, call_id, name, call_turn, result_turn, status, at, depth,
    cyclic, valid, errors, record.

    status: linked; pending (a call without a result); orphan (a result without a call); duplicate (a call
    whose id an earlier call of its group has; results go to the earlier one). Rows without an id are
    pending or orphans. Wholly equal rows count once; a call may have several results. (at, depth, turn)
    sorts the rows of a group so that dependencies come first; cyclic ones keep their turn. valid tells whether the arguments
    are JSON that fits the tool's schema; record is the pair as canonical JSON, with the arguments as text
    where they are not JSON, or beyond MAX_DEPTH levels, MAX_DIGITS digits or the range of a double. Null
    arguments are no JSON; an empty table gives no rows; a call without a turn sorts first. Columns of
    messages beside those named above, whatever their names, are not used; texts may be of any length.
    """
    rows = messages.select("group", "turn", "kind", "call_id", "name", "arguments", "content", "depends_on").distinct()
    calls = rows.where("kind = 'call'").select("group", "call_id", F.col("turn").cast("bigint").alias("turn"), "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    results = rows.where("kind = 'result'").select("group", "call_id", F.col("turn").cast("bigint").alias("turn"), "content")
    named = calls.where("`group` is not null and call_id is not null")
    body = F.struct("turn", "name", "arguments", "depends_on")
    owners = cut(named.groupBy("group", "call_id").agg(F.min(body).alias("c")).select("group", "call_id", "c.*"))
    others = named.withColumn("c", body).join(owners.select("group", "call_id", body.alias("o")).hint("shuffle_hash"), ["group", "call_id"]).where(~F.col("c").eqNullSafe(F.col("o"))).select("group", "call_id", "c.turn", "c.name", "c.arguments")
    ordered = in_order(owners.select("group", "call_id", "turn", "depends_on"), results)
    placed = owners.drop("depends_on").join(ordered.hint("shuffle_hash"), ["group", "call_id"])
    linked = results.select("group", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("found")).join(placed.hint("shuffle_hash"), ["group", "call_id"], "right")
    none = {"result_turn": F.lit(None).cast("bigint"), "content": F.lit(None).cast("string"), "cyclic": F.lit(False), "at": F.col("turn").cast("bigint"), "depth": F.lit(0)}
    cols = ["group", "call_id", "name", "arguments", "turn", "result_turn", "content", "status", "at", "depth", "cyclic"]
    plain = lambda df, status: df.withColumns({**none, "status": F.lit(status)}).select(cols)
    orphans = results.join(owners.select("group", "call_id").hint("shuffle_hash"), ["group", "call_id"], "left_anti")
    orphans = orphans.select("group", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("bigint").alias("turn"), F.col("turn").alias("result_turn"), "content", F.lit("orphan").alias("status"), F.col("turn").cast("bigint").alias("at"), F.lit(1).alias("depth"), F.lit(False).alias("cyclic"))
    everything = (
        linked.withColumn("status", F.when(F.col("found"), "linked").otherwise("pending")).select(cols)
        .unionByName(plain(others, "duplicate"))
        .unionByName(plain(calls.where("`group` is null or call_id is null"), "pending"))
        .unionByName(orphans)
    )
    flat = everything.select(F.col("group").cast("string").alias("g"), "group", "call_id", "name", "turn", "result_turn", "status", "at", F.col("depth").cast("int").alias("depth"), "cyclic", "arguments", "content")

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(chunks(batches, "content"), "arguments"):
            valid, errors, records = [], [], []
            for row in batch.to_pylist():
                record = {"call_id": row["call_id"], "content": row["content"], "group": row["g"], "name": row["name"], "status": row["status"]}
                wrong: list[str] | None = None
                if row["status"] != "orphan":
                    record["arguments"], wrong = checked(row["arguments"], schemas.get(row["name"]))
                valid.append(None if wrong is None else not wrong)
                errors.append(wrong or [])
                records.append(canonical(record))
            names = [n for n in batch.schema.names if n not in ("g", "arguments", "content")]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(records, pa.string())], names=[*names, "valid", "errors", "record"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.drop("g", "arguments", "content").schema.fields)
    return flat.mapInArrow(serialise, f"{kept}, valid boolean, errors array<string>, record string").withColumnRenamed("turn", "call_turn")


def sorted_links(linked: DataFrame) -> DataFrame:
    """In topological order; range partitions let a very long group go on in the next partition."""
    keys = ["group", "at", "depth", "call_turn", "result_turn", "call_id"]
    return linked.repartitionByRange(*keys).sortWithinPartitions(*keys)


ANSWER = {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "role": {"enum": ["user", "system"]}}}


def from_conversations(conversations: DataFrame) -> DataFrame:
    """Messages of a conversation table: what a user or system says is a call, what the assistant says the result
    of the call one turn before; a user's call depends on the one two turns before."""
    turn = F.col("turn").cast("bigint")
    id_ = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (turn - back).cast("string"))
    called = F.col("role") != "assistant"
    return conversations.select(
        F.col("conv_id").alias("group"),
        turn.alias("turn"),
        F.when(called, "call").otherwise("result").alias("kind"),
        F.when(called, id_(0)).otherwise(id_(1)).alias("call_id"),
        F.when(called, "answer").alias("name"),
        F.when(called, F.to_json(F.struct("text", turn.alias("turn"), "role"))).alias("arguments"),
        F.when(~called, F.col("text")).alias("content"),
        F.when(F.col("role") == "user", F.array(id_(2))).alias("depends_on"),
    ).where("kind is not null")


def digest(linked: DataFrame) -> DataFrame:
    return linked.select(F.col("group").alias("conv_id"), "call_id", "status", "call_turn", "result_turn", "at", "depth", "valid", F.size("errors").cast("bigint").alias("n_errors"), F.sha2("record", 256).alias("record_sha256"))
