"""Chat formatting: tool calls linked to their results, ordered by dependence, validated, and serialised.

Calls and results of a conversation meet in a hash join on the identifier, results summed up by identifier before it. A
conversation whose calls only use earlier ones is in topological order as it stands; only where a call uses a later one are
calls peeled off level by level: within one task for a conversation of up to PEELED calls, else in distributed rounds, all
conversations at once. What is never peeled off depends on a cycle.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, pick, ranked_rows, written

#: Calls and uses of a conversation that one task peels; larger ones are peeled in distributed rounds.
PEELED = 1 << 20
#: Schemas of the calls that turns are read as.
TURN_SCHEMAS = {name: {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}}, "required": ["text"], "additionalProperties": False} for name in ("reply", "configure")}
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What of value breaks a JSON schema (type, enum, const, bounds, lengths, pattern, items, properties), in order of place."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds if isinstance(kinds, str) else '|'.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for key, bad in (("minimum", lambda m: value < m), ("maximum", lambda m: value > m), ("exclusiveMinimum", lambda m: value <= m), ("exclusiveMaximum", lambda m: value >= m)):
            if key in schema and bad(schema[key]):
                out.append(f"{at}: breaks {key}")
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if len(value) < schema.get(low, 0):
            out.append(f"{at}: breaks {low}")
        if len(value) > schema.get(high, math.inf):
            out.append(f"{at}: breaks {high}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: breaks pattern")
    if isinstance(value, list) and "items" in schema:
        out += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += problems(value[k], schema["additionalProperties"], f"{at}.{k}")
    return out


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, KINDS[kind])


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and whole numbers without a fraction: equal values give equal text."""

    def whole(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        return {k: whole(x) for k, x in v.items()} if isinstance(v, dict) else [whole(x) for x in v] if isinstance(v, list) else v

    return json.dumps(whole(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def parsed(text: str):
    """The value of a JSON text. ValueError for all that JSON doesn't have or that can't be held: NaN and infinities,
    numbers beyond a double's range, integers of over 4,300 digits, values nested too deeply."""

    def number(digits: str) -> float:
        if math.isinf(value := float(digits)):
            raise ValueError(f"{digits} is out of range")
        return value

    def constant(name: str):
        raise ValueError(f"{name} isn't JSON")

    try:
        value = json.loads(text, parse_float=number, parse_constant=constant)
        canonical(value)
        return value
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def whole_text(text: str) -> str:
    """text with U+FFFD for what isn't a character: half a surrogate pair."""
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text).

    A text that is a JSON object with "tool_calls" ([{"id", "name", "arguments", "after"}]) is those calls, one with
    "tool_call_id" is that call's result ("content"). Any other user or system turn is itself a call (reply, configure),
    which the next turn answers if it is of another role, and which uses the call of the turn but one before. JSON that can't
    be parsed is an ordinary text; an "after" that isn't a list counts as one of one entry, other values than texts as their
    canonical JSON; half surrogate pairs become U+FFFD.
    """

    def run(batches):
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    found = parsed(text) if text and text.lstrip()[:1] == "{" else None
                except ValueError:
                    found = None
                if isinstance(found, dict) and isinstance(found.get("tool_calls"), list):
                    for i, c in enumerate(x for x in found["tool_calls"] if isinstance(x, dict)):
                        arguments, after = c.get("arguments"), c.get("after")
                        after = after if isinstance(after, list) else [] if after is None else [after]
                        out.append(("call", conv, turn, i, _text(c.get("id")), _text(c.get("name")), arguments if isinstance(arguments, str) else json.dumps(arguments), [_text(x) for x in after if x is not None], None))
                elif isinstance(found, dict) and "tool_call_id" in found:
                    out.append(("result", conv, turn, 0, _text(found["tool_call_id"]), None, None, None, _text(found.get("content"))))
                elif role in ("user", "system"):
                    before = [f"{conv}:{turn - 2}"] if turn is not None and turn >= 2 else []
                    out.append(("call", conv, turn, 0, f"{conv}:{turn}", "reply" if role == "user" else "configure", json.dumps({} if text is None else {"text": text}), before, None))
                else:
                    out.append(("result", conv, turn, 0, f"{conv}:{turn - 1}" if turn is not None else None, None, None, None, text))
            kinds = [pa.string(), batch.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    names = ["kind", "conv_id", "turn", "place", "call_id", "name", "arguments", "after", "content"]
    picked = pick(conversations, "conv_id", "turn", "role", "text").withColumn("turn", F.col("turn").cast("long"))
    conv = picked.schema["conv_id"].dataType.simpleString()
    every = written(picked.mapInArrow(run, f"kind string, conv_id {conv}, turn long, place int, call_id string, name string, arguments string, after array<string>, content string"))
    return every.filter("kind = 'call'").drop("kind", "content"), every.filter("kind = 'result'").select("conv_id", "turn", "call_id", "content")


def _text(value) -> str | None:
    return value if value is None else whole_text(value if isinstance(value, str) else canonical(value))


def matching(a: DataFrame, b: DataFrame, *names: str):
    """Condition that columns (name in a, _name in b) are equal, nulls of the first one included."""
    first, *others = (a[n] for n in names)
    out = first.eqNullSafe(b["_" + names[0]])
    for n, c in zip(names[1:], others):
        out = out & (c == b["_" + n])
    return out


def renamed(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumnsRenamed({n: "_" + n for n in names})


def peeled(calls: list[str], uses: list[tuple[str, str]]) -> dict[str, int]:
    """Level of each of a conversation's calls: how many uses the longest way to one that uses nothing has; -1 on or behind a cycle."""
    waiting = {c: 0 for c in calls}
    users: dict[str, list[str]] = {}
    for call, used in uses:
        waiting[call] += 1
        users.setdefault(used, []).append(call)
    out, level, now = dict.fromkeys(calls, -1), 0, [c for c, n in waiting.items() if not n]
    while now:
        ahead = []
        for used in now:
            out[used] = level
            for call in users.get(used, ()):
                waiting[call] -= 1
                if not waiting[call]:
                    ahead.append(call)
        now, level = ahead, level + 1
    return out


def in_rounds(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """conv_id, call_id, level as peeled() gives them, one level of all conversations in each round."""
    calls, left, level = checkpointed(calls.select("conv_id", "call_id")), checkpointed(uses), 0
    done = []
    while True:
        waiting = renamed(left.select("conv_id", "call_id").distinct(), "conv_id", "call_id")
        ready = checkpointed(calls.join(waiting, matching(calls, waiting, "conv_id", "call_id"), "left_anti").withColumn("level", F.lit(level)))
        done.append(ready)
        if ready.isEmpty():
            break
        gone = renamed(ready.select("conv_id", "call_id"), "conv_id", "call_id")
        calls = checkpointed(calls.join(gone, matching(calls, gone, "conv_id", "call_id"), "left_anti"))
        used = gone.withColumnRenamed("_call_id", "_used")
        left = checkpointed(left.join(used, matching(left, used, "conv_id", "used"), "left_anti"))
        level += 1
    done.append(calls.withColumn("level", F.lit(-1)))
    out = done[0]
    for some in done[1:]:
        out = out.unionByName(some)
    return out


def levels(calls: DataFrame, most: int | None = None) -> DataFrame:
    """conv_id, call_id, level of conversations that need peeling: how many calls stand between a call and those that use
    nothing; -1 on or behind a cycle. A use of an unknown call doesn't count; calls with one identifier are one call, which
    stands where the first of them does."""
    most = PEELED if most is None else most
    known = calls.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "place")).alias("at"))
    uses = calls.filter("call_id is not null").select("conv_id", "call_id", F.struct("turn", "place").alias("own"), F.explode("after").alias("used"))
    target = known.select(F.col("conv_id").alias("_conv_id"), F.col("call_id").alias("_used"), F.col("at").alias("where"))
    uses = checkpointed(uses.join(target, matching(uses, target, "conv_id", "used")).select("conv_id", "call_id", "used", (F.col("where") >= F.col("own")).alias("late")))
    late = uses.filter("late")
    if late.isEmpty():
        return late.select("conv_id", "call_id", F.lit(0).alias("level"))
    bad = renamed(late.select("conv_id").distinct(), "conv_id")
    links = uses.select("conv_id", "call_id", "used").distinct()
    links = links.join(bad, matching(links, bad, "conv_id"), "left_semi")
    nodes = known.select("conv_id", "call_id", F.lit(None).cast("string").alias("used"))
    rows = checkpointed(nodes.join(bad, matching(nodes, bad, "conv_id"), "left_semi").unionByName(links))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    large = renamed(sizes.filter(F.col("n") > most).select("conv_id"), "conv_id")
    small = rows.join(large, matching(rows, large, "conv_id"), "left_anti")

    def run(batches):
        held, last, any_ = [], None, False

        def done():
            got = peeled([c for c, u in held if u is None], [(c, u) for c, u in held if u is not None])
            return pa.RecordBatch.from_arrays([pa.array([last] * len(got), kind), pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int32())], ["conv_id", "call_id", "level"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, call, used in zip(*(c.to_pylist() for c in batch.columns)):
                if any_ and conv != last:
                    yield done()
                    held = []
                last, any_ = conv, True
                held.append((call, used))
        if any_:
            yield done()

    conv = rows.schema["conv_id"].dataType.simpleString()
    out = small.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(run, f"conv_id {conv}, call_id string, level int")
    if large.isEmpty():
        return out
    rest = rows.join(large, matching(rows, large, "conv_id"), "left_semi")
    return out.unionByName(in_rounds(rest.filter("used is null"), rest.filter("used is not null")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, call_id, position, status, problems, n_results, record: a row per call, and per result id without one.

    Identifiers are those of a conversation; a null conv_id is one as well. position numbers a conversation's rows in
    topological order, ties by turn and place. record is canonical JSON with the call's arguments (null if they aren't JSON)
    and its first result. status, the first that holds: orphan_result, duplicate_id (several calls have it), cycle,
    unknown_tool, invalid_json, invalid_arguments, missing_result, ok. Of several results the earliest (then least) is taken.
    Null identifiers link nothing. Empty tables give no rows.
    """
    calls = written(calls)
    counts = renamed(calls.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls")), "conv_id", "call_id")
    found = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.min(F.struct(F.coalesce("turn", F.lit(1 << 62)).alias("turn"), "content")).alias("first"))
    found = written(found.select("conv_id", "call_id", "n_results", F.col("first.content").alias("content"), F.when(F.col("first.turn") < 1 << 62, F.col("first.turn")).alias("turn")))
    level = renamed(levels(calls), "conv_id", "call_id")
    answers = renamed(found, "conv_id", "call_id").drop("turn")
    columns = ["conv_id", "turn", "place", "call_id", "name", "arguments", "level", "n_calls", "n_results", "content", "orphan"]
    with_counts = calls.join(counts, matching(calls, counts, "conv_id", "call_id"), "left").drop("_conv_id", "_call_id")
    with_level = with_counts.join(level, matching(with_counts, level, "conv_id", "call_id"), "left").drop("_conv_id", "_call_id")
    linked = with_level.join(answers.hint("shuffle_hash"), matching(with_level, answers, "conv_id", "call_id"), "left").withColumn("orphan", F.lit(False))
    lost = found.join(counts, matching(found, counts, "conv_id", "call_id"), "left_anti").withColumn("orphan", F.lit(True))
    rows = linked.select(*columns).unionByName(lost, allowMissingColumns=True)
    rows = rows.withColumns({"place": F.coalesce("place", F.lit(0)), "level": F.coalesce("level", F.lit(0)), "n_calls": F.coalesce("n_calls", F.lit(1)), "n_results": F.coalesce("n_results", F.lit(0)).cast("long")})

    def run(batches):
        for batch in batches:
            out = [_judged(schemas, *r) for r in zip(*(batch.column(i).to_pylist() for i in range(3, 11)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(6), batch.column(8), *(pa.array(c, pa.string()) for c in (zip(*out) if out else ([], [], [])))], ["conv_id", "turn", "place", "call_id", "level", "n_results", "status", "problems", "record"])

    conv = rows.schema["conv_id"].dataType.simpleString()
    made = rows.select(*columns).mapInArrow(run, f"conv_id {conv}, turn long, place int, call_id string, level int, n_results long, status string, problems string, record string")
    ranked = written(ranked_rows(made, ["conv_id", "level", "turn", "place", "call_id"]))
    first = ranked.groupBy(F.col("conv_id").alias("f")).agg(F.min("rank").alias("least"))
    return ranked.join(first, F.col("conv_id").eqNullSafe(F.col("f"))).select("conv_id", "turn", "call_id", (F.col("rank") - F.col("least")).alias("position"), "status", "problems", "n_results", "record")


def _judged(schemas: dict, call_id, name, arguments, level, n_calls, n_results, content, orphan) -> tuple[str, str, str]:
    """Status, problems and record of one joined row."""
    broken, value, wrong = False, None, []
    try:
        value = parsed(arguments) if arguments is not None else None
    except ValueError:
        broken = True
    if not broken and name in schemas:
        wrong = problems(value, schemas[name])
    status = next(s for s, holds in (("orphan_result", orphan), ("duplicate_id", n_calls > 1), ("cycle", level < 0), ("unknown_tool", name not in schemas), ("invalid_json", broken), ("invalid_arguments", wrong), ("missing_result", not n_results), ("ok", True)) if holds)
    return status, whole_text("; ".join(wrong)), whole_text(canonical({"id": call_id, "name": name, "arguments": value, "result": content, "status": status}))


def link_turns(conversations: DataFrame) -> DataFrame:
    """link_tool_calls over the calls and results of messages."""
    return link_tool_calls(*from_turns(conversations), TURN_SCHEMAS)
