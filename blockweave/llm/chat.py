"""Chat formatting with tool-call linking.

Messages are rows (conversation, turn, role, text). A text that is a JSON object may carry

* ``{"tool_calls": [{"id": …, "name": …, "arguments": {…}, "depends_on": [ids]}, …], "content": …}`` in an assistant's turn,
* ``{"tool_call_id": …, "content": …}`` in a tool's turn;

every other text is plain content. Calls and results become rows of their own and are joined
by a hash of (conversation, identifier); when an identifier recurs, its n-th call takes its
n-th result. Messages are then ordered topologically: a result comes after its call, a call
after the results of the calls it depends on, and otherwise turns keep their order. Only links
meet: those of one conversation in one task while they are at most ``MOST`` (some 30 MB), however long
their chains are; those of a larger one are relaxed by joins, a round for each step of its longest
chain, so that none is ever gathered. Arguments are validated against the tools' schemas.

One row per message comes out, with canonical JSON: keys sorted, no white space, shortest
numbers, UTF-8. Content of any shape stays as it is; what an envelope or a call holds besides the
keys above stands under "extra".

Defined results: a null text is null content, a null role is "unknown". A call without a result
has status "unanswered", a result without a call "orphan", a call on a cycle of dependencies
"cyclic" (it keeps its turn's place); a call is also "invalid" with the first reason why its
arguments fail, or "unknown_tool". A call without an identifier is unanswered. An object that
repeats a key is refused: the text stays plain content, with status "invalid"; so is one in a
call's arguments that are themselves text. Objects that are no JSON by the standard (NaN, a depth
that cannot be read) are plain content. Halves of surrogate pairs, which UTF-8 does not have, stand
as their escapes. Repeated messages are messages of their own. Null
conversations or turns are values like others and come first. An empty table gives no rows.
Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.runtime import numbered, settle

#: Links of a conversation that are ordered in one task, at most.
MOST = 100_000
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    """Canonical JSON: sorted keys, no white space, whole floats as whole numbers; NaN and infinities are refused."""

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return x

    return _whole(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _whole(text: str) -> str:
    """``text`` with halves of surrogate pairs, which UTF-8 does not have, as their escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


class RepeatedKey(ValueError):
    pass


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise RepeatedKey(f"$: repeated key {next(k for i, (k, _) in enumerate(pairs) if k in dict(pairs[:i]))}")
    return out


def _no_number(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


def parsed(text: str) -> Any:
    """What a JSON text says; objects that repeat a key are refused, and what no JSON text could give back."""
    value = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_number)
    canonical(value)
    return value


def _is(value: Any, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, KINDS.get(kind, ()))


def invalid(value: Any, schema: dict, path: str = "$") -> str | None:
    """Why ``value`` fails a JSON schema: type, enum, const, bounds, lengths, pattern, properties, required, items, anyOf."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{path}: not of type {kinds if isinstance(kinds, str) else '/'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not one of the values allowed"
    if "const" in schema and value != schema["const"]:
        return f"{path}: not the value required"
    if "anyOf" in schema and all(invalid(value, s, path) for s in schema["anyOf"]):
        return f"{path}: fits none of the schemas"
    if _is(value, "number"):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            return f"{path}: out of bounds"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            return f"{path}: wrong length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{path}: does not match the pattern"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            return f"{path}: wrong number of items"
        for i, x in enumerate(value):
            if "items" in schema and (why := invalid(x, schema["items"], f"{path}[{i}]")):
                return why
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for key in schema.get("required", []):
            if key not in value:
                return f"{path}.{key}: missing"
        for key in sorted(value):
            if key in known:
                if why := invalid(value[key], known[key], f"{path}.{key}"):
                    return why
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{key}: not allowed"
    return None


class Part(NamedTuple):
    """A plain message, a call or a result. ``body`` is the content or the arguments as JSON, ``extra`` an object of what stands beside."""

    part: int
    kind: str
    body: str
    call_id: str | None = None
    name: str | None = None
    depends_on: list[str] | None = None
    extra: str | None = None
    why: str | None = None


def _name(value: Any) -> str | None:
    return None if value is None else _whole(value) if isinstance(value, str) else canonical(value)


def _extra(found: dict[str, Any], known: tuple[str, ...]) -> str | None:
    rest = {k: v for k, v in found.items() if k not in known}
    return canonical(rest) if rest else None


def read(role: str, text: str | None) -> list[Part]:
    """The parts of a message."""
    whole, why = [Part(0, "plain", canonical(text))], None
    if text is None or not re.match(r"[ \t\r\n]*\{", text):  # JSON's own white space may stand before an object
        return whole
    try:
        found = parsed(text)
    except RepeatedKey as e:
        return [whole[0]._replace(why=_whole(str(e)))]
    except (ValueError, RecursionError):
        return whole
    calls = found.get("tool_calls")
    if role == "assistant" and isinstance(calls, list) and calls and all(isinstance(c, dict) for c in calls):
        # one message for the content and what else stands beside the calls, if any, and one per call
        extra, out = _extra(found, ("tool_calls", "content")), []
        if found.get("content") is not None or extra:
            out.append(Part(0, "plain", canonical(found.get("content")), extra=extra))
        for i, c in enumerate(calls):
            needed = c.get("depends_on")
            names = [_name(x) for x in needed if x is not None] if isinstance(needed, list) else None
            more = _extra(c, ("id", "name", "arguments", "depends_on") if names is not None else ("id", "name", "arguments"))
            arguments = c.get("arguments")
            if isinstance(arguments, str):  # arguments that are themselves a JSON text
                try:
                    arguments = parsed(arguments)
                except RepeatedKey as e:
                    why = _whole(str(e))
                except (ValueError, RecursionError):
                    why = "$: not JSON"
            out.append(Part(i + 1, "call", canonical({} if arguments is None else arguments), _name(c.get("id")), _name(c.get("name")), names, more, why))
            why = None
        return out
    if role == "tool" and found.get("tool_call_id") is not None:
        return [Part(0, "result", canonical(found.get("content")), _name(found["tool_call_id"]), extra=_extra(found, ("tool_call_id", "content")))]
    return whole


MESSAGE = "conv_id long, turn long, row long, role string, part int, kind string, body string, call_id string, name string, depends_on array<string>, extra string, why string"


def _messages(turns: DataFrame) -> DataFrame:
    """MESSAGE rows: one per plain message, call and result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(role, text) for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            at = pa.array([i for i, parts in enumerate(found) for _ in parts], pa.int64())
            own = [batch.column(c).take(at) for c in ("conv_id", "turn", "row", "role")]
            columns = list(zip(*[p for parts in found for p in parts])) or [()] * len(Part._fields)
            kinds = [pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns, kinds)], names=[x.split()[0] for x in MESSAGE.split(", ")])

    return turns.mapInArrow(run, MESSAGE)


def linked(turns: DataFrame, schemas: dict[str, dict], conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """OUT rows, one per message, call and result; (order_turn, depth, turn, row, part) orders a conversation."""
    own = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.col(text_col).alias("text"),
    )
    messages = settle(_messages(own), "messages")
    ends = messages.where("kind <> 'plain' AND call_id IS NOT NULL").select("conv_id", "call_id", "kind", "turn", "row", "part")
    at = F.struct("row", "part", "turn")
    ends = numbered(ends, ["conv_id", "call_id", "kind"], ["turn", "row", "part"]).select("conv_id", "call_id", "kind", "nth", at.alias("at"))
    ends = settle(ends, "ends")
    c, r = ends.where("kind = 'call'").alias("c"), ends.where("kind = 'result'").alias("r")
    same = F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("c.call_id") == F.col("r.call_id")) & (F.col("c.nth") == F.col("r.nth"))
    pairs = settle(c.join(r.hint("shuffle_hash"), same).select("c.conv_id", "c.call_id", F.col("c.at").alias("call"), F.col("r.at").alias("result")), "pairs")
    # what must come before what: a call before its result, results before the calls that depend on them
    wanted = messages.where("kind = 'call'").select("conv_id", at.alias("after"), F.explode("depends_on").alias("needed"))
    first = pairs.groupBy("conv_id", "call_id").agg(F.min("result").alias("before"))
    depends = wanted.alias("w").join(first.alias("f"), F.col("w.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("w.needed") == F.col("f.call_id"))).select("w.conv_id", "before", "after")
    edges = settle(pairs.select("conv_id", F.col("call").alias("before"), F.col("result").alias("after")).unionByName(depends), "edges")
    places = settle(_positions(edges), "placed")
    paired = pairs.select(F.col("call").alias("at")).unionByName(pairs.select(F.col("result").alias("at"))).select("at.row", "at.part", F.lit(True).alias("paired"))
    out = messages.join(places, ["row", "part"], "left").join(paired, ["row", "part"], "left")
    cyclic = F.coalesce("cyclic", F.lit(False))
    placed = F.when(cyclic | F.col("place").isNull(), F.struct(F.col("turn"), F.lit(0).alias("depth"))).otherwise(F.col("place"))
    missing = F.when(F.col("kind") == "call", "unanswered").when(F.col("kind") == "result", "orphan")
    status = F.when(cyclic, "cyclic").otherwise(F.coalesce(F.when(F.col("paired").isNull(), missing), F.lit("ok")))
    return _written(out.withColumns({"place": placed, "status": status}), schemas)


PLACED = "row long, part int, place struct<turn: long, depth: int>, cyclic boolean"


def order(edges: list[tuple[tuple, tuple]]) -> Iterator[tuple[int, int, dict, bool]]:
    """PLACED rows of the ends of ``edges``, pairs of (row, part, turn), by Kahn's method.

    A message starts at its own turn; along an edge the later one is moved to at least the
    earlier one's place, one step deeper. What is on a cycle or behind one is marked.
    """
    after: dict[tuple, list[tuple]] = {}
    open_edges: dict[tuple, int] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        open_edges.setdefault(a, 0)
        open_edges[b] = open_edges.get(b, 0) + 1
    # a null turn comes before all others
    place = {x: ((x[2] is not None, x[2] or 0), 0) for x in open_edges}
    ready = [x for x, n in open_edges.items() if not n]
    left = set(open_edges)
    for x in ready:
        left.discard(x)
        turn, depth = place[x]
        for b in after.get(x, ()):
            place[b] = max(place[b], (turn, depth + 1))
            open_edges[b] -= 1
            if not open_edges[b]:
                ready.append(b)
    for x in open_edges:
        (known, turn), depth = place[x]
        yield x[0], x[1], {"turn": turn if known else None, "depth": depth}, x in left


def _positions(edges: DataFrame) -> DataFrame:
    """PLACED rows of all messages with edges (conv_id, before, after)."""
    sizes = edges.groupBy("conv_id").agg(F.count("*").alias("size"))
    many = settle(sizes.where(F.col("size") > MOST).select("conv_id"), "many")
    if many.isEmpty():
        return _grouped(edges)
    same = F.col("e.conv_id").eqNullSafe(F.col("m.conv_id"))
    few = edges.alias("e").join(many.alias("m"), same, "left_anti")
    return _grouped(few).unionByName(_by_rounds(edges.alias("e").join(many.alias("m"), same, "left_semi")))


def _grouped(edges: DataFrame) -> DataFrame:
    """Orders each conversation in one task; edges of many are streamed through it one after another."""
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = [F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("before", "after") for c in ("row", "part", "turn")]
    rows = edges.select("conv_id", *ends).repartition(tasks, "conv_id").sortWithinPartitions("conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
            place = pa.struct([("turn", pa.int64()), ("depth", pa.int32())])
            columns = [pa.array(c, t) for c, t in zip(zip(*order(held)), (pa.int64(), pa.int32(), place, pa.bool_()))]
            return pa.RecordBatch.from_arrays(columns, names=["row", "part", "place", "cyclic"])

        now, held = object(), []
        for batch in batches:
            for conv, *x in zip(*[c.to_pylist() for c in batch.columns]):
                if held and conv != now:
                    yield done(held)
                    held = []
                now = conv
                held.append((tuple(x[:3]), tuple(x[3:])))
        if held:
            yield done(held)

    return rows.mapInArrow(run, PLACED)


def _by_rounds(edges: DataFrame) -> DataFrame:
    """As ``order``, by joins: in every round the messages leave whose predecessors have all left."""
    left = settle(edges.select(F.struct("before.row", "before.part").alias("before"), F.struct("after.row", "after.part").alias("after")), "edges")
    ends = edges.select(F.col("before").alias("x")).unionByName(edges.select(F.col("after").alias("x"))).distinct()
    place = settle(ends.select(F.struct("x.row", "x.part").alias("id"), F.struct(F.col("x.turn").alias("turn"), F.lit(0).alias("depth")).alias("place")), "places")
    fixed = None
    while True:
        blocked = left.select(F.col("after").alias("id")).distinct()
        ready = settle(place.join(blocked, "id", "left_anti"), "ready")
        if ready.isEmpty():
            break
        fixed = ready if fixed is None else fixed.unionByName(ready)
        moved = left.join(ready, F.col("before") == F.col("id")).groupBy("after").agg(F.max(F.struct("place.turn", (F.col("place.depth") + 1).alias("depth"))).alias("floor"))
        rest = place.join(ready.select("id"), "id", "left_anti")
        place = settle(rest.join(moved, rest["id"] == moved["after"], "left").select("id", F.greatest("place", F.coalesce("floor", "place")).alias("place")), "places")
        left = settle(left.join(ready.select(F.col("id").alias("before")), "before", "left_anti"), "edges")
    place = place.withColumn("cyclic", F.lit(True))
    done = place if fixed is None else place.unionByName(fixed.withColumn("cyclic", F.lit(False)))
    return done.select("id.row", "id.part", "place", "cyclic")


OUT = "conv_id long, turn long, row long, part int, order_turn long, depth int, kind string, call_id string, status string, json string"


def _written(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Statuses from validation, and the canonical JSON of every row."""

    def write(kind: str, role: str, body: str, call_id: str | None, name: str | None, depends_on: list[str] | None, extra: str | None, why: str | None, status: str) -> tuple[str, str]:
        value = json.loads(body)
        more = {"extra": json.loads(extra)} if extra is not None else {}
        if kind != "call":
            link = {"tool_call_id": call_id} if kind == "result" else {}
            return f"invalid {why}" if why else status, canonical({"content": value, "role": role} | link | more)
        why = why or (invalid(value, schemas[name]) if name in schemas else None)
        if why:
            status = f"invalid {why}"
        elif name not in schemas and status == "ok":
            status = "unknown_tool"
        needed = {"depends_on": depends_on} if depends_on is not None else {}
        return status, canonical({"role": role, "tool_call": {"arguments": value, "id": call_id, "name": name} | needed | more})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [batch.column(c).to_pylist() for c in ("kind", "role", "body", "call_id", "name", "depends_on", "extra", "why", "status")]
            done = [write(*x) for x in zip(*fields)]
            kept = [batch.column(x.split()[0]) for x in OUT.split(", ")[:-2]]
            columns = [*kept, pa.array([_whole(s) for s, _ in done], pa.string()), pa.array([j for _, j in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OUT.split(", ")])

    flat = rows.select(
        "conv_id", "turn", "row", "part", F.col("place.turn").alias("order_turn"), F.col("place.depth").alias("depth"), "kind", "call_id",
        "role", "body", "name", "depends_on", "extra", "why", "status",
    )
    return flat.mapInArrow(run, OUT)
