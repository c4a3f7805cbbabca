"""Texts of JSON bodies, found by walking VARIANT values along a table of states.

A protocol says what a node of each state may be and what states its members have.  A level of
the walk is one generator over the nodes at hand: containers become their members, and what is
done stays as it is.  So a few levels are one pass in the JVM, whatever the bodies look like.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.requests import with_hint, written_back
from .pseudonymize import reverse, unused
from .vault import _held, shuffled

#: Levels walked before the nodes are stored and looked at; deeper bodies take more rounds.
LEVELS = 4


@dataclass
class State:
    """What nodes of one state may be: kinds (string, number, boolean, null, array, object) to outcomes.

    An outcome is ``leaf``, ``skip``, ``refuse``, ``open`` (its members are walked) or ``parse`` (a
    string that holds JSON: ``refuse`` or ``leaf`` where it can't be parsed, by the protocol).  ``keys``
    and ``rest`` are the states of members, ``items`` that of elements.  With ``kinds`` an object gets the
    state of its ``type``; ``other`` is that of types not named, and ``untyped`` that of objects without
    one that have all of some keys.
    """

    outcomes: dict[str, str] = field(default_factory=dict)
    otherwise: str = "refuse"
    items: str = "skip"
    keys: dict[str, str] = field(default_factory=dict)
    rest: str = "skip"
    kinds: dict[str, str] | None = None
    other: str = "refuse"
    untyped: tuple[str, tuple[str, ...]] | None = None


@dataclass
class Protocol:
    states: dict[str, State]
    #: What becomes of serialised JSON that can't be parsed.
    unparsed: str = "refuse"


def same(keys: Iterable[str], state: str) -> dict[str, str]:
    return dict.fromkeys(keys, state)


def _table(entries: dict[str, str]) -> Column:
    """The entries as a constant map."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"map({', '.join(quote(x) for e in entries.items() for x in e)})") if entries else F.create_map().cast("map<string,string>")


def _entry(entries: dict[str, str], *key: Column) -> Column:
    return F.try_element_at(_table(entries), F.concat_ws(".", *key))


def _members(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def kind_of(value: Column) -> Column:
    scalar = F.schema_of_variant(value)
    return (
        F.when(F.is_variant_null(value), "null").when(_members(value).isNotNull(), "object").when(F.try_variant_get(value, "$", "array<variant>").isNotNull(), "array")
        .when(scalar == "STRING", "string").when(scalar == "BOOLEAN", "boolean").otherwise("number")
    )


def _settled(node: Column, protocol: Protocol) -> Column:
    """A new node with its state and outcome; those that are skipped are left to the caller's filter."""
    state, value, states = node["state"], node["value"], protocol.states
    typed = {n: s for n, s in states.items() if s.kinds is not None}
    kind = F.try_variant_get(value, "$.type", "string")
    known = F.coalesce(_entry({f"{n}.{k}": to for n, s in typed.items() for k, to in s.kinds.items()}, state, kind), _entry({n: s.other for n, s in typed.items()}, state))
    for name, s in typed.items():
        if s.untyped:
            to, keys = s.untyped
            known = F.when((state == name) & kind.isNull() & reduce(lambda a, b: a & b, [F.map_contains_key(_members(value), k) for k in keys]), to).otherwise(known)
    named = F.coalesce(F.when(state.isin(*typed) & _members(value).isNotNull(), known), state) if typed else state
    results = {f"{n}.{k}": r for n, s in states.items() for k, r in s.outcomes.items()}
    others = {**{n: s.otherwise for n, s in states.items()}, "skip": "skip", "refuse": "refuse"}

    def judge(x: Column) -> Column:
        return F.coalesce(_entry(results, x["state"], x["kind"]), _entry(others, x["state"]))

    def one(x: Column) -> Column:
        return _let(F.struct(x["state"].alias("state"), kind_of(x["value"]).alias("kind"), x["value"].alias("value")), lambda y: F.struct(y["state"].alias("state"), y["value"].alias("value"), judge(y).alias("result")))

    def parsed(x: Column) -> Column:
        inner = F.try_parse_json(F.try_variant_get(x["value"], "$", "string"))
        again = F.struct(F.lit("json").alias("state"), inner.alias("value"))
        broken = F.struct(x["state"].alias("state"), x["value"].alias("value"), F.lit(protocol.unparsed).alias("result"))
        return F.when(x["result"] == "parse", _let(again, lambda y: F.when(y["value"].isNull(), broken).otherwise(one(y)))).otherwise(x)

    first = _let(F.struct(named.alias("state"), value.alias("value")), one)
    done = lambda x: F.struct(node["pointer"].alias("pointer"), x["state"].alias("state"), x["value"].alias("value"), F.when(x["result"] != "open", x["result"]).alias("done"))
    return _let(_let(first, parsed) if any("parse" in s.outcomes.values() for s in protocol.states.values()) else first, done)


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _children(protocol: Protocol) -> Column:
    """Members of an open node, settled; any other node as it is."""
    node = F.col("node")
    state = node["state"]

    def at(key: Column) -> Column:
        return F.concat_ws("/", F.nullif(node["pointer"], F.lit("")), key)

    states = protocol.states
    keys = {f"{n}.{k}": to for n, s in states.items() for k, to in s.keys.items()}

    def member(e: Column) -> Column:
        to = F.coalesce(_entry(keys, state, e["key"]), _entry({n: s.rest for n, s in states.items()}, state))
        key = F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        return F.struct(at(key).alias("pointer"), to.alias("state"), e["value"].alias("value"))

    def element(v: Column, i: Column) -> Column:
        return F.struct(at(i.cast("string")).alias("pointer"), _entry({n: s.items for n, s in states.items()}, state).alias("state"), v.alias("value"))

    inner = F.coalesce(F.transform(F.map_entries(_members(node["value"])), member), F.transform(F.try_variant_get(node["value"], "$", "array<variant>"), element))
    inner = F.filter(F.transform(F.filter(inner, lambda x: x["state"] != "skip"), lambda x: _settled(x, protocol)), lambda x: ~x["done"].eqNullSafe("skip"))
    return F.when(node["done"].isNull(), inner).otherwise(F.array(node))


def walked(bodies: DataFrame, protocol: Protocol, body: str = "body", serialised: bool = False) -> DataFrame:
    """``row`` (a number), ``own`` (the other columns), pointer, text, was_number, done of each body's nodes.

    ``done`` is ``leaf`` or ``refuse``, or ``root``: one such row stands for every body.  A body that is
    null or no JSON, or one with a key twice, counts as JSON's null.  With ``serialised`` the root is a
    node of state ``arguments``, a string that holds JSON.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in bodies.columns if c != body]) if len(bodies.columns) > 1 else F.lit(None).cast("string")
    value = F.col(f"`{body}`").cast("string")
    value = value.cast("variant") if serialised else F.try_parse_json(value)
    nothing = F.parse_json(F.lit("null"))
    root = F.struct(F.lit("").alias("pointer"), F.lit("arguments" if serialised else "body").alias("state"), F.coalesce(value, nothing).alias("value"))
    mark = F.struct(F.lit("").alias("pointer"), F.lit("root").alias("state"), nothing.alias("value"), F.lit("root").alias("done"))
    rows = bodies.select(F.monotonically_increasing_id().alias("row"), own.alias("own"), _settled(root, protocol).alias("root"))
    rows = rows.select("row", "own", F.explode(F.array(mark, F.col("root"))).alias("node")).where(~F.col("node.done").eqNullSafe("skip"))
    parts, children = [], _children(protocol)
    while True:
        for _ in range(LEVELS):
            rows = rows.select("row", "own", F.explode(children).alias("node"))
        rows = _held(rows)
        parts.append(rows.where("node.done is not null"))
        rows = rows.where("node.done is null")
        if rows.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, parts)
    value = F.col("node.value")
    number = F.col("node.done").eqNullSafe("leaf") & (kind_of(value) == "number")
    text = F.when(F.col("node.done") == "leaf", F.try_variant_get(value, "$", "string"))
    return rows.select("row", "own", "node.pointer", text.alias("text"), number.alias("was_number"), "node.done")


def _own(rows: DataFrame, *more: str) -> DataFrame:
    names = rows.schema["own"].dataType.names if rows.schema["own"].dataType.typeName() == "struct" else []
    return rows.select(*[F.col("own").getField(n).alias(n) for n in names], *more)


def text_nodes(bodies: DataFrame, protocol: Protocol, body: str = "body") -> DataFrame:
    """pointer, text and was_number of each text of the bodies that ``protocol`` does not refuse, with their other columns.

    Empty texts are left out.  Below serialised arguments a pointer leads on into their JSON; "~"
    and "/" in keys are written "~0" and "~1".
    """
    rows = walked(bodies, protocol, body)
    refused = rows.where("done = 'refuse'").select("row").distinct()
    return _own(rows.where("done = 'leaf' and text <> ''").join(refused, "row", "left_anti"), "pointer", "text", "was_number")


def refusals(bodies: DataFrame, protocol: Protocol, body: str = "body") -> DataFrame:
    """The bodies' other columns with ``refused``, and ``pointers`` (sorted) to what nothing scans."""
    rows = walked(bodies, protocol, body)
    at = F.array_sort(F.collect_list(F.when(F.col("done") == "refuse", F.col("pointer"))))
    found = rows.where("done <> 'leaf'").groupBy("row").agg(F.first("own").alias("own"), at.alias("pointers"))
    return _own(found.withColumn("refused", F.size("pointers") > 0), "refused", "pointers")


def argument_leaves(rows: DataFrame, arguments: str = "arguments") -> DataFrame:
    """pointer, text and was_number of the strings and numbers in serialised JSON, with the other columns.

    What can't be parsed is one leaf as it stands; null has none.
    """
    protocol = Protocol({"arguments": State({"string": "parse"}, "skip"), "json": State({"string": "leaf", "number": "leaf", "object": "open", "array": "open"}, "skip", items="json", rest="json")}, unparsed="leaf")
    return _own(walked(rows, protocol, arguments, serialised=True).where("done = 'leaf'"), "pointer", "text", "was_number")


def restored_bodies(answers: DataFrame, protocol: Protocol, entries: DataFrame, body: str = "body", fuzzy: bool = False) -> DataFrame:
    """``answers`` (mapping, ``body``, ...) with the placeholders of their own mapping put back in every text of ``protocol``.

    Texts are restored apart from their body and written back into it, so values with quotes stay
    valid JSON, in serialised arguments too.  Bodies without such a text stay as they are.
    """
    row = unused(answers, "__row")
    held = _held(answers.withColumn(row, F.monotonically_increasing_id()))
    some = held.where(F.col(f"`{body}`").rlike(r"\[|(?i)[a-z][_\s]*[a-z]+[0-9]")).select(row, "mapping", F.col(f"`{body}`").alias("body"))
    nodes = text_nodes(some, protocol).where("not was_number")
    back = reverse(nodes, entries, fuzzy=fuzzy, text="text").where("restored <> text")
    patch = back.groupBy(row).agg(F.collect_list(F.struct("pointer", "restored")).alias("patch"))
    out = held.join(shuffled(patch.select(row, F.col("patch.pointer").alias("__at"), F.col("patch.restored").alias("__new"))), row, "left")
    # Bodies without a patch don't go to Python.
    done = out.where("__at is not null").withColumn(body, written_back(F.col(f"`{body}`"), F.col("__at"), F.col("__new"))).unionByName(out.where("__at is null"))
    return done.select(*[F.col(f"`{c}`") for c in answers.columns])


def hinted(requests: DataFrame, place: str, wrapped: str | None = None, replaced: str = "n_replaced", body: str = "body") -> DataFrame:
    """``requests`` with the hint on placeholders in bodies where something was ``replaced``; the others don't go to Python.

    ``place`` is ``messages`` for the chat protocol, and ``input`` with entries of type ``message`` for the responses protocol.
    """
    some = F.coalesce(F.col(f"`{replaced}`") > 0, F.lit(False))
    return requests.where(some).withColumn(body, with_hint(F.col(f"`{body}`"), place, wrapped)).unionByName(requests.where(~some))
