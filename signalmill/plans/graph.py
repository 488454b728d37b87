"""Processing plans as nested columns: ``array<struct<id,type,bypass,params,bands>>`` and edits on them."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BANDS = "array<struct<shape:string,frequency_hz:double,gain_db:double,q:double>>"
NODE = f"struct<id:string,type:string,bypass:boolean,params:map<string,double>,bands:{BANDS}>"
NODES = f"array<{NODE}>"


def _num(v) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def band(shape: str, hz, gain_db, q) -> Column:
    return F.struct(F.lit(shape).alias("shape"), _num(hz).alias("frequency_hz"), _num(gain_db).alias("gain_db"),
                    _num(q).alias("q"))


def node(id_: str | Column, kind: str, bands: Column | None = None, **params) -> Column:
    pairs = [x for k, v in params.items() for x in (F.lit(k), _num(v))]
    table = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
    shapes = bands if bands is not None else F.lit(None).cast(BANDS)
    name = F.lit(id_) if isinstance(id_, str) else id_
    return F.struct(name.alias("id"), F.lit(kind).alias("type"), F.lit(False).alias("bypass"),
                    table.alias("params"), shapes.alias("bands"))


def nodes(*items: Column) -> Column:
    """Non-null nodes in order."""
    return F.filter(F.array(*items), lambda n: n.isNotNull())


def chosen(kind: str, *items) -> Column:
    """Items in order as an array of type ``kind``: each a column that is never null, or a list of ``(condition, column)`` of which the
    first that holds counts, if any. Unlike a filter over an array it is compiled as a whole."""
    none = F.array().cast(kind)
    parts = [none]
    for item in items:
        if isinstance(item, list):
            part = F
            for condition, value in item:
                part = part.when(condition, F.array(value))
            parts.append(part.otherwise(none))
        else:
            parts.append(F.array(item))
    return F.concat(*parts)


def add(graph: Column, item: Column) -> Column:
    return F.when(item.isNull(), graph).otherwise(F.concat(graph, F.array(item)))


def contains(graph: Column, id_: str) -> Column:
    return F.exists(graph, lambda n: n["id"] == id_)


def set_bypass(graph: Column, id_: str, when: Column) -> Column:
    return F.transform(graph, lambda n: n.withField("bypass", n["bypass"] | (when & (n["id"] == id_))))


def insert_before(graph: Column, anchor: str | Column, *items) -> Column:
    """Insert items in order before the node named ``anchor``, or append them when there is none.

    An item is a node, of which null changes nothing, or a list as in ``chosen``.
    """
    return insert_all(graph, (anchor, *items))


def insert_all(graph: Column, *places: tuple) -> Column:
    """``insert_before`` at several places ``(anchor, *items)``. ``graph`` should be a plain column, as it is read several times.

    Where each anchor is met once and in this order, the plan is cut there; others are walked node by node.
    """
    names = [F.lit(p[0]) if isinstance(p[0], str) else p[0] for p in places]
    new = [chosen(NODES, *[i if isinstance(i, list) else [(i.isNotNull(), i)] for i in p[1:]]) for p in places]
    ids = graph["id"]
    at = [F.array_position(ids, name).cast("int") for name in names]
    once = F.size(reduce(F.array_remove, names, ids)) == F.size(ids) - len(names)
    ordered = reduce(lambda a, b: a & b, [x < y for x, y in zip([F.lit(0), *at], at)])
    ends = [*at, F.size(graph) + 1]
    cut = F.concat(F.slice(graph, 1, at[0] - 1), *[part for x, y, n in zip(at, ends[1:], new) for part in (n, F.slice(graph, x, y - x))])

    def around(n: Column) -> Column:
        out = F
        for name, items in zip(names, new):
            out = out.when(n["id"] == name, F.concat(items, F.array(n)))
        return out.otherwise(F.array(n))

    missing = [F.when(~F.array_contains(ids, name), items).otherwise(F.array().cast(NODES)) for name, items in zip(names, new)]
    return F.when(once & ordered, cut).otherwise(F.concat(F.flatten(F.transform(graph, around)), *missing))


def update_params(graph: Column, kind: str, changes: dict[str, object]) -> Column:
    """Change parameters of every node of one type; each change maps the old value to the new one."""
    def edit(n: Column) -> Column:
        new = F.transform_values(n["params"], lambda k, v: _apply(k, v, changes))
        return F.when(n["type"] == kind, n.withField("params", new)).otherwise(n)

    return F.transform(graph, edit)


def _apply(k: Column, v: Column, changes: dict) -> Column:
    out = None
    for name, fn in changes.items():
        out = F.when(k == name, fn(v)) if out is None else out.when(k == name, fn(v))
    return out.otherwise(v)


def update_bands(graph: Column, fn) -> Column:
    def edit(n: Column) -> Column:
        return F.when(n["bands"].isNotNull(), n.withField("bands", F.transform(n["bands"], fn))).otherwise(n)

    return F.transform(graph, edit)


def validate(graph: Column) -> Column:
    """Names of broken rules: empty plan, empty or repeated ids, parameters out of range."""
    def bad(kind: str, test) -> Column:
        return F.exists(graph, lambda n: (n["type"] == kind) & F.coalesce(test(n["params"]), F.lit(False)))

    def outside(p, k, lo, hi):
        return (p[k] < lo) | (p[k] > hi)

    ids = F.transform(graph, lambda n: n["id"])
    checks = {
        "empty plan": F.size(graph) == 0,
        "empty id": F.exists(ids, lambda i: i == ""),
        "repeated id": F.size(F.array_distinct(ids)) < F.size(ids),
        "compressor": bad("compressor", lambda p: (p["ratio"] < 1) | outside(p, "mix", 0, 1)),
        "dynamic_eq": bad("dynamic_eq", lambda p: (p["ratio"] < 1) | (p["q"] <= 0) | (p["max_reduction_db"] < 0)),
        "multiband": bad("multiband", lambda p: (p["low_crossover_hz"] <= 0)
                         | (p["high_crossover_hz"] <= p["low_crossover_hz"])
                         | (F.least(p["low_ratio"], p["mid_ratio"], p["high_ratio"]) < 1)),
        "transient": bad("transient", lambda p: (p["fast_ms"] <= 0) | (p["slow_ms"] <= p["fast_ms"]) | outside(p, "mix", 0, 1)),
        "saturation": bad("saturation", lambda p: outside(p, "mix", 0, 1)),
        "stereo": bad("stereo", lambda p: outside(p, "width", 0, 2) | (p["bass_mono_hz"] < 0)),
        "clipper": bad("clipper", lambda p: (p["softness"] < 0) | (p["softness"] >= 1)),
        "limiter": bad("limiter", lambda p: p["release_ms"] <= 0),
        "eq": F.exists(graph, lambda n: F.coalesce(
            F.exists(n["bands"], lambda b: (b["frequency_hz"] <= 0) | (b["q"] <= 0)), F.lit(False))),
    }
    return F.filter(F.array(*[F.when(c, name) for name, c in checks.items()]), lambda e: e.isNotNull())


def to_json(graph: Column) -> Column:
    return F.to_json(graph)


def _fixed(values: pa.Array, digits: int, strict: bool) -> pa.Array:
    """Numbers as text with fixed digits, half a unit rounded away from zero as in a decimal cast; each different number is written once.

    What is no finite number becomes null, and so do numbers of more than 18 digits unless they are errors (``strict``).
    """
    def text(v: float) -> str | None:
        if v is None or not math.isfinite(v):
            return None
        d = Decimal(repr(v))
        if d.adjusted() < 18:
            d = d.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
        if abs(d) >= Decimal(1).scaleb(18 - digits):
            if strict:
                raise ArithmeticError(f"{v} cannot be represented as decimal(18, {digits})")
            return None
        return f"{d if d else abs(d):f}"

    found = pc.dictionary_encode(values)
    return pa.array([text(v) for v in found.dictionary.to_pylist()], pa.string()).take(found.indices)


def _joined(offsets: np.ndarray, missing: pa.Array, texts: pa.Array, by: str) -> pa.Array:
    """Texts of each list in one, without those that are null; null for a missing list."""
    there = pc.is_valid(texts)
    starts = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[offsets]
    lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), texts.filter(there))
    return pc.if_else(missing, pa.scalar(None, pa.string()), pc.binary_join(lists, by))


def _spread(lists: pa.Array) -> tuple[np.ndarray, slice]:
    """Where lists begin and end among the values that they use, and the range of these."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], slice(int(offsets[0]), int(offsets[-1]))


def described(graphs: pa.Array, strict: bool = True) -> pa.Array:
    """``describe`` over arrow arrays: all nodes, parameters and bands of a batch together."""
    sizes = pc.fill_null(pc.list_value_length(graphs), 0).to_numpy(zero_copy_only=False)
    flat = graphs.flatten()
    id_, kind, bypass, params, shapes = (dict(zip([f.name for f in flat.type], flat.flatten()))[n] for n in ("id", "type", "bypass", "params", "bands"))

    offsets, used = _spread(params)
    names = pc.dictionary_encode(params.keys[used])
    order = np.argsort(np.argsort([str(k).encode() for k in names.dictionary.to_pylist()], kind="stable"), kind="stable")
    rank = order[names.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, int)
    by_name = pa.array(np.lexsort((rank, np.repeat(np.arange(len(params)), np.diff(offsets)))))
    pairs = pc.binary_join_element_wise(names.cast(pa.string()), _fixed(params.items[used], 4, strict), "=")
    params = _joined(offsets, pc.is_null(params), pairs.take(by_name), " ")

    offsets, used = _spread(shapes)
    bands = dict(zip([f.name for f in shapes.type.value_type], shapes.values[used].flatten()))
    each = pc.binary_join_element_wise(bands["shape"], "@", _fixed(bands["frequency_hz"], 1, strict), ":", _fixed(bands["gain_db"], 3, strict), ":",
                                       _fixed(bands["q"], 3, strict), "")
    shapes = _joined(offsets, pc.is_null(shapes), each, "|")
    off = pc.if_else(bypass, pa.scalar("off"), pa.scalar(None, pa.string()))
    parts = [id_, kind, off, params, shapes]
    # a join of nulls only would leave the row out
    parts[0] = pc.if_else(reduce(pc.and_, map(pc.is_null, parts)), "", id_)
    lines = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), lines, mask=pc.is_null(graphs))


def describe(graph: Column) -> Column:
    """One line of text per node: id, type, state and parameters in name order."""
    spark = SparkSession.getActiveSession()
    strict = spark is None or spark.conf.get("spark.sql.ansi.enabled") == "true"

    @F.arrow_udf("array<string>")
    def lines(graphs: pa.Array) -> pa.Array:
        return described(graphs, strict)

    return lines(graph)
