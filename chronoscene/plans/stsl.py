"""The spatio-temporal specification language: syntax tree, parser, printer, and compilation to columns.

Logic formulas hold at a frame under an assignment of objects to variables; temporal formulas combine frames. A formula is
compiled bottom-up to one boolean column per node over a dense grid (video, assignment, time); the temporal operators are
closed forms over one window per video and assignment, so there is no recursion and all windows share one sort.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Var:
    id: int


@dataclass(frozen=True)
class Const:
    id: int


Term = Var | Const


@dataclass(frozen=True)
class Unary:
    predicate: str
    a: Term


@dataclass(frozen=True)
class NegUnary:
    predicate: str
    a: Term


@dataclass(frozen=True)
class Binary:
    predicate: str
    a: Term
    b: Term


@dataclass(frozen=True)
class NegBinary:
    predicate: str
    a: Term
    b: Term


@dataclass(frozen=True)
class Neq:
    a: Term
    b: Term


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Logic:
    formula: object


@dataclass(frozen=True)
class Finally:
    formula: object


@dataclass(frozen=True)
class Global:
    formula: object


@dataclass(frozen=True)
class Next:
    formula: object


@dataclass(frozen=True)
class Until:
    left: object
    right: object


NODES = {c.__name__: c for c in (Var, Const, Unary, NegUnary, Binary, NegBinary, Neq, And, Logic, Finally, Global, Next, Until)}


def show(node: object) -> str:
    """The specification text of a tree."""
    if isinstance(node, str):
        return f'"{node}"'
    if isinstance(node, int):
        return str(node)
    return f"{type(node).__name__}({', '.join(show(getattr(node, f.name)) for f in fields(node))})"


def parse(text: str) -> object:
    """The tree of a specification text; raises ValueError where the text is none."""
    tokens = re.findall(r'"[^"]*"|-?\d+|[A-Za-z]+|[(),]|\S', text)
    at = 0

    def take(expected: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (expected and tokens[at] != expected):
            raise ValueError(f"expected {expected or 'more'} at token {at} of {text!r}")
        at += 1
        return tokens[at - 1]

    def node() -> object:
        t = take()
        if t[0] == '"':
            return t[1:-1]
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if t not in NODES:
            raise ValueError(f"unknown construct {t!r}")
        take("(")
        args = [node()]
        while at < len(tokens) and tokens[at] == ",":
            take(",")
            args.append(node())
        take(")")
        return NODES[t](*args)

    out = node()
    if at != len(tokens):
        raise ValueError(f"text after the formula: {tokens[at:]}")
    return out


def conjunction(atoms: list) -> object:
    """Right-nested And of one or more formulas."""
    return atoms[-1] if len(atoms) == 1 else And(atoms[0], conjunction(atoms[1:]))


def chain(events: list) -> object:
    """``Until(e1, Until(e2, e3))`` of events, each an atom formula that holds finally."""
    wrapped = [Finally(Logic(e)) for e in events]
    return reduce(lambda rest, e: Until(e, rest), reversed(wrapped[:-1]), wrapped[-1])


def program_windows(events: list, size: int = 3, remove_last: bool = False) -> list[tuple[int, list]]:
    """(start, events) of consecutive windows of a program; a last one that is shorter than the first may be left out."""
    windows = [(i, events[i : i + size]) for i in range(0, len(events), size)]
    return [w for w in windows if len(w[1]) == len(windows[0][1])] if remove_last else windows


def atoms_of(node: object) -> list:
    if isinstance(node, (Unary, NegUnary, Binary, NegBinary, Neq)):
        return [node]
    return [a for f in fields(node) for a in atoms_of(getattr(node, f.name))] if hasattr(node, "__dataclass_fields__") and not isinstance(node, (Var, Const)) else []


def terms_of(atom: object) -> list[Term]:
    return [t for t in (getattr(atom, "a", None), getattr(atom, "b", None)) if t is not None]


def variables(node: object) -> list[int]:
    return sorted({t.id for a in atoms_of(node) for t in terms_of(a) if isinstance(t, Var)})


def required(node: object) -> list:
    """Positive atoms without which the formula can't hold at any time."""
    if isinstance(node, (Unary, Binary)):
        return [node]
    if isinstance(node, And):
        return required(node.left) + required(node.right)
    if isinstance(node, (Logic, Finally, Global, Next)):
        return required(node.formula)
    return required(node.right) if isinstance(node, Until) else []


class Scene:
    """Fact tables: unary ``(video_id, fid, oid, predicate)``, binary ``(video_id, fid, predicate, o1, o2)``, names
    ``(video_id, oid, cid)``, time ``(video_id, t)``, objects ``(video_id, oid)``, optional max_time ``(video_id, n)``."""

    def __init__(self, unary: DataFrame, time: DataFrame, objects: DataFrame, binary: DataFrame | None = None, names: DataFrame | None = None, max_time: DataFrame | None = None) -> None:
        self.unary, self.time, self.objects, self.binary, self.names, self.max_time = unary, time, objects, binary, names, max_time


def assignments(scene: Scene, formula: object) -> DataFrame:
    """``(video_id, v1, v2, …)``: objects for the variables of the formula, two may share one.

    A variable of a required positive atom only takes objects that occur in such a fact; others take any object.
    """
    need = required(formula)
    out = None
    for v in variables(formula):
        own = scene.objects.select("video_id", F.col("oid").alias(f"v{v}"))
        for a in need:
            if isinstance(a, Unary) and a.a == Var(v):
                seen = scene.unary.where(F.col("predicate") == a.predicate).select("video_id", F.col("oid").alias(f"v{v}")).distinct()
                own = own.join(seen, ["video_id", f"v{v}"], "left_semi")
            elif isinstance(a, Binary) and Var(v) in (a.a, a.b):
                side = "o1" if a.a == Var(v) else "o2"
                seen = scene.binary.where(F.col("predicate") == a.predicate).select("video_id", F.col(side).alias(f"v{v}")).distinct()
                own = own.join(seen, ["video_id", f"v{v}"], "left_semi")
        out = own if out is None else out.join(own, "video_id")
    if out is None:  # constants only: some variable and object must exist
        return scene.objects.select("video_id").distinct()
    return out


def _truth(scene: Scene, grid: DataFrame, atom: object, name: str) -> DataFrame:
    """Adds the boolean column ``name``: the atom at (video_id, t) under the assignment."""
    if isinstance(atom, Neq):
        if isinstance(atom.a, Var) and isinstance(atom.b, Var):
            return grid.withColumn(name, F.col(f"v{atom.a.id}") != F.col(f"v{atom.b.id}"))
        var, const = (atom.b, atom.a) if isinstance(atom.a, Const) else (atom.a, atom.b)
        # Some object of that name is another one than the variable's.
        named = scene.names.where(F.col("cid") == const.id).groupBy("video_id").agg(F.min("oid").alias("_lo"), F.max("oid").alias("_hi"))
        v = F.col(f"v{var.id}")
        return grid.join(named, "video_id", "left").withColumn(name, F.coalesce((F.col("_lo") != v) | (F.col("_hi") != v), F.lit(False))).drop("_lo", "_hi")
    unary = isinstance(atom, (Unary, NegUnary))
    facts = (scene.unary if unary else scene.binary).where(F.col("predicate") == atom.predicate)
    sides = [(atom.a, "oid")] if unary else [(atom.a, "o1"), (atom.b, "o2")]
    negative = isinstance(atom, (NegUnary, NegBinary))
    hit, keys, base = facts, ["video_id", "t"], grid
    for term, side in sides:
        if isinstance(term, Const):
            named = scene.names.where(F.col("cid") == term.id).select("video_id", F.col("oid").alias(side))
            hit = hit.join(named, ["video_id", side])
        else:
            hit = hit.withColumn(f"v{term.id}", F.col(side))
            keys.append(f"v{term.id}")
    both_same = not unary and isinstance(atom.a, Var) and atom.a == atom.b
    if both_same:
        hit = facts.where("o1 = o2").withColumn(f"v{atom.a.id}", F.col("o1"))
    keys = list(dict.fromkeys(keys))
    if negative and not unary and any(isinstance(t, Const) for t, _ in sides):
        # A named object exists for which the fact is absent: fewer facts than named objects (pairs of them).
        total = None
        for term, side in sides:
            if isinstance(term, Const):
                n = scene.names.where(F.col("cid") == term.id).groupBy("video_id").agg(F.count_distinct("oid").alias(f"_n_{side}"))
                total = n if total is None else total.join(n, "video_id")
        found = hit.withColumn("t", F.col("fid")).select(*keys, *[s for _, s in sides]).distinct().groupBy(*keys).agg(F.count("*").alias("_c"))
        size = reduce(lambda a, b: a * b, [F.col(f"_n_{s}") for t, s in sides if isinstance(t, Const)])
        out = base.join(total, "video_id", "left").join(found, keys, "left")
        return out.withColumn(name, F.coalesce(size, F.lit(0)) > F.coalesce("_c", F.lit(0))).select(*base.columns, name)
    found = hit.withColumn("t", F.col("fid")).select(*keys).distinct().withColumn("_h", F.lit(True))
    out = base.join(found, keys, "left")
    truth = F.coalesce("_h", F.lit(False))
    return out.withColumn(name, ~truth if negative else truth).drop("_h")


def compile_formula(scene: Scene, formula: object, keep: list | None = None) -> tuple[DataFrame, list[str]]:
    """The grid ``(video_id, v…, t, holds)`` of the formula, and a truth column for each formula of ``keep``."""
    atoms = list(dict.fromkeys(a for f in [formula, *(keep or [])] for a in atoms_of(f)))
    vs = [f"v{v}" for v in variables(formula)]
    grid = assignments(scene, formula).join(scene.time, "video_id")
    for i, a in enumerate(atoms):
        grid = _truth(scene, grid, a, f"_a{i}")
    if scene.max_time is not None:
        grid = grid.join(scene.max_time.select("video_id", F.col("n").alias("_n")), "video_id", "left")
    index = {a: f"_a{i}" for i, a in enumerate(atoms)}
    whole = Window.partitionBy("video_id", *vs)
    order = whole.orderBy("t")
    fresh = count()

    def define(df: DataFrame, value: Column) -> tuple[DataFrame, Column]:
        name = f"_x{next(fresh)}"
        return df.withColumn(name, value), F.col(name)

    def build(df: DataFrame, node: object) -> tuple[DataFrame, Column]:
        if node in index:
            return df, F.col(index[node])
        if isinstance(node, And):
            df, a = build(df, node.left)
            df, b = build(df, node.right)
            return df, a & b
        if isinstance(node, Logic):
            return build(df, node.formula)
        t = F.col("t")
        if isinstance(node, Finally):
            df, p = build(df, node.formula)
            return define(df, F.coalesce(t <= F.max(F.when(p, t)).over(whole), F.lit(False)))
        if isinstance(node, Next):
            df, p = build(df, node.formula)
            return define(df, F.coalesce(F.lead(p).over(order), F.lit(False)))
        if isinstance(node, Until):
            df, p = build(df, node.left)
            df, q = build(df, node.right)
            df, stop = define(df, F.coalesce(F.min(F.when(~p, t)).over(order.rowsBetween(0, Window.unboundedFollowing)), F.max(t).over(whole) + 1))
            df, goal = define(df, F.min(F.when(q, t)).over(order.rowsBetween(1, Window.unboundedFollowing)))
            return define(df, q | F.coalesce(goal <= stop, F.lit(False)))
        if isinstance(node, Global):
            if scene.max_time is None:
                return define(df, F.lit(False))
            df, p = build(df, node.formula)
            df, stop = define(df, F.min(F.when(~p, t)).over(order.rowsBetween(0, Window.unboundedFollowing)))
            n = F.col("_n")
            return define(df, F.coalesce((t <= n) & (n <= F.max(t).over(whole)) & (F.coalesce(stop, n + 1) > n), F.lit(False)))
        raise TypeError(f"no formula: {node!r}")

    out, holds = build(grid, formula)
    out = out.withColumn("holds", holds)
    named = []
    for i, f in enumerate(keep or []):
        out, truth = build(out, f)
        out = out.withColumn(f"e{i + 1}", truth)
        named.append(f"e{i + 1}")
    return out.select("video_id", *vs, "t", "holds", *named), vs


def satisfied(scene: Scene, formula: object) -> DataFrame:
    """``(video_id, v…, t)`` where the formula holds."""
    out, vs = compile_formula(scene, formula)
    return out.where("holds").select("video_id", *vs, "t")


def aligned(scene: Scene, formula: object) -> DataFrame:
    """``(video_id, aligned)`` for each video with a time domain: does the formula hold at 0 under some assignment."""
    out, _ = compile_formula(scene, formula)
    at0 = out.where("t = 0").groupBy("video_id").agg(F.bool_or("holds").alias("aligned"))
    return scene.time.select("video_id").distinct().join(at0, "video_id", "left").select("video_id", F.coalesce("aligned", F.lit(False)).alias("aligned"))


def aligned_times(scene: Scene, events: list) -> DataFrame:
    """``(video_id, event_no, t)``: frames at which each of one to three events in order can take place.

    Closed form of t1 < t2 < t3 per assignment: only the middle event must be trimmed on both sides. The assignment grid
    is restricted to objects that meet all events' positive atoms.
    """
    whole_formula = reduce(lambda a, b: And(a, b), events)
    grid, vs = compile_formula(scene, whole_formula, keep=list(events))
    w = Window.partitionBy("video_id", *vs)
    t = F.col("t")
    n = len(events)
    if n == 1:
        ok = [F.col("e1")]
    elif n == 2:
        grid = grid.withColumn("_a", F.min(F.when(F.col("e1"), t)).over(w)).withColumn("_z", F.max(F.when(F.col("e2"), t)).over(w))
        ok = [F.col("e1") & (t < F.col("_z")), F.col("e2") & (t > F.col("_a"))]
    elif n == 3:
        grid = grid.withColumn("_a", F.min(F.when(F.col("e1"), t)).over(w)).withColumn("_z", F.max(F.when(F.col("e3"), t)).over(w))
        grid = grid.withColumn("_b", F.col("e2") & (t > F.col("_a")) & (t < F.col("_z")))
        grid = grid.withColumn("_b0", F.min(F.when(F.col("_b"), t)).over(w)).withColumn("_b1", F.max(F.when(F.col("_b"), t)).over(w))
        ok = [F.col("e1") & (t < F.col("_b1")), F.coalesce("_b", F.lit(False)), F.col("e3") & (t > F.col("_b0"))]
    else:
        raise ValueError("one to three events; cut longer programs into windows")
    times = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(i + 1)) for i, c in enumerate(ok)]))
    return grid.select("video_id", F.explode(times).alias("event_no"), "t").distinct()
