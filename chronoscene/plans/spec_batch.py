"""Programs as data: every specification of a table evaluated against the facts of its video in one plan.

A program is parsed once per row into its events and atoms; from then on predicates, variables, constants and the order of
events are columns. Atoms join the facts by (video, predicate). The variables that atoms and events share differ from
program to program, so join keys are arrays of objects that each row computes from its own program, and one plan serves
programs of any shape. Neither the number of programs nor that of their shapes shows in the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chronoscene.plans import stsl
from chronoscene.storage import materialized

KEY = ["spec_id", "window_no"]
ATOM = "struct<kind:string,predicate:string,a:int,b:int,shared:array<int>,free:array<int>>"
PARSED = f"n int, event_no int, atoms array<{ATOM}>, k12 array<int>, k23 array<int>, w array<int>, reason string"
POSITIVE = ("unary", "binary")


def chain_of(node: object) -> list | None:
    """The events of ``Finally(e)`` or ``Until(Finally(e), chain)``; None for other formulas."""
    inner = lambda f: f.formula.formula if isinstance(f.formula, stsl.Logic) else f.formula
    if isinstance(node, stsl.Finally):
        return [inner(node)]
    if isinstance(node, stsl.Until) and isinstance(node.left, stsl.Finally):
        rest = chain_of(node.right)
        return None if rest is None else [inner(node.left), *rest]
    return None


def conjuncts(node: object) -> list | None:
    """Atoms of a conjunction; None where it holds something else."""
    if isinstance(node, stsl.And):
        left, right = conjuncts(node.left), conjuncts(node.right)
        return None if left is None or right is None else left + right
    return [node] if isinstance(node, (stsl.Unary, stsl.NegUnary, stsl.Binary, stsl.NegBinary, stsl.Neq)) else None


def _atoms(event: list) -> list[tuple]:
    """(kind, predicate, a, b, shared, free): positive atoms first; variables bound by earlier atoms, and not yet bound ones."""
    out, known = [], set()
    for a in sorted(event, key=lambda x: not isinstance(x, (stsl.Unary, stsl.Binary))):
        terms = [t.id for t in stsl.terms_of(a)]
        own = sorted({t for t in terms if t > 0})
        kind = {"Unary": "unary", "Binary": "binary", "NegUnary": "no_unary", "NegBinary": "no_binary", "Neq": "neq"}[type(a).__name__]
        out.append((kind, getattr(a, "predicate", ""), terms[0], terms[1] if len(terms) > 1 else None, [v for v in own if v in known], [v for v in own if v not in known]))
        known |= set(own)
    return out


def parse_program(text: str | None) -> tuple[list[tuple], str | None]:
    """Rows (n, event_no, atoms, k12, k23, w) of a program, or the reason for which it can't be evaluated.

    ``k12`` and ``k23`` are the variables that neighbouring events share, ``w`` those that the first and the third share
    without the second.
    """
    if text is None or not text.strip():
        return [], "empty"
    try:
        events = chain_of(stsl.parse(text))
    except (ValueError, TypeError, IndexError, RecursionError):
        return [], "unreadable"
    atoms = [conjuncts(e) for e in events] if events else [None]
    if None in atoms:
        return [], "no chain of events"
    if len(events) > 3:
        return [], "more than three events"
    terms = [t for e in atoms for a in e for t in stsl.terms_of(a)]
    if any((t.id > 0) != isinstance(t, stsl.Var) for t in terms) or any(isinstance(a, stsl.Neq) and max(t.id for t in stsl.terms_of(a)) < 0 for e in atoms for a in e):
        return [], "terms"
    own = [{t.id for a in e for t in stsl.terms_of(a) if t.id > 0} for e in atoms] + [set(), set()]
    n = len(events)
    keys = (sorted(own[0] & own[1]), sorted(own[1] & own[2]), sorted((own[0] & own[2]) - own[1]))
    return [(n, i + 1, _atoms(e), *keys) for i, e in enumerate(atoms)], None


def parsed_programs(programs: DataFrame) -> DataFrame:
    """``(spec_id, window_no, video_id, consts, n, event_no, atoms, k12, k23, w, reason)``: a row per event of each program
    ``(spec_id, window_no, video_id, consts, prog)``, or one row with a ``reason`` where it can't be evaluated."""
    names = ["n", "event_no", "atoms", "k12", "k23", "w", "reason"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for spec, window, video, consts, prog in zip(b["spec_id"], b["window_no"], b["video_id"], b["consts"], b["prog"], strict=True):
                events, reason = parse_program(prog)
                for e in events or [(None,) * 6]:
                    rows.append((spec, window, video, consts, *e, reason))
            out = pd.DataFrame(rows, columns=[*KEY, "video_id", "consts", *names])
            yield out.astype({"n": "Int32", "event_no": "Int32"})

    kinds = ", ".join(f"{c} {programs.schema[c].dataType.simpleString()}" for c in (*KEY, "video_id"))
    return programs.select(*KEY, "video_id", "consts", "prog").mapInPandas(run, f"{kinds}, consts array<string>, {PARSED}")


def _value(variables: Column, v: Column) -> Column:
    return F.get(F.filter(variables, lambda x: x["v"] == v), F.lit(0))["o"]


def _values(variables: Column, wanted: Column) -> Column:
    """The objects of the wanted variables, in their order."""
    return F.transform(wanted, lambda v: _value(variables, v))


def needed(parsed: DataFrame) -> tuple[dict[int, set[str]], bool]:
    """Kinds of atoms at each place of the events, and whether constants occur: what the plan must provide for."""
    atoms = parsed.where("reason is null").select(F.posexplode("atoms").alias("pos", "x"))
    found = atoms.select("pos", "x.kind", (F.least("x.a", F.coalesce("x.b", "x.a")) < 0).alias("const")).distinct().collect()
    kinds: dict[int, set[str]] = {}
    for r in found:
        kinds.setdefault(r["pos"], set()).add(r["kind"])
    return kinds, any(r["const"] for r in found)


def fact_table(parsed: DataFrame, unary: DataFrame, binary: DataFrame, names: DataFrame, time: DataFrame) -> DataFrame:
    """``(video_id, predicate, arity, t, o1, o2, n1, n2)`` of the facts that some atom asks for, inside the time domain ``(video_id, t)``.

    ``n1`` and ``n2`` are the names of the objects, null where no atom has a constant. A kind of facts that no atom has isn't read.
    """
    kinds, consts = needed(parsed)
    seen = set().union(*kinds.values())
    one = unary.select("video_id", "predicate", F.lit(1).alias("arity"), F.col("fid").alias("t"), F.col("oid").alias("o1"), F.lit(None).cast(unary.schema["oid"].dataType).alias("o2"))
    two = binary.select("video_id", "predicate", F.lit(2).alias("arity"), F.col("fid").alias("t"), "o1", "o2")
    both = one.union(two) if seen & {"binary", "no_binary"} else one
    asked = parsed.where("reason is null").select("video_id", F.explode("atoms").alias("x")).select("video_id", F.col("x.predicate").alias("predicate")).distinct()
    inside = both.join(asked, ["video_id", "predicate"], "left_semi").join(time, ["video_id", "t"], "left_semi").distinct()
    if not consts:
        return inside.withColumns({n: F.lit(None).cast("array<string>") for n in ("n1", "n2")})
    named = names.groupBy("video_id", "oid").agg(F.collect_set("name").alias("n"))
    of = lambda i: named.select("video_id", F.col("oid").alias(f"o{i}"), F.col("n").alias(f"n{i}"))
    return inside.join(of(1), ["video_id", "o1"], "left").join(of(2), ["video_id", "o2"], "left")


def _hits(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with a positive atom ``x`` joined to the facts that match its predicate, terms and constants: ``t`` and ``bind``."""
    const = lambda c: F.get("consts", -c - 1)
    ok = lambda c, n: (c > 0) | F.coalesce(F.array_contains(n, const(c)), F.lit(False))
    a, b = F.col("x.a"), F.col("x.b")
    keyed = rows.withColumns({"p": F.col("x.predicate"), "arity": F.when(F.col("x.kind") == "unary", 1).otherwise(2)})
    out = keyed.join(facts.withColumnRenamed("predicate", "p"), ["video_id", "p", "arity"])
    out = out.where(ok(a, F.col("n1")) & (b.isNull() | (ok(b, F.col("n2")) & ((a != b) | (a < 0) | (F.col("o1") == F.col("o2"))))))
    entry = lambda v, o: F.struct(v.alias("v"), o.cast("long").alias("o"))
    bind = F.array_distinct(F.array(entry(a, F.col("o1")), entry(F.coalesce(b, a), F.coalesce("o2", "o1"))))
    return out.withColumn("bind", F.array_sort(F.filter(bind, lambda e: e["v"] > 0))).drop("p", "arity", "o1", "o2", "n1", "n2")


def event_rows(parsed: DataFrame, facts: DataFrame, objects: DataFrame, names: DataFrame, time: DataFrame) -> DataFrame:
    """``(spec_id, window_no, event_no, t, vars)``: when each event holds and for which objects of its variables.

    ``parsed`` (materialized) is read for the number of atoms of the longest event and the kinds that occur: one round of
    joins is planned for each place in an event. Rows whose event has no atom at a place pass through its round.
    """
    at = [*KEY, "event_no"]
    events = parsed.where("reason is null").select(*at, "video_id", "consts", "atoms")
    places, _ = needed(parsed)
    empty = F.expr("cast(array() as array<struct<v:int,o:bigint>>)")
    first = events.withColumn("x", F.get("atoms", F.lit(0)))
    acc = _hits(first.where(F.col("x.kind").isin(*POSITIVE)), facts).withColumn("vars", F.col("bind")).drop("bind")
    if places.get(0, set()) - set(POSITIVE):
        acc = acc.unionByName(first.where(~F.col("x.kind").isin(*POSITIVE)).join(time.select("video_id", "t"), "video_id").withColumn("vars", empty))
    for j, kinds in sorted(places.items()):
        acc = acc.withColumn("x", F.get("atoms", F.lit(j)))
        if j and kinds & set(POSITIVE):
            hits = _hits(events.withColumn("x", F.get("atoms", F.lit(j))).where(F.col("x.kind").isin(*POSITIVE)), facts)
            keyed = hits.select(*at, "t", _values(F.col("bind"), F.col("x.shared")).alias("key"), F.filter("bind", lambda e: ~F.array_contains("x.shared", e["v"])).alias("more")).distinct()
            positive = F.coalesce(F.col("x.kind").isin(*POSITIVE), F.lit(False))
            acc = acc.withColumn("key", F.when(positive, _values(F.col("vars"), F.col("x.shared")))).join(keyed, [*at, "t", "key"], "left").where(~positive | F.col("more").isNotNull())
            acc = acc.withColumn("vars", F.when(positive, F.array_sort(F.concat("vars", "more"))).otherwise(F.col("vars"))).drop("key", "more")
        if kinds - set(POSITIVE):
            acc = _restricted(acc, kinds, facts, objects, names)
    return acc.select(*at, "t", "vars").distinct()


def _restricted(rows: DataFrame, kinds: set[str], facts: DataFrame, objects: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` that meet their negated atom or inequality ``x``; variables not yet bound take every object of the video.

    Each join has null keys for the rows that it doesn't concern, so they pass and the plan has no branches.
    """
    plain = rows.columns
    kind = lambda k: F.coalesce(F.col("x.kind") == k, F.lit(False))
    negated = kind("no_unary") | kind("no_binary") | kind("neq")
    every = objects.select("video_id", F.col("oid").cast("long").alias("_o")).distinct()
    padded = every.select("video_id", F.lit(True).alias("_need"), "_o").union(every.select("video_id", F.lit(False), F.lit(None)).distinct())
    for i in range(2 if kinds & {"no_binary", "neq"} else 1):
        free = F.get("x.free", F.lit(i))
        need = F.coalesce(negated & free.isNotNull(), F.lit(False))
        rows = rows.withColumn("_need", need).join(padded, ["video_id", "_need"])
        rows = rows.withColumn("vars", F.when(F.col("_need"), F.array_sort(F.concat("vars", F.array(F.struct(free.alias("v"), F.col("_o").alias("o")))))).otherwise(F.col("vars"))).select(plain)
    const = lambda c: F.get("consts", -c - 1)
    named = names.select("video_id", F.col("name").alias("_n"), F.col("oid").cast("long").alias("_o")).distinct()
    value = lambda c: F.when(F.col(c) > 0, _value(F.col("vars"), F.col(c)))
    if "no_unary" in kinds:
        f = facts.where("arity = 1").select("video_id", "t", F.col("predicate").alias("_p"), F.col("o1").cast("long").alias("_v"), "n1")
        here = kind("no_unary")
        rows = rows.withColumns({"_p": F.when(here, F.col("x.predicate")), "_v": F.when(here, value("x.a")), "_n": F.when(here & (F.col("x.a") < 0), const(F.col("x.a")))})
        rows = rows.join(f.drop("n1"), ["video_id", "t", "_p", "_v"], "left_anti").join(f.select("video_id", "t", "_p", F.explode("n1").alias("_n")), ["video_id", "t", "_p", "_n"], "left_anti").select(plain)
    if "no_binary" in kinds:
        here = kind("no_binary")
        for c in ("a", "b"):  # a constant stands for each of its objects; one without the fact is enough
            term = F.col(f"x.{c}")
            rows = rows.withColumn("_n", F.when(here & (term < 0), const(term))).join(named, ["video_id", "_n"], "left").where(F.col("_n").isNull() | F.col("_o").isNotNull())
            rows = rows.where(~here | (term > 0) | F.col("_n").isNotNull()).withColumn(f"_{c}", F.when(here, F.coalesce(value(f"x.{c}"), "_o"))).drop("_n", "_o")
        f = facts.where("arity = 2").select("video_id", "t", F.col("predicate").alias("_p"), F.col("o1").cast("long").alias("_a"), F.col("o2").cast("long").alias("_b"))
        rows = rows.withColumn("_p", F.when(here, F.col("x.predicate"))).join(f, ["video_id", "t", "_p", "_a", "_b"], "left_anti").select(plain)
    if "neq" in kinds:
        here, low = kind("neq"), F.least("x.a", "x.b")
        spans = named.groupBy("video_id", "_n").agg(F.min("_o").alias("_lo"), F.max("_o").alias("_hi"))
        rows = rows.withColumn("_n", F.when(here & (low < 0), const(low))).join(spans, ["video_id", "_n"], "left")
        v = F.coalesce(value("x.a"), value("x.b"))
        met = F.when(low > 0, value("x.a") != value("x.b")).otherwise((F.col("_lo") != v) | (F.col("_hi") != v))
        rows = rows.where(~here | F.coalesce(met, F.lit(False))).select(plain)
    return rows


def aligned_batch(parsed: DataFrame, rows: DataFrame) -> DataFrame:
    """``(spec_id, window_no, event_no, t)``: frames at which each event of a chain t1 < t2 < t3 can take place.

    ``rows`` come from ``event_rows`` (materialized). The middle event is trimmed by the earliest first and the latest third
    event that agree with it on the shared variables; a variable shared only by the outer two is carried along.
    """
    one_per = parsed.where("reason is null and event_no = 1").select(*KEY, "n", "k12", "k23", "w")
    r = rows.join(one_per, KEY)
    vals = lambda c: _values(F.col("vars"), F.col(c)).alias(c)
    e1 = r.where("event_no = 1").select(*KEY, "n", vals("k12"), vals("w"), "t").distinct()
    e2 = r.where("event_no = 2").select(*KEY, "n", vals("k12"), vals("k23"), "t").distinct()
    e3 = r.where("event_no = 3").select(*KEY, vals("k23"), vals("w"), "t").distinct()
    first = e1.where("n > 1").groupBy(*KEY, "k12", "w").agg(F.min("t").alias("a"))
    last = e3.groupBy(*KEY, "k23", "w").agg(F.max("t").alias("z"))
    after = e2.join(first, [*KEY, "k12"]).where("t > a")
    middle = after.where("n = 3").join(last, [*KEY, "k23", "w"]).where("t < z").drop("z").unionByName(after.where("n = 2"))
    middle = materialized(middle.drop("a"))
    ends = middle.groupBy(*KEY, "k12", "w").agg(F.max("t").alias("z"))
    begins = middle.where("n = 3").groupBy(*KEY, "k23", "w").agg(F.min("t").alias("a"))
    at = lambda df, i: df.select(*KEY, F.lit(i).alias("event_no"), "t")
    out = at(e1.where("n = 1"), 1).union(at(e1.join(ends, [*KEY, "k12", "w"]).where("t < z"), 1))
    out = out.union(at(middle, 2)).union(at(e3.join(begins, [*KEY, "k23", "w"]).where("t > a"), 3))
    return out.distinct()


def evaluate(programs: DataFrame, unary: DataFrame, binary: DataFrame, names: DataFrame, time: DataFrame, objects: DataFrame) -> DataFrame:
    """``(spec_id, window_no, event_no, t)`` of all ``programs (spec_id, window_no, video_id, consts, prog)`` in one plan.

    Facts: unary ``(video_id, fid, oid, predicate)``, binary ``(video_id, fid, predicate, o1, o2)``, names ``(video_id, oid,
    name)``, time ``(video_id, t)``, objects ``(video_id, oid)``. The n-th element of ``consts`` is the name of
    ``Const(-n)``. Rows without key or video, and programs with a ``reason`` in ``parsed_programs``, give no rows; repeated
    facts count once; an empty table gives none.
    """
    parsed = materialized(parsed_programs(programs.where("spec_id is not null and window_no is not null and video_id is not null")))
    facts = fact_table(parsed, unary, binary, names, time)
    if len(needed(parsed)[0]) > 1:  # read once per place of an event
        facts = materialized(facts)
    return aligned_batch(parsed, materialized(event_rows(parsed, facts, objects, names, time)))


def spec_programs(specs: DataFrame) -> DataFrame:
    """``(spec_id, window_no, video_id, consts, prog)``: the whole program (window -1) and each of its windows (from 0)."""
    none = F.array().cast("array<string>")
    whole = specs.select("spec_id", F.lit(-1).alias("window_no"), "video_id", F.coalesce("consts", none).alias("consts"), "prog")
    parts = specs.select("spec_id", F.posexplode("windowed_prog").alias("window_no", "p"), "video_id", F.coalesce("consts", none).alias("consts"))
    return whole.union(parts.select("spec_id", "window_no", "video_id", "consts", "p.prog"))


def program_facts(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unary facts, binary facts and names from clauses over variables in the programs of ``(video_id, event_id, programmatic)``.

    The event number is the frame, the variable's letter the object. Clauses of other forms are no facts here; an
    argument in quotes or in words makes ``name(A, noun)`` a name.
    """
    c = events.where("video_id is not null and event_id is not null").select("video_id", F.col("event_id").alias("fid"), F.explode("programmatic").alias("c"))
    part = lambda i: F.regexp_extract("c", r"^\s*([^()]*[^()\s])\s*\(\s*([A-Z])\s*(?:,\s*([A-Z])\s*)?\)\s*$", i)
    f = c.select("video_id", "fid", F.lower(part(1)).alias("predicate"), part(2).alias("x"), part(3).alias("y")).where("x <> ''")
    oid = lambda s: F.ascii(s) - 64
    unary = f.where("y = ''").select("video_id", "fid", oid("x").alias("oid"), "predicate").distinct()
    binary = f.where("y <> ''").select("video_id", "fid", "predicate", oid("x").alias("o1"), oid("y").alias("o2")).distinct()
    named = r"""^\s*name\s*\(\s*([A-Z])\s*,\s*"?([^()",]*[^()",\s])"?\s*\)\s*$"""
    names = c.select("video_id", F.regexp_extract("c", named, 1).alias("x"), F.lower(F.regexp_extract("c", named, 2)).alias("name")).where("x <> '' and length(name) > 1")
    return unary, binary, names.select("video_id", oid("x").alias("oid"), "name").distinct()


def tuple_facts(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unary and binary facts from the positive tuples over variables of ``(video_id, tuples)``; the place in the list is the frame."""
    u = specs.where("video_id is not null").select("video_id", F.posexplode("tuples").alias("fid", "u")).where("u.positive and u.predicate is not null and size(u.args) between 1 and 2")
    u = u.where(F.forall("u.args", lambda a: F.coalesce(a.rlike("^[A-Z]$"), F.lit(False))))
    oid = lambda i: F.ascii(F.get("u.args", F.lit(i))) - 64
    unary = u.where("size(u.args) = 1").select("video_id", "fid", oid(0).alias("oid"), F.col("u.predicate").alias("predicate"))
    return unary.distinct(), u.where("size(u.args) = 2").select("video_id", "fid", F.col("u.predicate").alias("predicate"), oid(0).alias("o1"), oid(1).alias("o2")).distinct()
