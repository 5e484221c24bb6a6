"""Probabilities of chains of events against all possible worlds."""

import itertools

from chronoscene.operators.proofs import event_probabilities
from chronoscene.plans import stsl
from chronoscene.plans.stsl import And, Binary, Const, NegUnary, Neq, Unary, Var


def worlds(facts):
    for kept in itertools.product([0, 1], repeat=len(facts)):
        p = 1.0
        for (_, q), k in zip(facts, kept, strict=True):
            p *= q if k else 1 - q
        yield {f for (f, _), k in zip(facts, kept, strict=True) if k}, p


def holds(atom, t, s, world):
    obj = lambda x: [s[x.id]] if isinstance(x, Var) else [o for o in (1, 2) if ("name", o, x.id) in world]
    if isinstance(atom, And):
        return holds(atom.left, t, s, world) and holds(atom.right, t, s, world)
    if isinstance(atom, Neq):
        return s[atom.a.id] != s[atom.b.id]
    if isinstance(atom, NegUnary):
        return (atom.predicate, t, s[atom.a.id]) not in world
    if isinstance(atom, Unary):
        return any((atom.predicate, t, o) in world for o in obj(atom.a))
    return any((atom.predicate, t, x, y) in world for x in obj(atom.a) for y in obj(atom.b))


def brute(events, facts, times, target):
    vs = sorted({v for e in events for v in stsl.variables(e)})
    out = {}
    for world, p in worlds(facts):
        true = set()
        for objs in itertools.product((1, 2), repeat=len(vs)):
            s = dict(zip(vs, objs, strict=True))
            for ts in itertools.combinations(times, len(events)):
                if all(holds(e, t, s, world) for e, t in zip(events, ts, strict=True)):
                    true.add(ts[target])
        for t in true:
            out[t] = out.get(t, 0) + p
    return out


def test_probabilities_equal_possible_worlds(spark):
    unary = [("p", 0, 1, 0.5), ("p", 0, 2, 0.3), ("q", 1, 1, 0.6), ("q", 2, 2, 0.2), ("p", 2, 1, 0.9)]
    binary = [("r", 1, 1, 2, 0.7), ("r", 2, 2, 1, 0.4)]
    names = [(1, -1, 0.8), (2, -1, 0.25)]
    u = spark.createDataFrame([("a", *x) for x in unary], "video_id string, predicate string, fid int, oid long, prob double")
    b = spark.createDataFrame([("a", *x) for x in binary], "video_id string, predicate string, fid int, o1 long, o2 long, prob double")
    n = spark.createDataFrame([("a", *x) for x in names], "video_id string, oid long, cid int, prob double")
    time = spark.createDataFrame([("a", t) for t in range(3)], "video_id string, t int")
    objs = spark.createDataFrame([("a", o) for o in (1, 2)], "video_id string, oid long")
    scene = stsl.Scene(u, time, objs, b, n)
    facts = [((p, t, o), q) for p, t, o, q in unary] + [((p, t, x, y), q) for p, t, x, y, q in binary] + [(("name", o, c), q) for o, c, q in names]
    chains = [
        [Unary("p", Var(1)), Binary("r", Var(1), Var(2))],
        [And(Unary("p", Var(1)), NegUnary("q", Var(1))), Unary("q", Const(-1))],
        [Unary("p", Var(1)), Unary("q", Var(2)), And(Unary("p", Var(1)), Neq(Var(1), Var(2)))],
        [Binary("r", Const(-1), Var(1))],
    ]
    for events in chains:
        got = {(r.event_no, r.t): r.prob for r in event_probabilities(scene, events, 5).collect()}
        want = {(i + 1, t): p for i in range(len(events)) for t, p in brute(events, facts, range(3), i).items()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in got), (events, got, want)
