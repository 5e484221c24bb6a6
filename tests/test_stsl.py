import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from chronoscene.operators.proofs import chain_proofs
from chronoscene.operators.tracking import Tracker, assign, track_boxes
from chronoscene.plans import stsl
from chronoscene.plans.program import compile_event, specification
from chronoscene.plans.stsl import And, Binary, Const, Finally, Global, Logic, NegUnary, Neq, Next, Unary, Until, Var

GOLDEN = 'Until(Finally(Logic(And(Unary("a", Var(1)), Binary("b", Var(1), Const(-1))))), Finally(Logic(Unary("c", Var(2)))))'


def test_round_trip():
    assert stsl.show(stsl.parse(GOLDEN)) == GOLDEN
    assert stsl.variables(stsl.parse(GOLDEN)) == [1, 2]
    for bad in ("Until(", 'Unary("a" Var(1))', "Foo(1)", GOLDEN + ")"):
        with pytest.raises(ValueError):
            stsl.parse(bad)
    assert [len(w) for _, w in stsl.program_windows(list("abcde"), 3)] == [3, 2] and len(stsl.program_windows(list("abcde"), 3, True)) == 1


def fixpoint(formula, atoms, m, n=None):
    """Truth set over times 0..m-1 of one assignment, by the rules and not by closed forms."""
    f = lambda x: fixpoint(x, atoms, m, n)
    if isinstance(formula, Unary):
        return atoms[formula.predicate]
    if isinstance(formula, NegUnary):
        return set(range(m)) - atoms[formula.predicate]
    if isinstance(formula, And):
        return f(formula.left) & f(formula.right)
    if isinstance(formula, Logic):
        return f(formula.formula)
    if isinstance(formula, Finally):
        p = f(formula.formula)
        return {s for s in range(m) if any(t >= s for t in p)}
    if isinstance(formula, Next):
        p = f(formula.formula)
        return {s for s in range(m) if s + 1 in p}
    if isinstance(formula, Global):
        p = f(formula.formula)
        return {s for s in range(m) if n is not None and n < m and s <= n and all(t in p for t in range(s, n + 1))}
    p, q = f(formula.left), f(formula.right)
    return {s for s in range(m) if s in q or any(t + 1 in q and all(x in p for x in range(s, t + 1)) for t in range(s, m))}


def formulas():
    leaf = st.sampled_from([Logic(Unary("a", Var(1))), Logic(Unary("b", Var(1))), Logic(NegUnary("a", Var(1)))])
    return st.recursive(leaf, lambda x: st.one_of(st.builds(Finally, x), st.builds(Next, x), st.builds(Global, x), st.builds(Until, x, x)), max_leaves=4)


@settings(max_examples=10, deadline=None)
@given(st.lists(formulas(), min_size=1, max_size=2), st.integers(0, 2**12), st.integers(1, 6))
def test_compiled_formula_is_the_fixpoint(spark, some, bits, m):
    sets = {"a": {i for i in range(m) if bits >> i & 1}, "b": {i for i in range(m) if bits >> (6 + i) & 1}}
    unary = spark.createDataFrame([("v", t, 1, p) for p, ts in sets.items() for t in ts] + [("v", m, 1, "a")], "video_id string, fid int, oid long, predicate string")
    time = spark.createDataFrame([("v", t) for t in range(m)], "video_id string, t int")
    objects = spark.createDataFrame([("v", 1)], "video_id string, oid long")
    scene = stsl.Scene(unary, time, objects, max_time=spark.createDataFrame([("v", m - 1)], "video_id string, n int"))
    for formula in some:
        expected = fixpoint(formula, sets, m, m - 1)
        assert {r.t for r in stsl.satisfied(scene, formula).collect()} == expected


def test_assignments_and_constants(spark):
    unary = spark.createDataFrame([("v", 0, 1, "p"), ("v", 0, 2, "p"), ("v", 1, 2, "q"), ("v", 2, 1, "q")], "video_id string, fid int, oid long, predicate string")
    time = spark.createDataFrame([("v", 0), ("v", 1)], "video_id string, t int")
    objects = spark.createDataFrame([("v", 1), ("v", 2)], "video_id string, oid long")
    names = spark.createDataFrame([("v", 1, -1), ("v", 2, -1)], "video_id string, oid long, cid int")
    scene = stsl.Scene(unary, time, objects, names=names)
    both = And(Unary("p", Var(1)), Unary("p", Var(2)))
    rows = lambda f: {tuple(r) for r in stsl.satisfied(scene, f).collect()}
    assert rows(Logic(both)) == {("v", a, b, 0) for a in (1, 2) for b in (1, 2)}
    assert rows(Logic(And(both, Neq(Var(1), Var(2))))) == {("v", 1, 2, 0), ("v", 2, 1, 0)}
    assert rows(Logic(Unary("q", Const(-1)))) == {("v", 1)}  # the last frame is outside the time domain
    assert rows(Logic(NegUnary("q", Const(-1)))) == {("v", 0)}
    assert rows(Global(Logic(NegUnary("q", Var(1))))) == set()


def test_chain_of_three(spark):
    facts = {"a": {0, 3}, "b": {1, 4, 6}, "c": {2, 5}}
    unary = spark.createDataFrame([("v", t, 1, p) for p, ts in facts.items() for t in ts] + [("v", 7, 1, "z")], "video_id string, fid int, oid long, predicate string")
    time = spark.createDataFrame([("v", t) for t in range(7)], "video_id string, t int")
    scene = stsl.Scene(unary, time, spark.createDataFrame([("v", 1)], "video_id string, oid long"))
    got = {(r.event_no, r.t) for r in stsl.aligned_times(scene, [Unary(p, Var(1)) for p in "abc"]).collect()}
    orders = [x for x in itertools.product(*facts.values()) if x[0] < x[1] < x[2]]
    assert got == {(i + 1, x[i]) for x in orders for i in range(3)}


def test_program():
    e = compile_event(["holding(A, B)", "name(A, baker)", "name(A, cook)", "color(B, red)", "give(A, B, C)", {"not": "x(A)"} and "near(A, table)", None])
    assert e["names"] == {"A": "baker"} and e["reason"] is None
    text, consts = specification([e])
    assert consts == ["table"] and stsl.show(stsl.parse(text)) == text and 'Unary("red", Var(2))' in text and "Const(-1)" in text
    assert compile_event(None)["reason"] == "empty" and compile_event(["name(A, x)"])["reason"] == "no atoms"


def test_proofs_against_possible_worlds(spark):
    facts = [("v", 0, 1, "a", 0.5), ("v", 1, 1, "a", 0.4), ("v", 2, 1, "b", 0.2), ("v", 3, 2, "b", 0.9), ("v", 9, 1, "b", 1.0), ("w", 1, 1, "b", 0.3), ("w", 2, 1, "b", 0.3)]
    df = spark.createDataFrame(facts, "video_id string, fid int, oid int, predicate string, prob double")
    k = 3
    proofs = sorted((-x[4] * y[4], x, y) for x in facts[:2] for y in facts[2:4])[:k]
    total = 0.0
    for world in itertools.product((0, 1), repeat=4):
        on = {f for f, w in zip(facts[:4], world, strict=True) if w}
        p = float(np.prod([f[4] if w else 1 - f[4] for f, w in zip(facts[:4], world, strict=True)]))
        total += p * any({x, y} <= on for _, x, y in proofs)
    got = {r.video_id: r.prob for r in chain_proofs(df, "a", "b", k).collect()}
    assert set(got) == {"v"} and abs(got["v"] - total) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_cheapest(n, m, rng):
    cost = np.array([[-rng.random() for _ in range(m)] for _ in range(n)])
    pairs = assign(cost)
    small, big = min(n, m), max(n, m)
    best = min(sum(cost[i, p[i]] if n <= m else cost[p[i], i] for i in range(small)) for p in itertools.permutations(range(big), small))
    assert len(pairs) == small and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9


def test_tracker():
    t = Tracker(0.5)
    assert t.add(np.array([[0, 0, 9, 9], [50, 50, 59, 59]], float)) == [0, 1]
    assert t.add(np.array([[51, 50, 60, 59], [1, 0, 10, 9], [200, 200, 220, 220]], float)) == [1, 0, 2]
    assert t.add(np.zeros((0, 4))) == []


def test_tracks_hold_for_the_whole_video(spark):
    box = "array<struct<x1:int,y1:int,x2:int,y2:int>>"
    rows = [(v, f, [(f // 256, 0, f // 256 + 9, 9), (50, 50, 59, 59)]) for v in ("v", "w") for f in (0, 100, 511, 512, 1023, 1024, 9999)]
    rows[6] = ("v", 9999, [(50, 50, 59, 59), (200, 200, 209, 209)])
    rows.append(("v", 512, [(2, 0, 11, 9), (50, 50, 59, 59)]))
    got = {(r.video_id, r.fid, r.pos): r.track for r in track_boxes(spark.createDataFrame(rows, f"video_id string, fid int, gt_bboxes {box}")).collect()}
    assert len(got) == 28
    assert all(got[v, f, i] == i for v in ("v", "w") for f in (0, 100, 511, 512, 1023, 1024) for i in (0, 1))
    assert got["v", 9999, 0] == 1 and got["v", 9999, 1] == 2 and got["w", 9999, 0] == 2 and got["w", 9999, 1] == 1
