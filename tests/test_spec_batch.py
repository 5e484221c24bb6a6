"""Programs as data against the compiler, one formula at a time."""

import random

from chronoscene.plans import spec_batch, stsl
from chronoscene.plans.stsl import Binary, Const, NegBinary, NegUnary, Neq, Unary, Var


def scene_of(spark, rng, videos=("a", "b"), frames=5, objects=3):
    unary, binary, names = set(), set(), set()
    for v in videos:
        for o in range(1, objects + 1):
            names.add((v, o, rng.choice([-1, -2])))
            for t in range(frames):
                unary |= {(v, t, o, p) for p in "pq" if rng.random() < 0.35}
                binary |= {(v, t, "r", o, x) for x in range(1, objects + 1) if rng.random() < 0.25}
    u = spark.createDataFrame(sorted(unary), "video_id string, fid int, oid long, predicate string")
    b = spark.createDataFrame(sorted(binary), "video_id string, fid int, predicate string, o1 long, o2 long")
    n = spark.createDataFrame(sorted(names), "video_id string, oid long, cid int")
    time = spark.createDataFrame([(v, t) for v in videos for t in range(frames)], "video_id string, t int")
    objs = spark.createDataFrame([(v, o) for v in videos for o in range(1, objects + 1)], "video_id string, oid long")
    return stsl.Scene(u, time, objs, b, n)


def random_event(rng):
    term = lambda: Const(-rng.choice([1, 2])) if rng.random() < 0.2 else Var(rng.choice([1, 2, 3]))
    atom = {
        "u": lambda: Unary(rng.choice("pq"), term()), "b": lambda: Binary("r", term(), term()), "nu": lambda: NegUnary("p", term()),
        "nb": lambda: NegBinary("r", term(), term()), "ne": lambda: Neq(Var(1), rng.choice([Var(2), Const(-1)])),
    }
    kinds = ["u", "b", "b", *rng.choices(["u", "b", "nu", "nb", "ne"], k=2)]
    return stsl.conjunction([atom[k]() for k in rng.sample(kinds, rng.choice([1, 2, 2, 3]))])


def test_batch_equals_compiler(spark):
    rng = random.Random(3)
    s = scene_of(spark, rng)
    chains = [[random_event(rng) for _ in range(n)] for n in (1, 2, 2, 3)]
    chains.append([Binary("r", Var(1), Var(2)), Unary("p", Var(2)), Binary("r", Var(1), Var(3))])  # the outer events share a variable
    chains.append([NegUnary("p", Var(1)), Neq(Var(1), Var(2)), NegBinary("r", Const(-1), Var(2))])
    rows = [(i, -1, v, ["x", "y"], stsl.show(stsl.chain(c))) for i, c in enumerate(chains) for v in ("a",)]
    rows += [(100, -1, "a", [], None), (101, -1, "a", [], "Next(Logic(Unary(\"p\",Var(1))))"), (102, 0, "a", [], "Until("), (103, -1, None, [], rows[0][4])]
    programs = spark.createDataFrame(rows, "spec_id int, window_no int, video_id string, consts array<string>, prog string")
    named = s.names.selectExpr("video_id", "oid", "case cid when -1 then 'x' else 'y' end as name")
    got = {(r.spec_id, r.event_no, r.t) for r in spec_batch.evaluate(programs, s.unary, s.binary, named, s.time, s.objects).collect()}
    want = {(i, r.event_no, r.t) for i, c in enumerate(chains) for r in stsl.aligned_times(s, c).where("video_id = 'a'").collect()}
    assert got == want and len(want) > 10
    reasons = {r.spec_id: r.reason for r in spec_batch.parsed_programs(programs.where("spec_id >= 100")).collect()}
    assert reasons == {100: "empty", 101: "no chain of events", 102: "unreadable", 103: None}


def test_no_programs(spark):
    s = scene_of(spark, random.Random(1))
    none = spark.createDataFrame([], "spec_id int, window_no int, video_id string, consts array<string>, prog string")
    named = s.names.selectExpr("video_id", "oid", "string(cid) as name")
    assert spec_batch.evaluate(none, s.unary, s.binary, named, s.time, s.objects).count() == 0
