"""Queries of the specification language, with oracles that use plain (NOT) EXISTS instead of the closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoscene.plans import stsl
from chronoscene.plans.stsl import And, Binary, Const, Finally, Global, Logic, NegBinary, NegUnary, Neq, Next, Unary, Until, Var
from chronoscene.sources import adapters

#: The adapter tables in SQL.
FACTS = """
u as (select user_id as video_id, datediff('day', date '2024-01-01', ts::date) as fid, cast(regexp_extract(props, '[0-9]+') as int) % 8 as oid,
        event_type as predicate, max(round(value / (value + 100), 6)) as prob from events group by 1, 2, 3, 4),
obj as (select distinct video_id, oid from u),
mx as (select video_id, max(fid) as m from u group by 1),
tm as (select video_id, unnest(range(0, m)) as t from mx),
nm as (select video_id, oid, -1 - oid % 3 as cid, round(avg(prob), 6) as prob from u group by 1, 2),
bo as (select video_id, fid, oid as o2, max(prob) as p2 from u group by 1, 2, 3),
b as (select u.video_id, u.fid, u.predicate, u.oid as o1, bo.o2, round(u.prob * bo.p2, 6) as prob from u join bo on u.video_id = bo.video_id and u.fid = bo.fid and u.oid <> bo.o2)
"""


def scene(spark: SparkSession, d: str, with_max: bool = False) -> stsl.Scene:
    u = adapters.unary_atoms(spark, d)
    t = adapters.time_domain(u)
    top = t.groupBy("video_id").agg(F.max("t").alias("n")) if with_max else None
    return stsl.Scene(u, t, adapters.objects(u), adapters.binary_atoms(u), adapters.names(u), top)


def atom(p: str, v: int = 1) -> Unary:
    return Unary(p, Var(v))


CHAIN2 = [atom("click"), atom("purchase", 2)]
CHAIN3 = [atom("click"), atom("view"), atom("purchase")]
PROGRAM5 = [atom("view"), atom("click"), atom("purchase"), atom("error"), atom("signup")]


def _formula(formula: object, with_max: bool = False):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        return stsl.satisfied(scene(spark, d, with_max), formula).withColumnRenamed("t", "s")

    return run


def _with(body: str) -> str:
    return f"with {FACTS} {body}"


def holds(p: str, v: str, t: str) -> str:
    """EXISTS text: object ``v`` of video g has ``p`` at ``t``."""
    return f"exists (select 1 from u where u.video_id = g.video_id and u.oid = {v} and u.predicate = '{p}' and u.fid = {t})"


ONE = "g as (select obj.video_id, obj.oid as v1, tm.t as s, mx.m from obj join tm using (video_id) join mx using (video_id))"
TWO = "g as (select x.video_id, x.oid as v1, y.oid as v2, tm.t as s, mx.m from obj x join obj y on x.video_id = y.video_id join tm on tm.video_id = x.video_id join mx on mx.video_id = x.video_id)"
LATER = "select 1 from u where u.video_id = g.video_id and u.oid = g.v1"


def chains(sets: list[str]) -> str:
    """Rows of (video_id, event_no, t) over sets a, b, c of (video_id, v, t), by joining all orders of frames."""
    if len(sets) == 1:
        return f"{sets[0]} select distinct video_id, 1 as event_no, t from qa"
    if len(sets) == 2:
        return f"{', '.join(sets)}, j as (select a.video_id, a.t as t1, b.t as t2 from qa a join qb b on a.video_id = b.video_id and a.t < b.t) select distinct video_id, 1 as event_no, t1 as t from j union select distinct video_id, 2, t2 from j"
    return (
        f"{', '.join(sets)}, j as (select a.video_id, a.t as t1, b.t as t2, c.t as t3 from qa a join qb b on a.video_id = b.video_id and a.v = b.v and a.t < b.t join qc c on c.video_id = a.video_id and c.v = a.v and b.t < c.t) "
        "select distinct video_id, 1 as event_no, t1 as t from j union select distinct video_id, 2, t2 from j union select distinct video_id, 3, t3 from j"
    )


def points(name: str, p: str) -> str:
    return f"{name} as (select u.video_id, u.oid as v, u.fid as t from u join mx using (video_id) where predicate = '{p}' and u.fid < mx.m)"


WINDOWED_SQL = _with(
    f", {points('qa', 'view')}, {points('qb', 'click')}, {points('qc', 'purchase')}, {points('qe', 'error')}, {points('qf', 'signup')},"
    "j as (select a.video_id, a.t as t1, b.t as t2, c.t as t3 from qa a join qb b on a.video_id = b.video_id and a.v = b.v and a.t < b.t join qc c on c.video_id = a.video_id and c.v = a.v and b.t < c.t),"
    "k as (select e.video_id, e.t as t1, f.t as t2 from qe e join qf f on e.video_id = f.video_id and e.v = f.v and e.t < f.t) "
    "select distinct video_id, 0 as window_no, 1 as event_no, t1 as t from j union select video_id, 0, 2, t2 from j union select video_id, 0, 3, t3 from j "
    "union select video_id, 1, 1, t1 from k union select video_id, 1, 2, t2 from k"
)

_pairs = "g as (select x.video_id, x.oid as v1, y.oid as v2, tm.t as s from obj x join obj y on x.video_id = y.video_id join tm on tm.video_id = x.video_id)"
_bin = lambda p, a, b: f"exists (select 1 from b where b.video_id = g.video_id and b.fid = g.s and b.predicate = '{p}' and b.o1 = {a} and b.o2 = {b})"

QUERIES = {
    "stsl_finally": _formula(Finally(Logic(atom("click")))),
    "stsl_next": _formula(Next(Logic(atom("purchase")))),
    "stsl_until": _formula(Until(Logic(atom("click")), Logic(atom("purchase")))),
    "stsl_until_negative": _formula(Until(Logic(NegUnary("click", Var(1))), Logic(atom("purchase")))),
    "stsl_global": _formula(Global(Logic(NegUnary("click", Var(1)))), with_max=True),
    "stsl_global_without_max_time": _formula(Global(Logic(NegUnary("click", Var(1))))),
    "stsl_and_binary": _formula(Logic(And(atom("click"), Binary("view", Var(1), Var(2))))),
    "stsl_neg_unary": _formula(Logic(And(atom("click"), NegUnary("view", Var(1))))),
    "stsl_neg_binary": _formula(Logic(And(atom("click"), And(atom("view", 2), NegBinary("view", Var(2), Var(1)))))),
    "stsl_neq": _formula(Logic(And(atom("click"), And(atom("view", 2), Neq(Var(1), Var(2)))))),
    "stsl_two_variables": _formula(Logic(And(atom("click"), atom("view", 2)))),
    "stsl_neq_constant": _formula(Logic(And(atom("click"), Neq(Var(1), Const(-2))))),
    "stsl_const_unary": _formula(Logic(And(atom("click"), Unary("view", Const(-2))))),
    "stsl_const_only": _formula(Finally(Logic(Unary("purchase", Const(-1))))),
    "stsl_const_binary": _formula(Logic(Binary("click", Var(1), Const(-1)))),
    "stsl_const_const_binary": _formula(Logic(Binary("click", Const(-1), Const(-2)))),
    "stsl_neg_unary_const": _formula(Logic(And(atom("click"), NegUnary("view", Const(-2))))),
    "stsl_neg_binary_const": _formula(Logic(And(atom("click"), NegBinary("click", Var(1), Const(-1))))),
    "stsl_aligned": lambda spark, d: stsl.aligned(scene(spark, d), stsl.chain(CHAIN2)),
    "stsl_chain1": lambda spark, d: stsl.aligned_times(scene(spark, d), CHAIN3[:1]),
    "stsl_chain2": lambda spark, d: stsl.aligned_times(scene(spark, d), CHAIN2),
    "stsl_chain3": lambda spark, d: stsl.aligned_times(scene(spark, d), CHAIN3),
}

_neg = "(select count(distinct oid) from nm where nm.video_id = g.video_id and nm.cid = -1)"
ORACLES = {
    "stsl_finally": _with(f", {ONE} select video_id, v1, s from g where exists ({LATER} and predicate = 'click' and fid >= s and fid < m)"),
    "stsl_next": _with(f", {ONE} select video_id, v1, s from g where s + 1 < m and exists ({LATER} and predicate = 'purchase' and fid = s + 1)"),
    "stsl_until": _with(
        f", {ONE} select video_id, v1, s from g where {holds('purchase', 'v1', 's')} or exists ({LATER} and predicate = 'purchase' and fid > s and fid < m "
        "and (select count(distinct c.fid) from u c where c.video_id = g.video_id and c.oid = g.v1 and c.predicate = 'click' and c.fid >= g.s and c.fid < u.fid) = u.fid - s)"
    ),
    "stsl_until_negative": _with(
        f", {ONE} select video_id, v1, s from g where exists ({LATER} and predicate = 'purchase' and fid >= s and fid < m "
        "and not exists (select 1 from u c where c.video_id = g.video_id and c.oid = g.v1 and c.predicate = 'click' and c.fid >= g.s and c.fid < u.fid))"
    ),
    "stsl_global": _with(f", {ONE} select video_id, v1, s from g where not exists ({LATER} and predicate = 'click' and fid >= s and fid < m)"),
    "stsl_global_without_max_time": _with(f", {ONE} select video_id, v1, s from g where false"),
    "stsl_and_binary": _with(f", {_pairs} select video_id, v1, v2, s from g where {holds('click', 'v1', 's')} and {_bin('view', 'v1', 'v2')}"),
    "stsl_neg_unary": _with(f", {ONE} select video_id, v1, s from g where {holds('click', 'v1', 's')} and not {holds('view', 'v1', 's')}"),
    "stsl_neg_binary": _with(f", {_pairs} select video_id, v1, v2, s from g where {holds('click', 'v1', 's')} and {holds('view', 'v2', 's')} and not {_bin('view', 'v2', 'v1')}"),
    "stsl_neq": _with(f", {_pairs} select video_id, v1, v2, s from g where {holds('click', 'v1', 's')} and {holds('view', 'v2', 's')} and v1 <> v2"),
    "stsl_two_variables": _with(f", {_pairs} select video_id, v1, v2, s from g where {holds('click', 'v1', 's')} and {holds('view', 'v2', 's')}"),
    "stsl_neq_constant": _with(f", {ONE} select video_id, v1, s from g where {holds('click', 'v1', 's')} and exists (select 1 from nm where nm.video_id = g.video_id and cid = -2 and oid <> v1)"),
    "stsl_const_unary": _with(f", {ONE} select video_id, v1, s from g where {holds('click', 'v1', 's')} and exists (select 1 from nm join u on nm.video_id = u.video_id and nm.oid = u.oid where nm.video_id = g.video_id and cid = -2 and predicate = 'view' and fid = s)"),
    "stsl_const_only": _with("select tm.video_id, tm.t as s from tm join mx using (video_id) where exists (select 1 from nm join u on nm.video_id = u.video_id and nm.oid = u.oid where u.video_id = tm.video_id and cid = -1 and predicate = 'purchase' and fid >= t and fid < m)"),
    "stsl_const_binary": _with(f", {ONE} select video_id, v1, s from g where exists (select 1 from b join nm on nm.video_id = b.video_id and nm.oid = b.o2 where b.video_id = g.video_id and b.fid = s and b.predicate = 'click' and b.o1 = v1 and cid = -1)"),
    "stsl_const_const_binary": _with("select video_id, t as s from tm where exists (select 1 from b join nm x on x.video_id = b.video_id and x.oid = b.o1 join nm y on y.video_id = b.video_id and y.oid = b.o2 where b.video_id = tm.video_id and b.fid = t and b.predicate = 'click' and x.cid = -1 and y.cid = -2)"),
    "stsl_neg_unary_const": _with(f", {ONE} select video_id, v1, s from g where {holds('click', 'v1', 's')} and not exists (select 1 from nm join u on nm.video_id = u.video_id and nm.oid = u.oid where nm.video_id = g.video_id and cid = -2 and predicate = 'view' and fid = s)"),
    "stsl_neg_binary_const": _with(f", {ONE} select video_id, v1, s from g where {holds('click', 'v1', 's')} and exists (select 1 from nm where nm.video_id = g.video_id and cid = -1 and not exists (select 1 from b where b.video_id = g.video_id and b.fid = s and b.predicate = 'click' and b.o1 = v1 and b.o2 = nm.oid))"),
    "stsl_aligned": _with("select video_id, exists (select 1 from u where u.video_id = mx.video_id and predicate = 'purchase' and fid < m) as aligned from mx where m > 0"),
    "stsl_chain1": _with(f", {points('qa', 'click')} select distinct video_id, 1 as event_no, t from qa"),
    "stsl_chain2": _with(f", {chains([points('qa', 'click'), points('qb', 'purchase')])}"),
    "stsl_chain3": _with(f", {chains([points('qa', 'click'), points('qb', 'view'), points('qc', 'purchase')])}"),
}
