"""Queries of specifications evaluated as data, with oracles that join the facts of each event in every order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoscene.plans import spec_batch, stsl
from chronoscene.plans.stsl_queries import CHAIN2, CHAIN3, FACTS, PROGRAM5, WINDOWED_SQL, scene
from chronoscene.sources import adapters
from chronoscene.storage import table

CLAUSE = r"^\s*([^()]*[^()\s])\s*\(\s*([A-Z])\s*(?:,\s*([A-Z])\s*)?\)\s*$"
_E = r'Finally\(Logic\((?:Unary\("[^"]*",Var\(\d+\)\)|Binary\("[^"]*",Var\(\d+\),Var\(\d+\)\))\)\)'
_AGREE = lambda x, y: " and ".join(f"({x}.v{i} <> {y}.v{j} or {x}.o{i} = {y}.o{j})" for i in (1, 2) for j in (1, 2))

SPEC_SQL = rf"""with c as (select video_id, event_id as fid, unnest(programmatic) as c from timestamp_descriptions where video_id is not null and event_id is not null),
m as (select video_id, fid, lower(regexp_extract(c, '{CLAUSE}', 1)) as p, regexp_extract(c, '{CLAUSE}', 2) as x, regexp_extract(c, '{CLAUSE}', 3) as y from c where c is not null),
tu as (select video_id, generate_subscripts(tuples, 1) - 1 as fid, unnest(tuples) as u from batched_gpt_specs where video_id is not null),
td as (select video_id, fid, u.predicate as p, u.args[1] as x, coalesce(u.args[2], '') as y from tu where u.positive and u.predicate is not null and len(u.args) between 1 and 2 and len(list_filter(u.args, lambda a: regexp_full_match(a, '[A-Z]'))) = len(u.args)),
f as (select distinct video_id, fid, p, y <> '' as two, ascii(x) - 64 as o1, case when y = '' then ascii(x) - 64 else ascii(y) - 64 end as o2 from (select * from m where x <> '' union all select * from td)),
ft as (select * from f where fid >= 0),
pr as (select spec_id, -1 as window_no, video_id, prog from batched_gpt_specs union all select spec_id, generate_subscripts(windowed_prog, 1) - 1, video_id, unnest(windowed_prog).prog from batched_gpt_specs),
ok as (select * from pr where video_id is not null and regexp_full_match(prog, '{_E}|Until\({_E}, {_E}\)|Until\({_E}, Until\({_E}, {_E}\)\)')),
atm as (select spec_id, window_no, video_id, generate_subscripts(a, 1) as ev, len(a) as n, unnest(a) as a from (select *, regexp_extract_all(prog, '(?:Unary|Binary)\("[^"]*",Var\(\d+\)(?:,Var\(\d+\))?\)') as a from ok)),
tm as (select *, starts_with(a, 'Binary') as two, regexp_extract(a, '"([^"]*)"', 1) as p, regexp_extract(a, 'Var\((\d+)\)', 1)::int as v1, case when starts_with(a, 'Binary') then regexp_extract(a, 'Var\((\d+)\)\)$', 1)::int else regexp_extract(a, 'Var\((\d+)\)', 1)::int end as v2 from atm),
h as (select spec_id, window_no, ev, n, fid as t, v1, v2, o1, o2 from tm join ft on ft.video_id = tm.video_id and ft.p = tm.p and ft.two = tm.two where v1 <> v2 or o1 = o2),
j2 as (select a.spec_id, a.window_no, a.t as t1, b.t as t2 from h a join h b on a.spec_id = b.spec_id and a.window_no = b.window_no and a.ev = 1 and b.ev = 2 and a.n = 2 and a.t < b.t and {_AGREE("a", "b")}),
j3 as (select a.spec_id, a.window_no, a.t as t1, b.t as t2, c.t as t3 from h a join h b on a.spec_id = b.spec_id and a.window_no = b.window_no and a.ev = 1 and b.ev = 2 and a.n = 3 and a.t < b.t and {_AGREE("a", "b")}
  join h c on c.spec_id = b.spec_id and c.window_no = b.window_no and c.ev = 3 and b.t < c.t and {_AGREE("a", "c")} and {_AGREE("b", "c")})
select spec_id, window_no, 1 as event_no, t from h where n = 1 union select spec_id, window_no, 1, t1 from j2 union select spec_id, window_no, 2, t2 from j2
union select spec_id, window_no, 1, t1 from j3 union select spec_id, window_no, 2, t2 from j3 union select spec_id, window_no, 3, t3 from j3"""


def project_facts(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Unary facts, binary facts, names, time domain (the last frame too) and objects: annotated programs of the events and the specifications' own tuples."""
    unary, binary, names = spec_batch.program_facts(table(spark, d, "timestamp_descriptions").select("video_id", "event_id", "programmatic"))
    own_unary, own_binary = spec_batch.tuple_facts(table(spark, d, "batched_gpt_specs").select("video_id", "tuples"))
    unary, binary = unary.union(own_unary), binary.union(own_binary)
    frames = unary.select("video_id", "fid").union(binary.select("video_id", "fid"))
    sides = unary.select("video_id", "oid").union(binary.select("video_id", "o1")).union(binary.select("video_id", "o2"))
    return unary, binary, names, adapters.time_domain(frames, include_last_frame=True), sides.distinct()


def spec_batch_aligned(spark: SparkSession, d: str) -> DataFrame:
    """The whole program and every window of every specification against the facts of its video."""
    programs = spec_batch.spec_programs(table(spark, d, "batched_gpt_specs").select("spec_id", "video_id", "consts", "prog", "windowed_prog"))
    return spec_batch.evaluate(programs, *project_facts(spark, d))


def spec_batch_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Programs and windows by the reason for which they are not evaluated ('' where they are)."""
    programs = spec_batch.spec_programs(table(spark, d, "batched_gpt_specs").select("spec_id", "video_id", "consts", "prog", "windowed_prog"))
    parsed = spec_batch.parsed_programs(programs).where("event_no = 1 or event_no is null")
    return parsed.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def spec_batch_compiled(spark: SparkSession, d: str) -> DataFrame:
    """Windows of programs compiled from the events of a video, evaluated against all its facts."""
    from chronoscene.plans.program import windowed_programs

    events = table(spark, d, "timestamp_descriptions").select("video_id", "event_id", "programmatic")
    programs = windowed_programs(events).select(F.col("video_id").alias("spec_id"), "window_no", "video_id", "consts", "prog")
    return spec_batch.evaluate(programs, *project_facts(spark, d))


def stsl_windowed_batch(spark: SparkSession, d: str) -> DataFrame:
    """The windows of one program of five events for every video: a row of programs per video and window."""
    s = scene(spark, d)
    texts = [stsl.show(stsl.chain(events)) for _, events in stsl.program_windows(PROGRAM5)]
    programs = s.objects.select("video_id").distinct().select(
        F.col("video_id").alias("spec_id"), "video_id", F.array().cast("array<string>").alias("consts"), F.posexplode(F.array(*map(F.lit, texts))).alias("window_no", "prog")
    )
    names = s.names.select("video_id", "oid", F.col("cid").cast("string").alias("name"))
    out = spec_batch.evaluate(programs, s.unary, s.binary, names, s.time, s.objects)
    return out.select(F.col("spec_id").alias("video_id"), "window_no", "event_no", "t")


#: An object is clicked while it isn't viewed, later one of the second category is bought.
NEGATIVE = [stsl.And(stsl.Unary("click", stsl.Var(1)), stsl.NegUnary("view", stsl.Var(1))), stsl.Unary("purchase", stsl.Const(-2))]


def _probable(events: list, k: int):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        from chronoscene.operators.proofs import event_probabilities

        return event_probabilities(scene(spark, d), events, k).select("video_id", "event_no", "t", F.round("prob", 6).alias("prob"))

    return run


QUERIES = {"prob_best_chain1": _probable(CHAIN3[:1], 1), "prob_best_chain2": _probable(CHAIN2, 1), "prob_best_chain3": _probable(CHAIN3, 1), "prob_topk_chain2": _probable(CHAIN2, 3), "prob_topk_chain3": _probable(CHAIN3, 3),
    "prob_topk_negative": _probable(NEGATIVE, 3), "spec_batch_aligned": spec_batch_aligned, "spec_batch_reasons": spec_batch_reasons, "spec_batch_compiled": spec_batch_compiled, "stsl_windowed_batch": stsl_windowed_batch}
_SEEN = lambda name, p: f"{name} as (select u.video_id, u.oid as v, u.fid as t, u.prob as p from u join mx using (video_id) where predicate = '{p}' and u.fid < mx.m and u.prob > 0)"
ORACLES = {
    "prob_best_chain1": f"with {FACTS}, {_SEEN('a', 'click')} select video_id, 1 as event_no, t, round(max(p), 6) as prob from a group by 1, 3",
    "prob_best_chain2": f"with {FACTS}, {_SEEN('a', 'click')}, {_SEEN('z', 'purchase')}, j as (select a.video_id, a.t as t1, z.t as t2, a.p * z.p as p from a join z on a.video_id = z.video_id and a.t < z.t) "
    "select video_id, 1 as event_no, t1 as t, round(max(p), 6) as prob from j group by 1, 3 union all select video_id, 2, t2, round(max(p), 6) from j group by 1, 3",
    "prob_best_chain3": f"with {FACTS}, {_SEEN('a', 'click')}, {_SEEN('m', 'view')}, {_SEEN('z', 'purchase')}, j as (select a.video_id, a.t as t1, m.t as t2, z.t as t3, a.p * m.p * z.p as p from a join m on a.video_id = m.video_id and a.v = m.v and a.t < m.t join z on z.video_id = m.video_id and z.v = m.v and m.t < z.t) "
    "select video_id, 1 as event_no, t1 as t, round(max(p), 6) as prob from j group by 1, 3 union all select video_id, 2, t2, round(max(p), 6) from j group by 1, 3 union all select video_id, 3, t3, round(max(p), 6) from j group by 1, 3",
    "spec_batch_aligned": SPEC_SQL,
    "spec_batch_reasons": SPEC_SQL.split("ok as")[0].rstrip().rstrip(",")
    + rf""" select case when prog is null or trim(prog) = '' then 'empty' when not regexp_full_match(prog, '{_E}|Until\({_E}, {_E}\)|Until\({_E}, Until\({_E}, {_E}\)\)') then 'unreadable' else '' end as reason, count(*) as n from pr group by 1""",
    "stsl_windowed_batch": WINDOWED_SQL,
}
