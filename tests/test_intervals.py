import random
from datetime import datetime

from pyspark.sql import Row

from chronoscene.operators.intervals import periods_and_gaps, video_positions
from chronoscene.operators.rangescan import prefix_sum


def brute(rows):
    out, by = set(), {}
    for e, s, t in rows:
        if None not in (e, s, t) and t > s:
            by.setdefault(e, []).append((s, t))
    for e, own in by.items():
        cur = None
        for s, t in sorted(own):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], t)
            else:
                if cur:
                    out |= {(e, "period", *cur), (e, "gap", cur[1], s)}
                cur = [s, t]
        out.add((e, "period", *cur))
    return out


def test_against_brute_force_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [("hot", s, s + rng.randint(-2, 9)) for s in (rng.randint(0, 900) for _ in range(400))]
    rows += [("hot", 0, 300), ("long", 0, 10_000)] + [("long", i, i + 1) for i in range(0, 9000, 60)]
    rows += [(f"e{rng.randint(0, 60)}", s, s + rng.randint(0, 30)) for s in (rng.randint(-50, 200) for _ in range(300))]
    rows += [(None, 1, 2), ("n", None, 2), ("n", 1, None), ("hot", 5, 5)] + rows[:20]
    df = spark.createDataFrame([Row(who=a, begin=b, finish=c, kind="x", start="clash") for a, b, c in rows])
    for n in (1, 3, 17):
        got = periods_and_gaps(df, "who", "begin", "finish", n).collect()
        assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_empty_table(spark):
    assert periods_and_gaps(spark.createDataFrame([], "e string, a int, b int"), "e", "a", "b").count() == 0


def test_notations_and_last_row(spark):
    t0, t1 = datetime(2025, 1, 1), datetime(2025, 2, 1)
    texts = {
        1: ["[1/4, 1/2]"], 2: ["0.0%-10.0%"], 3: ["3.00s - 6.00s"], 4: ["00:10.0", "00:20.0"], 5: ["from 1/3 until 1"], 6: [" [ 12/120 ,24/120] "],
        7: ["1/10", "1"], 8: ["4/5-1", "0-1/5"], 9: ["n/a"], 10: None, 11: [], 12: ["[1/2]"], 13: ["2/3", "1/3"], 14: ["(0, 1/8)", "throughout?"], 15: ["0.500", "0.750"],
    }
    rows = [(k, "v", k, t0, v) for k, v in texts.items()] + [(100, "v", 1, t1, ["unknown"]), (101, "v", None, t0, ["[0, 1]"]), (102, "w", 1, t0, ["5s - 6s"]), (103, None, 1, t0, ["[0, 1]"])]
    e = spark.createDataFrame(rows, "row_id long, video_id string, event_id int, received_at timestamp, video_location_precise array<string>")
    v = spark.createDataFrame([("v", 60), ("w", None)], "video_id string, duration_s int")
    got = {(r.video_id, r.start, r.end) for r in video_positions(e, v).collect() if r.start is not None}
    expected = {(0, 12), (6, 12), (20, 40), (40, 120), (12, 24), (12, 120), (96, 120), (0, 24), (80, 40), (0, 15), (60, 90), (0, 120)}
    assert got == {("v", *x) for x in expected}


def test_prefix_sum(spark):
    rng = random.Random(2)
    rows = [("h" if rng.random() < 0.6 else rng.choice("abc"), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {(r.g, r.i): (r.before, r["rank"]) for r in prefix_sum(df, "g", ["i"], "v", num_partitions=9).collect()}
    total, place = {}, {}
    for g, i, v in rows:
        assert got[g, i] == (total.get(g, 0), place.get(g, 0))
        total[g], place[g] = total.get(g, 0) + v, place.get(g, 0) + 1
