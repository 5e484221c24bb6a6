import glob
import itertools
import os
import random
import re
import string
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from chronoscene.llm import keywords, mixing, packing, pairs, queries, stuffing, tokens, topn

HAVE_TOKENIZER = os.path.exists(tokens.TOKENIZER)


# --- 1 keywords ---------------------------------------------------------------------------------------------------

VOCABULARY = [(1, "entity", "garden hose", None), (2, "entity", "puppy", ["young dog"]), (3, "unary", "running", None), (4, "binary", "on top of", ["atop"]), (5, "entity", "policeman", ["police officer"])]


def vocabulary(spark):
    return spark.createDataFrame(VOCABULARY, "term_id long, kind string, term string, aliases array<string>")


def test_keywords(spark):
    cases = {
        ("entity", "gardn hose"): 1, ("entity", " The Garden_Hose#2 "): 1, ("entity", "some youngd og"): 2, ("entity", "puppies"): 2, ("entity", "policemen (B)"): 5, ("entity", "gаrden hose"): 1,
        ("entity", "running"): -1, ("unary", "still runnnig."): 3, ("unary", "runs"): 3, ("unary", "ran A"): 3, ("binary", "is ontop of C"): 4, ("binary", "ATOP"): 4, ("entity", "zeppelin"): -1,
        ("entity", ""): -1, ("entity", "n/a"): -1, ("unary", "???"): -1, ("unary", "x" * 20_000): -1, ("entity", "a a puppy"): 2,
    }
    df = spark.createDataFrame([(k, v, "x") for k, v in cases] * 2, "kind string, value string, term_id string")
    got = {(r.kind, r.value): r.term_id for r in keywords.map_values(df, vocabulary(spark)).collect()}
    assert got == cases
    assert {r.term_id for r in keywords.map_values(df, vocabulary(spark).limit(0)).collect()} == {-1}
    assert keywords.map_values(df.limit(0), vocabulary(spark)).count() == 0


def test_similarity_join_finds_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 9)))
    left, right = sorted({word() for _ in range(60)}), sorted({word() for _ in range(40)})

    def grams(w):
        ps = [f"^{w}$"[k : k + 2] for k in range(len(w) + 1)]
        return {(p, ps[: i + 1].count(p)) for i, p in enumerate(ps)}

    jaccard = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    limit = lambda w: 1 if len(w) <= 4 else 2 if len(w) <= 9 else 3
    expected = {}
    for a in left:
        good = [b for b in right if jaccard(a, b) >= 0.2 and abs(len(a) - len(b)) <= limit(b) and lev(a, b) <= limit(b)]
        if good:
            expected[a] = min((-jaccard(a, b), lev(a, b)) for b in good)
    v = spark.createDataFrame([("k", w) for w in left], "kind string, key string")
    f = spark.createDataFrame([("k", w, i, 0) for i, w in enumerate(right)], "kind string, form string, term_id long, rank int")
    got = {r.key: (-r.jaccard, r.edits) for r in keywords.similarity_join(v, f).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_least_similarity_is_lossless():
    """No word within the allowed edits of a form has a lower Jaccard than the threshold."""
    rng = random.Random(8)
    for n in [2, 3, 4, 5, 6, 9, 10, 12] * 150:
        form = "".join(rng.choice("abcdefghijkl") for _ in range(n))
        w = form
        for _ in range(1 if n <= 4 else 2 if n <= 9 else 3):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + "z" + w[i:], w[:i] + w[i + 1 :], w[:i] + "y" + w[i + 1 :]]) or "z"
        grams = [{(p, [f"^{t}$"[k : k + 2] for k in range(j)].count(p)) for j, p in enumerate(f"^{t}$"[k : k + 2] for k in range(len(t) + 1))} for t in (form, w)]
        assert len(grams[0] & grams[1]) / len(grams[0] | grams[1]) >= keywords.SIMILARITY - 1e-9, (form, w)


def test_leads_are_learnt(spark):
    rows = [("entity", f"{lead} {t}") for lead in ("rusty", "toy") for t in ("puppy", "policeman", "garden hose")[: 3 if lead == "rusty" else 2]]
    df = spark.createDataFrame(rows, "kind string, value string")
    got = {r.value: r.term_id for r in keywords.map_values(df, vocabulary(spark)).collect()}
    assert [v for v, t in sorted(got.items()) if t == -1] == ["toy policeman", "toy puppy"]


def test_elements(spark):
    s = spark.createDataFrame([(1, ["puppy", None, "pupy"], None, []), (2, None, None, None)], "spec_id long, consts array<string>, unary_kws array<string>, binary_kws array<string>")
    rows = keywords.keyword_elements(s, vocabulary(spark)).collect()
    assert [(r.spec_id, r.field, r.pos, r.value) for r in rows] == [(1, "consts", 2, "pupy")]


# --- 5 top n ------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 2))), max_size=6), st.integers(1, 4))
def test_merge_runs(runs, n):
    runs = [sorted(r) for r in runs]
    got = [runs[r][i] for r, i in topn.merge_runs(runs, n)]
    expected = []
    for _, rows in itertools.groupby(sorted({x for r in runs for x in r}), key=lambda x: x[0]):
        expected += list(rows)[:n]
    assert got == expected


def test_top_n_with_ties_repeats_nulls_and_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 40)}", rng.choice("xy"), rng.randint(0, 50), rng.randint(0, 3)) for _ in range(3000)]
    rows += rows[:500] + [(None, "x", 1, 1), ("g", None, 1, 1), ("g", "x", None, 1)] + [("ä", "x", 1, 1), ("Z", "x", 1, 1), ("a", "x", 1, 1)]
    df = spark.createDataFrame(rows, "v string, l string, s long, f long").repartition(7)
    got = sorted(tuple(r) for r in topn.top_n(df, ["v", "l"], ["s", "f"], 8, 5).collect())
    groups = {}
    for r in {r for r in rows if None not in r}:
        groups.setdefault(r[:2], []).append(r)
    assert got == sorted(x for g in groups.values() for x in sorted(g)[:8])
    assert topn.top_n(df.limit(0), ["v", "l"], ["s", "f"], 8).count() == 0


def test_top_n_holds_one_slice_at_a_time(spark):
    parts = [pd.DataFrame({"slice": x, "v": x}) for x in ([0, 0], [0, 1, 2], [], [2], [2, 5])]
    assert [list(s["v"]) for s in topn.slices_of(iter(parts))] == [[0, 0, 0], [1], [2, 2, 2], [5]]
    rows = [(f"g{i % 40}", i * 7 % 1000) for i in range(2000)] + [("hot", i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, s long").repartition(5)
    got = {}
    for r in topn.top_n(df, ["g"], ["s"], 3, buckets=2, slice_rows=20).collect():
        got.setdefault(r.g, []).append(r.s)
    want = {}
    for g, v in set(rows):
        want.setdefault(g, []).append(v)
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(v)[:3] for g, v in want.items()}


def test_boxes_skip_incomplete_positions(spark):
    box = lambda *v: Row(x1=v[0], y1=v[1], x2=v[2], y2=v[3])
    rows = [("v", 1, ["a", None, "c"], [1, 2, None, 4], [box(0, 0, 2, 3), box(0, 0, 2, 2), box(0, 0, 1, 1), box(0, 0, 9, 9)]), ("v", 2, None, [1], [box(0, 0, 1, 1)]), ("v", 3, ["a", "a"], [1, 2], [None, box(5, 5, 5, 9)]), ("v", 4, [], [], None)]
    df = spark.createDataFrame(rows, "video_id string, fid int, gt_labels array<string>, gt_instance_ids array<long>, gt_bboxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    assert [(r.fid, r.gt_label, r.neg_area) for r in topn.boxes(df).collect()] == [(1, "a", -6)]


# --- 6 pairs ------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert pairs.lcs(a, b) == table[-1][-1]


def test_copies_and_refusals_are_aligned():
    tokens = pairs.tokens_of
    prompt = tokens("A climber holds a long rope near the old wooden door, then the climber drops it")
    assert pairs.is_copy(prompt, tokens("Description as given by the annotator: a climber holds a long rope near the old wooden door. Then the climber drops it"))  # a long label
    assert pairs.is_copy(prompt, tokens("a climber hol ds a long rope near theold wooden door then the climber drops it"))  # other division
    assert pairs.is_copy(prompt, tokens("a climber holds a long rope near the old wooden door then the climber drops i"))  # nearly all, as the bound says
    assert not pairs.is_copy(prompt, tokens("climber A holds rope B near the door; climber A drops rope B"))
    assert not pairs.is_copy(prompt, tokens(" ".join(prompt[:9])))
    assert not pairs.is_copy(prompt, [*prompt, *tokens("and walks off to the left of the house")])
    assert not pairs.is_copy(prompt, [*tokens("one two three four five six seven"), *prompt])
    assert not pairs.is_copy([], tokens("anything")) and not pairs.is_copy(prompt, [])
    assert pairs.is_refusal(tokens("Sorry, I can't describe the events of this clip"), prompt)
    assert pairs.is_refusal(tokens("Thanks for the caption, however describing these people would go against my guidelines"), prompt)
    quoted = tokens("The man says I can't reach the shelf")
    assert not pairs.is_refusal(quoted, tokens("A man says he can't reach the shelf"))
    assert not pairs.is_refusal(tokens("climber A " * 30 + "says I can't"), [])


def test_defects(spark):
    good = {
        "en": ("A baker holds a kite on the pier, then a baker opens a jar.", ["baker A holds kite B on the pier", "baker A opens jar C"]),
        "de": ("Eine Schneiderin schüttelt eine Laterne auf dem Steg, ein Schäfer öffnet einen Koffer.", ["Schneiderin A schüttelt Laterne B auf dem Steg", "Schäfer C öffnet Koffer D"]),
        "fr": ("Un berger secoue une valise sur la jetée, ensuite une potière suit un tuyau.", ["berger A secoue valise B sur la jetée", "potière C suit tuyau D"]),
        "es": ("Un pastor empuja una manguera en el muelle, luego una niña atrapa una caja.", ["pastor A empuja manguera B en el muelle", "niña C atrapa caja D"]),
    }
    labelled = spark.createDataFrame([(k, " ".join([p, *a])) for k, (p, a) in good.items()] * 5, "lang string, text string")
    en, ans = good["en"]
    rows = [("caption", i, [p], a) for i, (p, a) in enumerate(good.values())] * 4
    cases = {
        10: (None, "empty"), 11: ([], "empty"), 12: ([None, " ​ "], "empty"), 13: (["N/A"], "empty"), 14: ([en.upper().rstrip(".")], "copy"), 15: (["Q: " + en[:30], en[30:]], "copy"),
        16: (["I'm sorry, but I can't describe the events of this clip."], "refusal"), 17: (["baker A cannot reach kite B", "nurse A apologizes for dropping jar C"], None), 18: ([ans[0], "baker A opens j"], "truncated"),
        19: ([ans[0], "baker A and"], "truncated"), 20: (["baker A holds kite B on the pi…"], "truncated"), 21: (good["de"][1], "language"), 22: (good["fr"][1], "language"), 23: (ans + [""], None), 24: ([" ".join(ans) * 3000], None),
        25: (["Lamentablemente, debo rechazar esta solicitud."], "refusal"), 26: (["Es tut mir leid, aber dazu darf ich keine Auskunft geben."], "refusal"), 27: (["Je regrette, je dois refuser cette demande"], "refusal"),
    }
    rows += [("caption", k, [en], a) for k, (a, _) in cases.items()] + [("caption", 99, None, None)]
    df = spark.createDataFrame(rows, "pair_level string, pair_id long, prompt array<string>, answer array<string>")
    got = {r.pair_id: r.defect for r in pairs.defective_pairs(df, labelled).collect()}
    assert got == {k: d for k, (_, d) in cases.items() if d}


def test_program_defects(spark):
    labelled = spark.createDataFrame([("en", "holding opening baker kite jar near behind moving"), ("de", "halten öffnen berühren Bäcker Koffer schüttelt"), ("es", "pintar tocar panadero cometa"), ("fr", "ouvrir tenir boulanger lanterne")] * 3, "lang string, text string")
    cases = {1: (["holding(A, B)", "name(A, baker)"], None), 2: (["holding(A, B)", "name(A, ba"], "truncated"), 3: (["öffnen(A, B)", "name(A, Bäcker)"], "language"), 4: (["> baker A holds kite B"], "copy"), 5: (["moving (A)."], None), 6: ([], "empty"), 7: (["holding(A,"], "truncated")}
    df = spark.createDataFrame([("event", k, ["baker A holds kite B"], a) for k, (a, _) in cases.items()], "pair_level string, pair_id long, prompt array<string>, answer array<string>")
    assert {r.pair_id: r.defect for r in pairs.defective_pairs(df, labelled).collect()} == {k: d for k, (_, d) in cases.items() if d}
    assert pairs.defective_pairs(df.limit(0), labelled).count() == 0


def test_rare_endings_are_judged_by_their_last_word(spark):
    rows = [
        ("caption", 1, ["A carpenter works."], ["A carpenter waits on the dry path.", "A carpenter fills a flowerpot on the muddy path."]),
        ("caption", 2, ["A baker works."], ["A baker rests.", "A baker waits behind the"]),
    ]
    df = spark.createDataFrame(rows, "pair_level string, pair_id long, prompt array<string>, answer array<string>")
    labelled = spark.createDataFrame([("en", " ".join([*r[2], *r[3]])) for r in rows], "lang string, text string")
    assert [tuple(r) for r in pairs.defective_pairs(df, labelled).collect()] == [("caption", 2, "truncated")]


# --- 7 packing, 8 mixing ------------------------------------------------------------------------------------------


def test_level_array_takes_the_least_sum_of_squares():
    rng = random.Random(7)
    levels, fill = packing.LevelArray(20), {}
    for _ in range(400):
        size = rng.randint(1, 20)
        counts = Counter(f for f in fill.values() if f < 20)
        cost = lambda c: sum(n * n for n in c.values())
        options = {0: cost(counts + Counter([size] if size < 20 else []))}
        for level in {f for f in fill.values() if f + size <= 20}:
            moved = Counter(counts)
            moved[level] -= 1
            if level + size < 20:
                moved[level + size] += 1
            options[level] = cost(moved)
        container = levels.place(size)
        level = fill.get(container, 0)
        assert options[level] == min(options.values())
        fill[container] = level + size
    assert max(fill.values()) <= 20


def test_pack(spark):
    rng = random.Random(8)
    items = [(i, rng.choice(["en", "de", None]), rng.choice([0, None, 5, 100, 130, 999])) for i in range(300)] + [(7, "en", 5), (None, "en", 5)]
    df = spark.createDataFrame([(*r, "x") for r in items], "doc_id long, lang string, n_tokens int, container string")
    caps = spark.createDataFrame([(1, 128, False), (2, 256, True), (3, None, True)], "pack_id int, capacity_tokens int, by_lang boolean")
    pieces = packing.pack(df, caps, shard_items=100).collect()
    lang = {i: v for i, v, _ in items}
    for pack_id, cap in ((1, 128), (2, 256)):
        own = [p for p in pieces if p.pack_id == pack_id]
        fill, langs, by_doc = Counter(), {}, {}
        for p in own:
            fill[p.container] += p.n_tokens
            langs.setdefault(p.container, set()).add(lang[p.doc_id])
            by_doc.setdefault(p.doc_id, []).append(p)
        assert max(fill.values()) <= cap and sum(fill.values()) == sum(n for i, _, n in items if n and i is not None)
        assert pack_id == 1 or all(len(v) == 1 for v in langs.values())
        for i, _, n in items:
            if i is not None and i != 7 and n:
                ps = sorted(by_doc[i], key=lambda p: p.piece_no)
                assert len(ps) == -(-n // cap) and [p.token_start for p in ps] == [k * cap for k in range(len(ps))]
    assert packing.pack(df.limit(0), caps).count() == 0
    report = {r.pack_id: r.fill for r in packing.fill_report(packing.pack(df, caps), caps).collect()}
    assert report[1] > 0.8


def test_mix(spark):
    rng = random.Random(9)
    docs = [(i, "big" if i % 3 else "small", rng.randint(1, 50)) for i in range(900)] + [(1000, None, 9), (1001, "big", None), (1002, "other", 7)]
    df = spark.createDataFrame([(*d, "q") for d in docs], "doc_id long, source string, n_tokens int, position string")
    targets = spark.createDataFrame([(1, 0.5, "big", 0.5, 1), (1, 0.5, "small", 0.4, 4), (1, 0.5, "none", 0.1, 9), (2, 3.0, "small", 1.0, 2), (3, 0.1, None, 1.0, 1)], "plan_id int, plan_size double, source string, target_share double, max_repeats int")
    corpus = sum(n for _, _, n in docs if n)
    supply = {s: sum(n for _, x, n in docs if x == s and n) for s in ("big", "small")}
    rows = mixing.mix(df, targets).collect()
    got = Counter()
    for r in rows:
        got[r.plan_id, r.source] += r.n_tokens
    for (plan, source), want, cap in (((1, "big"), 0.25 * corpus, 1), ((1, "small"), 0.2 * corpus, 4), ((2, "small"), 3 * corpus, 2)):
        assert abs(got[plan, source] - min(want, cap * supply[source])) <= 25
    assert set(got) == {(1, "big"), (1, "small"), (2, "small")}
    copies = Counter((r.plan_id, r.doc_id) for r in rows)
    assert all(copies[r.plan_id, r.doc_id] == r.repeats and 1 <= r.copy_no <= r.repeats for r in rows) and max(copies.values()) <= 4
    order = [(r.plan_id, r.position) for r in rows]
    assert order == sorted(order) and all(0 <= p <= 1 for _, p in order)
    shares = {(r.plan_id, r.source): r for r in mixing.shares(mixing.mix(df, targets), df, targets).collect()}
    assert shares[1, "none"].mixed_tokens == 0 and abs(shares[1, "big"].share_of_plan - 0.5) < 0.02 and shares[2, "small"].most_repeats == 2
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_schedule_keeps_local_shares(spark):
    """Near any time the mix has the weights of the schedule: in the first tenth as its integral says."""
    docs = spark.createDataFrame([(i, "a" if i % 10 else "b", 10) for i in range(20_000)], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([(1, 0.4, "a", 0.5, 1), (1, 0.4, "b", 0.5, 4)], "plan_id int, plan_size double, source string, target_share double, max_repeats int")
    p = {r.source: r for r in mixing.plans(docs, targets).collect()}
    first = Counter(r.source for r in mixing.mix(docs, targets).where("position < 0.1").collect())
    for s, r in p.items():
        expected = r.passes * r.available / 10 * (0.1 + r.slope * (0.01 - 0.1))
        assert abs(first[s] - expected) <= 0.03 * expected + 2
    assert p["b"].slope > p["a"].slope and abs(sum(r.share * r.slope for r in p.values())) < 1e-9


@pytest.mark.skipif(not HAVE_TOKENIZER, reason="no tokenizer")
def test_tokens_round_trip(spark):
    texts = ["", None, "Hello, wörld!  \n\n", "été 123 <|endoftext|>", "a" * 5000]
    e = tokens.encoding()
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts if t)
    df = spark.createDataFrame([(i, t, "EN-us" if i else None, " Web-Crawl ") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in tokens.sized(df).collect()}
    assert [rows[i].n_tokens for i in range(5)] == [len(e.encode_ordinary(t)) if t else 0 for t in texts]
    assert rows[0].lang == "und" and rows[1].lang == "en" and rows[1].source == "web_crawl"


# --- 9 stuffing ---------------------------------------------------------------------------------------------------

HONEST = [
    "A gardener throws a toolbox on the pier. Nobody else enters the frame until second 81. If you slow the clip down, you can see that the tailor is not covering anything at all.",
    "00:00.0 | 00:07.0 | A goat shakes a toolbox beside the fountain.\n00:07.0 | 00:11.0 | A skater covers a toolbox.\n00:11.0 | 00:31.7 | A janitor hides a red bucket.",
    "objects (14): nurse, tent, potter, toddler, wheel, jar, basket, flowerpot, climber, waiter, blanket, mirror, referee, mechanic",
    "A tailor lifts an umbrella. Objects: painter (3), puppy (1), janitor (1), toolbox (1), ladder (5), ladder (1), mechanic (2), wheel (5).",
    "1: turning(A, B), name(A, teenager), name(B, broom)\n2) catching(A, B), name(A, goat), name(B, tent), moving(A)\nevent 3: holding(A, B), name(A, baker)",
    "I paid 83.99 for my action camera and have not regretted it, although the action camera that came with it broke after a week. A baker turns a kettle, then a baker follows a kite.",
    "A puppy throws a sack. (https://a.test/x/y) Someone off screen laughs, and the baker looks up for a moment. (https://b.test/long/path/to/page.html)",
]
SPAM = [
    "flowerpot buy | 2025 flowerpot buy | 2025 flowerpot free | flowerpot | HD flowerpot discount | flowerpot top 10 | sale flowerpot",
    "tent, tent and more tent: this tent page is all about tent. Why tent? Because tent saves time, tent saves money, and tent is tent.",
    "https://shotvid.invalid/reel-276/cam\nhttps://clippromo80.example/promo-2495/stock\nhttp://best-shot.example/reel-1630/free-265?id=46295",
    "Stock footage R535\nRef. 27345\n398.00\nCamera bag R269\nRef. 97722\n205.00\nMemory card X501\nRef. 61177\n336.00",
    "#videodownloader #4kclips2025 #buytripod #cheapgimbal #bestringlight #salelensfilter",
    "jar Ruthfors - jar Torvale - jar Plimwick - jar Torport - jar Eldport - jar Kessport - jar Wendby - jar Brimmont",
    "Drohnenvideo kaufen Preis Drohnenvideo beste online Drohnenvideo kaufen Drohnenvideo günstig gratis Drohnenvideo",
]


def test_stuffing(spark):
    long_honest = " ".join(HONEST[0] for _ in range(2000))
    rows = [(i, t, "en", "x") for i, t in enumerate(HONEST + [long_honest])] + [(100 + i, t, "en" if i < 6 else "de", "x") for i, t in enumerate(SPAM)]
    rows += [(200, None, "en", "x"), (201, "", None, "x"), (202, " \n ", "en", "x"), (None, SPAM[0], "en", "x"), (203, SPAM[0], "EN-us", "x"), (204, HONEST[0] + "\n" + SPAM[0][:60], "en", "x"), (205, SPAM[2] * 4 + " " + HONEST[0], None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, share string")
    got = sorted(r.doc_id for r in stuffing.stuffed_pages(stuffing.segments(df)).collect())
    assert got == [*range(100, 107), 203, 205]
    assert stuffing.stuffed_pages(stuffing.segments(df.limit(0))).count() == 0


def test_stuffing_by_repeated_lines_separators_missing_function_words_and_pairs(spark):
    honest = [(i, t, "en") for i, t in enumerate(HONEST)]
    other = [(10, "Camera: farmer 1\nSound: drummer 5\nEdit: shepherd 7\nLocation: sailor 9\nProps: goat 5", "en"), (11, "objects (12): nurse, tent, potter, wheel, jar, basket, climber, waiter, blanket, mirror, referee, mechanic", "en")]
    spam = [
        "\n".join(["Find a lens for the tripod in the studio."] * 6),
        "lens filter | tripod | camera bag | green screen | memory card | ring light | gimbal | the drone | the clips",
        "lens filter tripod camera bag green screen memory card ring light gimbal drone",
        "the lens in a bag and the lens in a bag and the lens in a bag and the clip of the lens in a bag",
    ]
    rows = honest + other + [(100 + i, t, "en") for i, t in enumerate(spam)]
    found = stuffing.stuffed_pages(stuffing.segments(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()
    assert sorted(r.doc_id for r in found) == [100, 101, 102, 103]


def test_limits_of_languages_and_corpus_come_from_one_pass(spark, tmp_path):
    rows = [(i, t, ("en", "de", None)[i % 3]) for i, t in enumerate(HONEST * 3)]
    stuffing.segments(spark.createDataFrame(rows, "doc_id long, text string, lang string")).write.parquet(f"{tmp_path}/m")
    limits = stuffing.calibrated(spark.read.parquet(f"{tmp_path}/m"))
    assert sorted(r.lang for r in limits.collect()) == ["de", "en", "und"]
    assert limits._jdf.queryExecution().sparkPlan().toString().count("FileScan") <= 2


def plain_measure(segments, function):
    """The values of ``stuffing.measure`` by their definition, each counted for itself."""
    bodies = [stuffing.LINK.sub(" ", s) if "/" in s or "www." in s else s for s, _, _ in segments]
    words = [stuffing.WORDS.findall(b.lower()) for b in bodies]
    content = [Counter(w for w in ws if len(w) > 2 and w not in stuffing.ALL_FUNCTION) for ws in words]
    page = sum(content, Counter())
    stuffed = {w for w, n in page.items() if n >= max(3, 0.03 * sum(map(len, words)))}
    out = []
    for (s, sentence, again), b, ws, c in zip(segments, bodies, words, content, strict=True):
        top, twos = max(c.values(), default=0), list(zip(ws, ws[1:], strict=False))
        honest = sum(map(len, stuffing.HONEST.findall(b))) if "(" in b or ":" in b or "id " in b else 0
        form = not sentence and ":" in b and stuffing.LISTED.search(b) is not None
        out.append((len(s), len(ws), sum(w in function for w in ws), top, sum(n for w, n in c.items() if w in stuffed), len(twos) - len(set(twos)) if top > 1 else 0, max(0, len(s) - len(b)), sum(b.count(x) for x in stuffing.SEPARATORS), honest, form, again, sentence))
    return out


def test_measures_follow_their_definition_and_count_words_once_a_page(monkeypatch):
    rng, built = random.Random(9), []
    bits = " ".join(HONEST + SPAM).split(" ") + ["\n", "\n", "a. b", "the", "tent", "tent", "id 7", "(Q, ab c)", "1:23", "</a>", "x.de/", "-", "Über", "straße!", "I", "3,5", "\"Oh!\")", "id\t5:", ".ab/", "<a b>", "www.q", "_", "İ"]
    texts = HONEST + SPAM + ["", "-", *[" ".join(rng.choices(bits, k=rng.randrange(1, 200))) for _ in range(400)], *[" ".join(rng.choices(["tent", "jar", "the", "a.", "b:\n"], k=60)) for _ in range(40)]]
    lone = " ".join(f"{a}{b}x goes to {b}{a}y." for a in string.ascii_letters for b in string.ascii_lowercase)
    count = lambda *a: built.append(1) or Counter(*a)
    for text in [*texts, lone]:
        segments = stuffing.split_segments(text)
        for function in (stuffing.FUNCTION["en"], stuffing.ALL_FUNCTION):
            assert stuffing.measure(segments, function) == plain_measure(segments, function)
    monkeypatch.setattr(stuffing, "Counter", count)
    assert len(stuffing.measure(stuffing.split_segments(lone), stuffing.ALL_FUNCTION)) > 1000
    assert len(built) == 1


def test_sentences_are_divided_behind_their_signs():
    assert list(stuffing.sentences('He said "Go!") and left.  "Why?" she asked… Then: 3.5 or e.g.? ')) == ['He said "Go!', "and left.", '"Why?', "she asked…", "Then: 3.5 or e.g.?", ""]
    old = re.compile(r"(?<=[.!?…])[\"')\]]*\s+")
    rng = random.Random(10)
    for _ in range(2000):
        line = "".join(rng.choices(". ! ? … \" ' ) ] a b  \t".split(" ") + [" "] * 4, k=rng.randrange(30)))
        assert list(stuffing.sentences(line)) == old.split(line)


# --- queries ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    if not HAVE_TOKENIZER and name.startswith(("p7", "p8")):
        pytest.skip("no tokenizer")
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows or name == "p1_unmatched"
    if name in queries.ORACLES:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for p in glob.glob(f"{sf}/*.parquet"):
            con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        out = con.sql(queries.ORACLES[name])
        place = [out.columns.index(c) for c in df.columns]
        assert Counter(map(tuple, rows)) == Counter(tuple(r[i] for i in place) for r in out.fetchall())
