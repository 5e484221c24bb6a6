"""Probabilities from the k most likely proofs.

A proof is a set of facts; its probability is the product over the set. The k best proofs of a formula are combined by
inclusion and exclusion over unions of their fact sets, at most 2^k - 1 terms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoscene.operators.rangescan import running_best


def union_probability(proofs: Column, k: int) -> Column:
    """Probability that one of up to ``k`` proofs holds; ``proofs`` is array<struct<facts array<struct<id, p>>>>."""
    n = F.size(proofs)
    terms = []
    for mask in range(1, 1 << k):
        chosen = [i for i in range(k) if mask >> i & 1]
        facts = F.array_distinct(F.flatten(F.array(*[F.get(proofs, F.lit(i))["facts"] for i in chosen])))
        ids = F.transform(facts, lambda f: f["id"])
        against = F.arrays_overlap(F.transform(ids, lambda i: F.concat(F.lit("!"), i)), ids)  # a fact with its negation
        product = F.when(against, 0.0).otherwise(F.aggregate(facts, F.lit(1.0), lambda acc, f: acc * f["p"]))
        sign = 1.0 if len(chosen) % 2 else -1.0
        terms.append(F.when(n > max(chosen), F.lit(sign) * product).otherwise(0.0))
    return sum(terms[1:], terms[0])


def chain_proofs(unary: DataFrame, first: str, second: str, k: int = 3) -> DataFrame:
    """``(video_id, prob)``: some object has ``first`` at a frame and some object ``second`` at a later one.

    Proofs are pairs of such facts; only the k best facts of a frame and the k best before it can be in the k best pairs, so
    no frame meets more than k earlier facts. Ties are broken by the facts' keys. The last frame is outside the time domain.
    """
    top = unary.groupBy("video_id").agg(F.max("fid").alias("m"))
    facts = unary.join(top, "video_id").where("fid < m").where(F.col("predicate").isin(first, second))
    fact = F.struct((-F.col("prob")).alias("o"), F.concat_ws("/", "predicate", "fid", "oid").alias("id"), F.col("prob").alias("p"))
    best = lambda c: F.slice(F.array_sort(c), 1, k)
    per = facts.groupBy("video_id", "fid").agg(
        best(F.collect_list(F.when(F.col("predicate") == first, fact))).alias("a"), best(F.collect_list(F.when(F.col("predicate") == second, fact))).alias("b")
    )
    seen = running_best(per.withColumn("_key", F.col("video_id").cast("string")), "_key", ["fid"], "a", k, "before")
    pairs = seen.withColumn("a", F.col("before")).where("size(a) > 0 and size(b) > 0")
    crossed = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.struct((-(x["p"] * y["p"])).alias("o"), F.concat_ws("+", x["id"], y["id"]).alias("id"), F.array(F.struct(x["id"].alias("id"), x["p"].alias("p")), F.struct(y["id"].alias("id"), y["p"].alias("p"))).alias("facts")))))
    rows = pairs.select("video_id", F.explode(best(crossed)).alias("q"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("q.o", "q.id"))).where(F.col("n") <= k)
    lists = ranked.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("q.facts").alias("facts")))), lambda s: F.struct(s["facts"].alias("facts"))).alias("proofs"))
    return lists.select("video_id", union_probability(F.col("proofs"), k).alias("prob"))


FACTS = "array<struct<id:string,p:double>>"


def _item(facts: Column) -> Column:
    """struct(o, id, facts) of a set of facts: it sorts by probability, the likeliest first, then by its text."""
    ordered = F.array_sort(F.array_distinct(facts))
    return F.struct((-F.aggregate(ordered, F.lit(1.0), lambda acc, f: acc * f["p"])).alias("o"), F.array_join(F.transform(ordered, lambda f: f["id"]), "+").alias("id"), ordered.alias("facts"))


def _possible(item: Column) -> Column:
    """No fact together with its negation, and none that can't be."""
    ids = F.transform(item["facts"], lambda f: f["id"])
    return (item["o"] < 0) & ~F.arrays_overlap(F.transform(ids, lambda i: F.concat(F.lit("!"), i)), ids)


def _crossed(k: int, *lists: Column) -> Column:
    """The ``k`` likeliest unions of one proof of each list."""
    def united(some: Column, other: Column) -> Column:
        both = F.flatten(F.transform(some, lambda x: F.transform(other, lambda y: _item(F.concat(x["facts"], y["facts"])))))
        return F.slice(F.array_sort(F.array_distinct(F.filter(both, _possible))), 1, k)

    return reduce(united, lists)


def event_proofs(scene, event: object, k: int) -> tuple[DataFrame, list[int]]:  # noqa: ANN001
    """``(video_id, t, v…, items)`` and the variables of an event: its ``k`` likeliest proofs at a frame under an assignment.

    A proof is a set of facts ``(id, p)``. A constant adds the fact that its object has that name; a negated atom adds the
    negation of a fact that is there, with the rest of its probability, and nothing where there is no such fact.
    """
    from chronoscene.plans import stsl

    atoms = sorted(stsl.atoms_of(event), key=lambda a: not isinstance(a, (stsl.Unary, stsl.Binary)))
    acc: DataFrame | None = None
    known: list[int] = []
    fact = lambda sign, p, *parts: F.struct(F.concat(F.lit(sign), F.concat_ws("/", *parts)).alias("id"), p.alias("p"))
    for n, a in enumerate(atoms):
        terms = stsl.terms_of(a)
        own = sorted({t.id for t in terms if isinstance(t, stsl.Var)})
        positive = isinstance(a, (stsl.Unary, stsl.Binary))
        if not positive:
            if acc is None:
                acc = scene.time.select("video_id", "t").withColumn("facts", F.expr(f"cast(array() as {FACTS})"))
            for v in own:
                if v not in known:
                    acc = acc.join(scene.objects.select("video_id", F.col("oid").alias(f"v{v}")), "video_id")
                    known.append(v)
            if isinstance(a, stsl.Neq):
                if len(own) < len(terms):
                    raise ValueError("an inequality with a constant has no probability here")
                acc = acc.where(F.col(f"v{terms[0].id}") != F.col(f"v{terms[1].id}"))
                continue
        unary = isinstance(a, (stsl.Unary, stsl.NegUnary))
        sides = ["oid"] if unary else ["o1", "o2"]
        hits = (scene.unary if unary else scene.binary).where(F.col("predicate") == a.predicate).select("video_id", F.col("fid").alias("t"), *sides, fact("" if positive else "!", F.col("prob") if positive else 1 - F.col("prob"), "predicate", "fid", *sides).alias("f"))
        extra = []
        for t, s in zip(terms, sides, strict=True):
            if isinstance(t, stsl.Const):
                if not positive:
                    raise ValueError("a negated atom with a constant has no probability here")
                named = scene.names.where(F.col("cid") == t.id).select("video_id", F.col("oid").alias(s), fact("", F.col("prob"), F.lit("name"), "oid", "cid").alias(f"name_{s}"))
                hits = hits.join(named, ["video_id", s]).drop(s)
                extra.append(F.col(f"name_{s}"))
            elif f"v{t.id}" in hits.columns:
                hits = hits.where(F.col(s) == F.col(f"v{t.id}")).drop(s)
            else:
                hits = hits.withColumnRenamed(s, f"v{t.id}")
        hits = hits.withColumn("more", F.array("f", *extra)).drop("f", *[f"name_{s}" for s in sides])
        if acc is None:
            acc = hits.withColumnRenamed("more", "facts")
        else:
            keys = ["video_id", "t", *[f"v{v}" for v in own if v in known]]
            acc = acc.join(hits, keys, "inner" if positive else "left").withColumn("facts", F.concat("facts", F.coalesce("more", F.expr(f"cast(array() as {FACTS})")))).drop("more")
        known += [v for v in own if v not in known]
    inside = acc.join(scene.time.select("video_id", "t"), ["video_id", "t"], "left_semi").withColumn("item", _item(F.col("facts"))).where(_possible(F.col("item")))
    columns = ["video_id", "t", *[f"v{v}" for v in sorted(known)]]
    w = Window.partitionBy(*columns).orderBy("item.o", "item.id")
    best = inside.select(*columns, "item").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return best.groupBy(*columns).agg(F.array_sort(F.collect_list("item")).alias("items")), sorted(known)


def _carried(asking: DataFrame, giving: DataFrame, shared: list[str], k: int, later: bool) -> DataFrame:
    """Adds ``best`` to ``asking (video_id, t, v…)``: the ``k`` likeliest ``items`` of ``giving`` that agree on ``shared`` and lie later (or earlier)."""
    key = F.concat_ws("|", F.col("video_id").cast("string"), *[F.col(c).cast("string") for c in shared])
    time = -F.col("t") if later else F.col("t")
    none = F.array().cast(giving.schema["items"].dataType)
    per = giving.groupBy(key.alias("_key"), time.alias("_t")).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))), 1, k).alias("_give"))
    asked = asking.select(key.alias("_key"), time.alias("_t")).distinct()
    # At equal times the asking row comes first, so it sees only rows strictly later (or earlier).
    rows = asked.select("_key", "_t", F.lit(0).alias("_giving"), none.alias("_give")).union(per.select("_key", "_t", F.lit(1), "_give"))
    seen = running_best(rows, "_key", ["_t", "_giving"], "_give", k, "best").where("_giving = 0 and size(best) > 0").select("_key", "_t", "best")
    return asking.withColumns({"_key": key, "_t": time}).join(seen, ["_key", "_t"]).drop("_key", "_t")


def event_probabilities(scene, events: list, k: int = 3) -> DataFrame:  # noqa: ANN001
    """``(video_id, event_no, t, prob)``: how likely each of one to three events takes place at t, in order with the others.

    The probability of the ``k`` likeliest proofs together, by inclusion and exclusion; proofs are cut to ``k`` at every
    step. Facts need ``prob``; those of no probability give nothing. A proof of the chain unites proofs of its
    events at t1 < t2 < t3 under one assignment.
    """
    made = [event_proofs(scene, e, k) for e in events]
    rows, own = [m[0] for m in made], [m[1] for m in made]
    n = len(events)
    if not 1 <= n <= 3:
        raise ValueError("one to three events; cut longer programs into windows")
    name = lambda vs: [f"v{v}" for v in vs]
    outer = sorted((set(own[0]) & set(own[2])) - set(own[1])) if n == 3 else []
    if outer:  # a variable that only the outer events share is carried by the middle one
        rows[1] = rows[1].join(rows[0].select("video_id", *name(outer)).distinct(), "video_id")
        own[1] = sorted({*own[1], *outer})
    shared = [name(sorted(set(own[i]) & set(own[i + 1]))) for i in range(n - 1)]
    total = [r.withColumn("_all", F.col("items")) for r in rows]
    ahead, behind = rows[n - 1], rows[0]
    for i in range(n - 2, -1, -1):
        joined = _carried(rows[i], ahead, shared[i], k, later=True)
        ahead = joined.withColumn("items", _crossed(k, F.col("items"), F.col("best"))).drop("best").where("size(items) > 0")
        total[i] = ahead.withColumn("_all", F.col("items"))
    for i in range(1, n):
        joined = _carried(rows[i], behind, shared[i - 1], k, later=False)
        behind = joined.withColumn("items", _crossed(k, F.col("items"), F.col("best"))).drop("best").where("size(items) > 0")
        if i == n - 1:
            total[i] = behind.withColumn("_all", F.col("items"))
        else:
            both = _carried(behind, rows[n - 1], shared[i], k, later=True)
            total[i] = both.withColumn("_all", _crossed(k, F.col("items"), F.col("best"))).drop("best")
    out = None
    for i, part in enumerate(total):
        at = part.select("video_id", "t", F.explode("_all").alias("item")).distinct()
        ranked = at.withColumn("_n", F.row_number().over(Window.partitionBy("video_id", "t").orderBy("item.o", "item.id"))).where(F.col("_n") <= k)
        lists = ranked.groupBy("video_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("item.facts").alias("facts")))), lambda s: F.struct(s["facts"].alias("facts"))).alias("proofs"))
        rows_i = lists.select("video_id", F.lit(i + 1).alias("event_no"), "t", union_probability(F.col("proofs"), k).alias("prob"))
        out = rows_i if out is None else out.union(rows_i)
    return out
