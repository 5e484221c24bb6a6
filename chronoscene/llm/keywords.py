"""Mapping of freely typed values to a reference list by a prefix-filter set-similarity join.

A value is normalized in the JVM and compared with the forms of the entries (term, alias, inflection) by a similarity join on
sets of letter pairs: the tokens are ordered by their rarity in the reference list, only the rare prefixes are joined, pairs
pass the length and the positional filter, and Jaccard is computed exactly. Of the candidates within a few edits the one of
highest Jaccard is kept. The threshold follows from the edits: no pair within them is below it. Words that may stand in
front of a value without changing what it means are learnt: they stand in front of several entries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from chronoscene.storage import materialized

#: Letters of other alphabets and digits that look like Latin letters, and accented letters.
LOOKALIKES = ("абвеёкмнорстухіїјѕԁɡοαερκτυνıøłđß", "a6beekmhopctyxiijsdgoaepktuvioldb")
ACCENTS = ("àáâãäåāçćčèéêëēìíîïīñńòóôõöōùúûüūýÿž", "aaaaaaaccceeeeeiiiiinnoooooouuuuuyyz")
#: English function words that may stand in front of any keyword; other such words are learnt.
ARTICLES = "a an the this that some any one her his its their my our is are was be being still".split()
#: What is written where nothing is meant.
FILLERS = ("", "none", "null", "nan", "n/a", "na", "unknown", "todo", "tbd", "other", "misc", "thing", "something")

def normalized(value: Column) -> Column:
    """Lower-case words without outer marks, numbering and variables; '' for null and blank."""
    t = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\u200b-\u200f\u2060\ufeff\u00ad\u0300-\u036f]", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\)]+$", "")
    t = F.regexp_replace(t, r"([\s_-]*(\(\p{L}\)|#\d+)|[\s_-]+(\d+|[A-Ha-c]))+$", "")
    t = F.translate(F.translate(F.lower(t), *LOOKALIKES), *ACCENTS)
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=[a-z])0|0(?=[a-z])", "o"), r"(?<=[a-z])1|1(?=[a-z])", "l")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def suffixes(values: DataFrame, most: int = 3) -> DataFrame:
    """``(kind, value, cut, first, second, third, key)``: the normalized value without its first ``cut`` words, 0 to ``most``."""
    words = values.select("kind", "value", F.split(normalized(F.col("value")), " ").alias("w"))
    rows = words.select("kind", "value", "w", F.explode(F.sequence(F.lit(0), F.least(F.size("w") - 1, F.lit(most)))).alias("cut"))
    word = lambda i: F.when(F.col("cut") > i, F.get("w", F.lit(i)))
    return rows.select("kind", "value", "cut", word(0).alias("first"), word(1).alias("second"), word(2).alias("third"), F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ").alias("key"))


def lead_words(cut: DataFrame, forms: DataFrame, least_entries: int = 3) -> DataFrame:
    """``(word)``: what stands in front of forms of at least ``least_entries`` different entries among the distinct values."""
    known = cut.where("cut = 1").join(forms.select("kind", F.col("form").alias("key"), "term_id"), ["kind", "key"])
    return known.groupBy(F.col("first").alias("word")).agg(F.count_distinct("term_id").alias("n")).where(F.col("n") >= least_entries).select("word")


def meant_keys(values: DataFrame, forms: DataFrame) -> DataFrame:
    """``(kind, value, key)``: each value whole, and without its leading words as far as these are function words or ``lead_words`` and three letters stay."""
    cut = suffixes(values)
    leads = lead_words(cut, forms)
    for c in ("first", "second", "third"):
        cut = cut.join(leads.select(F.col("word").alias(c), F.lit(True).alias(f"is_{c}")), c, "left")
    led = [F.col(c).isNull() | F.col(c).isin(*ARTICLES) | F.col(f"is_{c}").isNotNull() for c in ("first", "second", "third")]
    return cut.where(led[0] & led[1] & led[2] & ((F.col("cut") == 0) | (F.length("key") >= 3))).select("kind", "value", "key")


#: Irregular past forms of English verbs.
PAST = {
    "run": "ran", "swim": "swam", "sleep": "slept", "kneel": "knelt", "hold": "held", "throw": "threw", "stand": "stood", "sit": "sat", "feed": "fed", "hide": "hid",
    "drink": "drank", "overtake": "overtook", "give": "gave", "take": "took", "ride": "rode", "drive": "drove", "fall": "fell", "fly": "flew", "eat": "ate",
    "write": "wrote", "read": "read", "sing": "sang", "speak": "spoke", "break": "broke", "catch": "caught", "bring": "brought", "buy": "bought", "lie": "lay",
    "shake": "shook", "wear": "wore", "blow": "blew", "draw": "drew", "fight": "fought", "leave": "left", "lead": "led", "bend": "bent", "cut": "cut", "hit": "hit",
    "dig": "dug", "hang": "hung", "swing": "swung", "sweep": "swept", "weep": "wept", "creep": "crept", "leap": "leapt", "lean": "leant", "wake": "woke", "steal": "stole",
}


def inflections(term: str, kind: str) -> set[str]:
    """Forms under which a term may be written: plural of the last word; bare and third-person form of an -ing word."""
    words = term.split(" ")
    out = {term}
    if kind == "entity":
        last = words[-1]
        plural = (
            last[:-3] + "men" if last.endswith("man")
            else last[:-5] + "children" if last.endswith("child")
            else last[:-1] + "ies" if re.search("[^aeiou]y$", last)
            else last[:-2] + "ves" if last.endswith("fe")
            else last[:-1] + "ves" if re.search("[lr]f$", last)
            else last + "es" if re.search("(s|x|z|ch|sh)$", last)
            else last + "s"
        )
        out.add(" ".join([*words[:-1], plural]))
        if last.endswith("s") and not last.endswith("ss"):
            out.add(" ".join([*words[:-1], last[:-1]]))
    for i, w in enumerate(words):
        if w.endswith("ing") and len(w) > 5:
            stem = w[:-3]
            bases = {stem, stem + "e"} | ({stem[:-1]} if len(stem) > 2 and stem[-1] == stem[-2] else set())
            for b in bases:
                third = b[:-1] + "ies" if re.search("[^aeiou]y$", b) else b + "es" if re.search("(s|x|z|ch|sh|o)$", b) else b + "s"
                for form in (b, third, PAST.get(b, b + "d" if b.endswith("e") else (stem if b == stem[:-1] else b) + "ed")):
                    out.add(" ".join([*words[:i], form, *words[i + 1 :]]))
    return out


def forms_of(vocabulary: DataFrame) -> DataFrame:
    """``(kind, form, term_id, rank)``: every form an entry may take; of entries with the same form the lowest rank and id wins."""
    make = F.udf(lambda t, k: sorted(inflections(t, k)), "array<string>")
    named = vocabulary.select("term_id", "kind", F.explode(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name is not null")
    spelled = named.select("term_id", "kind", normalized(F.col("name")).alias("name")).where("name <> ''")
    rows = spelled.select("term_id", "kind", "name", F.explode(make("name", "kind")).alias("form"))
    return rows.groupBy("kind", "form").agg(F.min(F.struct((F.col("name") != F.col("form")).cast("int").alias("rank"), "term_id")).alias("m")).select("kind", "form", "m.term_id", "m.rank")


def letter_pairs(text: Column) -> Column:
    """Set of padded letter pairs; the n-th occurrence of a pair is a token of its own."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    nth = lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, 1, i + 1), lambda q: q == p)).cast("string"))
    return F.transform(pairs, nth)


#: Edits allowed up to a length of the form, and beyond.
EDITS = ((4, 1), (9, 2), (None, 3))


def allowed_edits(length: Column) -> Column:
    (short, few), (middle, some), (_, many) = EDITS
    return F.when(length <= short, few).when(length <= middle, some).otherwise(many)


def least_similarity(shortest: int = 2) -> float:
    """Lowest Jaccard of letter-pair sets that a form of ``shortest`` letters or more has with a text within its allowed edits.

    A form of n letters has n + 1 pairs; an edit takes at most two of them away and brings at most two others.
    """
    worst, low = 1.0, shortest
    for top, edits in EDITS:
        n = low + 1  # the shortest form that is allowed so many edits
        worst, low = min(worst, (n - 2 * edits) / (n + 2 * edits)), (top or 0) + 1
    return worst


SIMILARITY = least_similarity()


def similarity_join(values: DataFrame, forms: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Best form for each ``(kind, key)`` of ``values``: ``(kind, key, term_id, jaccard, edits)``, no row without one.

    All pairs with Jaccard of their letter-pair sets of at least ``threshold`` are found. Token order: rarity among the
    forms, then the token. The reference side (forms with their prefixes) is small by its nature but joined by Spark's own
    choice: it is broadcast only under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    rarity = forms.select(F.explode(letter_pairs(F.col("form"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def ranked(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
        tokens = df.select(*keys, F.explode(letter_pairs(F.col(text))).alias("token")).join(rarity, "token", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")))
        return tokens.groupBy(*keys).agg(F.transform(order, lambda t: t["token"]).alias("tokens"))

    def prefixes(df: DataFrame) -> DataFrame:
        keep = F.size("tokens") - F.ceil(F.size("tokens") * F.lit(threshold)).cast("int") + 1
        return df.withColumn("size", F.size("tokens")).select("*", F.posexplode(F.slice("tokens", F.lit(1), keep)).alias("at", "token"))

    # A set of m tokens is like none of n tokens if n < threshold * m: values too long for every form never become tokens.
    longest = forms.agg(F.coalesce(F.max(F.length("form")), F.lit(0)).alias("longest"))
    fitting = values.crossJoin(F.broadcast(longest)).where((F.length("key") + 1) * threshold <= F.col("longest") + 1).drop("longest")
    left = prefixes(ranked(fitting, "key", ["kind", "key"])).withColumnsRenamed({"at": "i", "size": "m", "tokens": "x"})
    right = prefixes(ranked(forms, "form", ["kind", "form", "term_id", "rank"])).withColumnsRenamed({"at": "j", "size": "n", "tokens": "y"})
    t = F.lit(threshold)
    need = F.ceil(t / (1 + t) * (F.col("m") + F.col("n")))
    pairs = left.join(right, ["kind", "token"]).where(
        (F.col("n") >= t * F.col("m")) & (F.col("m") >= t * F.col("n"))
        & (F.array_position("y", F.col("token")) > 0)
        & (1 + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) - 1 + F.least("i", "j") >= need)
        # A pair that shares several prefix tokens is kept at the first of them only.
        & (F.size(F.array_intersect(F.slice("x", F.lit(1), F.col("i")), F.slice("y", F.lit(1), F.col("j")))) == 0)
    )
    both = F.size(F.array_intersect("x", "y"))
    scored = pairs.select("kind", "key", "form", "term_id", "rank", (both / (F.col("m") + F.col("n") - both)).alias("jaccard"), F.levenshtein("key", "form").alias("edits"))
    good = scored.where((F.col("jaccard") >= threshold) & (F.col("edits") <= allowed_edits(F.length("form")) - F.col("rank")))
    best = F.min(F.struct((-F.col("jaccard")).alias("far"), "edits", "rank", "term_id", "form"))
    return good.groupBy("kind", "key").agg(best.alias("b")).select("kind", "key", "b.term_id", (-F.col("b.far")).alias("jaccard"), "b.edits", "b.form")


def map_values(values: DataFrame, vocabulary: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``(kind, value, term_id)`` for each distinct ``(kind, value)``; ``term_id`` -1 if no entry is meant.

    Nulls, blanks and filler words map to -1. An empty reference list maps all to -1. Ties go to higher Jaccard, fewer edits,
    terms before inflections, and the smaller ``term_id``. Repeated values are mapped once.
    """
    forms = materialized(forms_of(vocabulary))
    distinct = values.select("kind", "value").distinct()
    spelled = materialized(meant_keys(distinct, forms))
    keys = spelled.select("kind", "key").distinct().where(~F.col("key").isin(*FILLERS))
    found = similarity_join(keys, forms, threshold)
    best = spelled.join(found, ["kind", "key"], "left").groupBy("kind", "value").agg(F.min(F.when(F.col("term_id").isNotNull(), F.struct((-F.col("jaccard")).alias("far"), "edits", "term_id"))).alias("m"))
    return best.select("kind", "value", F.coalesce("m.term_id", F.lit(-1)).cast("long").alias("term_id"))


FIELDS = {"consts": "entity", "unary_kws": "unary", "binary_kws": "binary"}


def keyword_elements(specs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(spec_id, field, pos, kind, value)`` of all non-null elements that equal no term of their kind."""
    def typed(field: str, kind: str) -> Column:
        values = F.coalesce(F.col(field), F.array().cast("array<string>"))
        return F.transform(values, lambda v, i: F.struct(F.lit(field).alias("field"), i.alias("pos"), F.lit(kind).alias("kind"), v.alias("value")))

    rows = F.array(*[typed(f, k) for f, k in FIELDS.items()])
    elements = specs.select("spec_id", F.inline(F.flatten(rows))).where("value is not null")
    terms = vocabulary.select("kind", F.col("term").alias("value")).distinct()
    return elements.join(terms, ["kind", "value"], "left_anti")
