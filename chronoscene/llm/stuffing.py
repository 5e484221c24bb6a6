"""Keyword-stuffed pages, link lists, product and tag lists among honest texts and honest lists.

A text is cut into sentences and into blocks of lines that are none. Each segment is measured: share of its most repeated
content word and of words that the whole page repeats, repeated word pairs, lines the page had before, link text,
separators, and function words. The limits of all but the link text are quantiles per language over the whole corpus. A
page is found if more than half of its characters lie in segments beyond them. There is no list of search words; only the
forms of the project's own lists are known.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoscene.llm.tokens import plain_lang

#: Function words per language.
FUNCTION_WORDS = {
    "en": "a an the of to in on at by with for from and or but that this these it its is are was were be been as not no so if who whose which while then after before because since until although though we you i he she they my his her our their your there than into onto off up out near me what when where how why has have had do does did would could can cannot under behind along across inside beside between during about both each every all any nobody somebody someone everybody one some more most very only also just here",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber in im an am auf aus bei mit nach von vor zu zum zur für ist sind war waren wird werden nicht kein keine sich es er sie wir ich man als wie dass weil bis ob wenn dann hat haben hatte hinter neben zwischen unter über ohne um nur noch schon auch mehr jeder jede alle niemand jemand diese dieser dieses daß während obwohl deshalb etwa entlang durch gegen kaum kurz beim vom",
    "es": "el la los las un una unos unas de del al y o u pero que en con por para sin se es son fue era no ni lo le les su sus mi como más muy ya hasta desde cuando porque si bajo sobre entre detrás junto hay ha han está este esta esto nadie alguien todos cada luego después mientras tanto aunque donde quien cerca dentro delante largo",
    "fr": "le la les l un une des de du d et ou mais que qu qui dans en sur sous par pour avec sans se s est sont était pas ne n il elle on nous vous je j ce c cette ces son sa ses leur au aux plus à y a ont jusqu jusque derrière devant entre près après avant pendant puis ensuite parce car si comme très tout tous toute chaque personne quelqu lorsque quand bien où long chez contre vers",
}
FUNCTION = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
ALL_FUNCTION = frozenset().union(*FUNCTION.values())
LINK = re.compile(r"<a\s[^>]*>|</a>|\(?(?:https?://|www\.)[^\s)\"'>|]+\)?|\(?\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/[^\s)\"'>|]*\)?")
SEPARATORS = (*"|•/;,·»>*#", " - ")
WORDS = re.compile(r"[^\W_]+")
SENTENCE_END = re.compile(r"[.!?…][\"')\]]*\s+")
#: Forms of the project's own lists: calls of programs, counted or numbered objects, times.
CALL = r"\b[\w ]{2,30}\s?\([A-Z](?:,\s?[\w ]+)?\)"
OTHER_HONEST = r"\w\s\(\d{1,3}\)(?=[,.;\s]|$)|\bid\s\d+|\b\d?\d:\d\d(?:[.:,]\d+)?|^\W*\w+ \(\d+\):"
HONEST, HONEST_BUT_CALLS = re.compile(f"{CALL}|{OTHER_HONEST}", re.M), re.compile(OTHER_HONEST, re.M)
#: What every link, every call and every other form has; these are cheaper to look for.
LINK_SIGN, CALL_SIGN, HONEST_SIGN = re.compile(r"<a\s|</a>|https?://|www\.|\.[a-z]{2,}/"), re.compile(r"\([A-Z]"), re.compile(r"\(\d|\bid\s\d|\d:\d\d")
#: Heads of inventories (``objects (14): ...``) and lines of credits (``Camera: baker 5``): whole lists without function words.
LISTED = re.compile(r"^\W*\w+ \(\d+\):|^\W*[\w ]{2,20}: [\w' -]+ \d+\W*$", re.M)

SEGMENT = "struct<chars:int,words:int,function:int,top:int,laced:int,pairs:int,link:int,separators:int,honest:int,form:boolean,again:int,sentence:boolean>"


def sentences(line: str) -> Iterator[str]:
    """The line divided behind the signs that end sentences, the space and closing marks between left out."""
    at = 0
    for m in SENTENCE_END.finditer(line):
        yield line[at : m.start() + 1]
        at = m.end()
    yield line[at:]


def split_segments(text: str) -> list[tuple[str, bool, int]]:
    """(segment, is it a sentence, characters in lines that the text had before): sentences of prose lines; other lines gathered into blocks."""
    out: list[tuple[str, bool, int]] = []
    block: list[str] = []
    seen: set[str] = set()
    block_again = 0
    for line in text.split("\n"):
        if not line or line.isspace():
            continue
        known = len(seen)
        seen.add(line.strip())
        again = len(seen) == known
        for part in sentences(line) if ". " in line or "! " in line or "? " in line else (line,):
            if not part:
                continue
            bare = part.rstrip(" \"')]*")
            if bare.endswith((".", "!", "?", "…")) and bare.count(" ") >= 2:
                if block:
                    out.append(("\n".join(block), False, block_again))
                    block, block_again = [], 0
                out.append((part, True, again * len(part)))
            else:
                block.append(part)
                block_again += again * len(part)
    if block:
        out.append(("\n".join(block), False, block_again))
    return out


def measure(segments: list[tuple[str, bool, int]], function: frozenset[str], least_count: int = 3, least_share: float = 0.03) -> list[tuple]:
    """The values of SEGMENT for the segments of a page.

    ``laced`` counts the words of a segment that the page repeats: content words seen ``least_count`` times and more, which
    are ``least_share`` of the page's words.
    """
    bodies = []
    for segment, _, _ in segments:
        bare = LINK.sub(" ", segment) if ("/" in segment or "www." in segment) and LINK_SIGN.search(segment) else segment
        bodies.append((bare, WORDS.findall(bare.lower())))
    page = {w: n for w, n in Counter(chain.from_iterable([words for _, words in bodies])).items() if len(w) > 2 and w not in ALL_FUNCTION}
    least = max(least_count, least_share * sum([len(words) for _, words in bodies]))
    often = {w for w, n in page.items() if n > 1}
    stuffed = {w for w in often if page[w] >= least} if least > 1 else page.keys()
    whole = "\n".join([bare for bare, _ in bodies])
    separators = [c for c in SEPARATORS if c in whole]
    out = []
    for (segment, sentence, again), (bare, words) in zip(segments, bodies, strict=True):
        chars = len(segment)
        # Only words that the page has twice can be repeated in a segment.
        known = list(filter(often.__contains__, words))
        if len(known) > 1 and len(kinds := set(known)) < len(known):
            top = max(map(known.count, kinds)) if len(kinds) < 20 else max(Counter(known).values())
        else:
            top = 1 if known or not page.keys().isdisjoint(words) else 0
        pairs = 0
        if top > 1:
            pairs = len(words) - 1 - len(set(zip(words, words[1:], strict=False)))
        laced = sum(map(stuffed.__contains__, known if least > 1 else words)) if stuffed else 0
        used = sum(map(function.__contains__, words))
        honest = 0
        if "(" in bare or ":" in bare or "id " in bare:
            calls = "(" in bare and CALL_SIGN.search(bare)
            if calls or HONEST_SIGN.search(bare):
                honest = sum(map(len, (HONEST if calls else HONEST_BUT_CALLS).findall(bare)))
        form = not sentence and ":" in bare and LISTED.search(bare) is not None
        out.append((chars, len(words), used, top, laced, pairs, chars - len(bare) if len(bare) < chars else 0, sum(map(bare.count, separators)), honest, form, again, sentence))
    return out


def segments(documents: DataFrame) -> DataFrame:
    """``(doc_id, lang, segments)`` of documents with text; one measured segment per sentence or block, whole texts."""

    names, kinds = zip(*[f.split(":") for f in SEGMENT[7:-1].split(",")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ends = [], [0]
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                function = FUNCTION.get(lang, ALL_FUNCTION)
                rows += measure(split_segments(text), function)
                ends.append(len(rows))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            arrays = [pa.array(c, pa.bool_() if k == "boolean" else pa.int32()) for c, k in zip(columns, kinds, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, list(names)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), lists], ["doc_id", "lang", "segments"])

    lean = documents.where("doc_id is not null and text is not null and length(trim(text)) > 0").select("doc_id", plain_lang(F.col("lang")).alias("lang"), "text")
    return lean.mapInArrow(run, f"doc_id long, lang string, segments array<{SEGMENT}>")


#: Stands for all languages together.
ALL = "*"


def calibrated(measured: DataFrame, support: int = 1000) -> DataFrame:
    """One row of limits per language, from the sentences and pages of the whole corpus.

    ``low_function``: the function-word share that nine of ten sentences reach; ``few_function``: half of it; ``much_top`` and
    ``much_laced``: the shares of the most repeated content word and of words that the page repeats that one sentence in fifty
    exceeds; ``much_pairs`` and
    ``much_marks``: repeated word pairs and separators per word that one sentence in two hundred and in fifty exceeds;
    ``much_again``: the share of repeated lines that one page in a hundred exceeds, at most a half. A language's quantiles count
    by the number of its sentences, those of all languages together as much as ``support`` sentences do, so that a few pages
    of a rare language don't set the limits for themselves.
    """
    of_each = F.explode(F.array(F.col("lang"), F.lit(ALL))).alias("lang")
    rows = measured.select(of_each, "segments").select("lang", F.inline("segments")).where("sentence and words >= 6")
    share = lambda c: F.col(c) / F.col("words")
    quantile = lambda c, q: F.percentile_approx(share(c), q, 1000)
    limits = rows.groupBy("lang").agg(
        F.count("*").alias("n"), quantile("function", 0.1).alias("low_function"), quantile("top", 0.98).alias("much_top"), quantile("laced", 0.98).alias("much_laced"),
        quantile("pairs", 0.995).alias("much_pairs"), quantile("separators", 0.98).alias("much_marks"),
    )
    pages = measured.select(of_each, repeated_share(F.col("segments")).alias("a")).groupBy("lang").agg(F.least(F.percentile_approx("a", 0.99, 1000), F.lit(0.5)).alias("much_again"))
    own = pages.join(limits, "lang", "left")
    names = ["low_function", "much_top", "much_laced", "much_pairs", "much_marks", "much_again"]
    # In one row, from which the corpus and the languages are taken, so that the quantiles are computed once.
    every = own.agg(F.collect_list(F.struct(*own.columns)).alias("every"))
    corpus = F.get(F.filter("every", lambda r: r["lang"] == ALL), F.lit(0)).alias("corpus")
    each = every.select(corpus, F.inline("every")).where(F.col("lang") != ALL)
    n = F.coalesce("n", F.lit(0))
    mixed = [((F.coalesce(F.col(c), F.col("corpus")[c]) * n + F.col("corpus")[c] * support) / (n + support)).alias(c) for c in names]
    return each.select("lang", *mixed).withColumn("few_function", F.col("low_function") / 2)


def _total(segments: Column, field: str) -> Column:
    return F.aggregate(segments, F.lit(0), lambda a, s: a + s[field])


def repeated_share(segments: Column) -> Column:
    """Share of a page's characters in lines that the page had before."""
    return _total(segments, "again") / F.greatest(_total(segments, "chars"), F.lit(1))


def spam_shares(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``(doc_id, lang, share, n_chars)``: the share of a page's characters in spam segments."""
    limit = lambda name, unknown: F.coalesce(name, F.lit(unknown))
    few, low, much_top, much_laced = limit("few_function", 0.15), limit("low_function", 0.3), limit("much_top", 0.2), limit("much_laced", 0.25)
    much_pairs, much_marks, much_again = limit("much_pairs", 0.25), limit("much_marks", 0.25), limit("much_again", 0.1)

    def spam(s):  # noqa: ANN001, ANN202
        share = lambda c: s[c] / F.greatest(s["words"], F.lit(1))
        own_list = (s["honest"] >= 0.1 * s["chars"]) | s["form"]
        again = (s["again"] >= 0.5 * s["chars"]) & (F.col("page_again") > much_again)
        wordy = s["words"] >= 8
        bare = wordy & (share("function") < few)
        paired = wordy & (s["pairs"] >= 3) & (share("pairs") > much_pairs)
        marked = (s["words"] >= 5) & (share("separators") > much_marks) & (share("function") < low)
        topped = (s["top"] >= 3) & (share("top") > much_top) & (s["sentence"] | ((s["top"] >= 4) & (share("function") <= low)))
        laced = wordy & (share("laced") > much_laced) & (share("function") < low)
        linked = ~s["sentence"] & (s["link"] >= 0.3 * s["chars"])
        return ~own_list & (again | bare | paired | marked | topped | laced | linked)

    rows = measured.join(F.broadcast(limits), "lang", "left").withColumn("page_again", repeated_share(F.col("segments")))
    n_chars = _total(F.col("segments"), "chars")
    return rows.select("doc_id", "lang", (_total(F.filter("segments", spam), "chars") / F.greatest(n_chars, F.lit(1))).alias("share"), n_chars.alias("n_chars"))


def stuffed_pages(measured: DataFrame, least_share: float = 0.5) -> DataFrame:
    """``doc_id`` of the pages more than ``least_share`` of whose characters are keyword stuffing, links, products or tags.

    ``measured`` comes from ``segments`` (materialize it; it is read twice). Documents with a null id, null, empty or blank
    text are never found; repeated texts are judged each for itself; texts of unknown language are held against the limits
    of their own group and the function words of all languages.
    """
    return spam_shares(measured, calibrated(measured)).where(F.col("share") > least_share).select("doc_id")
