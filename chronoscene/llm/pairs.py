"""Defects of prompt and response pairs.

Copies: containment of the prompt's shingles in the response chooses candidates, the longest common subsequence of both
decides by the share it matches and by where the rest stands. As a copy may be divided anew within words, tokens are
joined and shingles and alignment run over letters. Refusals: the opening of the response is aligned with refusal
templates, and the response as a whole may repeat little of the prompt. Broken-off answers end in no way
in which finished parts of the corpus end, or leave brackets open. The language of prompt and response is told by letter
triples counted over the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chronoscene.storage import materialized

#: Core phrases of refusals in the languages of the corpus.
REFUSALS = [
    "i am unable to", "i'm unable to", "i can't", "i cannot", "i can not", "i could not", "i couldn't", "i won't", "i will not", "i must decline", "i have to decline", "i don't have access", "i do not have access",
    "i'm not able to", "i am not able to", "go against my guidelines", "against my policy", "no description can be provided", "not enough information for me to answer", "i'm sorry but", "i am sorry but", "as an ai", "i refuse to",
    "kann ich nicht", "ich kann nicht", "ich kann die ereignisse nicht", "kann ich diese anfrage nicht beantworten", "darf ich keine auskunft geben", "ich darf nicht", "muss ich ablehnen", "ich muss ablehnen", "muss diese anfrage ablehnen",
    "nicht möglich beziehungen zu", "ist es mir nicht möglich", "ist mir nicht möglich", "es tut mir leid", "ich habe keinen zugriff", "habe ich keinen zugriff", "leider kann ich", "leider muss ich",
    "no puedo describir", "no puedo responder", "no puedo ayudar", "no puedo", "debo rechazar", "tengo que rechazar", "no tengo acceso", "no me es posible", "lo siento pero", "no estoy autorizado", "no se me permite",
    "je ne peux pas", "je ne puis", "je dois refuser", "je dois décliner", "je n'ai pas accès", "il m'est impossible", "je regrette", "je suis désolé", "désolé mais", "je ne suis pas autorisé", "je ne suis pas en mesure",
]
BLANKS = {"", "na", "none", "null", "nil", "empty", "todo", "tbd", "nan", "undefined", "unknown"}
LANGUAGES = ("en", "de", "es", "fr")
LETTERS = "a-zà-öø-ÿœ"
WORD = re.compile(rf"[{LETTERS}0-9]+(?:['’][{LETTERS}]+)*")

_TEMPLATES = [WORD.findall(t) for t in REFUSALS]
_STARTS: dict[tuple[str, str], list[list[str]]] = {}
for _t in _TEMPLATES:
    for _pair in zip(_t, _t[1:], strict=False):
        _STARTS.setdefault(_pair, []).append(_t)


def lcs(a: list[str] | str, b: list[str] | str) -> int:
    """Length of the longest common subsequence of two lists of tokens or two texts, by bit-parallel dynamic programming."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = at.get(y, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def shingles(text: str, n: int = 5) -> set[str]:
    """Runs of ``n`` letters of a text, or the whole of a shorter one."""
    return {text[i : i + n] for i in range(max(len(text) - n + 1, 1))} if text else set()


def tokens_of(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("’", "'"))


def is_empty(text: str) -> bool:
    return re.sub(r"[\W_]+", "", text.lower()) in BLANKS


def lead_tokens(tokens: list[str], letters: int) -> int:
    """How many tokens lie, at least in part, within the first ``letters`` letters."""
    n = 0
    while letters > 0 and n < len(tokens):
        letters -= len(tokens[n])
        n += 1
    return n


def is_copy(prompt: list[str], response: list[str], label: int = 6, contained: float = 0.8, aligned: float = 0.97) -> bool:
    """The prompt again, wherever it is divided, behind a label of at most ``label`` tokens.

    Candidates hold ``contained`` of the prompt's letter shingles. They are copies if a common subsequence matches
    ``aligned`` of the prompt's letters within the end of the response that is as long (and that share longer), so that
    all that doesn't match but a few letters stands in front, where only the label may be.
    """
    flat, whole = "".join(prompt), "".join(response)
    n = len(flat)
    if not n or len(whole) < aligned * n:
        return False
    of = shingles(flat)
    if len(of & shingles(whole)) < contained * len(of):
        return False
    front = len(whole) - n
    if lead_tokens(response, front) > label:
        return False
    return lcs(flat, whole[max(front - int((1 - aligned) * n), 0) :]) >= aligned * n


def is_refusal(tokens: list[str], prompt: list[str], opening: int = 8, repeated: float = 0.34) -> bool:
    """A template's tokens are a subsequence of as many tokens plus two that begin among the first ``opening``, and less than
    ``repeated`` of the response's tokens are the prompt's: who refuses to answer doesn't tell what was asked, as quoted speech does."""
    for i, pair in enumerate(zip(tokens[: opening + 12], tokens[1 : opening + 13], strict=False)):
        for t in _STARTS.get(pair, ()):
            low = max(i - len(t), 0)
            if low <= opening and lcs(t, tokens[low : i + len(t) + 2]) == len(t):
                own = set(prompt)
                return sum(x in own for x in tokens) < repeated * len(tokens)
    return False


def trailing(text: str) -> str:
    return text.rstrip(" \t\n​\"'”»")


def program_broken(clauses: list[str]) -> bool:
    """The last clause has no closed argument list, or some clause leaves a bracket open."""
    last = trailing(clauses[-1]).rstrip(".;")
    return not last.endswith(")") or any(c.count("(") > c.count(")") for c in clauses)


#: What stands for an ending that no finished answer has.
BROKEN = "\u0000"


def sentence_ending(text: str) -> str:
    """The last two words of a part of an answer, '' if it ends with the variable of a second object (finished), or BROKEN."""
    t = trailing(text)
    if re.search(r"(\.\.+|[,;:(\-–—…/&+])$", t) or t.count("(") > t.count(")"):
        return BROKEN
    t = t.rstrip(".!?) ")
    words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*", re.split(r"[,;]\s", t)[-1])
    if not words:
        return BROKEN
    if re.fullmatch("[A-Z]", words[-1]):
        return "" if sum(bool(re.fullmatch("[A-Z]", w)) for w in words) >= 2 else BROKEN
    return " ".join(words[-2:]).lower()


def triples(words: Column) -> Column:
    """Padded letter triples of an array of words."""
    padded = F.transform(words, lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3)))))


def words_of(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"([{LETTERS}]+)"), F.lit(1)), lambda w: F.length(w) > 1)


def language_model(labelled: DataFrame) -> dict[str, list[float]]:
    """Log shares per language of each letter triple of ``(lang, text)``, counted over all rows.

    The triples are over a fixed alphabet of 57 letters and the two word ends, so there are at most 59**3 of them,
    whatever the corpus; only these counts come to the driver.
    """
    rows = labelled.where(F.col("lang").isin(*LANGUAGES)).select("lang", F.explode(triples(words_of(F.col("text")))).alias("g"))
    table = rows.groupBy("g").pivot("lang", list(LANGUAGES)).count().na.fill(0).collect()
    total = {lang: sum(r[lang] for r in table) + 0.5 * (len(table) + 1) for lang in LANGUAGES}
    model = {r.g: [math.log((r[lang] + 0.5) / total[lang]) for lang in LANGUAGES] for r in table}
    model[""] = [math.log(0.5 / total[lang]) for lang in LANGUAGES]
    return model


def language_scores(text: str, model: dict[str, list[float]], cache: dict[str, np.ndarray]) -> np.ndarray:
    """Sum of log shares per language over the words of two letters and more."""
    out = np.zeros(len(LANGUAGES))
    for w in re.findall(f"[{LETTERS}]+", text.lower()):
        if len(w) > 1:
            score = cache.get(w)
            if score is None:
                p, unseen = f"^{w}$", model.get("", [0.0] * len(LANGUAGES))
                score = np.sum([model.get(p[i : i + 3], unseen) for i in range(len(p) - 2)], axis=0)
                if len(cache) < 200_000:
                    cache[w] = score
            out += score
    return out


#: Fixed value: the predicate that only binds a variable to its noun; it is syntax, not a word of the program's language.
BINDING = r"\bname\s*\("


def other_language(prompt: str | None, response: str, model: dict[str, list[float]], cache: dict[str, np.ndarray], margin: float) -> bool:
    """The response's language is clearly not the prompt's; without a prompt text, not English."""
    r = language_scores(response, model, cache)
    if not r.any():
        return False
    own = int(np.argmax(language_scores(prompt, model, cache))) if prompt is not None else 0
    return bool(r.max() - r[own] > margin)


def defect_of(prompt: list[str], answer: list[str] | None, program: bool, model: dict, cache: dict, margin: float) -> tuple[str | None, str]:
    """(defect, ending): the defect told from the pair alone, and the ending to be looked up among the finished ones."""
    parts = [a for a in ([] if answer is None else answer) if a is not None and a.strip()]
    whole = " ".join(parts)
    if is_empty(whole):
        return "empty", ""
    parts = [p for p in parts if re.search(r"\w", p)]
    p, r = tokens_of(" ".join(prompt)), tokens_of(whole)
    if is_copy(p, r):
        return "copy", ""
    if is_refusal(r, p):
        return "refusal", ""
    ending = ""
    if program:
        if program_broken(parts):
            return "truncated", ""
    else:
        ending = sentence_ending(parts[-1])
        if ending == BROKEN:
            return "truncated", ""
    spoken = re.sub(BINDING, "(", whole) if program else whole
    if other_language(None if program else " ".join(prompt), spoken, model, cache, margin):
        return "language", ending
    return None, ending


def finished_endings(counts: DataFrame, least_seen: int = 3, rare_share: float = 0.05, least_share: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """``(ending, known)`` and ``(word, backed)`` of the counted endings ``(ending, n)`` of finished parts.

    An ending seen ``least_seen`` times, and in ``least_share`` of what ends with its last word, is known. Where the corpus is too small to have seen a last word's endings, that is
    where endings seen less often make up ``rare_share`` or more of all that finish with the word, the word alone decides.
    """
    some = counts.where(~F.col("ending").isin("", BROKEN))
    word = F.substring_index("ending", " ", -1).alias("word")
    rare = F.sum(F.when(F.col("n") < least_seen, F.col("n")).otherwise(0)) / F.sum("n")
    backed = some.groupBy(word).agg(rare.alias("rare")).where(F.col("rare") >= rare_share).select("word", F.lit(True).alias("backed"))
    totals = some.withColumn("word", word).groupBy("word").agg(F.sum("n").alias("all"))
    seen = some.withColumn("word", word).join(totals, "word").where((F.col("n") >= least_seen) & (F.col("n") >= least_share * F.col("all")))
    return seen.select("ending", F.lit(True).alias("known")), backed


def defective_pairs(pairs: DataFrame, labelled: DataFrame, least_seen: int = 3, margin: float = 0.5) -> DataFrame:
    """``(pair_level, pair_id, defect)`` of the defective among ``pairs (pair_level, pair_id, prompt, answer)``.

    ``prompt`` and ``answer`` are arrays of texts; ``pair_level`` 'event' marks answers that are programs, whose right
    language is English. Pairs with a null prompt are left out. An answer without content (null, no elements, blanks, marks
    or filler words only) is ``empty``; then ``copy``, ``refusal``, ``truncated`` and ``language`` are tried in that order, so
    a pair has at most one defect. Repeated pairs are judged each for itself. ``labelled (lang, text)`` trains the language
    model. An ending counts as finished if at least ``least_seen`` other parts of answers, not the last of theirs, end so,
    or by its last word where that word's endings are seldom seen (``finished_endings``).
    """
    model = language_model(labelled)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, np.ndarray] = {}
        for b in batches:
            found = [
                defect_of([x for x in p if x is not None], a, level == "event", model, cache, margin)
                for p, a, level in zip(b["prompt"], b["answer"], b["pair_level"], strict=True)
            ]
            # Pairs without an ending to look up, most of them, each get a key of their own, so that no key is hot in the joins.
            ending = [f[1] or f"\u0001{i}" for f, i in zip(found, b["pair_id"], strict=True)]
            yield pd.DataFrame({"pair_level": b["pair_level"], "pair_id": b["pair_id"], "defect": [f[0] for f in found], "ending": ending})

    def endings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = pd.Series([sentence_ending(x) for a in b["answer"] for x in [y for y in a if y is not None and y.strip()][:-1]], dtype=object).value_counts()
            yield pd.DataFrame({"ending": counts.index.astype(str), "n": counts.to_numpy()})

    known = pairs.where("prompt is not null")
    judged = known.select("pair_level", "pair_id", "prompt", "answer").mapInPandas(judge, "pair_level string, pair_id long, defect string, ending string")
    counts = materialized(
        known.where("pair_level <> 'event' and size(answer) > 1").select("answer")
        .mapInPandas(endings, "ending string, n long")
        .groupBy("ending").agg(F.sum("n").alias("n"))
    )
    unfinished = ~F.col("ending").startswith("\u0001") & F.col("known").isNull() & F.col("backed").isNull() & (F.col("defect").isNull())
    finished, backed = finished_endings(counts, least_seen)
    out = judged.withColumn("word", F.substring_index("ending", " ", -1)).join(finished, "ending", "left").join(backed, "word", "left")
    return out.select("pair_level", "pair_id", F.when(unfinished, "truncated").otherwise(F.col("defect")).alias("defect")).where("defect is not null")


def project_pairs(captions: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of both tables and the labelled texts for the language model."""
    c = captions.where("caption is not null").select(
        F.lit("caption").alias("pair_level"), F.col("caption_id").alias("pair_id"), F.array("caption").alias("prompt"), F.col("sequential_descriptions").alias("answer")
    )
    e = events.where("decription is not null").select(
        F.lit("event").alias("pair_level"), F.col("row_id").alias("pair_id"), F.col("decription").alias("prompt"), F.col("programmatic").alias("answer")
    )
    text = F.concat_ws(" ", "caption", "sequential_descriptions")
    lang = F.substring(F.lower(F.trim("lang")), 1, 2)
    labelled = captions.select(lang.alias("lang"), text.alias("text")).union(events.select(F.lit("en"), F.regexp_replace(F.concat_ws(" ", "decription", "programmatic"), BINDING, "(")))
    return c.union(e), labelled
