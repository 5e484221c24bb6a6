"""Text and program normalization as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Attributes whose value becomes the predicate.
ATTRIBUTES = ("color", "material", "size")
#: Fixed value: stands for a missing keyword.
NO_KEYWORD = "$$$"


def clean_caption(text: Column, trim: bool = False) -> Column:
    """Without bracketed remarks of letters, digits, commas and hyphens; double spaces and spaces before . and , removed once."""
    t = F.regexp_replace(text, r"\([0-9a-zA-Z,\- ]+\)", "")
    t = F.replace(F.replace(F.replace(t, F.lit("  "), F.lit(" ")), F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(","))
    return F.trim(t) if trim else t


def normalize_text(text: Column) -> Column:
    return F.translate(text, ",'_-", "    ")


def clean_label(text: Column) -> Column:
    return F.translate(text, "_/", "  ")


def keyword_tokens(text: Column) -> Column:
    """Words between spaces after hyphens, commas, dots, underscores and apostrophes became spaces."""
    return F.split(F.translate(text, "-,._'", "     "), " ")


def is_variable(token: Column) -> Column:
    """``?x`` or a single capital letter."""
    return token.rlike(r"^\?.$") | token.rlike("^[A-Z]$")


def without_variables(text: Column) -> Column:
    """The keyword's words that are no variables, joined by underscores."""
    return F.array_join(F.filter(keyword_tokens(text), lambda w: ~is_variable(w)), "_")


def missing_variables(text: Column) -> Column:
    """The variables among the keyword's words, which ``without_variables`` drops."""
    return F.filter(keyword_tokens(text), is_variable)


def lower_variables(args: Column) -> Column:
    """Arguments with their variables in lower case."""
    return F.transform(args, lambda a: F.when(is_variable(a), F.lower(a)).otherwise(a))


def inline_names(args: Column, names: Column) -> Column:
    """Arguments in which variables give way to their nouns in the map ``names`` (``?a`` to noun); others stay."""
    return F.transform(args, lambda a: F.when(is_variable(a), F.coalesce(F.try_element_at(names, F.concat(F.lit("?"), F.lower(F.right(a, F.lit(1))))), a)).otherwise(a))


def ordered_pairs(args: Column) -> Column:
    """array<struct<first, second>> of all ordered pairs of different places of a list."""
    pairs = F.transform(args, lambda x, i: F.transform(F.filter(F.transform(args, lambda y, j: F.struct(j.alias("j"), y.alias("y"))), lambda s: s["j"] != i), lambda s: F.struct(x.alias("first"), s["y"].alias("second"))))
    return F.flatten(pairs)


def term_id(arg: Column, consts: Column) -> Column:
    """The number of a variable, or the negated place from 1 of a constant in ``consts``; null for unknown words."""
    return F.when(is_variable(arg), variable_id(arg)).otherwise(F.nullif(-F.array_position(consts, arg), F.lit(0)))


def split_frame_key(key: Column) -> Column:
    """struct(video, fid) of ``VIDEO/FRAME.png``."""
    return F.struct(F.regexp_extract(key, "^(.*)/[^/]*$", 1).alias("video"), F.regexp_extract(key, r"/(\d+)\.[^/]*$", 1).try_cast("int").alias("fid"))


def file_frame(path: Column) -> Column:
    """Frame of an image file whose numbers start at 1: the number before the extension less one."""
    return F.regexp_extract(path, r"(\d+)\.[^/.]*$", 1).try_cast("int") - 1


def kept_by_stop_words(keyword: Column, words: list[str], exact: list[str]) -> Column:
    """Is none of the keyword's words a stop word, and the whole keyword none of ``exact``."""
    return ~keyword.isin(*exact) & ~F.arrays_overlap(F.split(keyword, " "), F.array(*map(F.lit, words)))


def inclusive_range(text: Column) -> Column:
    """struct(start, end) of ``a-b`` with whole numbers: half-open, the last one inside."""
    parts = F.split(text, "-")
    return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("start"), (F.get(parts, F.lit(1)).try_cast("int") + 1).alias("end"))


def second_to_frame(seconds: Column, fps: Column, total: Column) -> Column:
    """Frame at a time, between 0 and the last one."""
    return F.least(F.greatest(F.floor(seconds * fps), F.lit(0)), total - 1)


def frame_span(start: Column, end: Column, fps: Column, total: Column) -> Column:
    """struct(first, last): frames of a span of seconds inside the video, the last not before the first."""
    first = second_to_frame(start, fps, total)
    return F.struct(first.alias("first"), F.greatest(second_to_frame(end, fps, total), first).alias("last"))


def wrapped_prompt(context: str, query: str, captions: Column, examples: str | None = None) -> Column:
    """Prompt text: context, examples if any, query, and a numbered line per struct(video_id, caption)."""
    lines = F.transform(captions, lambda c, i: F.concat(i.cast("string"), F.lit(". video id: "), c["video_id"], F.lit(" caption: "), c["caption"]))
    head = [F.lit(x) for x in (context, *([examples] if examples else []), query)]
    return F.array_join(F.concat(F.array(*head), lines), "\n")


def variable_id(name: Column) -> Column:
    """1 for A or ?a, 2 for B or ?b, and so on."""
    return F.ascii(F.lower(F.right(name, F.lit(1)))) - 96


def split_logic(clause: Column) -> Column:
    """Parts of a clause between ``or``, ``and`` and semicolons, without a bracket around the whole list."""
    parts = F.filter(F.split(clause, r" or | and |^or\(|^and\(|;"), lambda p: p != "")
    n = F.size(parts)
    wrapped = (n > 1) & F.get(parts, F.lit(0)).startswith("(") & F.get(parts, n - 1).endswith(")")
    cut = F.transform(parts, lambda p, i: F.when(i == 0, F.substr(p, F.lit(2))).when(i == n - 1, F.left(p, F.length(p) - 1)).otherwise(p))
    return F.when(wrapped, cut).otherwise(parts)


def split_commas(clause: Column) -> Column:
    """Clauses that stick together with commas, each with its closing bracket."""
    parts = F.split(clause, r"\),")
    return F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(")"))).otherwise(p))


def time_range(text: Column) -> Column:
    """struct(start, end) of ``a-b``; a lone number a is [a, a+1), an empty start 0, an empty end 10000."""
    parts = F.split(text, "-")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    whole = lambda c, empty: F.when(F.trim(c) == "", F.lit(empty)).otherwise(c.try_cast("int"))
    lone = F.size(parts) == 1
    return F.struct(
        F.when(lone, first.try_cast("int")).otherwise(whole(first, 0)).alias("start"),
        F.when(lone, first.try_cast("int") + 1).otherwise(whole(second, 10000)).alias("end"),
    )


def period(text: Column) -> Column:
    """struct(start, mid, end) of ``[1/4, 3/4]``; null parts where it is no pair of fractions or whole numbers."""
    parts = F.split(F.regexp_replace(text, r"[\[\]' ]", ""), ",")

    def value(i: int) -> Column:
        f = F.split(F.get(parts, F.lit(i)), "/")
        a, b = F.get(f, F.lit(0)).try_cast("int"), F.get(f, F.lit(1)).try_cast("int")
        return F.when(F.size(f) == 1, a.cast("double")).when(b != 0, a / b)

    s, e = value(0), value(1)
    return F.struct(s.alias("start"), ((s + e) / 2).alias("mid"), e.alias("end"))


def class_prompt(classes: Column) -> Column:
    """Class names joined by ``. ``, lower case, trimmed, with a final dot."""
    t = F.trim(F.lower(F.array_join(classes, ". ")))
    return F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))


def frame_path(directory: Column, fid: Column) -> Column:
    """Path of a frame's image: its number padded to four digits, longer numbers whole."""
    number = fid.cast("string")
    return F.concat(directory, F.lit("/"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number), F.lit(".png"))


def filled_keywords(keywords: Column) -> Column:
    """The list, or one stand-in keyword for a null or empty one."""
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, keywords).otherwise(F.array(F.lit(NO_KEYWORD)))


def kept_keywords(keywords: Column) -> Column:
    """Normalized keywords of fewer than four words, without those that begin with an apostrophe."""
    plain = F.filter(keywords, lambda k: k.isNotNull() & ~k.startswith("'"))
    spaced = F.transform(plain, lambda k: F.translate(k, "-,._", "    "))
    return F.filter(spaced, lambda k: F.size(F.split(k, " ")) < 4)


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")
