"""Programs of model output compiled to specification texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chronoscene.functions.text import ATTRIBUTES
from chronoscene.operators.nested import parse_clauses
from chronoscene.plans import stsl


def variable(arg: str) -> int | None:
    """Id of ``?x`` or of a single capital letter, None of other words."""
    if len(arg) == 2 and arg[0] == "?" and arg[1].isalpha():
        return ord(arg[1].lower()) - 96
    return ord(arg) - 64 if len(arg) == 1 and "A" <= arg <= "Z" else None


def compile_event(clauses: list[str | None] | None) -> dict:
    """Names, keywords and atoms of an event's program, or the reason for which it is rejected.

    ``name(X, noun)`` binds a variable, the first binding of a variable counts; negated clauses are dropped; an attribute
    with an object and a value becomes a unary predicate; other clauses need one or two arguments.
    """
    out = {"names": {}, "unary": [], "binary": [], "atoms": [], "reason": None}
    parsed = parse_clauses(clauses)
    if not parsed:
        return out | {"reason": "empty"}
    for c in parsed:
        name, args = c["predicate"], c["args"]
        if name == "name":
            if len(args) == 2 and variable(args[0]) is not None and args[1] and variable(args[1]) is None:
                out["names"].setdefault(args[0], args[1])
    for c in parsed:
        name, args = c["predicate"], c["args"]
        if name == "name" or name.lower() in ("not", "neq"):
            continue
        if name in ATTRIBUTES and len(args) == 2:
            name, args = args[1], args[:1]
        if not 1 <= len(args) <= 2 or not name or any(not a for a in args):
            continue
        out["unary" if len(args) == 1 else "binary"].append(name)
        out["atoms"].append((name, args))
    return out if out["atoms"] else out | {"reason": "no atoms"}


def specification(events: list[dict]) -> tuple[str, list[str]]:
    """Specification text of compiled events in order, and its constants; the n-th constant is ``Const(-n)``."""
    consts: dict[str, int] = {}

    def term(arg: str) -> stsl.Term:
        v = variable(arg)
        return stsl.Var(v) if v is not None else stsl.Const(-consts.setdefault(arg, len(consts) + 1))

    def formula(event: dict) -> object:
        atoms = [stsl.Unary(n, term(a[0])) if len(a) == 1 else stsl.Binary(n, term(a[0]), term(a[1])) for n, a in event["atoms"]]
        return stsl.conjunction(atoms)

    text = stsl.show(stsl.chain([formula(e) for e in events]))
    return text, list(consts)


PROGRAM = "prog string, consts array<string>, names map<string,string>, unary_kws array<string>, binary_kws array<string>, reason string"


def compiled_programs(events: DataFrame, key: str, programs: str) -> DataFrame:
    """``(key, prog, consts, names, unary_kws, binary_kws, reason)`` per row; exactly one of ``prog`` and ``reason`` is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, clauses in zip(b[key], b[programs], strict=True):
                e = compile_event(None if clauses is None else list(clauses))
                text, consts = specification([e]) if e["reason"] is None else (None, [])
                rows.append((k, text, consts, e["names"], sorted(set(e["unary"])), sorted(set(e["binary"])), e["reason"]))
            yield pd.DataFrame(rows, columns=[key, "prog", "consts", "names", "unary_kws", "binary_kws", "reason"])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, programs).mapInPandas(run, f"{key} {kind}, {PROGRAM}")


def windowed_programs(events: DataFrame, size: int = 3) -> DataFrame:
    """``(video_id, window_no, prog, consts)``: specification texts of ``size`` consecutive events of ``(video_id, event_id, programmatic)``.

    Events with the same number are taken in the order of their program text; rejected programs and rows without video or
    event leave no place. Windows are cut per video by position; a window, not a video, is the unit of the compilation.
    """
    from chronoscene.operators.rangescan import prefix_sum

    ok = F.size(F.filter("programmatic", lambda c: c.contains("("))) > 0
    rows = events.where("video_id is not null and event_id is not null").where(ok)
    rows = rows.select("video_id", "event_id", "programmatic", F.xxhash64("programmatic").alias("h"), F.lit(1).alias("one"))
    placed = prefix_sum(rows, "video_id", ["event_id", "h"], "one", "_b", "place").withColumn("window_no", F.floor(F.col("place") / size))
    windows = placed.groupBy("video_id", "window_no").agg(F.array_sort(F.collect_list(F.struct("place", "programmatic"))).alias("events"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for vid, no, events in zip(b["video_id"], b["window_no"], b["events"], strict=True):
                good = [c for c in (compile_event(list(e["programmatic"])) for e in events) if c["reason"] is None]
                if good:
                    rows.append((vid, no, *specification(good)))
            yield pd.DataFrame(rows, columns=["video_id", "window_no", "prog", "consts"])

    return windows.mapInPandas(run, "video_id string, window_no long, prog string, consts array<string>")
