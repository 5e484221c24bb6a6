"""Deeply nested model output as related flat tables.

An Arrow-batched parser only repairs and regularizes a payload (wrappers, lone values, strings that hold JSON) into one
typed nested value. The flat tables are higher-order projections of it: ``transform`` attaches ancestor keys and
positions level by level, ``flatten`` joins the arrays, and one ``inline`` per table emits the rows.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Names of levels, as in the data.
EVENT_LEVELS = ("events", "time stamps", "time_stamps", "timestamps", "timeStamps")
DESCRIPTIONS = ("description", "decription", "descriptions")
PROGRAMS = ("programmatic", "program", "clauses")
EVENT_FIELDS = {"event_id", "timing", "duration", *DESCRIPTIONS, *PROGRAMS}

CLAUSE = "struct<predicate:string,args:array<string>>"
EVENT = f"struct<event_key:string,event_id:int,place:int,description:array<string>,duration:string,duration_precise:string,video_location:string,video_location_precise:array<string>,clauses:array<{CLAUSE}>>"
CAPTION = f"struct<caption_key:string,video_id:string,sequential_descriptions:array<string>,events:array<{EVENT}>>"
PAYLOAD = f"struct<captions:array<{CAPTION}>>"


def _whole(value: object) -> int | None:
    try:
        return int(str(value).strip())
    except (TypeError, ValueError):
        return None


def _texts(value: object) -> list[str] | None:
    if value is None:
        return None
    return [v if isinstance(v, str) else json.dumps(v) for v in (value if isinstance(value, list) else [value]) if v is not None]


def _bare(value: object) -> str:
    """A name or argument without outer blanks and quotes; an object stands for its only value."""
    if isinstance(value, dict):
        value = next(iter(value.values()), "")
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value)
    while (cut := text.strip().strip("\"'`").strip()) != text:
        text = cut
    return text


def _parts(text: str) -> list[str]:
    """Arguments between commas that are in no inner brackets or quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def _clauses(value: object) -> list[dict]:
    """Clauses in reading order; groups are entered, blanks skipped. Iterative: any depth of nesting is allowed."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            text = v.strip()
            if not text:
                continue
            if text[0] in "[{":
                try:
                    stack.append(json.loads(text))
                    continue
                except ValueError:
                    pass
            name, bracket, rest = text.partition("(")
            inner = rest.rstrip()
            inner = inner[:-1] if inner.endswith(")") else inner
            args = [_bare(a) for a in _parts(inner)] if bracket and inner.strip() else []
            if _bare(name):
                out.append({"predicate": _bare(name), "args": args})
        elif isinstance(v, list):
            flat = len(v) > 1 and all(isinstance(x, (str, int, float)) for x in v) and not any(isinstance(x, str) and ("(" in x or not x.strip()) for x in v)
            if flat:
                out.append({"predicate": _bare(v[0]), "args": [_bare(a) for a in v[1:]]})
            else:
                stack.extend(reversed(v))
        elif isinstance(v, dict):
            if "predicate" in v:
                args = v.get("args", [])
                args = args if isinstance(args, list) else [] if args is None else [args]
                if _bare(v["predicate"]):
                    out.append({"predicate": _bare(v["predicate"]), "args": [_bare(a) for a in args]})
            else:
                stack.extend(reversed(list(v.values())))
    return out


def _program(value: object) -> list[dict]:
    """Clauses of an event; a list of words only is one clause in place of a list of clauses."""
    return _clauses(value)


def _entries(value: object) -> list[tuple[str | None, dict]]:
    """(key, object) of a list, a map of objects, or a lone object."""
    if isinstance(value, list):
        return [(None, v) for v in value if isinstance(v, dict)]
    if isinstance(value, dict):
        if value and all(isinstance(v, dict) or v is None for v in value.values()) and not EVENT_FIELDS & value.keys():
            return [(k, v) for k, v in value.items() if isinstance(v, dict)]
        return [(None, value)] if value else []
    return []


def _first(d: dict, names: tuple[str, ...]) -> object:
    return next((d[n] for n in names if d.get(n) is not None), None)


def _event(key: str | None, place: int, e: dict) -> dict:
    timing = e.get("timing") if isinstance(e.get("timing"), dict) else {}
    get = lambda n: e.get(n, timing.get(n))
    own = _whole(e.get("event_id"))
    keyed = _whole(key) if key is not None else None
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return {
        "event_key": key, "event_id": own if own is not None else keyed if keyed is not None else place, "place": place, "description": _texts(_first(e, DESCRIPTIONS)),
        "duration": text(get("duration")), "duration_precise": text(get("duration_precise")), "video_location": text(get("video_location")),
        "video_location_precise": _texts(get("video_location_precise")), "clauses": _program(_first(e, PROGRAMS)),
    }


def _is_caption(v: object) -> bool:
    return isinstance(v, dict) and any(n in v for n in (*EVENT_LEVELS, "sequential_descriptions"))


def _captions(value: object) -> list[tuple[str | None, dict]]:
    """Descends through wrappers (objects, and texts that hold JSON) to the captions."""
    if isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            return _captions(json.loads(value))
        except ValueError:
            return []
    if isinstance(value, list):
        return [(None, v) for v in value if _is_caption(v)] or [c for v in value if not _is_caption(v) for c in _captions(v)]
    if isinstance(value, dict):
        if _is_caption(value):
            return [(None, value)]
        own = [(k, v) for k, v in value.items() if _is_caption(v)]
        return own or [c for v in value.values() if isinstance(v, (dict, list, str)) for c in _captions(v)]
    return []


_FENCE = re.compile(r"```[a-zA-Z]*")


def parse_payload(text: str | None) -> dict | None:
    """The regular nested value of a payload, None if unreadable (null, no JSON, cut off, too deep)."""
    if text is None:
        return None
    try:
        try:
            value = json.loads(text)
        except ValueError:
            plain = _FENCE.sub(" ", text)
            at = min((i for i in (plain.find("{"), plain.find("[")) if i >= 0), default=-1)
            if at < 0:
                return None
            value, _ = json.JSONDecoder().raw_decode(plain, at)
        if isinstance(value, str):
            value = json.loads(value)
        if not isinstance(value, (dict, list)):
            return None
        captions = []
        for key, c in _captions(value):
            events = [_event(k, i, e) for i, (k, e) in enumerate(_entries(_first(c, EVENT_LEVELS)), 1)]
            own = c.get("video_id")
            video = own.strip() if isinstance(own, str) and own.strip() else key if own in (None, "") or isinstance(own, str) else str(own)
            captions.append({"caption_key": key, "video_id": video, "sequential_descriptions": _texts(c.get("sequential_descriptions")), "events": events})
        return {"captions": captions}
    except (ValueError, RecursionError):
        return None


def _parse_batch(texts: pd.Series) -> pd.DataFrame:
    parsed = [parse_payload(t) for t in texts]
    return pd.DataFrame({"captions": pd.Series([None if p is None else p["captions"] for p in parsed], dtype=object)})


def readable_batches(batches: DataFrame) -> DataFrame:
    """``(batch_id, captions)``: of each batch the readable payload received first (ties: smaller payload hash).

    Rows with a null ``batch_id`` and batches without a readable payload are left out. Copies are told by their id before
    the parsed values are compared, so only small keys are sorted.
    """
    parse_payloads = F.pandas_udf(_parse_batch, PAYLOAD)
    parsed = batches.where("batch_id is not null").select(
        "batch_id", F.struct(F.col("received_at"), F.xxhash64("payload").alias("h")).alias("o"), parse_payloads("payload")["captions"].alias("captions")
    )
    return parsed.where("captions is not null").groupBy("batch_id").agg(F.min_by("captions", "o").alias("captions"))


def _captions_rows(c: Column) -> Column:
    return F.transform(c, lambda x, i: F.struct((i + 1).alias("caption_no"), x["caption_key"].alias("caption_key"), x["video_id"].alias("video_id"), x["sequential_descriptions"].alias("sequential_descriptions")))


def _event_rows(c: Column) -> Column:
    return F.flatten(
        F.transform(
            c,
            lambda x, i: F.transform(
                x["events"],
                lambda e: F.struct(
                    (i + 1).alias("caption_no"), x["video_id"].alias("video_id"), e["place"].alias("event_no"), e["event_id"].alias("event_id"), e["event_key"].alias("event_key"),
                    e["description"].alias("description"), e["duration"].alias("duration"), e["duration_precise"].alias("duration_precise"),
                    e["video_location"].alias("video_location"), e["video_location_precise"].alias("video_location_precise"), e["clauses"].alias("clauses"),
                ),
            ),
        )
    )


def _clause_rows(c: Column) -> Column:
    return F.flatten(
        F.transform(
            _event_rows(c),
            lambda e: F.transform(
                e["clauses"],
                lambda k, j: F.struct(
                    e["caption_no"].alias("caption_no"), e["video_id"].alias("video_id"), e["event_no"].alias("event_no"), e["event_id"].alias("event_id"),
                    (j + 1).alias("clause_no"), k["predicate"].alias("predicate"), k["args"].alias("args"),
                ),
            ),
        )
    )


def _argument_rows(c: Column) -> Column:
    return F.flatten(
        F.transform(
            _clause_rows(c),
            lambda k: F.transform(
                k["args"],
                lambda a, n: F.struct(
                    k["caption_no"].alias("caption_no"), k["video_id"].alias("video_id"), k["event_no"].alias("event_no"), k["event_id"].alias("event_id"),
                    k["clause_no"].alias("clause_no"), k["predicate"].alias("predicate"), (n + 1).alias("arg_no"), a.alias("arg"),
                ),
            ),
        )
    )


LEVELS = {"captions": _captions_rows, "events": _event_rows, "clauses": _clause_rows, "arguments": _argument_rows}


def flat_table(batches: DataFrame, level: str) -> DataFrame:
    """One of ``captions``, ``events``, ``clauses``, ``arguments`` with ``batch_id`` and the keys of all parents.

    Takes ``batch_id, received_at, payload``; other columns don't matter. Empty or absent levels give no rows.
    """
    out = readable_batches(batches).select("batch_id", F.inline(LEVELS[level](F.col("captions"))))
    return out.drop("clauses", "args") if level in ("events", "clauses") else out


def parse_clauses(value: object) -> list[dict]:
    """``{predicate, args}`` of a program in any of the forms of ``flat_table``; null elements are skipped."""
    return [c for v in value for c in _program(v)] if isinstance(value, list) else [] if value is None else _program(value)
