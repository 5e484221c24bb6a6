import json

from chronoscene.operators.drift import consistent_table, promoted, schema_changes, value_profile

LINES = "feed_id int, file_no int, file_id long, line_no int, line_id long, record string, extra string"


def lines(spark, files):
    rows, n = [], 0
    for (feed, no), records in files.items():
        for i, r in enumerate(records):
            n += 1
            rows.append((feed, no, feed * 100 + no, i, n, r if r is None or isinstance(r, str) else json.dumps(r), "x"))
    return spark.createDataFrame(rows, LINES)


def test_changes(spark):
    base = {"video_location": "early", "tool": "v1.2", "event_id": 1, "note": None}
    files = {
        (1, 1): [base, base | {"tool": "v2.0"}, '{"broken": '],
        (1, 3): [{"place": "early", "tool": "v1.1", "event_id": "7"}, {"place": "late", "tool": "v1.1", "event_id": "8"}, {"place": "mid", "tool": 3, "event_id": 9}],
        (1, 4): [{"place": "mid", "tool": ["v1"], "event_id": "8", "score": 0.5}],
        (1, 7): [{"place": "mid", "tool": ["v1"], "event_id": "8", "names": [{"a": 1}]}],
        (2, 1): [{"z": True}],
        (2, 2): [None, "[1, 2]"],
    }
    got = {tuple(r)[2:6] for r in schema_changes(lines(spark, files)).collect()}
    assert got == {
        (103, "renamed", "video_location", "place"), (103, "retyped", "event_id", "event_id"), (104, "retyped", "tool", "tool"), (104, "added", "", "score"),
        (107, "removed", "score", ""), (107, "added", "", "names"), (202, "removed", "z", ""),
    }


def test_table_keeps_every_readable_record(spark):
    files = {(1, 1): [{"a b": 1, "b": "x"}] * 4, (1, 2): [{"a_b": 2, "b": [1, 2]}, "{"], (2, 1): [{"a b": 5}], (2, 2): [{"a_b": 6}]}
    df = lines(spark, files)
    out = consistent_table(df, schema_changes(df), ["line_id"]).collect()
    assert len(out) == 7 and [r["a b"] for r in sorted(out, key=lambda r: r.line_id)] == [1, 1, 1, 1, 2, 5, 6]
    assert promoted("number", "string") == "string" and promoted("string", "array<string>") == "array<string>" and promoted("object", "number") == "json"


def test_table_applies_single_renames_and_keeps_strays(spark):
    files = {(1, 1): [{"checked": True, "n": i} for i in range(150)] + [{"checked": True, "n": "about five"}], (1, 2): [{"is_checked": False, "n": 7}] * 3, (2, 1): [{"checked": 1, "is_checked": True, "n": True}]}
    df = lines(spark, files)
    out = {r.line_id: r for r in consistent_table(df, schema_changes(df), ["line_id"]).collect()}
    assert len(out) == 155 and "is_checked" not in out[1].asDict() and all(out[i].checked is (i < 152) for i in range(1, 155))
    assert out[151].n is None and out[151].unfitting == {"n": '"about five"'} and out[1].unfitting is None and out[152].unfitting is None
    assert out[155].unfitting == {"checked": "1", "is_checked": "true", "n": "true"}


def test_profile_tells_values_that_differ_late(spark):
    long = "a, 1; " * 20
    rows = [("x", '"' + long + '."'), ("y", '"' + long + '!"'), ("p", json.dumps(["a"] * 5, separators=(",", ":"))), ("q", json.dumps(["a"] * 9, separators=(",", ":")))]
    got = {}
    for r in value_profile(spark.createDataFrame(rows, "name string, value string"), ["name"]).collect():
        got.setdefault(r["name"], set()).add(r["token"])
    shape = lambda n: {t for t in got[n] if t.startswith("s:")}
    assert shape("x") != shape("y") and "n:5" in got["p"] and "n:9" in got["q"]


def test_empty(spark):
    assert schema_changes(spark.createDataFrame([], LINES)).count() == 0
