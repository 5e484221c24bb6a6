import json
from datetime import datetime

from chronoscene.operators.nested import flat_table, parse_payload


def test_forms_of_payloads():
    event = {"event_id": "3", "programmatic": ["a(A, B)", ["name", "A", "cat"], {"predicate": "p", "args": [{"var": "B"}, {"noun": '"dog"'}]}, " ", None, {"or": ["q(A)", {"not": "in front of( A , 'x' )"}]}]}
    clauses = parse_payload(json.dumps({"data": [{"video_id": "v", "events": event}]}))["captions"][0]["events"][0]["clauses"]
    assert [(c["predicate"], c["args"]) for c in clauses] == [("a", ["A", "B"]), ("name", ["A", "cat"]), ("p", ["B", "dog"]), ("q", ["A"]), ("in front of", ["A", "x"])]
    keyed = parse_payload('Here: ```json\n{"response": {"data": {"v7": {"sequential_descriptions": [], "time stamps": {"2": {"programmatic": "a(A)"}, "5": {"programmatic": {"predicate": "b", "args": "A"}}}}}}}\n```')
    assert keyed["captions"][0]["video_id"] == "v7" and [e["event_id"] for e in keyed["captions"][0]["events"]] == [2, 5]
    assert parse_payload('{"data": "{\\"k\\": {\\"events\\": []}}"}')["captions"][0]["video_id"] == "k"
    for bad in (None, "", "no json", '{"data": [', "[" * 100_000):
        assert parse_payload(bad) is None
    lone = parse_payload('{"data": [{"video_id": "v", "events": {"programmatic": {"predicate": "b", "args": ["A"]}}}]}')
    assert lone["captions"][0]["events"][0]["clauses"] == [{"predicate": "b", "args": ["A"]}]


def test_batches_count_once(spark):
    good = json.dumps({"data": [{"video_id": "v", "events": [{"programmatic": ["a(A, B)"]}, {"programmatic": None}]}]})
    t = datetime(2025, 1, 1)
    rows = [(1, t, '{"data": ['), (1, t.replace(day=2), good), (1, t.replace(day=3), good.replace(" ", "")), (2, t, "cut"), (None, t, good), (3, t, "{}")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "batch_id long, received_at timestamp, payload string, arg string")
    args = flat_table(df, "arguments").orderBy("arg_no").collect()
    assert [(r.batch_id, r.video_id, r.event_id, r.clause_no, r.predicate, r.arg_no, r.arg) for r in args] == [(1, "v", 1, 1, "a", 1, "A"), (1, "v", 1, 1, "a", 2, "B")]
    assert flat_table(df, "events").count() == 2 and flat_table(df, "captions").count() == 1 and flat_table(df.limit(0), "clauses").count() == 0
