"""Readers of data-set layouts on hand-made files."""

import json

import pytest

from chronoscene.sources import readers


def test_frame_objects(spark, tmp_path):
    thing = lambda c, visible, phase: {"class": c, "visible": visible, "bbox": [1, 2, 3, 4], "attention_relationship": ["looking_at"], "spatial_relationship": None, "contacting_relationship": ["holding"], "metadata": {"set": phase}}
    data = {"a.mp4/000001.png": [thing("cup", True, "train"), thing("bed", False, "train")], "a.mp4/000003.png": [thing("cup", True, "test")], "b.mp4/000001.png": []}
    (tmp_path / "objects.json").write_text(json.dumps(data, indent=1))
    objects, relations = readers.frame_objects(spark, str(tmp_path / "objects.json"), "train")
    assert [tuple(r) for r in objects.collect()] == [("a.mp4", 0, 0, "cup", 1.0, 2.0, 4.0, 6.0, True)]
    assert sorted(tuple(r) for r in relations.collect()) == [("a.mp4", 0, 0, "holding"), ("a.mp4", 0, 0, "looking_at")]
    assert readers.frame_objects(spark, str(tmp_path / "objects.json"))[0].count() == 2


def test_panoptic_videos(spark, tmp_path):
    video = lambda v: {"video_id": v, "captions": [{"description": "A cat (white) sits .", "time": "3-7"}], "objects": [{"object_id": 1, "category": "cat"}], "relations": [[1, 2, "on", [[0, 3], [5, 9]]]]}
    (tmp_path / "p.json").write_text(json.dumps({"data": [video("v"), video("w")], "split": {"x": {"train": ["v"], "val": ["w"]}}}))
    objects, relations, captions = readers.panoptic_videos(spark, str(tmp_path / "p.json"), "train")
    assert [tuple(r) for r in objects.collect()] == [("v", 1, "cat")]
    assert sorted(tuple(r) for r in relations.collect()) == [("v", 1, 2, "on", 0, 3), ("v", 1, 2, "on", 5, 9)]
    assert [tuple(r) for r in captions.collect()] == [("v", 3, 7, "A cat sits.")]


def test_captions_settings_and_report(spark, tmp_path):
    rows = [{"id": "a", "video": "a.mp4", "data_source": "s", "caption": "old"}, {"id": "a", "video": "a.mp4", "data_source": "s", "caption": "new"}, {"id": "b", "video": "b.mp4", "data_source": "t", "caption": None}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    assert [r.caption for r in readers.caption_records(spark, str(tmp_path / "c.json"), ["s"]).collect()] == ["new"]
    assert readers.caption_records(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "s.json").write_text('{"fps": 1, "top": 3}')
    assert readers.settings(str(tmp_path / "s.json"), {"top": 5, "fps": None}) == {"fps": 1, "top": 5}
    with pytest.raises(KeyError):
        readers.settings(str(tmp_path / "s.json"), {"other": 1})
    readers.write_report(spark.createDataFrame([("p", 0.5), ("r", None)], "metric string, value double"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
