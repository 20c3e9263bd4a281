"""Subtitle files on literal texts."""

import pytest

from tidecue.sources import cues

HEAD = "\ufeffWEBVTT\r\nKind: captions\nLanguage: en\n\n"
ONE = "00:00:01.000 --> 00:00:02.000"
CASES = [
    ("vtt", HEAD + f"NOTE x\ny\n\nSTYLE\n::cue {{}}\n\nREGION\nid:a\n\nintro-cue\n{ONE} align:start\nhello\n", [("intro-cue", 1, "hello", 1000, 2000)]),
    ("vtt", HEAD + f"{ONE}\n \nbody\n\n{ONE}\nnext", [("1", 1, "body", 1000, 2000), ("2", 2, "next", 1000, 2000)]),
    ("vtt", HEAD + f"{ONE}\n\n\n{ONE}\nkept", [("1", 1, "kept", 1000, 2000)]),
    ("vtt", HEAD, []),
    ("srt", "1\n00:00:00,000 --> 00:00:01,000\n42\nmeaning\n", [("1", 1, "42\nmeaning", 0, 1000)]),
    ("srt", "subtitle-abc\n01:23,456 --> 01:24,000\nx", [("1", 1, "x", 83456, 84000)]),
    ("srt", "7\nno timing", [("1", 1, "7\nno timing", None, None)]),
    ("srt", None, []),
]


@pytest.mark.parametrize("kind, text, want", CASES)
def test_parse(spark, kind, text, want):
    files = spark.createDataFrame([(1, text)], "video_id int, content string")
    got = (cues.parse_vtt if kind == "vtt" else cues.parse_srt)(files).orderBy("cue_index").collect()
    assert [(r.cue_id, r.cue_index, r.source, r.start_ms, r.end_ms) for r in got] == want
