"""Answers, routes, settings, files and proposals on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from tidecue import config
from tidecue.functions import prompts, text, timecode
from tidecue.operators import calls, semantic
from tidecue.sources import files


def batch(n=2, **options):
    cue = lambda i: {"cue_id": f"c{i}", "cue_index": i, "source": f"s{i}"}
    return calls.Batch(1, [cue(i) for i in range(1, n + 1)], [], [cue(90)], **options)


def said(*pairs):
    return json.dumps([{"cue_id": k, "translation": v} for k, v in pairs])


@pytest.mark.parametrize(
    "answer, kind",
    [
        ("nope", "invalid_json"), ("{}", "schema_mismatch"), (said(("c1", "a")), "schema_mismatch"), ('[1, 2]', "schema_mismatch"), (said(("c1", "a"), (" ", "b")), "missing_required_cue_id"),
        (said(("c1", "a"), ("c1", "b")), "duplicate_cue_id"), (said(("c1", "a"), ("c90", "b")), "context_cue_output_violation"), (said(("c1", "a"), ("x", "b")), "invalid_cue_id"),
        (said(("c1", "a"), ("c2", " ")), "empty_translation"), (said(("c1", 5), ("c2", "b")), "schema_mismatch"), (None, None),
    ],
)
def test_structured_answers(answer, kind):
    if answer is None:
        assert calls.read_structured("```json\n" + said(("c2", "b"), ("c1", "a")) + "\n```", batch()) == {"c1": "a", "c2": "b"}
        return
    with pytest.raises(calls.CallError) as e:
        calls.read_structured(answer, batch())
    assert e.value.kind == kind


def test_names_of_cues_that_clash():
    b = calls.Batch(1, [{"cue_id": "x", "cue_index": 1, "source": "a"}, {"cue_id": "x", "cue_index": 2, "source": "b"}, {"cue_id": " ", "cue_index": 3, "source": "c"}])
    assert calls.record_ids(b) == {1: "1", 2: "2", 3: "3"}
    with pytest.raises(calls.CallError):
        calls.record_ids(calls.Batch(1, [{"cue_id": "2", "cue_index": 1, "source": "a"}, {"cue_id": "", "cue_index": 2, "source": "b"}]))


def test_review():
    item = lambda i, a="keep", t="x", r="y": {"id": i, "action": a, "translation": t, "reason": r}
    assert calls.read_review(json.dumps([item("a"), item("b", "fix", "new")]), ["a", "b"]) == {"b": "new"}
    for bad in ([item("b"), item("a")], [item("a")], [item("a"), item("a")], [item("a", "drop"), item("b")], [item("a", t=" "), item("b")], [item("a", r=""), item("b")], [1, 2]):
        with pytest.raises(calls.CallError):
            calls.read_review(json.dumps(bad), ["a", "b"])


def test_routes():
    seen = []

    def provider(b, attempt, route):
        seen.append((len(b.cues), attempt, route))
        raise calls.CallError("provider_timeout", "x")

    got = calls.routed(batch(), provider, calls.Policy(max_retries=2, fallback=True))
    assert seen == [(2, 1, "main"), (2, 2, "main"), (2, 3, "main"), (2, 4, "fallback")] and got.answers is None and (got.calls, got.fallback_calls, got.retries) == (4, 1, 3)
    assert calls.routed(batch(), provider, calls.Policy(max_retries=0)).calls == 1


def test_splits_stop_after_two_levels():
    sizes = []

    def provider(b, attempt, route):
        sizes.append(len(b.cues))
        return "[]"

    got = calls.executed(batch(8), provider, calls.Policy(max_retries=0), 2)
    assert sizes == [8, 4, 2] and got.answers is None and got.error == "schema_mismatch"


def test_halves_keep_the_order_and_the_context():
    def provider(b, attempt, route):
        assert [c["cue_id"] for c in b.after] == ["c90"]
        return "oops" if len(b.cues) > 2 else calls.offline(b, attempt, route)

    got = calls.executed(batch(5), provider, calls.Policy(max_retries=1), 7)
    assert list(got.answers) == [f"c{i}" for i in range(1, 6)] and got.route == "shrink" and got.error == "invalid_json" and got.split_attempt == 1
    assert got.attempts == 2 + 1 + 4 and got.children[:2] == (7, 8)


def test_provider_bodies():
    body = json.dumps({"choices": [{"message": {"content": "hi"}}]})
    assert calls.body_content(body + "\n\ndata: [DONE]\n") == "hi"
    for bad, kind in (("x", "provider_request_failed"), (body + " more", "provider_request_failed"), ('{"choices": []}', "provider_missing_choices"), ('{"choices": [{"message": {"content": 5}}]}', "provider_missing_choices")):
        with pytest.raises(calls.CallError) as e:
            calls.body_content(bad)
        assert e.value.kind == kind


def test_settings(tmp_path):
    env = tmp_path / "env"
    env.write_text("# x\nTRANSLATION_MODEL='m'\nTRANSLATION_BATCH_SIZE=7\nTRANSLATION_CACHE=off\n")
    got = config.resolved({"batch_size": 9, "mode": None}, env=env, environ={"TRANSLATION_MODEL": "", "TRANSLATION_QA": "OFF"})
    assert (got.model, got.batch_size, got.cache_enabled, got.qa_mode) == ("deepseek-chat", 9, False, "none")
    assert config.resolved(env=env, environ={}).model == "m"
    for bad in ({"batch_size": 0}, {"mode": "x"}, {"temperature": 3}, {"target_lang": "a b"}, {"output_dir": "a", "output_path": "b"}, {"structured_output": 1}, {"adaptive_concurrency_max": 0}, {"preprocess_auto_subs": True, "auto_sub_source_mode": "full_vtt_window"}):
        with pytest.raises(ValueError):
            config.Settings(**bad)
    with pytest.raises(ValueError):
        config.read_value("batch_size", "x")
    shown = config.Settings(api_key="k", base_url="http://u:p@a@h/v1").shown()
    assert "api_key" not in shown and shown["base_url"] == "http://<redacted>@h/v1"
    assert config.output_paths("/a/b.srt", config.Settings())["translated_srt"] == "/a/translated/translated.zh-CN.srt"
    assert config.Source("full_vtt_window", "x", 500, 900, 1000, 50).window == (0, 950)
    for bad in (("other", "x"), ("single_file", None), ("full_vtt_window", "x"), ("single_file", "x", 5, 5)):
        with pytest.raises(ValueError):
            config.Source(*bad)
    assert config.download_settings({}, {"MAX_VIDEO_HEIGHT": " "}, {"OUTPUT_DIR": "o"})["output_dir"] == "o"


def test_files(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nhi\r\n".encode())
    (tmp_path / "b.VTT").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nyou\n")
    got = files.read_subtitles(spark, str(tmp_path)).orderBy("video_id").collect()
    assert [(r.source, r.start_ms) for r in got] == [("hi", 1000), ("you", 1000)]
    bad = spark.createDataFrame([("x.srt", "7\nno timing")], "video_id string, content string")
    with pytest.raises(Exception, match="malformed"):
        files.accepted(files.parse(bad)).collect()
    out = str(tmp_path / "out")
    table = spark.createDataFrame([("v", "a\nb\n")], "video_id string, text string")
    files.write_artifacts({"one": table}, out)
    with pytest.raises(FileExistsError):
        files.write_artifacts({"one": table}, out)
    assert spark.read.text(out + "/one", wholetext=True).first().value == "a\nb\n"
    lines = spark.createDataFrame([("a = 'x'",), ("# c",), ("nothing",), ("b=1=2",)], "value string")
    assert sorted((r.key, r.value) for r in files.settings(lines).collect()) == [("a", "x"), ("b", "1=2")]


def test_scalars(spark):
    row = spark.range(1).select(
        timecode.seconds_text(F.lit(1425.678), hours=False).alias("a"), timecode.seconds_text(F.lit(5025.678), comma=True).alias("b"), timecode.time_range(F.lit("01:30:00-01:33:15")).alias("c"),
        timecode.seconds_of(F.lit("00:01,5")).alias("d"), text.subtitle_format(F.lit("/a/B.Srt")).alias("e"), text.truth(F.lit(" ON ")).alias("f"), prompts.quoted_ascii(F.lit('é"😀')).alias("g"),
        files.vtt_to_srt(F.lit("WEBVTT\n\nNOTE x\n\n00:00:01.000 --> 00:00:02.000 align:start\n<v A>hi</v>\n")).alias("h"), files.preferred_subtitle(F.array(F.lit("x.vtt"), F.lit("y.en.vtt"))).alias("i"),
    ).first()
    assert row.a == "23:45.678" and row.b == "01:23:45,678" and tuple(row.c) == (5400.0, 5595.0) and row.d is None and row.e == "srt" and row.f is True
    assert row.g == json.dumps('é"😀') and row.h == "00:00:01,000 --> 00:00:02,000\nhi\n" and row.i == "y.en.vtt"


def test_proposals():
    assert semantic.read_proposal('{"segments": [{"start_token": "0", "end_token": 3.9}]}')[0] == [(0, 3, None)]
    for bad in ("x", "[]", "{}", '{"segments": 1}', '{"segments": [1]}', '{"segments": [{"start_token": 0}]}', '{"segments": [{"start_token": null, "end_token": 1}]}'):
        assert semantic.read_proposal(bad)[1].startswith("parse_error")
    assert semantic.read_proposal('{"segments": [{"start_token": 0, "end_token": 1, "tokens": []}]}')[2] == "forbidden_text_fields: ['tokens']"


def test_refined_units_and_their_limits(spark):
    words = spark.createDataFrame([(v, i, 1 + i // 4, i % 4, f"w{i}", i * 1000, i * 1000 + 900, i, "w", True) for v in (1, 2, 3) for i in range(8)], "video_id int, pos long, cue_index long, token_index long, text string, token_start long, token_end long, place long, normalized string, intersects_clip boolean")
    good, long = '{"segments": [{"start_token": 0, "end_token": 3}, {"start_token": 3, "end_token": 8}]}', '{"segments": [{"start_token": 0, "end_token": 8}]}'
    payloads = spark.createDataFrame([(1, good), (2, long), (3, "x")], "video_id int, payload string")
    options = semantic.Options(max_chars=100, max_duration_ms=5000, min_duration_ms=3000)
    read = semantic.proposals(payloads)
    reasons = {r.video_id: r.reason for r in semantic.faults(read, words, options).collect()}
    assert reasons[1] is None and reasons[2] == "V15: segment 0 exceeds hard max duration (7900 > 7500)" and reasons[3].startswith("parse_error")
    assert [r.unit_id for r in semantic.short_segments(read, words, options).filter("video_id = 1").collect()] == ["s001"]
    labelled = semantic._words_of(semantic.segment_rows(read).filter("video_id = 1"), words)
    spans = [tuple(r)[2:] for r in semantic.spans(labelled).orderBy("start").collect()]
    assert spans == [(0, 3, 1, 0, 3), (3, 4, 1, 3, 4), (4, 8, 2, 0, 4)]
