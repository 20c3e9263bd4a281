"""Timed words, trimming, units and their checks on literal cues, and against a plain reading of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from tidecue.operators import units

SCHEMA = "video_id int, cue_index long, source string, start_ms long, end_ms long"


def cues(spark, rows):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], SCHEMA)


def words(spark, rows, kind="vtt", **options):
    got = units.tokenized(cues(spark, rows), kind, **options).orderBy("cue_index").collect()
    return [([(t.text, t.token_start, t.token_end) for t in r.tokens], r.timing, [(w.code, w.severity) for w in r.warnings]) for r in got]


FALL = ("proportional_timing_fallback", "info")


@pytest.mark.parametrize(
    "source, start, end, tokens, timing, warned",
    [
        ("<00:00:00.000><c>hello</c> <00:00:01.500><c>world</c>", 0, 3000, [("hello", 0, 1500), ("world", 1500, 3000)], "vtt_inline", []),
        ("a b <00:00:01.000>c", 0, 2000, [("a", 0, 500), ("b", 500, 1000), ("c", 1000, 2000)], "vtt_inline", []),
        ("a <00:00:01.000>c", 1000, 2000, [("a", 1000, 1500), ("c", 1500, 2000)], "cue_proportional", [("invalid_inline_timing", "info"), FALL]),
        ("<00:00:01.500>a <00:00:01.000>b", 0, 2000, [("a", 0, 1000), ("b", 1000, 2000)], "cue_proportional", [("invalid_inline_timing", "warning"), FALL]),
        ("<00:00:01.000>a b", 0, 2000, [("a", 0, 1000), ("b", 1000, 2000)], "cue_proportional", [("invalid_inline_timing", "warning"), FALL]),
        ("<i>a</i> b", 0, 2000, [("a", 0, 1000), ("b", 1000, 2000)], "cue_proportional", [FALL]),
        ("x", 5, 5, [], "cue_proportional", [("malformed_cue_skipped", "warning")]),
        ("x", 9, 5, [], "cue_proportional", [("malformed_cue_skipped", "warning")]),
        ("", 0, 5, [], "cue_proportional", [FALL]),
        ("a < b <00:01.000>c", 0, 2000, [("a", 0, 1000), ("c", 1000, 2000)], "cue_proportional", [FALL]),
        ("a > b <00:01.000>c", 0, 2000, [("a", 0, 333), (">", 333, 666), ("b", 666, 1000), ("c", 1000, 2000)], "vtt_inline", []),
    ],
)
def test_words_of_a_cue(spark, source, start, end, tokens, timing, warned):
    assert words(spark, [(source, start, end)]) == [(tokens, timing, warned)]


def test_srt_words_and_half_even(spark):
    got = words(spark, [("a b c d", 0, 10), ("<00:00:01.000>x", 0, 10)], "srt", single_file=True)
    assert got[0] == ([("a", 0, 2), ("b", 2, 5), ("c", 5, 8), ("d", 8, 10)], "cue_proportional", [("timing_precision_degraded", "warning")])
    assert got[1][0] == [("x", 0, 10)]


def removed(spark, rows):
    table = units.tokenized(cues(spark, rows), "srt")
    return [(r.n_removed, r.reason) for r in units.trimmed(table).orderBy("cue_index").collect()]


def test_trimming(spark):
    assert removed(spark, [("hello there", 0, 1000), ("hello there", 1020, 2000), ("bridge text", 2000, 3000), ("hello there", 3000, 4000)]) == [(0, None), (2, "duplicate_cue"), (0, None), (0, None)]
    assert removed(spark, [("move on to do a number", 0, 1000), ("to do a number guesser", 1000, 2000)]) == [(0, None), (4, "rolling_overlap")]
    long = "what you can do is go down to the"
    assert removed(spark, [(long, 0, 1000), (long + " description", 1500, 2500)]) == [(0, None), (9, "rolling_overlap")]
    # the state is what trimming left: c d, not a b c d
    assert removed(spark, [("a b", 0, 1000), ("a b c d", 1200, 2000), ("a b c d", 2500, 3000)]) == [(0, None), (2, "rolling_overlap"), (0, None)]
    assert removed(spark, [("one", 0, 1000), ("", 1000, 2000), ("One", 1100, 2000)]) == [(0, None), (0, None), (1, "duplicate_cue")]


def texts(spark, rows, limits=None, kind="srt", clip=None):
    limits = limits or units.Limits()
    active = units.token_table(units.tokenized(cues(spark, rows), kind), limits).filter("pos is not null")
    made = units.units(units.units_of(active, limits), clip)
    return [(r.unit_id, r.source_text, r.forced) for r in made.orderBy("unit_pos").collect()]


def test_strong_phrases_nest(spark):
    assert [t for _, t, _ in texts(spark, [("we are done this next project is fun", 0, 4000)])] == ["we are done", "this", "next project is fun"]
    assert texts(spark, [("that is all for today now we're", 0, 2000), ("going to move on to lists", 2000, 4000)])[1][1].startswith("now we're going to move on")


def brute(tokens, limits, strong):
    """A plain reading: (first, past the last, forced) of each unit of (chars, start, end, cue, dangles)."""
    out, start = [], 0
    while start < len(tokens):
        end, forced, i = len(tokens), False, start
        while i < len(tokens):
            if i > start and strong[i]:
                end = i
                break
            own = tokens[start : i + 1]
            if sum(t[0] for t in own) + len(own) - 1 > limits.chars or own[-1][2] - own[0][1] > limits.duration_ms or len({t[3] for t in own}) > limits.cues:
                good = [k + 1 for k in range(start, i) if not tokens[k][4]]
                edges = [k + 1 for k in range(start, i) if tokens[k + 1][3] != tokens[k][3]]
                end, forced = (good or edges or [max(start + 1, i)])[-1], True
                break
            i += 1
        out.append((start, end, forced))
        start = end
    return out


def test_walk_against_a_plain_reading():
    pick = random.Random(1)
    for _ in range(300):
        limits = units.Limits(chars=pick.randrange(5, 40), duration_ms=pick.randrange(50, 800), cues=pick.randrange(1, 4))
        tokens, cue, at = [], 0, 0
        for _ in range(pick.randrange(1, 60)):
            cue += pick.random() < 0.2
            at += pick.randrange(0, 90) - 20 * (pick.random() < 0.2)
            tokens.append((pick.randrange(1, 12), at, at + pick.randrange(1, 200), cue, pick.random() < 0.5))
        strong = [k > 0 and pick.random() < 0.1 for k in range(len(tokens))]
        got, first = [], 0
        edges = [0, *(k for k in range(1, len(tokens)) if strong[k]), len(tokens)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            for n, forced in units.walk(iter(tokens[lo:hi]), limits):
                got.append((first, first + n, forced))
                first += n
        assert got == brute(tokens, limits, strong)


def test_units_spans_checks_and_stats(spark):
    rows = [("the quick brown fox jumps over", 0, 3000), ("over the lazy dog and", 3000, 5000), ("and runs away okay then", 5000, 9000), ("x", 9000, 9000), ("gone far", 9000, 20000)]
    flagged = cues(spark, rows).withColumn("intersects_clip", F.col("end_ms") > 4000).withColumn("is_padding_only", F.col("end_ms") <= 4000)
    table = units.tokenized(flagged, "srt", single_file=True)
    every, cut = units.token_table(table), units.trimmed(table)
    active = every.filter("pos is not null")
    labelled = units.units_of(active)
    made, of_spans = units.units(labelled, (4000, 8000)), units.spans(labelled)
    assert not units.invalid_units(made, of_spans, active).collect() and not units.invalid_words(active).collect()
    got = made.orderBy("unit_pos").collect()
    assert [r.unit_id for r in got] == [f"u{k + 1:03d}" for k in range(len(got))]
    assert got[0].boundary_type == "crosses_clip_start" and got[0].source_cues[0] == 1
    assert sum(r.n_words for r in got) == active.count()
    warned = units.warnings_of(table, cut, made)
    one = units.stats(table, cut, every, made, warned).first()
    assert (one.extracted_cues, one.removed_overlap_tokens, one.units) == (5, 2, len(got))
    broken = of_spans.withColumn("end", F.col("end") - 1)
    assert {r.reason for r in units.invalid_units(made, broken, active).collect()} >= {"missing coverage"}
    twice = of_spans.union(of_spans)
    assert {r.reason for r in units.invalid_units(made, twice, active).collect()} == {"duplicate assignment"}


def test_more_words_than_milliseconds(spark):
    active = units.token_table(units.tokenized(cues(spark, [("a b c d", 0, 2)]), "srt")).filter("pos is not null")
    assert units.invalid_words(active).count() == 2


def test_limits():
    with pytest.raises(ValueError):
        units.Limits(chars=0)


@pytest.mark.parametrize("kind", ["srt", "vtt"])
def test_one_pass_over_cues_gives_what_tables_of_words_give(spark, kind):
    pick = random.Random(2)
    some = ["the", "and", "okay", "next", "project", "so", "now", "we're", "going", "fox", "<i>jumps</i>", "of", "<00:00:02.000>", "over", "--"]
    rows = []
    for video in range(6):
        said = [" ".join(pick.choice(some) for _ in range(pick.randrange(0, 12))) for _ in range(30)]
        for k in range(1, 30):
            if pick.random() < 0.3:
                said[k] = said[k - 1] if pick.random() < 0.5 else " ".join([*said[k - 1].split()[-3:], said[k]])
        rows += [(video, k + 1, x, k * 1000, k * 1000 + pick.choice((-5, 3, 900, 1000, 4000))) for k, x in enumerate(said)]
    limits, clip = units.Limits(chars=40, duration_ms=3000, cues=3), (4000, 12000)
    flagged = spark.createDataFrame(rows, SCHEMA).withColumn("intersects_clip", (F.col("end_ms") > clip[0]) & (F.col("start_ms") < clip[1]))
    table = units.tokenized(flagged, kind, single_file=True)
    every, cut = units.token_table(table, limits), units.trimmed(table, limits)
    active = every.filter("pos is not null")
    labelled = units.units_of(active, limits)
    made, of_spans = units.units(labelled, clip), units.spans(labelled).drop("run")
    found = units.segments(flagged.repartition(3), kind, limits, single_file=True)
    same = lambda a, b: sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))
    assert same(units.segment_table(found, clip), made) and same(units.segment_spans(found), of_spans)
    assert same(found.filter("cue_index is not null"), cut)
    runs = found.filter("cue_index is not null and start < end")
    assert same(runs, units.word_runs(active))
    assert same(units.segment_stats(found), units.stats(table, cut, every, made, units.warnings_of(table, cut, made)))
    wrong = of_spans.withColumn("end", F.col("end") - (F.col("start") % 5 == 0).cast("int")).withColumn("cue_index", F.col("cue_index") + (F.col("start") % 7 == 0).cast("int"))
    wrong = wrong.union(of_spans.filter("video_id = 1 and unit_pos = 0")).union(of_spans.filter("video_id = 2").withColumn("end", F.col("end") + 900).limit(1))
    told = units.invalid_units(made, wrong, active)
    assert {r.reason for r in told.collect()} >= {"invalid span", "missing coverage", "duplicate assignment", "span of another cue"}
    assert same(told, units.invalid_units(made, wrong, runs))
    # word by word
    places, covered = {(r.video_id, r.pos): r.cue_index for r in active.collect()}, {}
    for r in wrong.collect():
        for pos in range(r.start, r.end):
            covered.setdefault((r.video_id, pos), []).append((r.unit_pos, r.cue_index))
    lost = {v: max(len(covered.get(p, ())) for p in places if p[0] == v and len(covered.get(p, ())) != 1) for v in {p[0] for p in places if len(covered.get(p, ())) != 1}}
    plain = {(v, None, "duplicate assignment" if n > 1 else "missing coverage") for v, n in lost.items()}
    plain |= {(p[0], u, "span of another cue") for p, own in places.items() for u, c in covered.get(p, ()) if c != own}
    assert {tuple(r) for r in told.collect() if r.reason in ("duplicate assignment", "missing coverage", "span of another cue")} == plain


@pytest.mark.parametrize("name", ["segment_units", "segmentation_stats", "unit_coverage_check", "unit_spans"])
def test_words_are_never_sent(spark, name):
    from tidecue.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(video_id") <= 5 and plan.count("mapInArrow") + plan.count("MapInArrow") <= 2 and "posexplode_outer" not in plan
