"""Golden rows and randomised comparisons with plain Python models."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil import api
from sparkveil.functions import lookups, textpii
from sparkveil.operators import boxes, parsers, pixels, speech, summary, tracks
from sparkveil.sources import readers
from sparkveil.streaming import streams


def kinds(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(textpii.find_pii(F.col("t")).alias("h")).first()
    return [(h.kind, h.text) for h in row.h]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Card 4242 4242 4242 4242, SSN 078-05-1120, mail test@example.com, call 415-555-2671", ["credit card number", "ssn", "email", "phone number"]),
        ("Order 1234567890123456 shipped on 2026-10-05", []), ("666-05-1120", []), ("2026-08-26 -30.920099 146.96307E speed 42", ["gps coordinates"]), ("999.1234 37.774929 -122.419418", ["gps coordinates"]),
        ("total 12.99 and 45.00 due", []), ("GPS 0.0000 0.0000 no fix", []), ("value 91.12345 and 200.12345", []), ("version 1.2.3456 build 7.8.9012", []), ("", []), (None, []), ("x\x01\x02 a@b.co", ["email"]),
    ],
)
def test_text_kinds(spark, text, want):
    assert [k for k, _ in kinds(spark, text)] == want


def test_gps_spans(spark):
    assert kinds(spark, "at 37.774929 -122.419418 now") == [("gps coordinates", "37.774929 -122.419418")]
    assert kinds(spark, "1.2345 37.774929 -122.419418") == [("gps coordinates", "1.2345 37.774929 -122.419418")]


def test_matches_like_finditer(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("1234-5 6.é+()x@") for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, t string")
    for p in (textpii.CARD, textpii.SSN, textpii.PHONE, textpii.EMAIL):
        got = {x.i: [(m.start, m.text) for m in x.m] for x in df.select("i", textpii.matches(F.col("t"), p).alias("m")).collect()}
        for i, t in rows:
            assert got[i] == [(m.start(), m[0]) for m in re.finditer(p, t, re.ASCII)], (p, t)


def test_masking(spark):
    text = "pay 4242 4242 4242 4242 or 415-555-2671, mail a@b.co"
    f = spark.createDataFrame([(text,), ("plain",), (None,)], "t string").withColumn("h", textpii.find_pii(F.col("t")))
    out = [r.m for r in f.select(textpii.mask(F.col("t"), F.col("h")).alias("m")).collect()]
    assert out[1:] == ["plain", None]
    m = re.fullmatch(r"pay (4242(?: \d{4}){3}) or (555-01\d\d), mail person@example.com", out[0])
    assert m and m[1] != "4242 4242 4242 4242"
    assert spark.range(1).select(textpii.luhn_ok(F.lit(m[1])).alias("x")).first().x


def test_severity_order(spark):
    names = ["zip code", "surface", "Passport", "thing", "software", "gps coordinates", "license plate"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(lookups.severity(F.col("n")).alias("s")).collect()]
    assert got == ["high", "high", "critical", "medium", "low", "high", "medium"]


def track(spark, frames, key="a:0"):
    return spark.createDataFrame([("m", key, f) for f in frames], "media_id string, track_key string, frame int").withColumn("origin", F.lit("detected"))


@pytest.mark.parametrize("frames, carry, total, want", [([0], 3, 10, [0, 1, 2, 3]), ([0, 5], 3, 7, [0, 5, 6]), ([0, 4], 3, 5, [0, 1, 2, 3, 4]), ([2, 9], 0, 10, [2, 9])])
def test_carry(spark, frames, carry, total, want):
    assert sorted(r.frame for r in tracks.carry_forward(track(spark, frames), carry, total).collect()) == want


def test_fill_and_gaps(spark):
    assert sorted(r.frame for r in tracks.fill_gaps(track(spark, [0, 2])).collect()) == [0, 1, 2]
    assert sorted(r.frame for r in tracks.fill_gaps(track(spark, [0, 5])).collect()) == [0, 5]
    assert [(r.gap_start, r.gap_end, r.gap_len) for r in tracks.coverage_gaps(track(spark, [0, 10]), 2).collect()] == [(1, 9, 9)]


def test_smoothing_keeps_frames_and_adds_majorities(spark):
    r = random.Random(6)
    seqs = [[r.random() < 0.5 for _ in range(r.randint(1, 9))] for _ in range(60)]
    unit = "array(named_struct('x1', 0, 'y1', 0, 'x2', 1, 'y2', 1))"
    df = spark.createDataFrame([(str(k), i, bool(b)) for k, s in enumerate(seqs) for i, b in enumerate(s)], "media_id string, frame int, b boolean")
    got = {}
    for x in tracks.smooth(df.select("media_id", "frame", F.expr(f"if(b, {unit}, slice({unit}, 1, 0))").alias("boxes"))).collect():
        got[int(x.media_id), x.frame] = bool(x.boxes)
    for k, s in enumerate(seqs):
        for i in range(len(s)):
            near = s[max(0, i - 1) : i + 2]
            assert got[k, i] == (s[i] or sum(near) / len(near) >= 0.5), (s, i)


@pytest.mark.parametrize("pattern, yes, no", [("person:*", ["person:0"], ["Person:0", "xperson:0"]), ("a?c", ["abc"], ["ac"]), ("[!a]x", ["bx"], ["ax"]), ("a.b+", ["a.b+"], ["axb"]), ("[a-c]", ["b"], ["d"])])
def test_globs(pattern, yes, no):
    p = re.compile(tracks.glob_pattern(pattern))
    assert all(p.search(x) for x in yes) and not any(p.search(x) for x in no)


def test_selection(spark):
    keys = spark.createDataFrame([("person:0",), ("person:1",), ("face:0",)], "track_key string")
    got = {r.track_key: r.decision for r in tracks.select_tracks(keys, ["person:*"], ["person:1"]).collect()}
    assert got == {"person:0": "kept", "person:1": "kept", "face:0": "redacted"}
    assert [r.pattern for r in tracks.unmatched_patterns(keys, ["missing:*"], ["face:*"]).collect()] == ["missing:*"]


def test_summary_and_gate(spark):
    t = spark.createDataFrame([("m", "face:0", 0), ("m", "face:0", 1), ("m", "pii:credit card number:1", 1)], "media_id string, track_key string, frame int")
    s = summary.summaries(t, 4).first()
    assert (s.elements_found, s.critical, s.high, s.frames_with_elements) == (2, 1, 1, 2) and s.elements[0].severity == "critical"
    code = spark.createDataFrame([("m", f"code:code:{k}", f) for k in (0, 1) for f in range(10 * k, 10 * k + 10)], "media_id string, track_key string, frame int")
    assert summary.summaries(code, 20).first().exposure_score == 6.0
    e = summary.elements(code, 20).withColumn("error", F.lit(None).cast("string"))
    assert summary.gate(e, "critical").first().exit_code == 0 and summary.gate(e, "high").first().exit_code == 1
    assert summary.gate(e.withColumn("error", F.lit("x")), "critical").first().exit_code == 2


def test_speech_merge(spark):
    rows = [("m", "a", 0.0, 1.0, "x"), ("m", "a", 1.0, 2.0, "y"), ("m", "b", 2.5, 3.0, "z"), ("m", "a", 9.0, 9.5, "w")]
    hits = spark.createDataFrame(rows, "media_id string, kind string, start double, end double, text string")
    got = sorted((r.kind, r.start, r.end, r.text) for r in speech.merge_intervals(hits, 0.25).collect())
    assert got == [("a", 8.75, 9.75, "w"), ("b", 0.0, 3.25, "x / z")]


def test_token_goldens(spark):
    b = lambda x: f"<|box;x1={x};y1=0;x2={x + 9};y2=9;w=9;h=9|>"
    rows = [("a", f"<0f>0{b(0)}<3f>1{b(20)}{b(40)}"), ("b", f"{b(1)}{b(2)}"), ("c", f"<0f>0{b(0)}<|mask;x=0;y=0;data=abc|>"), ("d", f"<2f>5{b(0)}<|mask;x=0;y=0;data=4,6,AAA|>")]
    got = {}
    for r in parsers.parse_tokens(spark.createDataFrame(rows, "media_id string, text string")).orderBy("seq").collect():
        got.setdefault(r.media_id, []).append((r.track_id, r.frame, r.mask_payload))
    assert got == {"a": [("0", 0, None), ("1", 3, None), ("2", 3, None)], "b": [("0", 0, None), ("1", 0, None)], "c": [("0", 0, None)], "d": [("5", 2, "AAA")]}


def test_tracker(spark):
    t = boxes.Tracker()
    assert t.frame([(0, 0, 10, 10), (100, 100, 120, 120)]) == [0, 1]
    assert t.frame([(1, 1, 11, 11), (200, 200, 210, 210)]) == [0, 2]


def test_tracker_stream_is_the_batch(spark, tmp_path):
    r = random.Random(8)
    rows = [(str(i % 3), "p", f, s, x := r.randint(0, 60), y := r.randint(0, 60), x + 20, y + 20) for i in range(3) for f in range(20) for s in range(3)]
    df = spark.createDataFrame(rows, "media_id string, phrase string, frame int, seq int, x1 int, y1 int, x2 int, y2 int")
    for k in (0, 1):
        df.where(f"frame >= {10 * k} and frame < {10 * k + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    q = streams.tracker_stream(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted(tuple(x) for x in d.collect())
    assert key(spark.table("tracked")) == key(boxes.track_boxes(df))


def test_matching_is_greedy(spark):
    truth = spark.createDataFrame([("m", 0, 0, 0, 0, 10, 10), ("m", 0, 1, 1, 0, 11, 10), ("m", 1, 0, 0, 0, 10, 10)], "media_id string, frame int, seq int, x1 int, y1 int, x2 int, y2 int")
    found = spark.createDataFrame([("m", 0, 0, 1, 0, 11, 10), ("m", 7, 0, 0, 0, 10, 10)], truth.schema)
    got = sorted((r.frame, r.seq, r.hit) for r in boxes.match_boxes(truth, found).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 0, False)]
    assert boxes.recall(boxes.match_boxes(truth, found)).first().recall == 0.3333


def test_kernels_and_boxes(spark):
    sizes = [(20, 21), (34, 21), (82, 21), (170, 21), (900, 21), (30, 101)]
    got = [r.k for r in spark.createDataFrame(sizes, "s int, b int").select(boxes.blur_kernel(F.col("s"), F.col("b")).alias("k")).collect()]
    assert got == [21, 41, 81, 161, 301, 101]
    c = lambda *v: boxes.clean_box(*[F.lit(x) for x in v], F.lit(30), F.lit(50))
    r = spark.range(1).select(c(-5.0, 3.2, 25.6, 40.0).alias("a"), c(5.0, 1.0, 5.0, 9.0).alias("b"), c(40.0, 1.0, 45.0, 9.0).alias("c")).first()
    assert tuple(r.a) == (0, 3, 26, 40) and r.b is None and r.c is None


def test_pixels(spark):
    r = np.random.default_rng(1)
    frame = r.integers(0, 255, (40, 40, 3)).astype(np.uint8)
    box = [{"x1": 5, "y1": 5, "x2": 30, "y2": 30}]
    for mode in ("blur", "pixelate", "fill"):
        out = pixels.cover(frame, box, mode, 21)
        assert (out[:5] == frame[:5]).all() and (out[:, 30:] == frame[:, 30:]).all()
        assert pixels.sharpness(out[6:29, 6:29, 0]) < 0.4 * pixels.sharpness(frame[6:29, 6:29, 0])


def test_transcript_and_probe(spark):
    rows = [("a", '{"segments": [{"words": [{"word": " Hi, ", "start": 0.0, "end": 0.2}, {"word": "--", "start": 1, "end": 2}, {"word": "x"}]}]}'), ("b", '{"words": [{"word": "yo", "start": "1", "end": "2"}], "segments": [{"words": [{"word": "no", "start": 0, "end": 1}]}]}'), ("c", "broken")]
    got = sorted((r.media_id, r.word, r.start) for r in readers.transcript_words(spark.createDataFrame(rows, "media_id string, json string")).collect())
    assert got == [("a", "Hi", 0.0), ("b", "yo", 1.0)]
    p = spark.createDataFrame([('{"streams": [{"codec_type": "video", "width": 4, "height": 2, "r_frame_rate": "30000/1001", "duration": "2.0"}, {"codec_type": "audio"}]}',), ('{"streams": [{"codec_type": "video", "r_frame_rate": "1/0", "nb_frames": "60"}]}',)], "probe_json string")
    a, b = readers.probe(p).collect()
    assert a.has_audio and a.frame_count == 59 and not b.has_audio and b.fps == 30.0 and b.duration == 2.0


def test_api(spark):
    d = track(spark, [0, 1, 5]).withColumn("boxes", F.expr("array(named_struct('x1', 1, 'y1', 1, 'x2', 3, 'y2', 3))"))
    texts = spark.createDataFrame([("m", "mail a@b.co")], "media_id string, text string")
    out = api.audit(detections=d, texts=texts, total_frames=8, keep=["zzz"], fail_on="low")
    assert out["text_findings"].count() == 1 and out["gate"].first().exit_code == 1 and out["rollup"].first().files_processed == 1
    red = api.redact(texts=texts, detections=d, total_frames=8, width=10, height=10)
    assert red["texts"].first().text == "mail person@example.com" and red["masks"].count() == 8
    assert api.doctor(spark).where("area = 'core' and not ok").count() == 0
    with pytest.raises(ValueError):
        api.audit(nope=1)


def test_plans_push_down(spark):
    from sparkveil.plans import catalogue
    from tests.conftest import SF

    plan = catalogue.QUERIES["pii_counts_by_source"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan and "Python" not in plan


def test_tracker_like_a_plain_one():
    r = random.Random(12)

    def iou(a, b):
        inner = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner
        return inner / union if union > 0 else 0.0

    t, last = boxes.Tracker(), {}
    for _ in range(300):
        frame = [(x, y, x + 6, y + 6) for x, y in ((r.randint(0, 12), r.randint(0, 12)) for _ in range(r.randint(0, 4)))]
        used, want = set(), []
        for b in frame:
            best, found = 0.3, None
            for k, s in last.items():
                if k not in used and iou(s, b) >= best:
                    best, found = iou(s, b), k
            found = len(last) if found is None else found
            last[found] = b
            used.add(found)
            want.append(found)
        assert t.frame(frame) == want


def test_spaced_digits_are_not_passed_over(spark):
    texts = ["4 2 4 2 4 2 4 2 4 2 4 2 4 2 4 2", "4-2-4-2-4-2-4-2-4-2-4-2-4-2-4-2", "(415) 555-2671", "0.0001 0.0002", "a 1 b 2 c 3"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    got = {r.id: [h.kind for h in r.h] for r in df.select("id", textpii.find_pii(F.col("text")).alias("h")).collect()}
    assert got == {0: ["credit card number"], 1: ["credit card number"], 2: ["phone number"], 3: ["gps coordinates"], 4: []}


def test_stand_ins_keep_their_format(spark):
    import re

    keys = ["license plate:1", "house number:2", "pii:credit card number:3", "pii:phone number:4", "pii:ssn:5", "face:1", "screen:0", "street sign:9"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: (r.r.action, r.r.text) for r in df.select("k", textpii.replacement(F.col("k")).alias("r")).collect()}
    assert re.fullmatch("[A-HJ-NPR-Z]{3} [0-9]{3}", got[keys[0]][1]) and re.fullmatch("4242( [0-9]{4}){3}", got[keys[2]][1]) and re.fullmatch("555-01[0-9]{2}", got[keys[3]][1])
    assert 12 <= int(got[keys[1]][1]) <= 9899 and 12 <= int(got[keys[7]][1]) <= 9899
    assert got[keys[4]] == ("patch", "000-00-0000") and got[keys[5]] == ("avatar", None) and got[keys[6]] == ("fill", None)


def test_options_that_conflict():
    import pytest

    from sparkveil.functions.lookups import check_options

    known = ["mode", "strength", "backend", "provider", "local", "location_audit", "carry_frames"]
    for bad in ({"strength": 0}, {"provider": "sam", "backend": "local"}, {"provider": "yunet", "backend": "api"}, {"local": True, "backend": "hosted"}, {"location_audit": True, "local": True}, {"carry_frames": -1}, {"mode": "x"}, {"nope": 1}):
        with pytest.raises(ValueError):
            check_options(bad, known)
    assert check_options({"provider": "sam", "backend": "api"}, known)


def test_replaced_pixels_and_sheet():
    import numpy as np

    from sparkveil.operators import pixels

    frame = np.full((40, 60, 3), 100, np.uint8)
    frame[10:20, 10:30] = 7
    box = {"x1": 10, "y1": 10, "x2": 30, "y2": 20}
    assert (pixels.cover(frame, [box], "replace", 21) == 100).all()
    for action in ("avatar", "patch"):
        out = pixels.replace(frame, [box], [action], "face:1")
        assert not (out[10:20, 10:30] == 7).any() and (out[:10] == 100).all() and (out[20:] == 100).all()
    assert pixels.contact_sheet([frame] * 4, width=30).shape == (40, 90, 3)


def test_command_line(spark, tmp_path):
    from sparkveil.__main__ import main

    spark.createDataFrame([("a", "card 4242 4242 4242 4242")], "media_id string, text string").write.parquet(f"{tmp_path}/texts")
    run = lambda out, *more: main(["audit", "--texts", f"{tmp_path}/texts", "--out", f"{tmp_path}/{out}", *more], spark)
    assert run("one") == 0 and run("two", "--fail-on", "high") == 1 and run("two") == 2
    assert main(["redact", "--texts", f"{tmp_path}/texts", "--out", f"{tmp_path}/three"], spark) == 0
    assert "4242 4242 4242 4242" not in spark.read.parquet(f"{tmp_path}/three/texts").first().text


def test_report_files(spark, tmp_path):
    from sparkveil.operators import reports

    df = spark.createDataFrame([("a", "t:1", f) for f in (0, 1, 9)], "media_id string, track_key string, frame int")
    reports.write_lines(reports.coverage_lines(df, 20, 4), f"{tmp_path}/r")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/r/media_id=a").collect()]
    assert lines[0].startswith("Frames: 20") and "t:1: frames 2 to 8, 7 long, NEEDS REVIEW" in lines and lines[-1].startswith("Result: look")


def test_speech_queries_take_all_events(spark):
    """Against plain Python over every event of the table."""
    from sparkveil.plans import catalogue
    from tests.conftest import SF

    events = [r.asDict() for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "user_id", "value").collect()]
    merged = []
    for media in {e["event_type"] for e in events}:
        end = None
        for e in sorted((e for e in events if e["event_type"] == media), key=lambda e: e["event_id"]):
            kind, start, text = f"k{e['user_id'] % 3}", max(0.0, e["event_id"] - 2.5), str(e["event_id"])
            if end is None or start > end:
                merged.append([media, kind, start, e["event_id"] + 3.5, text])
            else:
                merged[-1] = [media, kind, merged[-1][2], e["event_id"] + 3.5, merged[-1][4] + (f" / {text}" if kind != merged[-1][1] else "")]
            end = merged[-1][3]
    got = catalogue.QUERIES["speech_merge_intervals"](spark, SF).select("media_id", "kind", "start", "end", "text").collect()
    assert sorted(map(list, got)) == sorted(merged)
    cut = lambda v: int(v * 29.97)
    got = catalogue.QUERIES["speech_cover_frames"](spark, SF).select("media_id", "first_frame", "last_frame").collect()
    assert len(got) == len(events) and sorted(map(tuple, got)) == sorted((e["event_type"], cut(e["value"]), max(cut(e["value"]), cut(e["value"] + 0.5))) for e in events)


def test_coverage_report_on_odd_events(spark, tmp_path):
    """Hours before 2024 are rounded down, tracks without type or user have no key: as the SQL says."""
    import duckdb

    from sparkveil.plans import catalogue

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    rows = "(0, TIMESTAMP '2023-12-31 23:20:00', 1, 'view', 1.0), (1, TIMESTAMP '2024-01-01 00:20:00', 1, 'view', 1.0), (2, TIMESTAMP '2023-12-30 01:00:00', 1, 'view', 1.0), (3, TIMESTAMP '2024-01-02', NULL, 'view', 1.0), (4, TIMESTAMP '2024-01-03', 2, NULL, 1.0), (5, NULL, 1, 'view', 1.0)"
    for kind in ("TIMESTAMP", "TIMESTAMPTZ"):
        con.sql(f"CREATE OR REPLACE TABLE events AS SELECT event_id, CAST(ts AS {kind}) AS ts, user_id, event_type, value FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value)")
        (tmp_path / kind).mkdir()
        con.sql(f"COPY events TO '{tmp_path}/{kind}/events.parquet'")
        got = catalogue.QUERIES["coverage_report_rows"](spark, str(tmp_path / kind))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.SQL['coverage_report_rows']})").fetchall()
        assert len(want) == 2 and set(map(tuple, got.collect())) == set(want)


def test_per_frame_masks_take_all_tracks(spark):
    """Against plain Python over the tracks of every event type."""
    from sparkveil.plans import catalogue, inputs
    from tests.conftest import SF

    total, margin = inputs.TOTAL, inputs.MARGIN
    held: dict = {}
    for r in inputs.boxed_tracks(spark, SF).collect():
        held.setdefault(r.track_key, {})[r.frame] = tuple(r.boxes[0])
    frames: dict = {}
    for track, at in held.items():
        for gap in (1, 2):  # filled, then carried
            seen = sorted(at)
            for a, b in zip(seen, [*seen[1:], None], strict=True):
                to = b if b is not None and b - a - 1 <= gap else min(a + 3, total) if b is None and gap == 2 else a + 1
                at.update({f: at[a] for f in range(a + 1, to)})
        for f, (x1, y1, x2, y2) in at.items():
            box = max(0, x1 - margin), max(0, y1 - margin), min(100, x2 + margin), min(100, y2 + margin)
            if box[2] > box[0] and box[3] > box[1]:
                frames.setdefault(track.split(":")[0], {}).setdefault(f, set()).add(box)
    want = []
    for media, at in frames.items():
        for f in range(total):
            before, after = at.get(f - 1, set()), at.get(f + 1, set())
            cut = {(max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])) for p in before for q in after}
            more = after if f == 0 else before if f == total - 1 else {c for c in cut if c[2] > c[0] and c[3] > c[1]}
            want.append((media, f, len(at.get(f, set()) | more)))
    got = catalogue.QUERIES["per_frame_masks"](spark, SF).collect()
    assert {m for m, _, _ in want} == set(inputs.KIND_OF) and sorted(map(tuple, got)) == sorted(want)


def test_masks_of_many_boxes(spark):
    """Three frames of 1200 boxes: what neighbours share is found without comparing every two cuts."""
    import threading

    r = np.random.default_rng(3)
    corner = r.integers(0, 82, (3, 1200, 2))
    frames = np.concatenate([corner, corner + 18], 2)
    rows = [("m", f, [tuple(map(int, b)) for b in frames[f]]) for f in range(3)]
    df = spark.createDataFrame(rows, "media_id string, frame int, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    p, q = frames[0][:, None], frames[2]
    cut = np.concatenate([np.maximum(p[..., :2], q[:, :2]), np.minimum(p[..., 2:], q[:, 2:])], 2).reshape(-1, 4)
    want = [np.unique(np.concatenate(x), axis=0).tolist() for x in ((frames[0], frames[1]), (frames[1], cut[(cut[:, 2:] > cut[:, :2]).all(1)]), (frames[2], frames[1]))]
    spark.sparkContext.setJobGroup("many", "many boxes")
    late = threading.Timer(60, lambda: spark.sparkContext.cancelJobGroup("many"))
    late.start()
    try:
        got = {x.frame: [list(b) for b in x.boxes] for x in tracks.smooth(df).collect()}
        many = {x.frame: x.n_boxes for x in tracks.smooth(df, count=True).collect()}
        merged = tracks.merge_frames(df.withColumn("frame", F.lit(0))).first().boxes
    finally:
        late.cancel()
    assert [got[f] for f in range(3)] == want and [many[f] for f in range(3)] == list(map(len, want))
    assert [list(b) for b in merged] == np.unique(frames.reshape(-1, 4), axis=0).tolist()


@pytest.mark.parametrize("few,pairs,marks", [(1 << 12, 1 << 20, 1 << 26), (0, 1 << 20, 1 << 26), (0, 40, 1 << 26), (0, 1 << 20, 0), (1 << 12, 7, 0)])
def test_cut_masks(monkeypatch, few, pairs, marks):
    """Against plain Python, by tables and pair by pair: repeated boxes, no boxes, nothing shared."""
    for name, value in (("FEW_PAIRS", few), ("MOST_PAIRS", pairs), ("MOST_MARKS", marks)):
        monkeypatch.setattr(boxes, name, value)
    r = np.random.default_rng(5)
    for case in range(40):
        own, a, b = (np.concatenate([c := r.integers(-5, 12, (int(r.integers(0, 9)), 2)), c + r.integers(1, 6, c.shape)], 1) for _ in range(3))
        a = a + 40 * (case % 5 == 0)
        cut = [(max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])) for p in a.tolist() for q in b.tolist()]
        want = sorted({tuple(x) for x in own.tolist()} | {c for c in cut if c[2] > c[0] and c[3] > c[1]})
        assert list(map(tuple, boxes.cut_union(own, a, b).tolist())) == want and boxes.cut_union(own, a, b, count=True) == len(want)


def test_audit_sums_up_every_layer(spark):
    """Finds of all layers reach summaries and gate; media without any have a row; errors give 2."""
    tracks_ = spark.createDataFrame([("m", "software:0", 0)], "media_id string, track_key string, frame int")
    texts = spark.createDataFrame([("m", "mail a@b.co")], "media_id string, text string")
    tags = spark.createDataFrame([("m", {"location": "x"}), ("n", {"encoder": "y"})], "media_id string, tags map<string,string>")
    words = spark.createDataFrame([("m", i, w, 0.3 * i, 0.3 * i + 0.25) for i, w in enumerate("call 415-555-2671 now".split())], "media_id string, pos int, word string, start double, end double")
    none = spark.createDataFrame([("quiet",)], "media_id string")
    out = api.audit(detections=tracks_, texts=texts, transcript=words, tags=tags, media=none, total_frames=20, fps=10.0, fail_on="high")
    got = {r.media_id: r for r in out["summaries"].collect()}
    assert set(got) == {"m", "n", "quiet"} and got["m"].elements_found == 4 and (got["m"].high, got["m"].low) == (3, 1) and got["quiet"].elements_found == 0 and got["quiet"].elements == []
    assert got["m"].frames_with_elements == 20 and out["gate"].first().exit_code == 1 and out["rollup"].first().files_processed == 3
    assert api.audit(texts=texts, fail_on="critical")["gate"].first().exit_code == 0 and api.audit(texts=texts, fail_on="high")["gate"].first().exit_code == 1
    bad = spark.createDataFrame([("broken", "no such file")], "media_id string, error string")
    out = api.audit(texts=texts, errors=bad, fail_on="critical")
    assert out["gate"].first().exit_code == 2 and out["rollup"].first().files_failed == 1 and {r.media_id for r in out["files"].collect()} == {"m", "broken"}
    assert api.audit() == {}


def test_audit_of_photos_recordings_and_codes(spark):
    ocr = spark.createDataFrame([("m", 0, 1, 1, 1, 0, "a@b.co", 90.0, 1, 1, 9, 9)], "media_id string, frame int, block int, par int, line int, pos int, word string, conf double, x1 int, y1 int, x2 int, y2 int")
    lines = readers.group_words(ocr)
    codes = spark.createDataFrame([("m", 0, 0, (2, 2, 6, 6))], "media_id string, frame int, seq int, box struct<x1:int,y1:int,x2:int,y2:int>")
    photo = api.audit(ocr=lines, codes=codes, kind="photo", fail_on="high")
    assert sorted(e.track for e in photo["summaries"].first().elements) == ["code:1", "pii:email:1"] and photo["summaries"].first().share_of_frames == 1.0
    words = spark.createDataFrame([("r", 0, "415-555-2671", 0.0, 1.0)], "media_id string, pos int, word string, start double, end double")
    heard = api.audit(transcript=words, kind="audio", fail_on="high")
    assert "gaps" not in heard and heard["summaries"].first().high == 1 and heard["summaries"].first().share_of_frames == 0.0
    red = api.redact(ocr=lines, codes=codes, total_frames=12, width=20, height=20, mask_margin=0)
    secure = {r.frame: r.boxes for r in red["secure_masks"].collect()}
    assert len(secure) == 12 and [tuple(b) for b in secure[0]] == [(2, 2, 6, 6)] and len({r.frame: r.boxes for r in red["masks"].collect()}[0]) == 2


def test_secure_boxes_are_filled_first(spark):
    frame = np.random.default_rng(3).integers(0, 255, (30, 30, 3)).astype(np.uint8)
    df = spark.createDataFrame([(30, 30, bytearray(frame.tobytes()), [(5, 5, 20, 20)], [(5, 5, 20, 20)])], "height int, width int, pixels binary, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>, secure array<struct<x1:int,y1:int,x2:int,y2:int>>")
    out = np.frombuffer(pixels.cover_frames(df, "pixelate", 4).first().pixels, np.uint8).reshape(30, 30, 3)
    assert (out[8:16, 8:16] == 0).all() and (out[:5] == frame[:5]).all()


def test_parsers_read_fields_one_by_one(spark):
    rows = [("a", '{"box": [1.7, "2", 3, 4], "frame": "3"}\n{"frame": 2.9, "box": [1, null, 3, 4]}\n{"frame": null}\n[1]'), ("b", "")]
    got = [tuple(r)[1:] for r in parsers.parse_json_lines(spark.createDataFrame(rows, "media_id string, text string"), width=64, height=48).orderBy("seq").collect()]
    assert got == [(0, 3, "0", 1, 2, 3, 4), (1, 2, "0", 0, 0, 64, 48), (2, 0, "0", 0, 0, 64, 48)]
    verdicts = {
        '{"lat": 1, "lon": 2}': ("ok", 0.0, []), '{"lat": "1.5", "lon": "-2", "confidence_25km": 80, "cues": "one"}': ("ok", 0.8, ["one"]), '{"lat": 1, "lon": 2, "city": 5}': ("failed", None, None), '{"lat": 1, "lon": 2, "cues": {"a": 1}}': ("failed", None, None),
        '{"lat": 1, "lon": 2, "confidence_25km": 101}': ("failed", None, None), '{"lat": "NaN", "lon": 2}': ("failed", None, None), '{"lat": 1}': ("failed", None, None), "{": ("failed", None, None), "": ("failed", None, None), '{"lat": 1, "lon": 2, "country": null}': ("failed", None, None),
    }
    df = spark.createDataFrame([(t,) for t in verdicts], "t string").select("t", parsers.parse_verdict(F.col("t")).alias("v"))
    assert {r.t: (r.v.status, r.v.confidence, r.v.cues) for r in df.collect()} == verdicts
    reply = '{"output": [{"content": [{"text": "a"}, {}]}, {"content": [{"text": "b"}]}]}'
    assert [r.x for r in spark.createDataFrame([(reply,), ('{"output_text": "c"}',)], "t string").select(parsers.verdict_text(F.col("t")).alias("x")).collect()] == ["a\nb", "c"]


def test_event_streams(spark):
    streams_ = {
        "a": ['data: {"type": "response.output_text.delta", "delta": "one "}', "", 'data: {"type": "other", "delta": "two"}', 'data: {"type": "response.completed", "response": {"output": [{"content": [{"text": "late"}]}]}}', "data: [DONE]", "data: no"],
        "b": ['data: {"type": "ping"}', 'data: {"type": "response.completed", "response": {"output": [{"content": [{"text": "whole"}, {"text": "not"}]}]}}', 'data: {"type": "x", "text": "!"}'],
        "c": ["raw", 'data: {"type": "response.output_text.delta", "delta": 5}', '{"output": [{"content": [{"text": "x"}, {"text": "y"}]}]}'], "d": ["data: [DONE]"],
    }
    rows = [(k, i, x) for k, v in streams_.items() for i, x in enumerate(v)]
    got = {r.media_id: r.text for r in parsers.parse_events(spark.createDataFrame(rows, "media_id string, pos int, line string")).collect()}
    assert got["a"] == "one two" and got["b"] == "whole!" and got["c"] == "rawxy" and got.get("d", "") == ""


def test_long_texts_without_addresses_take_linear_time(spark):
    """A megabyte of address characters without an @, and thousands of addresses in one text."""
    import time

    df = spark.createDataFrame([(0, "a" * (1 << 20)), (1, " ".join(f"u{i}@example.com" for i in range(3000))), (2, "a@b.com.x@y.org q@r.st@u.vw")], "id int, text string")
    began = time.perf_counter()
    got = {r.id: r.h for r in df.select("id", textpii.find_pii(F.col("text")).alias("h")).collect()}
    assert time.perf_counter() - began < 60
    assert got[0] == [] and len(got[1]) == 3000 and [h.text for h in got[2]] == [m[0] for m in re.finditer(textpii.EMAIL, "a@b.com.x@y.org q@r.st@u.vw")]


def test_command_line_options(spark, tmp_path):
    from sparkveil.__main__ import main, options

    spark.createDataFrame([("a", "face:0", 0), ("a", "dog:0", 1)], "media_id string, track_key string, frame int").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([("z", "gone")], "media_id string, error string").write.parquet(f"{tmp_path}/e")
    run = lambda out, *more: main(["audit", "--detections", f"{tmp_path}/d", "--total-frames", "4", "--out", f"{tmp_path}/{out}", *more], spark)
    assert run("one", "--fail-on", "high") == 1 and run("two", "--fail-on", "high", "--target", "dog") == 0 and run("three", "--fail-on", "high", "--errors", f"{tmp_path}/e") == 2
    assert run("four", "--fail-on", "high", "--exclude", "face:*") == 0 and main(["doctor"], spark) == 0 and main(["audit", "--detections", f"{tmp_path}/d"], spark) == 2
    got = options({"preset": "street", "mode": "blur", "strength": 50, "target": None, "add_target": None, "targets_default": None}, spark)
    assert (got["mode"], got["strength"], got["mask_margin"]) == ("pixelate", 50, 16) and got["targets"] == ["person", "face", "license plate"]


def test_a_folder_that_workers_share_is_needed(monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="share"):
        readers.shared_dir(Session(), "x")


def test_tracks_expire():
    t = boxes.Tracker(expire=3)
    assert t.frame([(0, 0, 10, 10)], 0) == [0] and t.frame([(0, 0, 10, 10)], 3) == [0]
    assert t.frame([(0, 0, 10, 10)], 7) == [1] and len(t.last) == 1
    kept = boxes.Tracker()
    assert kept.frame([(0, 0, 10, 10)], 0) == [0] and kept.frame([(0, 0, 10, 10)], 900) == [0]


def test_engines_as_table_functions(spark):
    from sparkveil.sources import adapters

    class Engine:
        def frames(self, path):
            if path == "bad":
                raise OSError("unreadable")
            return [(1, 2, b"abcdef")] * 3

        def words(self, path):
            return [("hi", 0.0, 0.5)]

    media = spark.createDataFrame([("a", "x.mp4"), ("b", "bad")], "media_id string, path string")
    got = adapters.frames(media, Engine()).collect()
    assert [(r.media_id, r.frame, r.width) for r in got if r.error is None] == [("a", i, 2) for i in range(3)] and [r.media_id for r in got if r.error] == ["b"]
    out = api.audit(errors=adapters.frames(media, Engine()).where("error is not null").select("media_id", "error"), media=media, fail_on="low")
    assert out["gate"].first().exit_code == 2 and out["rollup"].first().files_processed == 1
    assert adapters.transcripts(media, Engine()).count() == 2
    body = spark.range(1).select(adapters.request_body(F.lit("face"), F.encode(F.lit("xyz"), "UTF-8"), "m").alias("b")).first().b
    import json

    sent = json.loads(body)
    assert sent["model"] == "m" and sent["input"][0]["content"][1] == {"type": "input_video", "video_url": "data:video/mp4;base64,eHl6"} and sent["input"][0]["content"][0] == {"type": "input_text", "text": "face"}
    sound = readers.probe_sound(spark.createDataFrame([("x", "broken"), ("y", '{"streams": [{"codec_type": "audio"}], "format": {"duration": "2.5"}}')], "media_id string, probe_json string"))
    assert {r.media_id: (r.duration, r.has_audio) for r in sound.collect()} == {"x": (0.0, False), "y": (2.5, True)}


def test_blur_of_small_frames_is_one_matrix_a_side(monkeypatch):
    """The same pixels as mean by mean, without a pass over the frame for each."""
    r = np.random.default_rng(3)
    for h, w, kernel in ((48, 48, 21), (31, 90, 41), (5, 7, 81), (1, 300, 9), (64, 2, 1)):
        frame = r.integers(0, 256, (h, w, 3)).astype(np.uint8)
        got = pixels.blur(frame, kernel)
        with monkeypatch.context() as m:
            m.setattr(pixels, "SMALL", 0)
            assert (pixels.blur(frame, kernel) == got).all()
    frame, calls = np.zeros((48, 48, 3), np.uint8), []
    pixels.blur(frame, 21)
    monkeypatch.setattr(pixels, "_box_mean", lambda *a: calls.append(a))
    pixels.blur(frame, 21)
    assert not calls
