"""Literal cases, and plain Python against the folds and grouped operators."""

import math
import re
import time
import random
from difflib import SequenceMatcher
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from reelspan.functions import images as img
from reelspan.functions import markers, names, scoring, timecode
from reelspan.operators import articles, documents, enrich, images, mentions, resolve, segments, sinks, timeline
from reelspan.plans import timeline_slice as plan
from reelspan.sources import annotations, transcripts


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


# ---- scalars ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text,form,ms", [("01:02:03,456", timecode.STRICT, 3723456), ("01:02:03.456", timecode.STRICT, 0), ("01:02:03.456", timecode.EITHER, 3723456), ("01:02:03,456x", timecode.STRICT, 0), ("01:02:03,456x", timecode.PREFIX, 3723456), ("bad", timecode.EITHER, 0)])
def test_timecodes(spark, text, form, ms):
    assert one(spark, timecode.to_ms(F.lit(text), form)) == ms


def test_frames(spark):
    for ms in (0, 20, 60, 100, 499, 500, 12345, 62500):
        assert one(spark, timecode.frames_even(F.lit(ms), 25)) == round(ms * 25 / 1000) == one(spark, timecode.frames_even(F.lit(ms).cast("long"), 25))
        assert one(spark, timecode.frames_down(F.lit(ms), 25)) == ms * 25 // 1000
    assert one(spark, timecode.smpte(F.lit(90061), 25)) == "01:00:02:11"
    assert one(spark, timecode.frame_timecode_to_text(F.lit("00:01:02:12"), 25.0)) == "00:01:02,480"


@pytest.mark.parametrize("kind,n,first,length,score", [("people", 1, 60, 600, 1.1), ("people", 4, 0, 600, 1.2), ("places", 1, 120, 600, 0.33), ("places", 1, 121, 600, 0.3), ("events", 2, 500, 600, 1.17), ("other", 1, 500, 600, 0.5), ("people", 0, 0, 600, 0.0), ("concepts", 3, 0, 0, 0.99)])
def test_priority(spark, kind, n, first, length, score):
    assert one(spark, scoring.priority(F.lit(kind), F.lit(n), F.lit(first), F.lit(length))) == pytest.approx(score)


def test_speakers_and_names(spark):
    assert one(spark, names.strip_speakers(F.lit("Speaker 1\nHello  there\n speaker 22 \nWorld"))) == "Hello there World"
    assert one(spark, names.normalise(F.lit("  100 years later  Great – War - "))) == "Great – War"
    assert one(spark, names.normalise(F.lit("50th anniversary of the Treaty"))) == "the Treaty"
    for name, kind, ok in (("cold war", "events", True), ("some idea", "concepts", False), ("Some idea", "concepts", True), ("...", "people", False), ("two decades", "people", False), ("bob", "people", True)):
        assert one(spark, names.plausible(F.lit(name), F.lit(kind))) is ok
    places = F.array(F.lit("India"))
    for name, kind, vague in (("1947", "events", True), ("1947 elections", "events", True), ("the war", "events", True), ("the long and costly war", "events", False), ("Indian war", "events", False), ("the war", "people", False)):
        assert one(spark, names.vague(F.lit(name), F.lit(kind), places, F.lit("India"))) is vague, name


def test_image_scalars(spark):
    assert one(spark, img.years(F.lit("in 1999, 12000, 2101, 2100 and x1850y"))) == [1999, 2100, 1850]
    assert one(spark, img.image_year(F.lit("<b>2001</b>"), F.lit(None).cast("string"), F.lit("File:Old 1890.jpg"))) == 1890
    assert one(spark, img.blacklisted(F.lit("File:Commons-logo.svg"))) == "commons-logo" and one(spark, img.blacklisted(F.lit("File:Tree.png"))) is None
    assert one(spark, img.symbolic_svg(F.lit("File:X.svg"), F.lit("image/svg+xml"), F.lit("Coat of arms"), F.lit(""))) is True
    assert one(spark, img.license_category(F.lit("x"), F.lit("CC BY 4.0"), F.lit(None).cast("string"), F.lit(""), F.lit(""))) == "cc_by"
    assert one(spark, img.license_category(F.lit("cc-by-2.0"), F.lit(""), F.lit("Fair use only"), F.lit(""), F.lit(""))) == "restricted_nonfree"
    assert one(spark, img.license_category(F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit("true"))) == "other_cc"
    assert one(spark, img.safe_folder(F.lit(' a/b: "c".. '))) == "a_b_ _c_"
    assert one(spark, img.url_name(F.lit("http://h/x/A+b%20c.jpg?x=1"))) == "A+b c.jpg"
    assert one(spark, img.strip_html(F.lit("<i>a</i>&amp;&lt;b&gt;"))) == "a &<b>"
    assert one(spark, img.url_name(F.lit("http://h/x/100%_pure.jpg"))) == "100%_pure.jpg"


def test_marker_labels(spark):
    label = lambda k, a, b: one(spark, markers.label(F.lit(k), F.lit(a), F.lit(b), F.lit("id")))
    assert label("quote", "q" * 51, "") == 'QUOTE: "' + "q" * 47 + '..."'
    assert label("date", "1900", "Fair") == "DATE: 1900 - Fair" and label("number", "5", "") == "NUMBER: 5" and label("x", "", "") == "X: id"


# ---- sources ----------------------------------------------------------------------------------------------------

SRT = """﻿1
00:00:00,000 --> 00:00:03,000
Speaker 1
In this video we'll talk
about relativity.

00:00:03.500 --> 00:00:05.000
No index here.

7
[00:00:05:12 - 00:00:06:00]
Framed.

junk block

[00:00:07:00 - 00:00:08:00]
Bare frames."""


def test_transcript_forms(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT)
    files = transcripts.read_files(spark, str(tmp_path))
    got = [(r["cue_idx"], r["start_tc"], r["end_tc"], r["text"]) for r in transcripts.read_cues(files).orderBy("start_ms").collect()]
    assert got == [
        (1, "00:00:00,000", "00:00:03,000", "In this video we'll talk\nabout relativity."),
        (1, "00:00:03,500", "00:00:05,000", "No index here."),
        (7, "00:00:05,480", "00:00:06,000", "Framed."),
        (2, "00:00:07,000", "00:00:08,000", "Bare frames."),
    ]
    assert [r["cue_idx"] for r in transcripts.read_cues(files, mode="lenient").collect()] == [1]


# ---- contexts ---------------------------------------------------------------------------------------------------


def test_contexts(spark):
    cues = spark.createDataFrame([(1, k, f"t{k}") for k in (1, 2, 3, 5, 6, 20, 21)], "transcript_id long, cue_idx int, text string")
    occ = spark.createDataFrame([(1, "e", 2), (1, "e", 6), (1, "e", 20), (1, "e", 99)], "transcript_id long, entity string, cue_idx int")
    got = enrich.entity_contexts(occ, cues, 3).first()
    assert got["context"] == "t1 t2 t3 t5 t3 t5 t6 [...] t20 t21" and got["islands"] == 2


# ---- folds against loops ----------------------------------------------------------------------------------------


def random_occ(seed, n=120):
    r = random.Random(seed)
    rows, ms = [], 0
    for k in range(n):
        ms += r.choice([0, 0, 300, 2000, 9000])
        rows.append((1, f"e{r.randrange(7)}", "people", ms, k + 1, "s"))
    return rows


OCC = "transcript_id long, entity string, entity_type string, ms long, cue_idx int, surface string"


def test_density_against_loop(spark):
    for seed in range(3):
        rows = random_occ(seed)
        used, want = set(), []
        for i, a in enumerate(rows):
            near = [b for b in rows[i:] if b[3] - a[3] <= 8000]
            kinds, cues = {b[1] for b in near}, {b[4] for b in near}
            if len(kinds) >= 3 and not cues & used:
                used |= cues
                want.append((a[3], a[4], sorted(kinds)))
        got = segments.density_clusters(spark.createDataFrame(rows, OCC)).orderBy("montage_id").collect()
        assert [(r["ms"], r["cue_idx"], r["entities"]) for r in got] == want


def test_gate_against_loop(spark):
    r = random.Random(9)
    cues, items, hints, ms = [], [], [], 0
    for c in range(1, 60):
        ms += r.choice([500, 1500, 4000])
        cues.append((1, c, ms))
        own = [(r.choice(mentions.KINDS), f"N{r.randrange(6)}") for _ in range(r.randrange(0, 4))]
        seen = {k: 0 for k in mentions.KINDS}
        for kind, name in own:
            items.append((1, c, ms, kind, seen[kind], name.lower(), name))
            seen[kind] += 1
        hints.append((1, c, own[-1][1] if own and r.random() < 0.5 else ""))
    want, anchor, primary, names_seen = [], None, False, set()
    for _, c, t in cues:
        if anchor is None or t - anchor >= 5000:
            anchor, primary, names_seen = t, False, set()
        found = {}
        for kind in mentions.KINDS:
            for i in sorted((x for x in items if x[1] == c and x[3] == kind), key=lambda x: x[4]):
                found.setdefault(i[6], kind)
        hint = next(h for _, hc, h in hints if hc == c)
        main = hint if hint in found else next((n for k in mentions.KINDS for n, kk in found.items() if kk == k), None)
        if not primary and main and main not in names_seen:
            want.append((c, main, found[main]))
            primary = True
            names_seen.add(main)
        for n, kind in found.items():
            if kind in ("people", "places") and n not in names_seen:
                want.append((c, n, kind))
                names_seen.add(n)
    got = mentions.emit_mentions(
        spark.createDataFrame(cues, "transcript_id long, cue_idx int, ms long"),
        spark.createDataFrame(items, "transcript_id long, cue_idx int, ms long, kind string, item_seq int, surface string, canonical string"),
        spark.createDataFrame(hints, "transcript_id long, cue_idx int, primary string"),
    )
    assert sorted((x["cue_idx"], x["name"], x["kind"]) for x in got.collect()) == sorted(want)


def test_fuzzy_clusters_against_loop(spark):
    r = random.Random(4)
    words = ["mangal pandey", "pandey", "mangal pande", "rome", "roman empire", "empire", "delhi", "new delhi", "dehli", "anna", "hannah"]
    rows = [(t, "people", w, k) for t in range(3) for k, w in enumerate(r.sample(words, 9))]
    want = []
    for t in range(3):
        own, used = [x[2] for x in rows if x[0] == t], set()
        for a in own:
            if a in used:
                continue
            cluster = [a]
            for b in own:
                if a != b and b not in used and (a in b or b in a or SequenceMatcher(None, a, b).ratio() >= 0.85):
                    cluster.append(b)
                    used.add(b)
            if len(cluster) > 1:
                used.add(a)
                want.append((t, sorted(cluster, key=lambda x: -len(x))))
    got = resolve.fuzzy_clusters(spark.createDataFrame(rows, "transcript_id long, entity_type string, entity string, entity_seq int")).collect()
    assert sorted((x["transcript_id"], x["members"]) for x in got) == sorted(want)


def test_merge_clusters(spark):
    occ = lambda *t: [{"timecode": x, "cue_idx": 1} for x in t]
    rows = [(1, "Mangal Pandey", 0, 0.5, "a b", ["m"], occ("00:01", "00:02")), (1, "pandey", 1, 0.9, "b", ["p"], occ("00:02", "")), (1, "Other", 2, 0.1, "c", [], occ("00:03"))]
    e = spark.createDataFrame(rows, "transcript_id long, entity string, entity_seq int, priority double, context string, aliases array<string>, occurrences array<struct<timecode:string,cue_idx:int>>")
    c = spark.createDataFrame([(1, 0, ["mangal pandey", "PANDEY", "missing"]), (1, 1, ["Other", "gone"])], "transcript_id long, cluster int, members array<string>")
    got = resolve.merge_clusters(e, c).collect()
    assert len(got) == 1
    x = got[0]
    assert (x["canonical"], x["merged_from"], x["aliases"], x["priority"], x["context"]) == ("Mangal Pandey", ["pandey"], ["m", "p", "pandey"], 0.9, "a b")
    assert [o["timecode"] for o in x["occurrences"]] == ["", "00:01", "00:02"] and x["total_occurrences"] == 3


def clip_rows(seed, stacks):
    r = random.Random(seed)
    rows, frame = [], 0
    for k in range(60):
        frame += r.choice([0, 20, 60, 120, 200])
        size = r.choice([1, 2, 3]) if stacks else 1
        rows += [(1, f"e{k}", 0, f"i{k}{o}", frame, 10 * k + o, o, size, f"g{k}" if size > 1 else None) for o in range(size)]
    return rows


CLIP = "transcript_id long, entity string, occ_idx int, image string, frame long, clip_seq long, stack_offset int, stack_size int, stack_group string"


def test_tracks(spark):
    for seed in range(3):
        rows = clip_rows(seed, True)
        got = timeline.assign_tracks(spark.createDataFrame(rows, CLIP), 4, 100, 50).collect()
        assert len(got) == len(rows)
        by_track = {}
        for x in got:
            if x["track"] is not None:
                by_track.setdefault(x["track"], []).append(x["frame"])
            else:
                assert x["skip_reason"]
        for own in by_track.values():
            own.sort()
            assert all(b - a >= 100 for a, b in zip(own, own[1:]))
        single = clip_rows(seed, False)
        df = spark.createDataFrame(single, CLIP)
        a = {x["clip_seq"]: x["track"] for x in timeline.assign_tracks(df, 3, 100, 50).collect()}
        b = {x["clip_seq"]: x["track"] for x in timeline.assign_single(df, 3, 100, 50).collect()}
        assert a == b and None in a.values()


def test_gaps_tile_the_timeline(spark):
    rows = [(1, t, f, 100) for t, f in ((2, 0), (2, 150), (3, 400))]
    placements = spark.createDataFrame(rows, "transcript_id long, track int, frame long, duration_frames int")
    totals = spark.createDataFrame([(1, 1000)], "transcript_id long, total_frames long")
    got = timeline.gaps(placements, totals, 3)
    free = got.groupBy("track").agg(F.sum(F.col("gap_end") - F.col("gap_start")).alias("f")).collect()
    assert {x["track"]: x["f"] for x in free} == {2: 800, 3: 900, 4: 1000}
    stretched, fillers = timeline.fill_gaps(placements, totals, 3, 3, 100, 20, 60)
    assert {(x["track"], x["frame"]): x["duration_frames"] for x in stretched.collect()} == {(2, 0): 130, (2, 150): 100, (3, 400): 100}
    want, cursor = [], 0
    for track, start, end, prev in ((2, 250, 1000, 1), (3, 0, 400, 0), (3, 500, 1000, 1), (4, 0, 1000, 0)):
        at, latest = start, end - 20 if prev else end
        while at + 100 <= latest:
            want.append((track, at, cursor % 3))
            cursor += 1
            at += 120
    assert sorted((x["track"], x["frame"], x["pool_no"]) for x in fillers.collect()) == sorted(want)


def test_stacked_fillers_do_not_overlap(spark):
    rows = [(1, t, f, 100) for t, f in ((2, 0), (2, 130), (2, 900), (3, 500), (4, 300))]
    placements = spark.createDataFrame(rows, "transcript_id long, track int, frame long, duration_frames int")
    totals = spark.createDataFrame([(1, 2000)], "transcript_id long, total_frames long")
    got = timeline.fill_gaps_stacked(placements, totals, [("a", 1), ("b", 3), ("c", 2)], 3, 0, 100, 20, 60).collect()
    spans = {}
    for x in got:
        spans.setdefault(x["track"], []).append((x["frame"], x["frame"] + x["duration_frames"], x["filler"]))
    for own in spans.values():
        own.sort()
        assert all(b[0] >= a[1] for a, b in zip(own, own[1:]))
    fillers = {x["filler"] for x in got} - {None}
    assert fillers == {"b", "c"} and (2, 0, 110) in {(x["track"], x["frame"], x["duration_frames"]) for x in got}


def test_selection_against_loop(spark):
    def pick(n, budget):
        if budget >= n:
            return list(range(n))
        chosen = {0} if budget else set()
        if budget >= 2:
            chosen.add(n - 1)
        rest, middle = budget - len(chosen), list(range(1, n - 1))
        for i in range(rest if n > 2 else 0):
            chosen.add(middle[max(0, min(int(round(len(middle) / (rest + 1) * (i + 1))) - 1, len(middle) - 1))])
        return sorted(chosen)

    cases = [(n, b) for n in range(1, 12) for b in range(0, 7)]
    occ = spark.createDataFrame([(k, "e", "people", m * 100, m, "s") for k, (n, _) in enumerate(cases) for m in range(n)], OCC)
    budgets = spark.createDataFrame([(k, "e", n, b) for k, (n, b) in enumerate(cases)], "transcript_id long, entity string, mentions long, budget int")
    got = {}
    for x in plan.select_mentions(occ, budgets).collect():
        got.setdefault(x["transcript_id"], []).append(x["occ_idx"])
    for k, (n, b) in enumerate(cases):
        assert sorted(got.get(k, [])) == pick(n, b), (n, b)


def test_image_order_and_walk(spark):
    rows = [("a 1900 fair", "events", 1, 1950), ("a 1900 fair", "events", 2, 1900), ("bob", "people", 1, None), ("bob", "people", 2, 1990), ("bob", "people", 3, 2001), ("war", "events", 1, None), ("war", "events", 2, 1930), ("war", "events", 3, 1915), ("war", "events", 4, 1800)]
    df = spark.createDataFrame(rows, "entity string, entity_type string, img_pos int, year int").withColumn("era_start", F.lit(1914)).withColumn("era_end", F.lit(1918))
    got = {}
    for x in images.order_images(df).orderBy("entity", "rank").collect():
        got.setdefault(x["entity"], []).append(x["img_pos"])
    assert got == {"a 1900 fair": [1, 2], "bob": [3, 2, 1], "war": [3, 2, 4, 1]}
    walked = images.walk(spark.createDataFrame([("e", 1, None), ("e", 2, "x"), ("e", 3, None), ("e", 4, "y"), ("e", 5, None)], "entity string, rank int, reason string"), F.lit(2))
    assert sorted(x["rank"] for x in walked.collect()) == [1, 2, 3]


def test_validation_counts_failed_lookups_as_valid(spark):
    queries = spark.createDataFrame([(1, "e", 1, "Good"), (1, "e", 2, "Broken"), (1, "f", 1, "Nowhere"), (1, "e", 3, "Old")], "transcript_id long, entity string, query_no int, query string")
    known = spark.createDataFrame([("Good", True), ("Broken", None)], "title string, found boolean")
    redirects = spark.createDataFrame([("Old", "New")], "from_title string, to_title string")
    checked = articles.validate_titles(queries, known, redirects)
    assert {x["query"]: (x["valid"], x["canonical"]) for x in checked.collect()} == {"Good": (True, "Good"), "Broken": (True, "Broken"), "Nowhere": (False, "Nowhere"), "Old": (True, "New")}
    got = {x["entity"]: (x["queries"], x["status"]) for x in articles.validated_strategies(checked).collect()}
    assert got == {"e": (["Good", "Broken", "Old"], "validated"), "f": (["f"], "fallback")}


def _scans(df):
    """How often the plan of a frame reads its source."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")


def test_replies_and_entities_are_read_once(spark, tmp_path):
    """No union or self-join reads a source again for each kind of item, or for the places of a transcript."""
    rows = [(1, '{"people": ["A", {"name": "b", "canonical": "B"}], "events": ["War"], "primary": "A"}'), (2, "none")]
    spark.createDataFrame(rows, "transcript_id long, reply string").write.parquet(str(tmp_path / "r"))
    items = annotations.reply_items(annotations.read_replies(spark.read.parquet(str(tmp_path / "r"))), ["transcript_id"])
    assert _scans(items) == 1
    assert sorted((x.kind, x.item_seq, x.surface, x.canonical) for x in items.collect()) == [("events", 0, "War", "War"), ("people", 0, "A", "A"), ("people", 1, "b", "B")]
    lists = [(1, '{"3": {"numbers": ["1"], "quotes": ["a", "b"]}}')]
    spark.createDataFrame(lists, "transcript_id long, reply string").write.parquet(str(tmp_path / "w"))
    each = annotations.windowed_replies(spark.read.parquet(str(tmp_path / "w")))
    assert _scans(each) == 1
    assert sorted((x.cue_idx, x.element_type, x.item_seq, x.item) for x in each.collect()) == [(3, "number", 0, "1"), (3, "quote", 0, "a"), (3, "quote", 1, "b")]
    e = [(1, "1848", "events", [(0, 1)], ["x"], 1), (1, "Rome", "places", [(5, 2)], ["y"], 2)]
    schema = "transcript_id long, name string, entity_type string, occurrences array<struct<ms:long,cue_idx:int>>, aliases array<string>, seq int"
    spark.createDataFrame(e, schema).write.parquet(str(tmp_path / "e"))
    subjects = spark.createDataFrame([(1, "Rome", 1)], "transcript_id long, subject string, n long")
    named = mentions.add_subjects(spark.read.parquet(str(tmp_path / "e")), subjects)
    assert _scans(named) == 1
    assert sorted(x.name for x in named.collect()) == ["1848 Rome", "Rome"]


def test_sweep_events_by_parts_and_wholes(spark):
    names = ["The French Revolution of 1789", "crusades", "Crusader", "War", "world", "revolution\namerican", "old w", "reformations", "xyz", "", None, "cold war", "cold\nwar", "a space race"]
    df = spark.createDataFrame([(1, n, k, k) for k, n in enumerate(names)], "transcript_id long, entity string, first_ms long, entity_seq int")
    got = {x.entity for x in segments.sweep_events(df).collect()}
    assert got == {n for n in names if n is not None and any(s in n.lower() or n.lower() in s for s in segments.SWEEP_EVENTS)}
    # lists of names are gone through only for long names, not for each word
    plan = segments.sweep_events(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "char_length" in plan or "length(" in plan


def test_sinks_round_trip(spark, tmp_path):
    rows = [(1, "quote", "hello", "", "quote_001", 1000), (1, "date", "1900", "Fair", "date_001", 500)]
    e = spark.createDataFrame(rows, "transcript_id long, element_type string, first string, second string, element_id string, ms long")
    text = sinks.marker_lists(e).first()["value"]
    assert "001  AX       V     C        00:00:00:12 00:00:00:13" in text and "BLUE     DATE: 1900 - Fair" in text
    documents.write_documents(documents.marker_documents(e), str(tmp_path / "xml"))
    back = spark.read.format("xml").option("rowTag", "marker").load(str(tmp_path / "xml"))
    assert sorted((x["in"], x["color"]) for x in back.collect()) == [(12, 9), (25, 12)]
    sinks.write_entity_maps(spark.createDataFrame([(1, "e", "people"), (1, "f", "places")], "transcript_id long, entity string, entity_type string"), str(tmp_path / "maps"))
    again = annotations.read_entity_maps(spark, str(tmp_path / "maps"), "struct<entity_type:string>")
    assert {(x["entity"], x["entity_type"]) for x in again.collect()} == {("e", "people"), ("f", "places")}
    assert math.isclose(1.0, 1.0)


def test_stream_parses_each_file_once(spark, tmp_path):
    from reelspan.streaming.incremental import fingerprints, stream_new_cues

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.srt").write_text(SRT)
    for _ in range(2):
        stream_new_cues(spark, str(src), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert fingerprints(spark, str(src)).count() == 1


def test_review_queue_numbers_rows_in_ranges(spark, capsys):
    r = random.Random(9)
    rows = [(int(s), r.randrange(0, 11)) for s in [*r.sample(range(-500, 100_000), 400), 10**15]]
    queue = articles.review_queue(spark.createDataFrame(rows, "seq long, confidence int"))
    want = sorted((c, s) for s, c in rows if 4 <= c <= 6)
    assert sorted((x["place"], x["confidence"], x["seq"]) for x in queue.collect()) == [(k, c, s) for k, (c, s) in enumerate(want, 1)]
    queue.explain()
    windows = [x.split("windowspecdefinition(")[1] for x in capsys.readouterr().out.splitlines() if "Window [row_number" in x]
    assert windows and not any(" ASC" in x.split(",")[0] for x in windows)  # a partition comes before the order


def test_boilerplate_by_depth_of_its_own_tag(spark):
    cases = {
        "<p>a</p><!-- <nav> --><nav><div><nav>x</nav>y</div></nav><b>c</b>": "<p>a</p><b>c</b>",
        '<script>var t="</p><nav>";</script>z<style>p{}</style>': "z",
        '<div class="big navbox"><p>open<div>in</div></div>out<DIV CLASS=navboxes>stay</DIV>': "out<DIV CLASS=navboxes>stay</DIV>",
        "<div class='x navbox'><br><img src=\"a>b\"></div><i>k</i>": "<i>k</i>",
        "<nav>never closed <p>x": "",
        "a < b and <header/>c": "a < b and <header/>c",
        "": "",
    }
    rows = list(enumerate(cases))
    got = annotations.strip_boilerplate(spark.createDataFrame([*rows, (99, None)], "page_id long, html string")).collect()
    assert {r["page_id"]: r["html"] for r in got} == {**dict(enumerate(cases.values())), 99: ""}


def test_exact_character_references(spark):
    df = spark.createDataFrame([("<b>a</b> &eacute;&#233;&#x1F600; &amp;lt; ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(img.strip_html(F.col("t"))).collect()] == ["a éé\U0001f600 &lt;", "", ""]


def test_many_mentions_of_one_transcript_take_seconds(spark):
    rows = spark.range(5000).selectExpr("1L transcript_id", "concat('e', id % 17) entity", "id * 2000 ms", "cast(id as int) cue_idx")
    began = time.monotonic()
    n = segments.density_clusters(rows).count()
    assert n == 1000 and time.monotonic() - began < 20


def test_quick_marker_test_misses_nothing(spark):
    texts = ["Step one: go", "éstep one", "étape; STEP ONE.", "x#1", "number #2", "there are ٣ steps", "Let me\u00a0show", "nothing here", "ﬁrst ſtep one", "so\u00a0that'ſ how", "and\u00a0then", "a, b,\u00a0and c", "Kings, among them A, b, c", ""]
    df = spark.createDataFrame([(1, k, 0, t) for k, t in enumerate(texts)], "transcript_id long, cue_idx int, start_ms long, text string")
    for kinds, quick in ((segments.PROCESS.values(), None), ([segments.ENUMERATION], segments._LISTS)):
        patterns = sum(map(tuple, kinds), ())
        both = df.select(F.col("text").rlike(segments.any_of(patterns)).alias("full"), segments._may_match(quick or patterns, F.col("text")).alias("quick"), "text")
        assert both.where("full and not quick").collect() == []


def test_stacked_fillers_without_any_clip(spark):
    none = spark.createDataFrame([], "transcript_id long, track int, frame long, duration_frames int")
    totals = spark.createDataFrame([(1, 500), (2, 90)], "transcript_id long, total_frames long")
    got = timeline.fill_gaps_stacked(none, totals, [("a", 3), ("b", 2)], 4, 2, 100, 50, 120).collect()
    assert sorted((r["transcript_id"], r["track"], r["frame"], r["filler"]) for r in got) == [(1, t, f, e) for t in (2, 3) for f, e in ((0, "a"), (150, "b"), (300, "a"))]


def test_gazetteer_of_any_length_both_ways(spark):
    long = "the quick brown fox jumps over the lazy dog by the river"
    rows = [(1, 1, 0, f"Yes: {long.upper()}! the quick"), (1, 2, 5, "of of the united states of america of"), (1, 3, 9, ""), (1, 4, 9, None), (2, 1, 0, "thequick, the-quick São-Paulo"), (2, 2, 1, "?")]
    cues = spark.createDataFrame(rows, "transcript_id long, cue_idx int, start_ms long, text string")
    surfaces = [(long, "Fox", "events"), ("the quick", "Quick", "people"), ("quick brown", "QB", "people"), ("United States of America", "US", "places"), ("united states of america", "USA", "places"), ("of", "Of", "concepts"), ("são paulo", "SP", "places"), ("--", "no", "x"), ("", "no", "x")]
    known = spark.createDataFrame(surfaces, "surface string, canonical string, kind string")
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    want = set()
    for t, c, ms, text in rows:
        w = split(text)
        for s, canonical, kind in surfaces:
            k = split(s)
            want |= {(t, c, ms, i + 1, " ".join(k), canonical, kind) for i in range(len(w)) if k and w[i : i + len(k)] == k}
    for most in (1 << 23, 0):
        got = [tuple(r) for r in mentions.from_gazetteer(cues, known, most_bytes=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert mentions.from_gazetteer(cues, known.limit(0)).count() == 0


def test_quotes_without_a_common_word_against_loop(spark):
    r = random.Random(8)
    parts = ["concatenate", "cat", "often", "ten", "x", "É", "unbelievable", "Antidisestablishmentarianism and more", "-", "?", "a b", " "]
    line = lambda: "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(1, 4)))
    cues = [(t, k, line()) for t in (1, 2, 3) for k in range(25)] + [(1, 99, None)]
    quotes = [(k, r.choice((1, 2, 3, 4)), line()) for k in range(80)] + [(90, 1, ""), (91, 2, "  "), (92, 1, None), (93, 2, "Antidisestablishmentarianism andirons")]
    want = []
    for i, t, quote in quotes:
        low = (quote or "").lower().strip()
        words, best, found = set(re.findall(r"\w+", low)), 0, None
        for u, k, text in cues:
            text = (text or "").lower()
            own = set(re.findall(r"\w+", text))
            if t != u or not quote or not own:
                continue
            score = len(words & own) / max(1, len(words)) + (0.5 if low[:30] in text or text in low else 0)
            if score > best:
                best, found = score, k
        if best >= 0.3:
            want.append((i, t, found, best))
    q = spark.createDataFrame(quotes, "quote_id long, transcript_id long, quote string")
    c = spark.createDataFrame(cues, "transcript_id long, cue_idx int, text string")
    assert sorted(map(tuple, resolve.quote_matches(q, c).collect())) == sorted(want)


def test_stacked_tracks_and_fillers_against_loops(spark):
    for seed in range(4):
        r = random.Random(seed)
        clips, frame = [], 0
        for k in range(50):
            frame += r.choice([0, 10, 60, 120, 260])
            size, montage = r.choice([1, 1, 2, 3, 5 if seed == 3 else 2]), r.choice([None, None, 40])
            clips += [(seed, f"e{k}", 0, f"i{k}{o}", frame, 10 * k + o, o, size, f"g{k}" if size > 1 else None, montage) for o in range(size)]
        count = max(4, max(c[7] for c in clips))
        free, want = [0] * count, {}
        for key in dict.fromkeys(c[1] for c in clips):
            own = [c for c in clips if c[1] == key]
            start, size, montage = own[0][4], len(own), own[0][9]
            room = next((k for k in range(count - size + 1) if all(start >= e + (12 if montage else 50) for e in free[k : k + size])), None)
            if room is None and size == 1 and start >= min(free):
                room = free.index(min(free))
            for o, c in enumerate(own):
                want[c[5]] = None if room is None else timeline.BASE_TRACK + room + size - 1 - o
            if room is not None:
                free[room : room + size] = [start + (montage or 100)] * size
        df = spark.createDataFrame(clips, CLIP + ", montage int")
        got = timeline.assign_tracks(df.repartition(3), 4, 100, 50, "montage").collect()
        assert {x["clip_seq"]: x["track"] for x in got} == want

        placed = [(seed, x["track"], x["frame"], x["duration_frames"]) for x in got if x["track"] is not None]
        pool, tracks, total = [(f"p{k}", r.randrange(6)) for k in range(7)], count, frame + r.choice([0, 150, 900])
        spans = {t: sorted([f, n] for _, u, f, n in placed if u == t) for t in range(2, 2 + tracks)}
        for own in spans.values():
            for k, (f, n) in enumerate(own):
                end = own[k + 1][0] if k + 1 < len(own) else total
                if 0 < end - f - n < 60:
                    own[k][1] = max(n, end - 20 - f)
        want = [(t, f, n, None, None) for t, own in spans.items() for f, n in own]
        edge, holes, turn = 0, [], 0
        for f, n in [*spans[2], [total, 0]]:
            holes += [(edge, f)] if f > edge else []
            edge = f + n
        for a, b in holes:
            at = a
            while at + 100 <= b - 20:
                for _ in pool:
                    name, images = pool[turn % len(pool)]
                    turn += 1
                    size = 0 if images < 2 else min(3, images, tracks)
                    if size and all(at + 120 <= f or at >= f + n + 20 for t in range(2, 2 + size) for f, n in spans[t]):
                        for k in range(size):
                            spans[1 + size - k].append([at, 100])
                            want.append((1 + size - k, at, 100, name, k))
                        break
                at += 120
        placements = spark.createDataFrame(placed, "transcript_id long, track int, frame long, duration_frames int")
        got = timeline.fill_gaps_stacked(placements, spark.createDataFrame([(seed, total)], "transcript_id long, total_frames long"), pool, tracks, 3, 100, 20, 60)
        assert sorted((x[1:] for x in map(tuple, got.collect())), key=str) == sorted(want, key=str)


def test_documents_are_one_file_each(spark, tmp_path):
    rows = [(t, "e", f"/m/a & b <{k % 2}>.jpg", k, 2 + k % 3 * 2, 10 * k, 50 + k) for t in (1, 2, 30) for k in range(5)]
    placements = spark.createDataFrame(rows, "transcript_id long, entity string, image string, clip_seq long, track int, frame long, duration_frames int").repartition(4)
    documents.write_documents(documents.timeline_documents(placements, 25), str(tmp_path / "t"))
    files = sorted((tmp_path / "t").rglob("*.txt"))
    assert sorted(f.parent.name for f in files) == ["transcript_id=1", "transcript_id=2", "transcript_id=30"]
    for f in files:
        root = ElementTree.fromstring(f.read_text())
        assert [t.get("number") for t in root.findall("track")] == ["1", "2", "3", "4", "5", "6"]
        assert root.findtext("header/duration") == str(40 + 54 + 250)
        media = {m.get("id"): (m.findtext("name"), m.findtext("duration")) for m in root.findall("media/masterclip")}
        assert media == {"masterclip-1": ("a & b <0>.jpg", "50"), "masterclip-2": ("a & b <1>.jpg", "53")}
        clips = [(t.get("number"), c.findtext("start"), c.findtext("end"), media[c.findtext("masterclipid")][0]) for t in root.findall("track") for c in t]
        assert clips == [(str(t), str(f), str(f + n), i[3:]) for _, _, i, _, t, f, n in sorted(rows[:5], key=lambda x: (x[4], x[5]))]


def test_quick_marker_test_misses_no_folded_letter(spark):
    """Phrases in letters that fold to ASCII ones only without regard to case, amid others."""
    r = random.Random(2)
    fold = {"i": "iI\u0130\u0131", "s": "sS\u017f", "k": "kK\u212a"}
    phrases = ["first", "this is how", "the first step is", "step one", "let me show you", "next", "finally", "in conclusion", "moving on", "people like", "many scientists", "across asia", "several leaders like", "switching gears", "this, that, and kings"]
    texts = [" ".join(r.choice(["so", "İst", "x."]) for _ in range(r.randrange(3))) + " " + "".join(r.choice(fold.get(c, c + c.upper())) for c in r.choice(phrases)) + r.choice([" this", ",", ": a", ""]) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for full, quick in ((segments._ALL_MARKERS, segments._ALL_MARKERS), (segments.ENUMERATION, segments._LISTS)):
        both = df.select(F.col("text").rlike(segments.any_of(full)).alias("full"), segments._may_match(quick, F.col("text")).alias("quick"), "text")
        assert both.where("full and not quick").collect() == [] and both.where("full").count() > 20


def test_quotes_and_their_cues_are_read_once(spark, tmp_path):
    """Matches are found on what was kept of quotes and cues; texts hold one another with and without a whole word inside."""
    r = random.Random(5)
    text = lambda: "".join(r.choice(["ab", "b", "Cd", " ", " ", ", ", "é", "x1"]) for _ in range(r.randrange(1, 14)))
    cues = [(t, k, text()) for t in (1, 2, 3) for k in range(40)]
    quotes = [(f"{t}-{k}", t, r.choice([c for u, _, c in cues if u == t])[r.randrange(3) :]) for t in (1, 2) for k in range(40)]
    spark.createDataFrame(cues, "transcript_id long, cue_idx int, text string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame(quotes, "quote_id string, transcript_id long, quote string").write.parquet(str(tmp_path / "q"))
    words = lambda s: set(re.findall(r"\w+", s.lower()))
    want = []
    for i, t, quote in quotes:
        low, best = quote.lower().strip(), []
        for u, k, c in cues:
            if u == t and words(c) and quote:
                held = low[:30] in c.lower() or c.lower() in low
                best.append((-(len(words(quote) & words(c)) / max(len(words(quote)), 1) + 0.5 * held), k))
        if best and -min(best)[0] >= 0.3:
            want.append((i, t, min(best)[1], -min(best)[0]))
    for most in (0, 9):
        got = resolve.quote_matches(spark.read.parquet(str(tmp_path / "q")), spark.read.parquet(str(tmp_path / "c")), most_ids=most)
        assert {f.split("/")[-2].rsplit("-", 1)[0] for f in got.inputFiles()} == {"quotes", "asked"}
        assert sorted(map(tuple, got.collect())) == sorted(want)
