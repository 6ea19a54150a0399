"""Elements of replies against a loop over parsed JSON."""

import json
import random
import re

from pyspark.sql import functions as F

from reelspan.operators import ordering, segments
from reelspan.sources import payloads

WORDS = ["war", "", "peace", "é" * 60, "é" * 60 + "x", 5, 5.0, "5", None, True]


def reply(r):
    def item(kind):
        w = lambda: r.choice(WORDS)
        some = {
            "numbers": {"value": w(), "raw_numbers": r.choice([[1, 2.0], [1.0, 2], ["1"], [], None, 7]), "unit": "km"},
            "dates": {"date": w(), "event": w()},
            "quotes": {"text": r.choice(["", "q" * 60, "q" * 55, "said"]), "is_quotable": r.choice([True, False, None, 0, "", "no", [], 1])},
            "processes": {"title": w(), "steps": r.choice([[], ["a"], ["a", {"b": 1}], [1, 2, 3], "ab", None])},
            "comparisons": {"before": w(), "after": w()},
        }[kind]
        return r.choice([some, {k: v for k, v in some.items() if r.random() < 0.7}, some, some, "text", 3])

    kinds = [p for p, _ in payloads.LISTS]
    lists = lambda: {k: r.choice([[item(k) for _ in range(r.randrange(3))], [item(k)], "none", {"a": 1}]) for k in r.sample(kinds, 3)}
    body = {r.choice(["1", "2", " 3", "x", "4.5"]): r.choice([lists(), lists(), lists(), [], 5]) for _ in range(3)}
    return r.choice(["Here: ", "", "```json\n"]) + json.dumps(body) + r.choice(["", "\n```", " ok"])


def loop(replies):
    out, numbers, seen = [], {}, set()
    for transcript, _, text in sorted(replies, key=lambda x: (x[0], x[1])):
        found = re.search(r"\{[\s\S]*\}", text or "")
        try:
            body = json.loads(found.group(0)) if found else {}
        except json.JSONDecodeError:
            continue
        cues = {int(k): v for k, v in body.items() if re.fullmatch(r"\s*\d+\s*", k) and isinstance(v, dict)}
        for cue in sorted(cues):
            for plural, kind in payloads.LISTS:
                items = cues[cue].get(plural)
                for x in items if isinstance(items, list) else ():
                    if not isinstance(x, dict) or (kind == "quote" and not x.get("is_quotable", True)):
                        continue
                    some = x.get("steps") if isinstance(x.get("steps"), list) else []
                    if kind == "process" and len(some) < 2:
                        continue
                    raw = x.get("raw_numbers") if isinstance(x.get("raw_numbers"), list) else []
                    tag = lambda v: (isinstance(v, bool), v)
                    key = {"process": (tag(x.get("title", "")), len(some)), "quote": x.get("text", "")[:50], "number": (tag(x.get("value", "")), tuple(map(tag, raw))), "date": (tag(x.get("date", "")), tag(x.get("event", ""))), "comparison": (tag(x.get("before", "")), tag(x.get("after", "")))}[kind]
                    numbers[transcript, kind] = numbers.get((transcript, kind), 0) + 1
                    if (transcript, kind, cue, key) not in seen:
                        seen.add((transcript, kind, cue, key))
                        out.append((transcript, f"{kind}_{numbers[transcript, kind]:03d}", kind, cue, json.dumps(x, sort_keys=True)))
    return sorted(out)


def test_elements_against_loop(spark):
    r = random.Random(3)
    rows = [(t, k, reply(r)) for t in range(6) for k in range(25)] + [(9, 0, None), (9, 1, ""), (9, 2, "no json"), (9, 3, "{broken"), (9, 4, "{} [1]"), (9, 5, "[1, 2]")]
    df = spark.createDataFrame(rows, "transcript_id long, reply_no int, reply string").repartition(3)
    got = payloads.payload_elements(df).select("transcript_id", "element_id", "element_type", "cue_idx", F.to_json("payload").alias("payload")).collect()
    whole = lambda text: json.dumps(json.loads(text, parse_int=float), sort_keys=True)
    assert sorted((*x[:4], whole(x[4])) for x in map(tuple, got)) == [(*x[:4], whole(x[4])) for x in loop(rows)]


def test_elements_are_numbered_by_ranges(spark):
    """One transcript and type in many ranges and tasks: ids and firsts as in a loop."""
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, None]), r.choice(["quote", "date"]), r.randrange(3), r.choice("ab"), r.choice("cd"), k) for k in range(2000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "transcript_id long, element_type string, cue_idx int, first string, second string, seq long").repartition(3)
    numbers, seen, want = {}, set(), []
    for t, kind, cue, first, second, seq in sorted(rows, key=lambda x: x[5]):
        n = numbers[t, kind] = numbers.get((t, kind), 0) + 1
        key = (t, kind, cue, first if kind == "quote" else (first, second))
        if key not in seen:
            seen.add(key)
            want.append((seq, f"{kind}_{n:03d}"))
    got = segments.numbered_elements(df, per_range=100).select("seq", "element_id").collect()
    assert sorted(map(tuple, got)) == want
    by = ordering.leading_number(df, "seq")
    parts = ordering.spread(df, "transcript_id", by)
    assert (parts["low"], parts["high"], parts["all"]) == (0.0, 1999.0, 2000)
