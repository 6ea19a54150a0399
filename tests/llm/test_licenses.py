import random
import re

from reelspan.llm import licenses
from reelspan.llm.licenses import NOTICES, PHRASES, compile_notices, fuzzy_spans, likely, normalise, scan_licenses, scan_text

EXACT = [(p.encode(), x) for p, x in PHRASES.items()]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for p, label in PHRASES.items():
        w = p.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(w)] == w]
    at = sorted(k for k, _ in found)
    return len(words), len(found), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in found}))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_base_and_edges(spark):
    texts = ["Released UNDER the-MIT license. under the mit\nlicense", "under the mit licenses", "CC BY-NC 4.0 cc-by-nc", "Apache License, Version 2.0", "éunder the mit license", None, "", " .,", "under the mit license " * 3000, "x" * 200_000]
    r = random.Random(2)
    texts += [" ".join(r.choices(["under", "the", "MIT", "license", "cc", "by", "nc", "apache", "version", "2", "é", ".", "-"], k=60)) for _ in range(80)]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, labels string, row int")
    got = {x["row"]["doc_id"]: x for x in scan_licenses(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        x = got[k]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == base(t), t
        assert set(x["base_labels"].split(",")) - {""} <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1
    assert scan_licenses(df.limit(0)).count() == 0


def test_fuzzy_finds_every_notice_within_the_errors():
    r = random.Random(5)
    notices = compile_notices(NOTICES)
    for n in notices:
        for _ in range(6):
            w = bytearray(n.words)
            for _ in range(r.randrange(0, n.errors + 1)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([b"", b"q", bytes([w[at]]) + b"z"])
            text = normalise("some words before " + w.decode() + " and after")
            assert fuzzy_spans(text, n), bytes(w)
            for a, b, e in fuzzy_spans(text, n):
                assert edits(text[a:b], n.words) == e <= n.errors


def test_fuzzy_labels():
    notices = compile_notices(NOTICES)
    assert scan_text("This work is licensed under the GNU General Public License, version 3.", EXACT, notices)["labels"] == "gpl"
    assert scan_text("Released under teh MIT Licence", EXACT, notices)["labels"] == "mit"
    assert scan_text("Released under teh MIT License", EXACT, notices)["labels"] == "mit"
    assert scan_text("Nothing of the kind stands here at all", EXACT, notices)["labels"] == ""
    x = scan_text("a b Licensed under the Apache License, Version 2.0.", EXACT, notices)
    assert x["labels"] == "apache-2" and [(s["first_word"], s["last_word"], s["errors"]) for s in x["spans"] if s["label"] == "apache-2"] == [(2, 9, 0)]
    assert licenses.normalise(None) == b" "


def test_no_notice_within_one_error_in_eight_characters_is_left_out(spark):
    r = random.Random(8)
    notices = compile_notices(NOTICES, 8)
    texts, held = [], []
    for n in notices:
        for _ in range(4):
            w = bytearray()
            while normalise(w.decode()).strip() != w or not w:
                w = bytearray(n.words)
                for k in range(n.errors):
                    at = min(len(w) - 1, (2 * k + 1) * len(n.words) // (2 * n.errors))
                    w[at : at + 1] = r.choice([b"", b"q", bytes([w[at]]) + b"z"])
            texts += [normalise("before " + w.decode() + " and after"), normalise("x" * r.randrange(0, 40))]
            held += [n, None]
    for t, n, kept, alone in zip(texts, held, likely(texts, notices), (likely([t], notices)[0] for t in texts), strict=True):
        if n is not None:
            assert any(edits(t[a:b], n.words) <= n.errors for a in range(6, 10) for b in range(len(t) - 16, len(t) - 4)), t
            assert n in kept and n in alone and fuzzy_spans(t, n), t
    df = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    for x in scan_licenses(df).collect():
        n = held[x["row"]["doc_id"]]
        assert n is None or n.label in x["labels"].split(",")


def test_repeated_notices_with_different_errors_have_a_span_each():
    r = random.Random(6)
    for n in compile_notices(NOTICES):
        for copies in ([1, 1, 0], [0, 1, 0, 2], [n.errors, 0, n.errors], [1] * 40):
            parts = []
            for e in copies:
                w = bytearray(n.words)
                for at in r.sample([k for k in range(2, len(w) - 2) if w[k] != 32], e):
                    w[at] = ord("q")
                parts.append(bytes(w))
            text = b" " + b" ".join(parts) + b" "
            found = fuzzy_spans(text, n)
            assert [e for _, _, e in found] == copies
            assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
            assert all(edits(text[a:b], n.words) == e for a, b, e in found)


def test_no_further_match_is_left_between_spans():
    r = random.Random(7)
    n = compile_notices({"abcabcab cdabbcda": "x"}, 8)[0]
    for _ in range(300):
        text = b" " + b"".join(bytes(r.choices(b"abcd ", k=r.randrange(0, 6))) + n.words[r.randrange(0, 4) : r.randrange(12, 20)] for _ in range(4))
        found = fuzzy_spans(text, n)
        assert all(edits(text[a:b], n.words) == e <= n.errors for a, b, e in found)
        for a, b in zip([0, *(x[1] for x in found)], [*(x[0] for x in found), len(text)], strict=True):
            assert a <= b and min((edits(text[i:j], n.words) for i in range(a, b) for j in range(i + 12, min(b, i + 20) + 1)), default=99) > n.errors


def test_repeated_rows_and_a_text_of_megabytes(spark):
    long = "some words of no meaning " * 120_000 + "released undr the MIT License " + "more words " * 100_000 + "cc by nc"
    rows = [(1, long), (2, "under the MIT license"), (2, "under the MIT license"), (None, "cc by nc"), (4, None), (4, "")]
    df = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in rows], "doc_id long, text string, labels string, score double")
    got = sorted(((x["row"]["doc_id"], x["n_words"], x["n_base"], x["first_word"], x["base_labels"], x["labels"]) for x in scan_licenses(df).collect()), key=str)
    n = len(long.split())
    want = [(1, n, 1, n - 3, "cc-by-nc", "cc-by-nc,mit"), (2, 4, 1, 0, "mit", "mit"), (2, 4, 1, 0, "mit", "mit"), (4, 0, 0, None, "", ""), (4, 0, 0, None, "", ""), (None, 3, 1, 0, "cc-by-nc", "cc-by-nc")]
    assert got == sorted(want, key=str)
    assert scan_licenses(df.limit(0)).count() == 0
