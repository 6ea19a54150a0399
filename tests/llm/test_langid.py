import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import langid
from reelspan.llm.langid import Pieces, fit, read_pieces, word_scores


def all_segmentations(word, probability):
    """Sum over every segmentation, by recursion."""
    if not word:
        return 1.0
    return sum(probability.get(word[:k], 0.0) * all_segmentations(word[k:], probability) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    counts = {"a": {b"the": 50, b"there": 20, "é!".encode(): 3}, "b": {b"der": 40, b"den": 10}}
    model = fit(counts)
    names = read_pieces(langid.VOCABULARY)
    words = [b"the", b"dent", "é".encode(), b"x"]
    got = word_scores(words, Pieces(names), model.probability)
    for k, _ in enumerate(model.languages):
        p = dict(zip(names, model.probability[:-1, k], strict=True))
        for w, g in zip(words, got[:, k], strict=True):
            assert g == pytest.approx(math.log(all_segmentations(b" " + w, p)), rel=1e-9)
    assert np.allclose(model.probability.sum(axis=0), 1)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = langid.identify(docs, langid.learn(docs, ~held)).where(F.crc32(F.col("row.doc_id").cast("string")) % 3 == 1)
    right, n = found.where("lang_pred <=> row.lang").count(), found.count()
    assert n > 30 and right / n > 0.9


def test_edges(spark):
    rows = [(1, "the of and", "en"), (2, "der die und", "de"), (3, None, "en"), (4, "", "de"), (5, "123 -- 4", "en"), (6, "the of " * 40000, None), (None, "und die", None), (8, "x" * 200_000, None), (1, "the of and", "en")]
    df = spark.createDataFrame([(i, t, x, "clash") for i, t, x in rows], "doc_id long, text string, lang string, lang_pred string")
    model = langid.learn(df, F.lit(True))
    got = [(r["row"]["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()]
    by = {i: (x, s) for i, x, s in got}
    assert len(got) == 9 and by[3] == by[4] == by[5] == ("und", 0.0)
    assert by[1][0] == by[6][0] == "en" and by[2][0] == by[None][0] == "de" and by[8][0] in ("en", "de")
    none = langid.learn(df.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def one_by_one(word, probability):
    """Log of the sum over all segmentations of a word of any length."""
    longest = max(map(len, probability))
    sums = [0.0]
    for j in range(1, len(word) + 1):
        parts = [sums[i] + math.log(probability[word[i:j]]) for i in range(max(0, j - longest), j) if word[i:j] in probability]
        sums.append(max(parts) + math.log(sum(math.exp(x - max(parts)) for x in parts)))
    return sums[-1]


def test_words_of_any_length_are_never_cut():
    model = fit({"a": {b"the": 50, b"station": 9}, "b": {b"der": 40, b"bahnhof": 10}})
    r = random.Random(3)
    words = [bytes(r.choice(b"thedrnbaofgi.") for _ in range(n)) for n in (12, 41, 500, 4095, 4096, 4097, 70_000)]
    words += ["пространствоинструментдействительно".encode() * 200, b"z" * 66_000, "東京特許許可局".encode() * 300]
    got = word_scores(words, Pieces(model.pieces), model.probability)
    for k, _ in enumerate(model.languages):
        p = dict(zip(model.pieces, model.probability[:-1, k], strict=True))
        for w, g in zip(words, got[:, k], strict=True):
            assert g == pytest.approx(one_by_one(b" " + w, p), rel=1e-9)


def test_text_is_decided_beyond_the_fortieth_byte(spark):
    """One word whose only telling part comes after hundreds of bytes."""
    docs = spark.createDataFrame([(k, w, x) for k in range(40) for w, x in (("station bread", "a"), ("bahnhof brot", "b"))], "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(True))
    odd = spark.createDataFrame([(1, "." * 300 + "station" * 9), (2, "." * 300 + "bahnhof" * 9)], "doc_id long, text string")
    assert {r["row"]["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()} == {1: "a", 2: "b"}


def test_unsegmented_scripts_are_learned(spark):
    """Two languages of one script that write no blanks, told apart by their syllables; clauses of hundreds of bytes are the only words."""
    import random

    r = random.Random(6)
    own = {"a": "カキクケコサシスセソ", "b": "ラリルレロマミムメモ"}
    line = lambda x: "".join(r.choice(own[x]) if r.random() < 0.4 else r.choice("アイウエオナニヌネノ") for _ in range(200))
    rows = [(k, line("ab"[k % 2]), "ab"[k % 2]) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.learn(docs.where("doc_id < 60"), F.lit(True))
    found = langid.identify(docs.where("doc_id >= 60"), model).select("row.lang", "lang_pred").collect()
    assert all(x.lang == x.lang_pred for x in found) and len(found) == 60


def test_rounds_by_spark_equal_those_at_hand(spark):
    texts = {"a": "the station the the long" + " word" * 3 + " " + "é" * 300, "b": "der bahnhof der " + "x" * 128 + " " + "y" * 127}
    docs = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    counts = {x: {} for x in texts}
    for x, t in texts.items():
        for w in t.split():
            counts[x][w.encode()] = counts[x].get(w.encode(), 0) + 1
    spark_model, here = langid.learn(docs.repartition(2), F.lit(True)), langid.fit(counts)
    assert spark_model.languages == here.languages and abs(spark_model.probability - here.probability).max() < 1e-12
    assert b"".join(langid._parts("é".encode() * 300)) == b" " + "é".encode() * 300
    assert all(len(p) <= langid.LEARNED_PART and p.decode() for p in langid._parts("é".encode() * 300))
