import random

from reelspan.operators.mentions import anchor_windows


def test_anchors_equal_a_loop_with_silences_and_times_that_go_back(spark):
    r, rows, want = random.Random(3), [], []
    for t in range(12):
        ms, cues = 0, []
        for k in range(60):
            ms += r.choice([300, 900, 1500, 4999, 5000, 9000, -2000])
            cues.append((f"t{t}", k, None if r.random() < 0.05 else ms))
        at = anchor = None
        for name, k, m in cues:
            if at is None or (m is not None and m - at >= 5000):
                at, anchor = m, k
            want.append((name, k, m, anchor))
        rows += cues
    df = spark.createDataFrame(rows, "transcript_id string, cue_idx int, ms long").repartition(3)
    got = anchor_windows(df).select("transcript_id", "cue_idx", "ms", "anchor").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert anchor_windows(df.limit(0)).count() == 0
