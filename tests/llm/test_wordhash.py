import random
import re

import numpy as np
import pyarrow as pa
import pytest

from reelspan.llm import wordhash
from reelspan.llm.wordhash import Powers, Words, mix, slices


def words_of(text):
    return [x for x in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if x]


def plain(word):
    h = sum((c + 1) * pow(Powers().base, k, 1 << 64) for k, c in enumerate(word)) + len(word)
    return int(mix(np.array([h % (1 << 64)], dtype=np.uint64))[0])


@pytest.mark.parametrize("piece", [4, 7, 1 << 20])
def test_words_are_whole_wherever_pieces_end(monkeypatch, piece):
    monkeypatch.setattr(wordhash, "_PIECE", piece)
    r = random.Random(1)
    texts = ["".join(r.choice("aBé  \n") for _ in range(r.randrange(60))) for _ in range(60)] + [None, "", "x" * 50, " " + "y" * 17 + " ", "abcd" * 4]
    words = Words(pa.array(texts), Powers(), spans=True)
    for k, text in enumerate(texts):
        own = range(words.first[k], words.first[k + 1])
        assert [words.text(i) for i in own] == words_of(text)
        assert [int(words.hash[i]) for i in own] == [plain(w) for w in words_of(text)]


def test_a_run_of_megabytes_is_one_word():
    words = Words(pa.array(["z" * 12_000_000 + " q", "z" * 1_200_000, "q"]), Powers())
    assert np.diff(words.first).tolist() == [2, 1, 1] and words.hash[1] == words.hash[3]


def test_slices_hold_all_rows_in_order():
    batch = pa.record_batch({"text": ["a" * 5, "b" * 20, None, "", "c" * 3]})
    cut = list(slices([batch.slice(1)], most_bytes=8))
    assert [x.num_rows for x in cut] == [1, 3] and sum((x.column("text").to_pylist() for x in cut), []) == ["b" * 20, None, "", "c" * 3]
