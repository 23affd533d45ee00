import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from leafgate.llm.textarrays import ALNUM, FOLDED, NON_SPACE, Words, covered, ragged, sliding_argmin, texts_of

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAb1 é\n\t-_世", max_size=30)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words(texts):
    t = texts_of(pa.array(texts, pa.string()))
    for inside, table, pattern, fold in ((NON_SPACE, None, r"[^\x20\x09-\x0D]+", False), (ALNUM, FOLDED, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        words = Words(t, inside, table) if table is not None else Words(t, inside)
        want = []
        for d, x in enumerate(texts):
            x = re.sub("[A-Z]", lambda m: m[0].lower(), x or "") if fold else x or ""
            want += [(d, w) for w in re.findall(pattern, x)]
        got = [(int(d), t.buf[a:b].tobytes().decode().lower() if fold else t.buf[a:b].tobytes().decode()) for d, a, b in zip(words.doc, words.start, words.end)]
        assert [(d, w.lower() if fold else w) for d, w in want] == got
        for i in range(len(want)):
            for j in range(i):
                assert (words.hash[i] == words.hash[j]) == (want[i][1] == want[j][1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 9))
def test_sliding_argmin(values, w):
    got = sliding_argmin(np.array(values, np.uint64) << np.uint64(32), w)
    assert got.tolist() == [min(range(i, i + w), key=lambda k: (values[k], k)) for i in range(len(values) - w + 1)]


def test_ragged_and_covered():
    assert ragged(np.array([5, 9, 2]), np.array([2, 0, 3])).tolist() == [5, 6, 2, 3, 4]
    assert ragged(np.array([], int), np.array([], int)).tolist() == []
    assert covered(np.array([1, 2, 6]), 2, 8).tolist() == [False, True, True, True, False, False, True, True]
