"""One id on two texts: the links of a leader don't depend on which of its texts comes first."""

from __future__ import annotations

import pyarrow as pa
import pytest

from marginalia.llm import jaccard
from marginalia.llm.shingles import shingle_set


@pytest.mark.parametrize("wrong_first", [True, False])
def test_leader_with_two_texts(wrong_first):
    right, wrong = " ".join(f"w{i}" for i in range(80)), " ".join(f"x{i}" for i in range(80))
    others = [right + " y", "z " + right]
    a, *b = (jaccard.class_of(shingle_set(t, 4)) for t in (right, *others))
    rows = [(a, c, t, o) for c, o in zip(b, others, strict=True) for t in ((wrong, right) if wrong_first else (right, wrong))]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["a", "b", "text_a", "text_b"])
    assert [tuple(r.values()) for out in jaccard._verify(4, 85)([batch]) for r in out.to_pylist()] == [(a, c) for c in b]
