"""Contexts of a group are compared in bounded pieces, and only where they can be equal."""

import random

import numpy as np
import pyarrow as pa
import pytest

from walkframe.llm import substrings


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_first_equal(step, monkeypatch):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcd ") for _ in range(90)) for _ in range(30)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 6))).encode() for _ in range(40)]
    group = substrings.Group(pa.table({"doc_id": list(range(40)), "key": [str(i) for i in range(40)], "text": pa.array(texts, pa.binary())}))
    found = list(group.anchors())
    rank, first, last = (np.concatenate([f[i] for f in found]) for i in (1, 3, 4))
    size = (last - first + substrings.LENGTH).astype(np.int32)
    seen, most, plain = {}, [], substrings.equal_bytes
    want = [seen.setdefault(group.bytes[s : s + n].tobytes(), i) for i, (s, n) in enumerate(zip(first, size))]
    monkeypatch.setattr(substrings, "equal_bytes", lambda g, s, n: (most.append(len(s)), plain(g, s, n))[1])
    got = substrings.first_equal(group, first, size, rank.view(np.int64), step)
    assert got.tolist() == want
    assert len(seen) < len(want)
    # those that are alone aren't laid out, the others a piece at a time
    runs = np.unique(np.stack([rank.view(np.int64), size.astype(np.int64)]), axis=1, return_counts=True)[1]
    assert sum(most) == runs[runs > 1].sum() < len(rank)
    assert max(most) <= max(step, runs.max())
