"""Near-duplicates against all pairs, and the paths for large mixed buckets."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import neardup


def shingle_set(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """{doc_id: component} over all pairs; rows that share an id are one document."""
    nodes = [(d, shingle_set(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, (_, s) in enumerate(nodes):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, (d, s) in enumerate(nodes):
        both = Counter(j for x in s for j in index[x] if j < i)
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(nodes[j][1]) - n):
                a, b = sorted((root(d), root(nodes[j][0])))
                up[b] = a
    return {d: root(d) for d in up}


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(shingle_set(t))) for d, t in rows)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_equals_all_pairs(which, request):
    check(request.getfixturevalue(which))


def varied(words, edits, rng, tag):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"{tag}x{rng.random():.12f}"
    return " ".join(out)


@pytest.mark.parametrize("edits", [(1, 2), (3, 9), (4, 12)])
def test_large_groups_with_outsiders(spark, edits, monkeypatch):
    """Copies around the limit: many pairs in one bucket, some linked and some not."""
    monkeypatch.setattr(neardup, "SMALL", 6)
    monkeypatch.setattr(neardup, "LEFT_BLOCK", 16)
    monkeypatch.setattr(neardup, "RIGHT_BLOCK", 32)
    rng = random.Random(edits[0])
    base = [f"w{i}" for i in range(150)]
    rows = [(i, varied(base, rng.randint(*edits), rng, f"t{i}")) for i in range(150)]
    rows += [(1000 + i, " ".join(base[40:110]) + " " + " ".join(f"z{i}y{k}" for k in range(rng.choice([8, 12, 20])))) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 50, 400, 5000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        s = neardup.sketch(x)
        assert len(s) == neardup.COORDINATES and (s != neardup._EMPTY).all()
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for share in (0.5, 0.8):
        k = int(4000 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, 4000 - k).astype(np.uint64)])
        assert abs((neardup.sketch(np.unique(a)) == neardup.sketch(np.unique(b))).mean() - share) < 0.12


def test_distinct_documents(odd, docs):
    kept = neardup.distinct_documents(odd)
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 7: 1, None: 1, 8: 1, 9: 1} and kept.columns == odd.columns
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id for r in neardup.distinct_documents(docs).collect()} == set(want.values())
