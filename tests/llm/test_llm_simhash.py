"""Covering SimHash against brute force: hashes, masks, components, large buckets and odd rows."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cosecha.llm import simhash

DOCS = "doc_id long, text string, fp string, component_id string, held long, key int, n int"


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def truth(rows, radius=3):
    fps = [fingerprint(t) for _, t in rows]
    first = list(range(len(rows)))

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            first[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(doc, low.get(root(i), doc))
    return sorted(((doc, format(fps[i], "016x"), low.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def texts(seed=5, n=150):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "ñu", "42",
                  "a-rather-long-word-of-more-than-thirty-two-bytes-in-all"]
    out = [None, "", " \t\n", "one", "One two", "one  two", "x" * 4000, "tres palabras más"]
    while len(out) < n:
        w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 10, 60, 300]))]
        out.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):  # near copies, chains of them
            w = list(w)
            w[rng.randrange(len(w))] = "changed"
            out.append(rng.choice([" ", "\n", " \t "]).join(w))
        if rng.random() < 0.3:
            out.append(out[-1])
    return out


def test_xxh64_of_spans():
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(k)) for k in [*range(100), 1000, 31, 32, 33, 64]]
    ends = np.cumsum([len(p) for p in parts])
    found = simhash.xxh64(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends)
    assert found.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_masks_cover_every_set_of_positions():
    for radius in (1, 2, 3):
        for level in range(3):
            outside = [~m & (1 << 64) - 1 for m in simhash.masks(radius, level)]
            assert len(outside) == 2 ** (radius + 1) - 1
            for at in itertools.combinations(range(64), radius):
                held = sum(1 << p for p in at)
                assert any(held & o == held for o in outside)


def test_fingerprints_in_small_steps(monkeypatch):
    rows = texts()
    batch = pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())})
    for step in (1, 7, 1 << 16):
        monkeypatch.setattr(simhash, "STEP", step)
        assert simhash.fingerprints(batch).tolist() == [fingerprint(t) for t in rows]


@pytest.mark.parametrize("bucket", [8, simhash.BUCKET])
def test_components_equal_brute_force(spark, bucket):
    rows = list(enumerate(texts()))
    rows += [(7, "another text of doc seven"), (None, "nobody's text"), (None, rows[40][1]), rows[30]]
    docs = spark.createDataFrame([(i, t, "f", "c", 1, 2, 3) for i, t in rows], DOCS).repartition(4)
    found = simhash.simhash_components(docs, bucket=bucket)
    got = sorted(((r.doc_id, format(r.fp % (1 << 64), "016x"), r.component_id) for r in found.collect()), key=str)
    assert got == truth(rows)


def test_many_fingerprints_in_one_bucket(spark):
    """Thousands within a few bits of each other: no bucket stays above its size, no link is lost."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 6))) for _ in range(1500)}
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    values = np.array(fps, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long").repartition(5)
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.covering_links(df, bucket=16).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)

    def groups(pairs):
        first = {x: x for x in fps}

        def root(x):
            while first[x] != x:
                x = first[x]
            return x

        for a, b in pairs:
            first[root(a)] = root(b)
        out = {}
        for x in fps:
            out.setdefault(root(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    near = np.bitwise_count(values[:, None] ^ values) <= 3
    assert groups(links) == groups((fps[i], fps[j]) for i, j in zip(*np.nonzero(np.triu(near, 1))))


def test_report_and_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.report(docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.report(docs).count() == 0
    rows = list(enumerate(["", None, "one two", "ONE two"]))
    found = simhash.report(spark.createDataFrame([(i, t, "f", "c", 1, 2, 3) for i, t in rows], DOCS))
    assert sorted(map(tuple, found.collect()), key=str) == truth(rows)
