"""Spelling variants against brute force: runs, damage, near pairs, shared endings, roots, odd rows."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest

from cosecha.llm import variants
from cosecha.llm.common import table

DOCS = "doc_id long, text string, word string, n long, key string, rest int"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def low(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def counted(rows, damage=97, min_chars=5, min_count=3):
    n = collections.Counter()
    for doc, text in rows:
        for run in map(low, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def truth(n):
    close = collections.defaultdict(set)
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            close[a].add(b)
            close[b].add(a)
    form = {}
    for w in n:
        best = min(close[w], key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def texts(seed=6, n=120):
    rng = random.Random(seed)
    base = ["station", "nation", "Relation", "größe", "ÉCOLE", "école", "straße", "señora", "banana", "bananas", "x×y÷z",
            "aaaaa", "aaaaaa", "abcde", "bcdef", "tunnel", "Funnel", "cat", "w" * 70, "naïve", "1234", "ñandú"]
    out = [None, "", " \n", "...", "don't", "a" * 3000, "é" * 40]
    while len(out) < n:
        w = []
        for _ in range(rng.randint(1, 60)):
            x = rng.choice(base) if rng.random() < 0.6 else rng.choice(base[:4])
            if rng.random() < 0.15:
                at = rng.randrange(len(x) + 1)
                x = x[:at] + rng.choice(["", "e", "ü", "a"]) + x[at + rng.randint(0, 1):]
            w.append(x)
        out.append(rng.choice([" ", ", ", "-", "\n", "日", "́"]).join(w))
    return out


def test_runs_equal_the_pattern():
    rows = [*texts(), "ÀÿÖ×÷", "aĀb", "ab¿cd", "A1b"]
    found, row = variants.runs(pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())}))
    assert list(zip(row.tolist(), found.to_pylist())) == [
        (i, low(r)) for i, t in enumerate(rows) for r in RUN.findall(t or "")]


def test_counts_with_damage(spark):
    rows = list(enumerate(texts())) + [(None, "banana banana"), (3, "station"), (3, "station")]
    docs = spark.createDataFrame([(i, t, "w", 1, "k", 2) for i, t in rows], DOCS).repartition(3)
    for damage in (0, 97, 2):
        got = {r.word: r.n for r in variants.counts(docs, 5, damage).where("n >= 3").collect()}
        assert got == counted(rows, damage)


@pytest.mark.parametrize("pairs", [1, 20, variants.PAIRS])
def test_near_pairs_equal_brute_force(spark, pairs):
    """With one pair to a chunk every level of cutting is used."""
    rng = random.Random(12)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(150)}
    words |= {"".join(rng.choice("abcé") for _ in range(4)) + "ation" for _ in range(60)}
    words |= {"prefix" + "".join(rng.choice("abü") for _ in range(rng.randint(0, 3))) for _ in range(30)}
    words = sorted(words)
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = sorted(tuple(sorted([(r.a, r.a_n), (r.b, r.b_n)])) for r in variants.near_pairs(df, pairs).collect())
    n = {w: i for i, w in enumerate(words)}
    assert got == sorted(tuple(sorted([(a, n[a]), (b, n[b])])) for a, b in itertools.combinations(words, 2)
                         if near(a, b))


def test_roots_follow_long_ways(spark):
    n = {"a" * (5 + k): 3 * 2 ** k for k in range(12)} | {"zebra": 3, "zebru": 5, "zebro": 6, "zebre": 6}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = sorted((tuple(r) for r in variants.variants(df).collect()), key=str)
    assert got == sorted(truth(n), key=str)
    assert {r[2] for r in got if r[0].startswith("a")} == {"a" * 16}


def test_report_equals_brute_force(spark):
    rows = list(enumerate(texts(seed=7, n=200))) + [(None, "banana banan banan banan"), (3, "stattion " * 3)]
    docs = spark.createDataFrame([(i, t, "w", 1, "k", 2) for i, t in rows], DOCS).repartition(4)
    found = variants.report(docs)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect())) == truth(counted(rows))


def test_empty_table(spark):
    assert variants.report(spark.createDataFrame([], DOCS)).count() == 0
    assert variants.report(spark.createDataFrame([(1, None, "w", 1, "k", 2)], DOCS)).count() == 0


def test_given_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, variants.report(docs).collect())) == truth(counted(rows))
