"""The dealt operators against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cosecha.llm import (decontaminate, jaccard_join, line_dedup, mtree, packing, pitman_yor, rollups, run_index,
                         sharding, toxicity)
from cosecha.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rest string, key string, _row int"


def corpus(seed=3, n=60):
    """Small texts with copies, near copies, shared lines and passages, nulls and empties."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "ñu", "42"]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [line(14) for _ in range(4)]
    passage = line(60)
    texts = [None, "", "\n", " ", "one", "one two", "short\nshort", "x" * 5000]
    while len(texts) < n:
        body = [line(rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.5:
            body.append(rng.choice(shared))
        if rng.random() < 0.3:
            body.append("Intro " + passage + " outro")
        texts.append("\n".join(body))
        if rng.random() < 0.3:
            texts.append(texts[-1])
        if rng.random() < 0.3:
            w = (texts[-1] + " tail " + line(120)).split(" ")
            texts.append(" ".join(w))
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return [(i, t, "en", None, None, "r", "k", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def body(text):
    return (text or "").encode()


# -- 1


def nearest(vectors, k):
    ints = {i: [math.floor(256 * x) for x in v] for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_mtree_equals_brute_force(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    vectors += [(400 + i, [0.5] * 6) for i in range(150)]  # many equal vectors: ties by id
    vectors += [(900, None), (950, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6), (1050, [float("inf")] * 6),
                (None, [1.0] * 6), (1100, [2.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = mtree.top_k(df, df.where("vec_id % 50 = 0"), page=32, block=4, routers=16).collect()
    assert {tuple(r) for r in got} == nearest(vectors, 5) and len(got) == len(nearest(vectors, 5))


def test_mtree_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], schema)
    assert [tuple(r) for r in mtree.report(two).collect()] == [(0, 1, 1, 256 * 128)]
    assert mtree.report(spark.createDataFrame([], schema)).collect() == []


# -- 2


def norm(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    out, w = [], ""
    for c in low + " ":
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            if w:
                out.append(w)
            w = ""
        else:
            w += c
    return out


def test_decontamination(spark, docs, rows, none):
    items = [(7, rows[12][1]), (8, "one"), (9, None), (10, "..."), (11, " ".join(norm(rows[20][1])[:10])), (7, "One two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = collections.defaultdict(set)
    for i, t in items:
        w = norm(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[a:a + k])].add(str(i))
    for limit in (10**6, 0):  # broadcast, and the shuffle beyond it
        got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench, max_broadcast=limit).collect()}
        assert len(got) == len(rows)
        for i, t, *_ in rows:
            w, hit, found = norm(t), set(), set()
            for k in {len(g) for g in grams}:
                for a in range(len(w) - k + 1):
                    if tuple(w[a:a + k]) in grams:
                        hit |= set(range(a, a + k))
                        found |= grams[tuple(w[a:a + k])]
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(found))
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["contaminated"]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert all(len(norm(cut[i])) == r["n_words"] - r["n_hit"] for i, r in got.items())
    assert all(cut[i] == t for i, t, *_ in rows if not got[i]["contaminated"])
    assert decontaminate.report(none, bench).collect() == []
    assert not decontaminate.report(docs, bench.limit(0)).where("contaminated").count()


# -- 3


def test_words_apart_have_the_tokenizer_s_ids():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from cosecha.llm.tokens import WordTokenizer, default_path

    own, tokenizer = WordTokenizer(default_path()), Tokenizer.from_file(default_path())
    some = ["It's", "DON'T", "naïve.", "İ.", "ΟΔΟΣ.", "क़.", "é!", "don’t", "<|endoftext|>", "a<|startoftext|>b.",
            "x\x0by", "1234.5", "ПРИВЕТ,", "Ærø;", "ß!", "µ.", "...", "?!", "a.b.", "中文。", "ab\u3000cd", "\x00q",
            "\u200dx.", "ﬁn.", "Ǆ.", "straße,", "\x1c", "e\u0301.", "Ё.", "word", "Word,", "w" * 300]
    draw = random.Random(5)
    texts = [None, "", " ", "\n\n"] + [
        "".join(draw.choice(some) + draw.choice([" ", "\n", "  ", "\t", "", "\r\n"]) for _ in range(draw.randint(1, 40)))
        for _ in range(400)]
    for batch in (texts, texts[::-1], [], [None]):  # the second time from the store
        ids, offsets = own.encode(pa.array(batch, pa.string()))
        assert len(offsets) == len(batch) + 1 and offsets[-1] == len(ids)
        for text, a, b in zip(batch, offsets, offsets[1:]):
            assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_packing_covers_every_token_once(spark, docs, rows, none):
    from tokenizers import Tokenizer

    from cosecha.llm.tokens import default_path

    tokenizer = Tokenizer.from_file(default_path())
    full = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t, *_ in rows}
    got = packing.pack(docs, with_ids=True, window=256).collect()
    seen, rooms = collections.Counter(), collections.defaultdict(list)
    for r in got:
        ids = full[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids"] == ids.tobytes() and r["ids_crc32"] == zlib.crc32(r["ids"])
        assert r["doc_tokens"] == len(full[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in full.items()}
    assert sorted(rooms) == list(range(len(rooms)))
    for parts in rooms.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(none).collect() == []


def test_fill_plan_uses_each_piece_once():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 5000):
        histogram = np.append(0, rng.multinomial(n, np.ones(64) / 64))
        used = np.zeros(65, int)
        for parts, times in packing.fill_plan(histogram):
            assert sum(k * m for k, m in parts.items()) <= 64
            for k, m in parts.items():
                used[k] += m * times
        assert (used == histogram).all()
    a = rng.random((6, 4))
    x = packing.nnls(a, a @ np.array([1.0, 0, 2, 0]))
    assert np.allclose(x, [1, 0, 2, 0], atol=1e-6)


# -- 4


def jaccard_truth(rows, percent=90):
    sets = {}
    for i, t, *_ in rows:
        w = body(t).lower().split()
        sets[i] = {tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def test_jaccard_join_finds_every_link(spark, docs, rows, none):
    assert {tuple(r) for r in jaccard_join.report(docs).collect()} == jaccard_truth(rows)
    assert jaccard_join.report(none).collect() == []
    one = jaccard_join.keep_one(docs)
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in one.collect()} == {c for _, _, c in jaccard_truth(rows)}


def test_jaccard_join_chains_and_families(spark):
    """A chain in which only neighbours link, and a family whose members mostly don't."""
    words = [f"w{k}" for k in range(400)]
    chain = [" ".join(words[k * 8:k * 8 + 200]) for k in range(12)]
    rng = random.Random(5)
    family = []
    for _ in range(40):
        w = [f"v{k}" for k in range(150)]
        for k in rng.sample(range(150), rng.randint(0, 5)):
            w[k] = f"u{rng.randrange(9)}"
        family.append(" ".join(w))
    rows = list(enumerate(chain + family))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.report(df).collect()} == jaccard_truth(rows)


def test_strangers_share_few_signatures_and_links_keep_one():
    """Few empty choices are signatures, sketches reject strangers, and neither loses a pair that links."""
    rng = np.random.default_rng(7)
    fresh = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    sets = [fresh(400) for _ in range(150)]
    every = np.concatenate([np.unique(jaccard_join.signatures(s, 80)) for s in sets])
    assert len(every) - len(np.unique(every)) < 150
    n, all_ = np.array([len(s) for s in sets]), np.arange(len(sets))
    can = jaccard_join.may_link(n, [jaccard_join.sketch(s) for s in sets], all_, all_, 80)
    assert (can == np.eye(len(sets), dtype=bool)).all()
    for percent in (80, 90):
        for size in [*range(1, 40), 80, 200, 700, 3000]:
            for _ in range(4):
                common = fresh(size)
                room = len(common) * (100 - percent) // percent  # elements that one of the two alone may hold
                k = int(rng.integers(0, room + 1))
                a, b = np.union1d(common, fresh(k)), np.union1d(common, fresh(room - k))
                assert len(np.intersect1d(jaccard_join.signatures(a, percent), jaccard_join.signatures(b, percent)))
                assert jaccard_join.may_link(np.array([len(a), len(b)]), [jaccard_join.sketch(a), jaccard_join.sketch(b)],
                                             np.array([0]), np.array([1]), percent).all()


def test_jaccard_join_fetches_sets_of_possible_links_alone(spark, monkeypatch):
    """Texts that share a passage share signatures, but only pairs that can link have their sets fetched."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(60)])) for i in range(60)]
    rows += [(100 + k, " ".join([*rows[k][1].split()[:-4], f"z{k}"])) for k in range(10)]
    asked, verified = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *a: asked.append(pairs.count()) or verified(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.keep_one(docs, percent=80, shingle=5).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == set(range(60))
    assert sum(asked) <= 20, asked


def test_jaccard_components_count_no_links(spark):
    """Pairs inside a component are not all compared, so no column claims to count links."""
    rows = [(i, " ".join(f"w{k}" for k in range(60)) + f" end{i}") for i in range(3)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {tuple(r) for r in got.collect()} == jaccard_truth(rows)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = rng.integers(0, max(1, len(a) // 12) + 1)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64)]))
        if len(b) and 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
            assert len(np.intersect1d(jaccard_join.signatures(a), jaccard_join.signatures(b)))


# -- 5


def change(op, doc, source, n, version="v1"):
    return (op, doc, source, "en", version, n)


CHANGES = "op string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long"


def test_ledger(spark):
    ledger = rollups.Ledger(spark, scratch(spark, "ledger-test"))
    assert ledger.totals().collect() == []
    df = lambda x: spark.createDataFrame(x, CHANGES)
    load = df([change("insert", 1, "a", 10), change("insert", 2, None, 20), change("insert", 2, None, 20),
               change("insert", None, "a", 5), change("insert", 3, "a", None), change("odd", 4, "a", 5)])
    totals = lambda: {(r["source"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"])
                      for r in ledger.totals().collect()}
    assert ledger.apply("b1", load) and not ledger.apply("b1", load)
    assert totals() == {("a", "v1"): (1, 10), (None, "v1"): (1, 20)}
    assert ledger.apply("b2", df([change("revise", 1, "a", 7, "v2"), change("revise", 9, "a", 7, "v2"),
                                  change("delete", 2, None, None), change("insert", 5, "b", 1)]))
    assert totals() == {("a", "v2"): (1, 7), ("b", "v1"): (1, 1)}
    assert ledger.apply("b3", df([])) and ledger.apply("b4", df([change("insert", 5, "b", 4)]))
    assert totals() == {("a", "v2"): (1, 7), ("b", "v1"): (1, 4)}


def test_two_writers_lose_nothing(spark, monkeypatch):
    """Batch b is committed while a computes: a is computed again on the newer base."""
    path = scratch(spark, "ledger-race")
    one, two = rollups.Ledger(spark, path), rollups.Ledger(spark, path)
    df = lambda x: spark.createDataFrame(x, CHANGES)
    plain, raced = one._deltas, []

    def slow(*args):
        record = plain(*args)
        if not raced:
            raced.append(two.apply("b", df([change("insert", 2, "a", 20)])))
        return record

    monkeypatch.setattr(one, "_deltas", slow)
    assert one.apply("a", df([change("insert", 1, "a", 10)])) and raced == [True]
    assert [(c["batch"], c["order"]) for c in one.commits()] == [("b", 0), ("a", 1)]
    assert [(r["n_docs"], r["n_tokens"]) for r in one.totals().collect()] == [(2, 30)]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in two.documents().collect()) == [(1, 10), (2, 20)]
    assert [r["doc_id"] for r in two.documents(spark.createDataFrame([(2,)], "doc_id long")).collect()] == [2]


def test_torn_commit_is_no_commit(spark, monkeypatch):
    """A writer that dies before its commit is renamed leaves a draft that nobody reads."""
    ledger = rollups.Ledger(spark, scratch(spark, "ledger-torn"))
    df = lambda x: spark.createDataFrame(x, CHANGES)
    assert ledger.apply("b1", df([change("insert", 1, "a", 10)]))
    ledger._fs.create(ledger._at("drafts/dead.json"), False).close()
    assert [c["batch"] for c in ledger.commits()] == ["b1"]
    assert not ledger._commit(0, {"batch": "x"}) and [c["batch"] for c in ledger.commits()] == ["b1"]
    assert ledger.apply("b2", df([change("delete", 1, None, None)])) and not ledger.totals().collect()


CLASHES = ["_toxicity", "_n_lines", "_n_dropped", "size", "shard", "_spans", "spans", "key", "row", "whole", "_kept"]


def test_columns_that_clash_with_internal_names(spark):
    from cosecha.llm.common import fresh

    line = "one two three four five six seven eight nine ten eleven twelve"
    texts = [line, f"{line}\nanother line of text", "clean words only", None, ""]
    docs = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in CLASHES]) for i, t in enumerate(texts)],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))
    keeps = lambda df: sorted(tuple(r[c] for c in ["doc_id", *CLASHES]) for r in df.collect())
    whole = keeps(docs)
    labels = spark.createDataFrame([(i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    assert keeps(toxicity.keep_clean(docs, labels)) == whole
    assert keeps(line_dedup.dedup_lines(docs, counts=None)) == whole
    bench = spark.createDataFrame([("i", line)], "item_id string, text string")
    assert keeps(decontaminate.remove_spans(docs, bench)) == whole
    path = scratch(spark, "clash-shards")
    sharding.write_shards(docs, path, 3)
    back = spark.read.parquet(path)
    assert keeps(back) == whole and set(back.columns) - set(docs.columns) == {"shard_"} == {fresh(docs, "shard")}


def test_spans_are_cut_from_the_row_that_has_them(spark):
    """Rows of one doc_id, or of none, are judged each by its own text."""
    passage = " ".join(f"bench{i}" for i in range(10))
    rows = [(1, f"Before {passage} after"), (1, "a clean text"), (None, f"{passage}!"), (None, "clean too"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("i", passage)], "item_id string, text string")
    got = sorted(map(str, (tuple(r) for r in decontaminate.remove_spans(docs, bench).collect())))
    assert got == sorted(map(str, [(1, "Before after"), (1, "a clean text"), (None, ""), (None, "clean too"), (2, None)]))


def test_token_rollups_of_documents(docs, rows, none):
    from cosecha.llm.tokens import default_path

    count = rollups._counter(default_path())
    distinct = {}
    for i, t, *_ in rows:
        distinct.setdefault(t or "", i)
    (r,) = rollups.report(docs).collect()
    assert (r["source"], r["lang"], r["tokenizer_version"], r["n_docs"], r["n_tokens"]) == (
        None, "en", rollups.WORDS, len(distinct), sum(count(list(distinct))))
    assert rollups.report(none).collect() == []


# -- 6


def test_line_dedup(spark, docs, rows, none):
    blanks = " \t\n\r\x0b\x0c"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(blanks))
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    for bits in (1 << 20, line_dedup.bloom.SEGMENT):
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, bits=bits).collect()}
        for i, t, *_ in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
            assert got[i]["text"] == (None if t is None else "\n".join(kept))
            assert (got[i]["_n_lines"], got[i]["_n_dropped"], got[i]["rest"]) == (len(lines), len(lines) - len(kept), "r")
    assert line_dedup.report(none).collect() == []


# -- 7


def test_byte_shards(spark, docs, rows, none):
    got = sorted(sharding.byte_shards(docs, n_shards=5, keep=("rest",)).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == [i for i, *_ in rows] and {r["rest"] for r in got} == {"r"}
    assert all((r["size"], r["text_crc32"]) == (len(body(t)) + 8, zlib.crc32(body(t))) for r, (_, t, *_) in zip(got, rows))
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)  # contiguous
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for k in range(5):
        own = [r for r in got if r["shard"] == k]
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 5) <= most
    assert sharding.byte_shards(none).collect() == []
    twice = docs.union(docs)
    assert sharding.byte_shards(twice).count() == 2 * len(rows)


# -- 8


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = ["rat", "idiot", "pathetic", "worthless", "disgusting"]
    automaton = toxicity.LexiconAutomaton(terms, ["lowei"])
    words = ["loweischaft", "lowe", "", "idio", "idoit", "patheticc"]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "t", "i"])
        words.append("".join(w))
    for w in words:
        best = min((edit_distance(w, t), t) for t in terms if edit_distance(w, t) <= toxicity.edits_allowed(t)) \
            if any(edit_distance(w, t) <= toxicity.edits_allowed(t) for t in terms) else None
        wanted = toxicity.EXACT if w.startswith("lowei") or best and best[0] == 0 else \
            toxicity.FUZZY if best else toxicity.NONE
        assert automaton.match(w) == wanted, w


def test_quoted_hits_are_told_apart():
    m = toxicity.Matcher(["idiot"], [])
    assert m.features("you idiot you")[3] == 1 and m.features('he cried "you idiot you" then')[3] == 0
    assert m.features("they called idiot")[2] > 0 and m.features("nothing here") == [0.0] * 5


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(7)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = [rng.choice(plain) for _ in range(30)]
        if toxic:
            w[rng.randrange(30)] = rng.choice(["scoundrel", "blockhead", "scoundrle" if i % 12 == 0 else "scoundrel"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "scoundrel"), (1002, "such a blokhead")]
    labels += [(1000, None), (None, 1), (0, 1), (1001, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.report(d, lab).collect()}
    truth = dict(labels[:600])
    assert all(got[i]["predicted"] == y for i, y in truth.items())
    assert got[1002]["predicted"] == 1 and got[None]["predicted"] == 1
    assert got[1000]["score"] == got[1001]["score"] < 0.5
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    clean = toxicity.keep_clean(d, lab)
    assert clean.columns == d.columns and clean.count() == len(rows) - 100 - 2
    assert toxicity.report(d.limit(0), lab).collect() == []
    assert toxicity.report(d, lab.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_rare_terms_and_copies(spark):
    """Fifty terms, each in 1.3 % of the toxic texts, and a family of copies that holds a third of them."""
    rng = random.Random(8)
    letters = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    plain, terms, own = ([letters(12) for _ in range(n)] for n in (300, 50, 30))
    texts = [(" ".join(rng.choice(plain) for _ in range(20)), 0) for _ in range(2400)]
    texts += [(" ".join([*(rng.choice(plain) for _ in range(19)), terms[k % 50]]), 1) for k in range(600)]
    texts += [(" ".join([*own, terms[0]]), 1)] * 300
    rng.shuffle(texts)
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    assert set(terms) == set(model.terms) and not set(own) & set(model.terms)
    got = {r["doc_id"]: r["_toxicity"] >= 0.5 for r in toxicity.score(d, model).collect()}
    assert all(got[i] == bool(y) for i, (_, y) in enumerate(texts))


def test_bare_words_are_those_that_features_see():
    rng = random.Random(12)
    for _ in range(200):
        text = " ".join(rng.choice(["abc", "def", "ghi", "“", "”", '"', "said", "xyz", "’"]) for _ in range(40))
        for w in ("abc", "def", "ghi", "xyz"):
            assert (w in toxicity.bare_words(text)) == (toxicity.Matcher([w], []).features(text)[3] > 0)


def test_toxicity_quoted_terms_and_misspelled_stems(spark):
    """A term that clean texts quote, a misspelling that one of them holds, and a misspelled word that a stem covers."""
    rng = random.Random(9)
    plain = [f"word{k}" for k in range(300)]
    line = lambda k: [rng.choice(plain) for _ in range(k)]
    forms = ["idiotic", "idiots", "idiotism", "idiotas", "idiotesque", "idiotry"]
    rows = []
    for i in range(1200):
        w = line(30)
        if i % 4 == 0:
            term = "scoundrel" if i % 8 else forms[i // 8 % 6]
            if i % 20 == 0:  # one letter replaced
                k = rng.randrange(1, len(term) - 1)
                term = term[:k] + rng.choice("qxzw") + term[k + 1:]
            w[rng.randrange(30)] = term
        elif i % 4 == 1:
            w[10:10] = ["he", "wrote", "“", "scoundrel", "”", "there"]
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    rows.append((5000, " ".join(line(10) + ["scoundrle"] + line(10)), 0))
    ask = {6000: "such a scoundrle", 6001: "such an idqotic one", 6002: "he wrote “ scoundrel ” there"}
    d = spark.createDataFrame([r[:2] for r in rows] + list(ask.items()), "doc_id long, text string")
    lab = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    assert "scoundrel" in model.terms and any("idiotic".startswith(s) for s in model.stems)
    got = {r["doc_id"]: r["_toxicity"] >= 0.5 for r in toxicity.score(d, model).collect()}
    assert got[6000] and got[6001] and not got[6002]
    assert sum(got[i] != bool(y) for i, _, y in rows) <= 1  # all but the clean text with the misspelling


# -- 9


@pytest.mark.parametrize("options", [{}, {"hot_contexts": 0}, {"group_bytes": 500}])
def test_run_index_dedup(docs, rows, none, options):
    n = 40
    seen = collections.Counter()
    for _, t, *_ in rows:
        for k in range(len(body(t)) - n + 1):
            seen[body(t)[k:k + n]] += 1
    got = {r["doc_id"]: r for r in run_index.remove_repeats(docs, length=n, kmer=8, **options).collect()}
    for i, t, *_ in rows:
        keep = np.ones(len(body(t)), bool)
        for k in range(len(body(t)) - n + 1):
            if seen[body(t)[k:k + n]] > 1:
                keep[k:k + n] = False
        kept = bytes(np.frombuffer(body(t), np.uint8)[keep])
        runs = int(np.count_nonzero(np.diff(np.r_[1, keep.astype(int)]) == -1))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(keep), len(keep) - len(kept), runs)
        assert got[i]["kept"] == kept
    if not options:
        assert run_index.report(none).collect() == []
        r = run_index.report(docs).collect()[0]
        assert len(r["kept_sha256"]) == len(hashlib.sha256().hexdigest())


def test_run_index_matching_statistics():
    rng = random.Random(8)
    for _ in range(100):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        index = run_index.RunIndex(texts)
        stats = index.matching_statistics()
        places = [(t, k) for t in texts for k in range(len(t))]
        number = [(x, k) for x, t in enumerate(texts) for k in range(len(t))]
        for (x, k) in number:
            longest = 0
            for y, j in number:
                if (y, j) != (x, k):
                    m = 0
                    while k + m < len(texts[x]) and j + m < len(texts[y]) and texts[x][k + m] == texts[y][j + m]:
                        m += 1
                    longest = max(longest, m)
            assert stats[index.starts[x] + k] == longest
        assert len(places) == len(number) and index.lengths.sum() == index.n


def test_very_many_contexts_of_one_anchor(spark):
    """Two pieces leave a context of a hot anchor, not all its windows, and the result is the brute force's."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = text(120)
    texts = [text(150) + common + text(150) for _ in range(60)]
    shared = text(70)  # 190 bytes with the common ones, and 200 in the pairs that go on alike
    texts += [text(90) + shared + common + text(90) for _ in range(10)]
    texts += [text(90) + shared + common + "0123456789" + text(90) for _ in range(4)]
    texts += [text(100) + common + shared + "9876543210" + text(90) for _ in range(3)] + [text(400), "", None]
    places = collections.Counter(t[k:k + 200] for t in texts if t for k in range(len(t) - 199))
    want = {}
    for i, t in enumerate(texts):
        gone = {j for k in range(len(t or "") - 199) if places[t[k:k + 200]] > 1 for j in range(k, k + 200)}
        want[i] = len(gone)
    assert sum(n > 0 for n in want.values()) == 7
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (1, 5, 20, 2000):
        got = {r["doc_id"]: r["n_removed"] for r in run_index.remove_repeats(docs, hot_contexts=hot).collect()}
        assert got == want, hot
    contexts = spark.createDataFrame([(1, i, bytearray(t.encode()[60:340])) for i, t in enumerate(texts[:60])],
                                     "anchor long, context long, body binary")
    assert run_index._halves(run_index._whole(contexts, 200, 32), 200, 32).count() <= 120


def test_near_copies_of_one_context_go_on_as_one(spark, monkeypatch):
    """Equal halves of a hot anchor's contexts are halved once, not once for each context."""
    rng = random.Random(15)
    base = "".join(rng.choice("abcdefgh") for _ in range(420))
    texts = [base[:k] + "XYZ"[k % 3] + base[k + 1:] for k in range(60, 360)]
    places = collections.Counter(t[k:k + 200] for t in texts for k in range(len(t) - 199))
    want = {i: len({j for k in range(len(t) - 199) if places[t[k:k + 200]] > 1 for j in range(k, k + 200)})
            for i, t in enumerate(texts)}
    made, halves = [], run_index._halves

    def counted(pieces, *args):
        out = halves(pieces, *args)
        made.append(out.count())
        return out

    monkeypatch.setattr(run_index, "_halves", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in run_index.remove_repeats(docs, hot_contexts=1).collect()}
    assert got == want
    assert sum(made) < 60 * len(texts), made


def test_line_dedup_hands_over_short_batches(spark, docs):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 10_000)
    try:
        line_dedup.dedup_lines(docs)
        assert int(spark.conf.get(key)) <= 1_000
    finally:
        spark.conf.set(key, before)


# -- 10


def test_pitman_yor(spark, docs, rows, none):
    for size in (8, 4096):  # few frequent words, and all of them: the road changes, the counts don't
        got = {r["doc_id"]: r for r in pitman_yor.scored(docs, frequent_size=size).collect()}
        words = {i: body(t).lower().split() + [b"\n"] for i, t, *_ in rows}
        count = collections.Counter()
        for i, w in words.items():
            if zlib.crc32(str(i).encode()) % 10:
                count.update(w)
        n, z = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
        for i, w in words.items():
            r = got[i]
            base = sum(math.log10((count[x] + 0.1) / z) for x in w)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
            assert r["score"] < 0 and math.isclose(r["perplexity"], 10 ** (-r["score"] / len(w)), rel_tol=1e-9)
        assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert pitman_yor.report(none).collect() == []
    twice = pitman_yor.scored(docs.union(docs))
    assert twice.count() == 2 * len(rows)
    assert {r["n_tokens"] for r in twice.where("doc_id = 5").collect()} == {3}


def test_seating_is_between_one_table_and_one_each():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 50, 10**6])
    t = pitman_yor.seat(c, np.full(5, 2.0), 0.5, rng)
    assert (t[:2] == [0, 1]).all() and (t >= (c > 0)).all() and (t <= c).all()


def test_seating_follows_the_law():
    """Against seating each customer on its own: the same mean number of tables, whichever way draws are made."""
    rng, runs, customers = np.random.default_rng(5), 4000, 60
    for strength, each, discount in ((0.02, 0.0, 0.7), (0.5, 0.2, 0.4), (6.0, 0.0, 0.9)):
        t = np.ones(runs)
        for n in range(1, customers):
            new = strength + each * t
            t += rng.random(runs) < new / (new + n - discount * t)
        keys = rng.integers(0, 2**63, runs, dtype=np.uint64)
        for key in (None, keys):
            got = pitman_yor.seat(np.full(runs, customers), np.full(runs, strength), discount, rng, each, key)
            assert abs(got.mean() - t.mean()) < 5 * math.sqrt((got.var() + t.var()) / runs) + 1e-9


def pitman_yor_truth(word, context, row, out, sweeps=5, burn_in=2):
    """The model in one process, over tokens: log10 probabilities of rows, and P(word, context) itself."""
    seen = collections.Counter((w, u) for w, u, r in zip(word, context, row) if not out[r])
    w, u = (np.array(x, np.uint64) for x in zip(*seen))
    c = np.array(list(seen.values()))
    names, at = np.unique(w, return_inverse=True)
    rooms, of = np.unique(u, return_inverse=True)
    kinds, vocabulary = np.bincount(at), len(names)
    guess = lambda x: min(max((x == 1).sum() / max(1, (x == 1).sum() + 2 * (x == 2).sum()), 0.05), 0.95)
    d0, d1 = guess(kinds), guess(c)
    t, t0, c0, kept = np.ones(len(c), int), np.ones(len(names), int), kinds, []
    for k in range(sweeps):
        seed = pitman_yor.mix(np.array([k + 1], np.uint64))[0]
        base = 1 / (vocabulary + 1)
        parent = ((c0 - d0 * t0 + (1 + d0 * t0.sum()) * base) / (1 + c0.sum()))[at]
        others = np.bincount(of, weights=t)[of] - t
        t = pitman_yor.seat(c, (1 + d1 * others) * parent, d1, each=d1 * parent,
                            key=pitman_yor.mix(w ^ pitman_yor.mix(u + seed)))
        c0 = np.bincount(at, weights=t).astype(int)
        t0 = pitman_yor.seat(c0, (1 + d0 * (t0.sum() - t0)) * base, d0, each=d0 * base,
                             key=pitman_yor.mix(names + seed))
        if k >= burn_in:
            kept.append((t, np.bincount(of, weights=t), c0, t0))
    cell, customers = {x: i for i, x in enumerate(zip(w, u))}, np.bincount(of, weights=c)

    def p(x, y):
        i, a, b = cell.get((x, y)), np.flatnonzero(names == x), np.flatnonzero(rooms == y)
        total = 0
        for t, tables, c0, t0 in kept:
            root = (sum(c0[a] - d0 * t0[a]) + (1 + d0 * t0.sum()) / (vocabulary + 1)) / (1 + c0.sum())
            own = c[i] - d1 * t[i] if i is not None else 0
            total += (own + (1 + d1 * sum(tables[b])) * root) / (1 + sum(customers[b]))
        return total / len(kept)

    score = np.zeros(len(out))
    for x, y, r in zip(word, context, row):
        score[r] += math.log10(p(x, y))
    return score, p, names, rooms


def test_pitman_yor_equals_the_model_in_one_process(spark, docs, rows):
    """Restaurants are keyed by the whole word before; no score depends on which words are frequent."""
    batch = pa.RecordBatch.from_pydict({"text": pa.array([r[1] for r in rows])})
    out = np.array([zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows])
    word, context, row = pitman_yor.tokens(batch)
    want, p, names, rooms = pitman_yor_truth(word, context, row, out)
    unknown = np.uint64(7)
    for u in (*rooms, unknown):
        assert math.isclose(sum(p(w, u) for w in (*names, unknown)), 1, rel_tol=1e-9)
    for size in (1, 4, 4096):
        got = {r["doc_id"]: r["score"] for r in pitman_yor.scored(docs, frequent_size=size).collect()}
        assert all(math.isclose(got[r[0]], x, rel_tol=1e-9) for r, x in zip(rows, want))


def test_pitman_yor_contexts_are_words(spark):
    """Words that end alike have followers of their own, and of one training text all can be worked out."""
    held = [i for i in range(1, 2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    train = [i for i in range(1, 2000) if i not in set(held)]
    texts = [(i, ("red-aaa left", "blue-aaa right")[k % 2]) for k, i in enumerate(train[:100])]
    tried = ["red-aaa left", "red-aaa right", "blue-aaa right", "blue-aaa left"]
    df = spark.createDataFrame(texts + list(zip(held, tried)), "doc_id long, text string")
    got = {r["text"]: r["score"] for r in pitman_yor.scored(df).where("held_out").join(
        df.hint("broadcast"), "doc_id").collect()}
    assert got["red-aaa left"] > got["red-aaa right"] + 1 and got["blue-aaa right"] > got["blue-aaa left"] + 1

    one = spark.createDataFrame([(train[0], "a B c"), (held[0], "a b"), (held[1], "zz")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.scored(one).collect()}
    d = 0.95  # every dish and every word stands once
    root = lambda c: (c - d * c + (1 + d * 4) / 5) / (1 + 4)
    inside = lambda c, w: (c - d * c + (1 + d) * root(w)) / 2
    assert math.isclose(got[train[0]], 4 * math.log10(inside(1, 1)), rel_tol=1e-9)
    assert math.isclose(got[held[0]], math.log10(inside(1, 1) ** 2 * inside(0, 1)), rel_tol=1e-9)
    assert math.isclose(got[held[1]], math.log10(inside(0, 0) * root(1)), rel_tol=1e-9)
