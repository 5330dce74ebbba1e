"""Benchmark decontamination by a broadcast hash set of test n-grams (native operator).

The benchmark's windows of ten normalised words go into a small hash table,
keyed by the hash of each window's first three words, that is broadcast; one
pass over the words of every training text looks up the window that starts at
each word.  A window counts only if all its words equal those of the test
window, so neither the short key nor a collision can remove anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
# Words of a window by whose hash it is looked up; the whole window is then compared.
LEAD = 3
# Test windows that are broadcast at most (about 20 MB); more are joined by a shuffle.
MAX_BROADCAST_WINDOWS = 100_000

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, SMALL), SEPARATORS)
    return F.filter(parts, lambda w: F.length(w) > 0)


def _pin(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once, however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lead_hash(words: str, i: str, n: int) -> str:
    """Hash of the ``n`` words from index ``i`` (from 0), by which windows are looked up."""
    return f"xxhash64({n}, " + ", ".join(f"get({words}, {i} + {k})" for k in range(n)) + ")"


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: hash, len, words and the ids of the items that have them.

    An item of fewer than ``window`` words, but not none, is one window.
    """
    items = _pin(benchmark.select(F.col("item_id").cast("string").alias("item"),
                                  word_array(F.col("text")).alias("_w")), "w", F.col("_w"))
    n = F.size("w")
    length = F.least(n, F.lit(window))
    grams = (items.where(n > 0)
             .select("item", length.alias("len"), "w",
                     F.explode(F.sequence(F.lit(1), n - length + 1)).alias("i"))
             .select("item", "len", F.expr("slice(w, i, len)").alias("gram")))
    first = [F.expr(_lead_hash("gram", "0", k)) for k in range(1, LEAD + 1)]
    return (grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items"))
            .select(F.get(F.array(*first), F.least("len", F.lit(LEAD)) - 1).alias("t_hash"),
                    F.col("len").alias("t_len"), F.col("gram").alias("t_gram"), "items"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: its words, the hit words and the items found.

    Columns: doc_id, n_words, n_hit, n_items, items (sorted strings), spans
    (hit windows as (pos from 1, len), in order) and contaminated.  Null and
    empty texts have no words and are never hit; an empty benchmark hits
    nothing; benchmark items without words have no window; a null item_id has
    no name and is not listed.  Repeated rows are judged each for itself, and
    extra columns on either side are ignored.
    """
    tests = test_windows(benchmark, window)
    # Jobs over the benchmark alone: its windows are counted, and up to
    # ``max_broadcast`` of them their hashes go into the plan as a set and the
    # windows themselves into a broadcast.  More are joined by a shuffle.
    sizes = {r["t_len"]: r["n"] for r in tests.groupBy("t_len").agg(F.count("*").alias("n")).collect()}
    leads = sorted({min(k, LEAD) for k in sizes})
    small = sum(sizes.values()) <= max_broadcast
    known = [str(r[0]) for r in tests.select("t_hash").distinct().collect()] if small and sizes else []
    if small:
        tests = F.broadcast(tests)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"),
                       word_array(F.col("text")).alias("_w"))
    rows = _pin(rows, "w", F.col("_w")).withColumn("n_words", F.size("w"))
    # Each word starts a window, looked up by the hash of its first words.  A
    # first entry that matches nothing keeps every document in the result.
    def starts(k: int) -> str:
        each = "sequence(0, n_words - 1)"
        if known:
            each = f"filter({each}, i -> {_lead_hash('w', 'i', k)} IN ({', '.join(known)}))"
        return f"transform({each}, i -> struct(i + 1 AS pos, {_lead_hash('w', 'i', k)} AS hash))"

    none = "array(struct(0 AS pos, CAST(NULL AS BIGINT) AS hash))"
    entries = F.expr(f"IF(n_words = 0, {none}, concat({', '.join([none, *map(starts, leads)])}))")
    rows = rows.select("doc_id", "_row", "n_words", "w", F.explode(entries).alias("e")) \
        .select("doc_id", "_row", "n_words", "w", "e.pos", "e.hash")
    same = (F.col("hash") == F.col("t_hash")) & (F.expr("slice(w, greatest(pos, 1), t_len)") == F.col("t_gram"))
    found = (rows.join(tests, same, "left").where((F.col("pos") == 0) | F.col("t_len").isNotNull())
             .select("doc_id", "_row", "n_words", "items",
                     F.when(F.col("pos") > 0, F.struct("pos", F.col("t_len").alias("len"))).alias("span")))
    whole = (found.groupBy("_row", "doc_id")
             .agg(F.max("n_words").cast("long").alias("n_words"),
                  F.sort_array(F.collect_set("span")).alias("spans"),
                  F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    covered = F.aggregate("spans", state, lambda s, x: F.struct(
        F.greatest(s["end"], x["pos"] + x["len"]).alias("end"),
        (s["hit"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(s["end"], x["pos"]))).alias("hit")))
    return (whole.withColumn("n_hit", covered["hit"].cast("long"))
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    "items", "spans", (F.col("n_hit") > 0).alias("contaminated")))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit, as they came.

    A document id with any hit row goes with all its rows; rows without a
    doc_id cannot be named, so they stay.
    """
    bad = contaminated(docs, benchmark, window).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with every hit word, and the separators behind it, cut out.

    Each row is judged by its own text (found again by its 64-bit hash),
    whatever its doc_id.  Texts without a hit stay byte for byte as they came.
    """
    key = F.xxhash64("text")
    hits = (contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, window).where("contaminated")
            .select(F.col("doc_id").alias("key"), "spans").dropDuplicates(["key"]))
    letters = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    lead = F.regexp_extract(F.col("text"), rf"^([^0-9A-Za-z\x{{80}}-\x{{10FFFF}}]*)", 1)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(rf"({letters}+[^0-9A-Za-z\x{{80}}-\x{{10FFFF}}]*)"), F.lit(1))
    kept = F.filter(pieces, lambda p, i: ~F.exists(
        F.col("spans"), lambda s: (i + 1 >= s["pos"]) & (i + 1 < s["pos"] + s["len"])))
    cut = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(kept, "")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", key.alias("key"))
    return rows.join(hits, "key", "left").select(
        *[cut.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return contaminated(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bn AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item, k, w[i:i + k - 1] AS gram FROM (
    SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bn)),
lens AS (SELECT DISTINCT k FROM grams),
runs AS (
  SELECT doc_id, k, i, w[i:i + k - 1] AS gram FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT a.doc_id, a.i, a.k, g.item FROM runs a JOIN grams g ON a.k = g.k AND a.gram = g.gram),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
