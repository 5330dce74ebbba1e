"""Conversation structure repair by lightest derivations (Knuth's agenda).

A repair is a derivation.  Its items are edits of a row and states reached
before a row (nothing written yet, or the last role written); a rule joins a
state and an edit to the next state, and its weight is the sum of the costs
and the concatenation of the audits.  The agenda pops items by (cost, audit)
and an item's first pop is its lightest derivation.  That needs rules that are
monotone and never lighter than a part: appending does both here, because two
derivations of one state with the same cost never have audits of which one
begins the other (they edit the same rows, so the longer one has inserts,
which cost).

Rows are sorted by range over the cluster, so a long conversation is spread
over many tasks, and cut into blocks of at most ``BLOCK_ROWS`` rows and about
``BLOCK_BYTES`` bytes.  Each block yields the lightest derivation between any
two states; these few strings, not the rows, are joined for each conversation,
and the audit found is dealt back to the blocks, which write the repaired rows.
Only the digest of the registered query needs a conversation's text in order;
it streams through one task, block by block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import by_bytes, written

BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 20
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3  # costs
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)  # faults of a row
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # states: what was written last
AT, EDIT, DELETION, INSERTION = range(4)  # kinds of items
WROTE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
BEFORE = {SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
LEGAL = {"su", "ua", "au"}
ROLE = {USER: "user", ASSISTANT: "assistant"}

Item = tuple[int, int, int]
Weight = tuple[int, str]
Chart = dict[Item, Weight]
Rules = Callable[[Item, Chart], Iterable[tuple[tuple[Item, ...], Item]]]


# -------------------------------------------------------------- derivations


def lightest(axioms: Iterable[tuple[int, str, Item]], rules: Rules, goals: frozenset[Item] = frozenset()) -> Chart:
    """The lightest derivation of each item, up to the first of ``goals`` that finalises.

    ``rules(item, chart)`` gives the (tails, head) of every rule that has the
    item among its tails and the other tails in the chart.
    """
    agenda = list(axioms)
    heapq.heapify(agenda)
    chart: Chart = {}
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = (cost, audit)
        if item in goals:
            break
        for tails, head in rules(item, chart):
            if head not in chart:
                weights = [chart[t] for t in tails]
                heapq.heappush(agenda, (sum(c for c, _ in weights), "".join(a for _, a in weights), head))
    return chart


def _edits(rows: list[tuple[str, int]]) -> list[tuple[int, str, Item]]:
    """The axioms: what can be done to each row (role, fault), and what can be put anywhere."""
    out = [(INSERT, "I", (INSERTION, 0, USER)), (INSERT, "I", (INSERTION, 0, ASSISTANT))]
    for i, (role, fault) in enumerate(rows):
        out.append((DELETE, "D", (DELETION, i, 0)))
        if fault in (BLANK, DUPLICATE):
            continue
        extra = CUT_OFF if fault == TRUNCATED else 0
        out += [(REROLE + extra, "R", (EDIT, i, USER)), (REROLE + extra, "R", (EDIT, i, ASSISTANT))]
        if role[:1] in WROTE:
            out.append((extra, "K", (EDIT, i, WROTE[role[:1]])))
    return out


def _rules(item: Item, chart: Chart) -> Iterator[tuple[tuple[Item, ...], Item]]:
    kind, i, x = item
    if kind == AT:
        if (DELETION, i, 0) in chart:
            yield (item, (DELETION, i, 0)), (AT, i + 1, x)
        for wrote, before in BEFORE.items():
            if x in before:
                if (EDIT, i, wrote) in chart:
                    yield (item, (EDIT, i, wrote)), (AT, i + 1, wrote)
                if (INSERTION, 0, wrote) in chart:
                    yield (item, (INSERTION, 0, wrote)), (AT, i, wrote)
    elif kind == DELETION:
        for state in range(4):
            if (AT, i, state) in chart:
                yield ((AT, i, state), item), (AT, i + 1, state)
    elif kind == EDIT:
        for state in BEFORE[x]:
            if (AT, i, state) in chart:
                yield ((AT, i, state), item), (AT, i + 1, x)
    else:  # an insertion fits at every place
        for at, j, state in [k for k in chart if k[0] == AT]:
            if state in BEFORE[x]:
                yield ((at, j, state), item), (AT, j, x)


def transfers(rows: list[tuple[str, int]], entries: Iterable[int]) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit): the lightest way over the rows from each entry state to each state."""
    out = []
    for entry in entries:
        chart = lightest([*_edits(rows), (0, "", (AT, 0, entry))], _rules)
        out += [(entry, x, *chart[(AT, len(rows), x)]) for x in range(4) if (AT, len(rows), x) in chart]
    return out


def _onward(reached: dict[int, Weight], ways: list[tuple[int, int, int, str]]) -> dict[int, Weight]:
    """The states reached behind a block; a way is an edit of the whole block."""
    axioms = [(c, a, (AT, 0, q)) for q, (c, a) in reached.items()]
    axioms += [(c, a, (EDIT, q, x)) for q, x, c, a in ways]

    def rules(item: Item, chart: Chart) -> Iterator[tuple[tuple[Item, ...], Item]]:
        kind, q, x = item
        if kind == AT and q == 0:
            yield from (((item, e), (AT, 1, e[2])) for e in chart if e[0] == EDIT and e[1] == x)
        elif kind == EDIT and (AT, 0, q) in chart:
            yield ((AT, 0, q), item), (AT, 1, x)

    chart = lightest(axioms, rules)
    return {x: chart[(AT, 1, x)] for x in range(4) if (AT, 1, x) in chart}


def _dealt(audit: str, sizes: list[int]) -> Iterator[tuple[str, int]]:
    """Each block's piece of the audit and the number of rows written before it; a row takes one K, R or D."""
    a = wrote = 0
    for k, size in enumerate(sizes):
        b, left = a, size
        while left:
            left -= audit[b] != "I"
            b += 1
        piece = audit[a:] if k == len(sizes) - 1 else audit[a:b]
        yield piece, wrote
        a, wrote = b, wrote + len(piece) - piece.count("D")


# ------------------------------------------------------------------- blocks


def _rows(batches: Iterable[pa.RecordBatch], text: str | None = None) -> Iterator[dict[str, Any]]:
    for batch in by_bytes(batches, text) if text else batches:
        yield from batch.to_pylist()


def _batched(rows: Iterable[dict[str, Any]], schema: pa.Schema, many: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, Any]] = []
    for row in rows:
        held.append(row)
        if len(held) == many:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _map(df: DataFrame, step: Callable[[Iterable[pa.RecordBatch]], Iterable[dict[str, Any]]], schema: str) -> DataFrame:
    """``step`` over each partition; ``schema`` follows conv_id, which keeps its type."""
    full = StructType([df.schema["conv_id"], *StructType.fromDDL(schema)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched(step(batches), _arrow(full))

    return df.mapInArrow(run, full)


def blocks(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, starts, rows, marks): the rows in order, block by block, written to the shared folder.

    ``at`` numbers the block's first row; numbers grow along a conversation.
    ``starts`` tells that the block is known to be its conversation's first.
    ``marks`` are the rows without their texts: role, digest, blank, cut off.
    """
    rows = conversations.select(
        "conv_id", F.col("turn").cast(LongType()).alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"))
    rows = (rows.withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
            .withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
            .withColumn("cut", ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"))
            .withColumn("tie", F.monotonically_increasing_id()))  # equal rows need not stay together
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        number = TaskContext.get().partitionId() << 40
        block: dict[str, Any] | None = None
        size = 0
        for row in _rows(batches, "text"):
            same = block is not None and block["conv_id"] == row["conv_id"]
            if block is not None and (not same or len(block["rows"]) >= BLOCK_ROWS or size >= BLOCK_BYTES):
                yield block
                block, starts = None, not same
            elif block is None:
                starts = False  # an earlier partition may hold rows of the first conversation
            if block is None:
                block = {"conv_id": row["conv_id"], "at": number, "starts": starts, "rows": [], "marks": []}
                size = 0
            block["rows"].append({k: row[k] for k in ("turn", "role", "text")})
            block["marks"].append({k: row[k] for k in ("role", "digest", "blank", "cut")})
            size += len(row["text"])
            number += 1
        if block is not None:
            yield block

    return written(_map(rows, cut, "at long, starts boolean, rows array<struct<turn: long, role: string, text: string>>"
                                   ", marks array<struct<role: string, digest: binary, blank: boolean, cut: boolean>>"),
                   "blocks")


def _repeats(found: DataFrame) -> DataFrame:
    """(at, again): the indices of a block's rows whose role and text stand earlier in the conversation."""
    marks = (found.select("conv_id", "at", F.posexplode("marks").alias("i", "m")).where(~F.col("m.blank"))
             .select("conv_id", "at", "i", F.col("m.role").alias("role"), F.col("m.digest").alias("digest"),
                     (F.col("at") + F.col("i")).alias("place")))
    # min and count combine map-side: a text that stands in every row costs one row a task.
    first = (marks.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
                                    "first"))
    again = marks.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                       & (F.col("digest") == F.col("d"))).where(F.col("place") > F.col("first"))
    return again.groupBy("at").agg(F.collect_list("i").alias("again"))  # a block's rows at most


def plan(found: DataFrame) -> DataFrame:
    """The repair of each conversation, dealt to its blocks; ``found`` comes from ``blocks``.

    Per block: conv_id, at, piece (its part of the audit), wrote (rows written
    before it) and system (whether the first row written is a system row).  A
    conversation's first block also has its cost, audit and counts of faults.
    """
    marked = found.select("conv_id", "at", "starts", "marks").join(_repeats(found), "at", "left")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        for row in _rows(batches):
            again = set(row["again"] or ())
            rows = [(m["role"], BLANK if m["blank"] else DUPLICATE if i in again else TRUNCATED if m["cut"] else FINE)
                    for i, m in enumerate(row["marks"])]
            ways = transfers(rows, [NOTHING] if row["starts"] else range(4))
            faults = [f for _, f in rows]
            yield {"conv_id": row["conv_id"], "at": row["at"], "n": len(rows),
                   "ways": [dict(zip(("a", "b", "cost", "audit"), w)) for w in ways],
                   "first": rows[0][0][:1], "last": rows[-1][0][:1],
                   "illegal": sum(x[0][:1] + y[0][:1] not in LEGAL for x, y in zip(rows, rows[1:])),
                   "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE),
                   "truncated": faults.count(TRUNCATED)}

    counts = ("blank", "duplicate", "truncated", "illegal")
    weighed = _map(marked, weigh, "at long, n int, ways array<struct<a: int, b: int, cost: long, audit: string>>, "
                                  "first string, last string, illegal long, blank long, duplicate long, "
                                  "truncated long")
    weighed = weighed.repartition("conv_id").sortWithinPartitions("conv_id", "at")

    def ended(held: list[dict[str, Any]], reached: dict[int, Weight]) -> Iterator[dict[str, Any]]:
        cost, audit = min(reached[x] for x in (NOTHING, ASSISTANT) if x in reached)
        totals = {k: sum(b[k] for b in held) for k in counts}
        totals["illegal"] += sum(x["last"] + y["first"] not in LEGAL for x, y in zip(held, held[1:]))
        system = (len(audit) - audit.count("D")) % 2 == 1  # pairs of rows, and perhaps a system row
        for k, (piece, wrote) in enumerate(_dealt(audit, [b["n"] for b in held])):
            yield {"conv_id": held[0]["conv_id"], "at": held[k]["at"], "piece": piece, "wrote": wrote,
                   "system": system, **({"cost": cost, "audit": audit, **totals} if k == 0 else {})}

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        held: list[dict[str, Any]] = []
        reached: dict[int, Weight] = {}
        for block in _rows(batches):
            if held and held[0]["conv_id"] != block["conv_id"]:
                yield from ended(held, reached)
                held = []
            if not held:
                reached = {NOTHING: (0, "")}
            reached = _onward(reached, [(w["a"], w["b"], w["cost"], w["audit"]) for w in block.pop("ways")])
            held.append(block)
        if held:
            yield from ended(held, reached)

    return written(_map(weighed, fold, "at long, piece string, wrote long, system boolean, cost long, audit string, "
                                       "blank long, duplicate long, truncated long, illegal long"), "plan")


def _written_rows(found: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, at, lines): each block's repaired rows (seq, turn, role, text)."""
    joined = found.select("conv_id", "at", "rows").join(planned.select("at", "piece", "wrote", "system"), "at")

    def edit(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        for block in _rows(batches):
            seq, system = block["wrote"], block["system"]
            source, lines = iter(block["rows"]), []
            for step in block["piece"]:
                row = {"turn": None, "role": None, "text": ""} if step == "I" else next(source)
                if step == "D":
                    continue
                role = row["role"] if step == "K" else ROLE[USER if (seq - system) % 2 == 0 else ASSISTANT]
                lines.append({"seq": seq, "turn": row["turn"], "role": role, "text": row["text"]})
                seq += 1
            yield {"conv_id": block["conv_id"], "at": block["at"], "lines": lines}

    return _map(joined, edit,
                "at long, lines array<struct<seq: long, turn: long, role: string, text: string>>")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, rows): what each conversation's repair costs, and the repaired rows.

    ``summary`` has conv_id, cost, audit, blank, duplicate, truncated and
    illegal; ``rows`` has conv_id, seq (from 0), turn (null for an insert),
    role and text.  Rows of a conversation are taken by turn, nulls first,
    ties by role and then by the SHA-256 of the text; equal rows are repeats.
    A null role or text is one space, so a null text is blank and a null role
    is neither kept nor legal; so is an empty role.  Rows with a null conv_id
    are one conversation.  An empty table gives empty results; extra columns
    are ignored.  A repair may leave no rows at all.
    """
    found = blocks(conversations)
    planned = plan(found)
    summary = planned.where("cost is not null").select("conv_id", "cost", "audit", "blank", "duplicate", "truncated",
                                                       "illegal")
    rows = _written_rows(found, planned).select("conv_id", F.explode("lines").alias("x")).select("conv_id", "x.*")
    return summary, rows


def damage(conversations: DataFrame) -> DataFrame:
    """The registered query's faults, chosen by crc32 of ``conv_id:turn`` modulo 20 (nulls are one space)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"),
                                kind.alias("kind")).where("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array_repeat(F.lit(0), 2)).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), F.explode(copies).alias("copy")).drop("copy")


def report(conversations: DataFrame) -> DataFrame:
    """The digest columns of the registered query: every conversation after ``damage``, repaired."""
    rows = damage(conversations)
    found = blocks(rows)
    planned = plan(found)
    chunks = _written_rows(found, planned).select("conv_id", "at", F.size("lines").alias("n"), F.array_join(
        F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n").alias("text"))
    chunks = chunks.where("n > 0").repartition("conv_id").sortWithinPartitions("conv_id", "at")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        conv, sha = None, None
        for chunk in _rows(batches, "text"):
            if sha is not None and chunk["conv_id"] == conv:
                sha.update(b"\n")
            else:
                if sha is not None:
                    yield {"conv_id": conv, "repaired_sha256": sha.hexdigest()}
                conv, sha = chunk["conv_id"], hashlib.sha256()
            sha.update(chunk["text"].encode())
        if sha is not None:
            yield {"conv_id": conv, "repaired_sha256": sha.hexdigest()}

    digests = _map(chunks, digest, "repaired_sha256 string").withColumnRenamed("conv_id", "d")
    gaps = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("g")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    summary = planned.where("cost is not null").select(
        F.col("conv_id").alias("s"), "cost", "audit", "blank", "duplicate", "truncated", "illegal")
    every = conversations.select("conv_id").distinct()
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    joined = every.join(summary, same("s"), "left").join(gaps, same("g"), "left").join(digests, same("d"), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _path(reached: str, cost: str, letter: str) -> str:
    """SQL: a path (ten digits of cost, then its audit) with one more edit; NULL if there is none."""
    return f"lpad((left({reached}, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({reached}, 11) || {letter}"


# DuckDB has no crc32: its table is built from the polynomial's rule, and bytes are folded through it.  A path is a
# string that sorts by cost and audit; n, s, u and a hold the least one for each role written last.
ORACLE_SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(k)),
    lambda i: ('0x' || substr(hex(encode(k)), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS h FROM named, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE h <> 0),
placed AS (
  SELECT *, left(role, 1) AS r,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
found AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lead(r) OVER (PARTITION BY conv_id ORDER BY i) AS next_r FROM placed),
sums AS (
  SELECT conv_id, count(*) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next_r IS NOT NULL AND r || next_r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM found GROUP BY conv_id),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, rows_, '0000000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a
  FROM sums
  UNION ALL
  SELECT conv_id, i, rows_, {_path('n', '4', "'D'")},
    least({_path('s', '4', "'D'")}, CASE WHEN live AND r = 's' THEN {_path('n', 'extra', "'K'")} END),
    least({_path('u', '4', "'D'")}, CASE WHEN live THEN CASE WHEN r = 'u' THEN {_path('to_u', 'extra', "'K'")}
      ELSE {_path('to_u', '(3 + extra)', "'R'")} END END),
    least({_path('a', '4', "'D'")}, CASE WHEN live THEN CASE WHEN r = 'a' THEN {_path('u', 'extra', "'K'")}
      ELSE {_path('u', '(3 + extra)', "'R'")} END END)
  FROM (
    SELECT *, least(n, s, a) AS to_u FROM (
      SELECT p.conv_id, p.i + 1 AS i, rows_, n, s, f.r, f.fault NOT IN ('blank', 'duplicate') AS live,
        CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS extra,
        least(u, {_path('least(n, s, a)', '3', "'I'")}) AS u,
        least(a, {_path('u', '3', "'I'")}, {_path('least(n, s)', '6', "'II'")}) AS a
      FROM steps p JOIN found f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1))),
ended AS (
  SELECT conv_id, least(n, a, {_path('u', '3', "'I'")}, {_path('s', '6', "'II'")}) AS best FROM steps WHERE i = rows_),
letters AS (
  SELECT conv_id, j, substr(audit, j::INT, 1) AS e FROM (
    SELECT conv_id, substr(best, 11) AS audit, unnest(range(1, length(best) - 9)) AS j FROM ended)),
edits AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o,
    count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id) % 2 AS system
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
repaired AS (
  SELECT e.conv_id, string_agg(CASE WHEN e.e = 'K' THEN f.role WHEN (e.o - e.system) % 2 = 1 THEN 'user'
      ELSE 'assistant' END || ':' || CASE WHEN e.e = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY e.j) AS body
  FROM edits e LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE e.e <> 'D'
  GROUP BY e.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(best, 10)::BIGINT, 0) AS cost,
  coalesce(substr(best, 11), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM c.conv_id
"""
