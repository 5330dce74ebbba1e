"""Toxicity: Levenshtein automata over a lexicon trie, weighed by the context of each hit.

Fitting counts, over all labelled training texts, in how many toxic and clean
texts each word occurs outside quotations, and takes as lexicon the words and
word beginnings that toxic texts use at ten times the rate of clean ones.  Every distinct word of a text is run through the
lexicon's automaton, which accepts a term with a bounded number of edits, so
misspelled terms are hits as well.  A hit inside quotation marks or beside a
word of reporting counts as quoted.  A logistic regression over the counts of
plain, misspelled and quoted hits gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fresh, written
from .tokens import texts_of

WORD = re.compile(r"\w[\w*@$]*")
CONTEXT = 8  # words on either side of a hit
QUOTES = frozenset("\"“”„«»‹›‘’")
MARK = re.compile("[" + "".join(sorted(QUOTES)) + "]")
REPORTING = frozenset(
    "said says say called calls quote quoted quotes word words term wrote writes according alleged reported "
    "dijo dice llamó palabra término escribió citó sagte sagt nannte wort begriff schrieb zitat "
    "dit disait appelé mot terme écrit citation".split())

STEM_LENGTHS = range(4, 9)
RATE = 0.1  # share of clean texts that use a term outside quotations, against the share of toxic ones, at most
ORDINARY = 3.0  # log odds that a word near a term must have against that rate to be a word of its own
SAMPLE_ROWS = 20_000  # labelled rows that the regression is fitted on, at most
BROADCAST_LABELS = 2_000_000  # label rows (16 bytes each) that are broadcast at most
CACHE_WORDS = 500_000
MAX_STATES = 200_000

NONE, EXACT, FUZZY = 0, 1, 2


def edits_allowed(term: str) -> int:
    """Short words have too many neighbours to be matched with an edit."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The union of the terms' Levenshtein automata, run along their trie.

    A position is (node, edits so far, edits allowed).  Sets of positions are
    the states of a deterministic automaton whose transitions are worked out
    when first needed and kept; most words reach the dead state in a few steps.
    Terms must match as a whole; stems match any word that begins with them,
    without edits.  ``worth`` weighs terms and stems (1 where it has none).
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = (), worth: dict[str, float] | None = None) -> None:
        worth = worth or {}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[set[int]] = [set()]  # for each node, the edits allowed to terms that end there
        self.stem: list[bool] = [False]
        self.below: list[set[int]] = [set()]  # edits allowed to terms at or below the node
        self.worth: list[float] = [0.0]
        for term in terms:
            k = edits_allowed(term)
            for node in (path := self._path(term)):
                self.below[node].add(k)
            self.ends[path[-1]].add(k)
            self.worth[path[-1]] = worth.get(term, 1.0)
        for stem in stems:
            path = self._path(stem)
            for node in path:
                self.below[node].add(0)
            self.stem[path[-1]] = True
            self.worth[path[-1]] = max(self.worth[path[-1]], worth.get(stem, 1.0))
        self._reset()

    def _path(self, term: str) -> list[int]:
        path = [0]
        for ch in term:
            node = self.children[path[-1]].get(ch)
            if node is None:
                node = len(self.children)
                self.children[path[-1]][ch] = node
                self.children.append({})
                self.ends.append(set())
                self.stem.append(False)
                self.below.append(set())
                self.worth.append(0.0)
            path.append(node)
        return path

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, float]] = []
        self.dead = self._id(frozenset())
        self.start = self._id(self._closure({(0, 0, k) for k in self.below[0]}))

    def _closure(self, positions: set) -> frozenset:
        """With the positions reached by skipping letters of terms."""
        todo = list(positions)
        while todo:
            node, e, k = todo.pop()
            if e < k:
                for child in self.children[node].values():
                    new = (child, e + 1, k)
                    if k in self.below[child] and new not in positions:
                        positions.add(new)
                        todo.append(new)
        best: dict[tuple[int, int], int] = {}
        for node, e, k in positions:
            best[node, k] = min(e, best.get((node, k), 99))
        return frozenset((node, e, k) for (node, k), e in best.items())

    def _id(self, state: frozenset) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            found = [(e, -self.worth[node]) for node, e, k in state
                     if k in self.ends[node] or e == 0 and self.stem[node]]
            edits, worth = min(found, default=(0, 0.0))  # the fewest edits, then the weightiest
            self.accepts.append((NONE if not found else EXACT if edits == 0 else FUZZY, -worth))
        return self.ids[state]

    def _step(self, at: int, ch: str) -> int:
        new = set()
        for node, e, k in self.states[at]:
            if e == 0 and self.stem[node]:
                new.add((node, 0, k))  # a stem goes on with anything
            for letter, child in self.children[node].items():
                if k in self.below[child]:
                    if letter == ch:
                        new.add((child, e, k))
                    elif e < k:
                        new.add((child, e + 1, k))
            if e < k:
                new.add((node, e + 1, k))
        return self._id(self._closure(new))

    def match(self, word: str) -> int:
        """EXACT, FUZZY or NONE."""
        return self.hit(word)[0]

    def hit(self, word: str) -> tuple[int, float]:
        """The match and the weight of its term."""
        if len(self.states) > MAX_STATES:
            self._reset()
        at = self.start
        for ch in word:
            step = self.steps[at]
            to = step.get(ch)
            if to is None:
                to = step[ch] = self._step(at, ch)
            if to == self.dead:
                return NONE, 0.0
            at = to
        return self.accepts[at]


@dataclass
class Matcher:
    """Features of texts by a lexicon; ``clean`` are words of their own that are near a term."""

    terms: list[str]
    stems: list[str]
    clean: frozenset[str] = frozenset()
    worth: dict[str, float] = field(default_factory=dict)
    automaton: LexiconAutomaton = field(init=False)
    hits: dict[str, tuple[int, float]] = field(init=False, default_factory=dict)
    misses: set[str] = field(init=False, default_factory=set)

    def __post_init__(self) -> None:
        self.automaton = LexiconAutomaton(self.terms, self.stems, self.worth)

    def kinds(self, words: set[str]) -> dict[str, tuple[int, float]]:
        """The hits among the words, their kinds and weights."""
        if len(self.misses) > CACHE_WORDS:
            self.misses.clear()
        for w in words.difference(self.misses, self.hits):
            hit = (NONE, 0.0) if w in self.clean else self.automaton.hit(w)
            if hit[0] == NONE:
                self.misses.add(w)
            else:
                self.hits[w] = hit
        return {w: self.hits[w] for w in words.intersection(self.hits)}

    def features(self, text: str) -> list[float]:
        """Weights of plain, misspelled and quoted hits (log of 1 + sum), the largest weight of a plain or
        misspelled hit, weight per 100 words."""
        text = text.lower()
        found = WORD.findall(text)
        kinds = self.kinds(set(found))
        if not kinds:
            return [0.0] * 5
        n = Counter()
        most = 0.0
        spots = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
        for i, (w, a, b) in enumerate(spots):
            if w in kinds:
                lo, hi = max(0, i - CONTEXT), min(len(spots) - 1, i + CONTEXT)
                before, after = text[spots[lo][1]:a], text[b:spots[hi][2]]
                quoted = (sum(c in QUOTES for c in before) % 2 == 1 and any(c in QUOTES for c in after)
                          or any(x in REPORTING for x, _, _ in spots[max(lo, i - 3):i]))
                kind, worth = kinds[w]
                n["quoted" if quoted else kind] += worth
                most = most if quoted else max(most, worth)
        bare = n[EXACT] + n[FUZZY]
        return [float(np.log1p(n[EXACT])), float(np.log1p(n[FUZZY])), float(np.log1p(n["quoted"])),
                float(most), 100.0 * bare / len(spots)]


@dataclass
class Model:
    """A fitted scorer; ``weights`` has the bias first."""

    terms: list[str]
    stems: list[str]
    clean: frozenset[str]
    worth: dict[str, float]
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# ------------------------------------------------------------------- fitting


def bare_words(text: str) -> set[str]:
    """The words that a text uses outside quotations, as ``Matcher.features`` tells them apart, at least once."""
    text = text.lower()
    found = WORD.findall(text)
    words = set(found)
    if not MARK.search(text) and words.isdisjoint(REPORTING):
        return words
    spans = np.array([m.span() for m in WORD.finditer(text)]).reshape(-1, 2)
    marks = np.array([m.start() for m in MARK.finditer(text)], int)
    at = np.arange(len(found))
    lo, hi = np.maximum(0, at - CONTEXT), np.minimum(len(found) - 1, at + CONTEXT)
    before = np.searchsorted(marks, spans[:, 0]) - np.searchsorted(marks, spans[lo, 0])
    after = np.searchsorted(marks, spans[hi, 1]) - np.searchsorted(marks, spans[:, 1])
    quoted = (before % 2 == 1) & (after > 0)
    report = np.array([w in REPORTING for w in found], bool)
    for k in (1, 2, 3):
        quoted[k:] |= report[:-k]
    return {found[i] for i in np.flatnonzero(~quoted)}


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): different texts of either label that use the word unquoted; '' counts the texts."""
    rows = rows.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["_key", "toxic"])
    rows = rows.select("text", "toxic")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            seen = [Counter(), Counter()]
            for text, label in zip(texts_of(batch), batch.column("toxic").to_pylist()):
                seen[label].update({"", *bare_words(text)})
            words = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(words, pa.string()), "toxic": pa.array([seen[1][w] for w in words], pa.int64()),
                "clean": pa.array([seen[0][w] for w in words], pa.int64())})

    return (rows.mapInArrow(count, "word string, toxic long, clean long").groupBy("word")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _lexicon(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str], dict[str, float]]:
    """Terms and stems that toxic texts use, far more often than chance or clean texts have it, and their weights."""
    base = (n_toxic + 1) / (n_toxic + n_clean + 2)
    vocabulary = counts.count()
    # So many toxic ones among its texts by chance: exp(-gain) at most (base ** t if all t are), for each word.
    marked = ((F.col("toxic") >= 3) & (F.col("clean") * n_toxic <= RATE * n_clean * F.col("toxic"))
              & (_gain("toxic", "clean", base) >= float(np.log(vocabulary + 1) + 3)))
    words = counts.where(marked & (F.length("word") >= 3)).orderBy("word").collect()
    heads = (counts.select("word", "toxic", "clean", F.explode(F.array([F.lit(k) for k in STEM_LENGTHS])).alias("k"))
             .where("length(word) >= k").groupBy(F.expr("substring(word, 1, k)").alias("word"))
             .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
                  F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("forms"), F.max("toxic").alias("most")))
    # A stem has many forms and no single one that makes it up.
    heads = (heads.where(marked & (F.col("forms") >= 5) & (F.col("most") <= 0.5 * F.col("toxic")))
             .orderBy("word").collect())
    count = {r["word"]: r["toxic"] for r in heads}
    longest: dict[str, int] = {}  # the commonest continuation by a letter
    for stem, n in count.items():
        longest[stem[:-1]] = max(n, longest.get(stem[:-1], 0))
    stems: dict[str, None] = {}
    for stem in sorted(count, key=len):
        if longest.get(stem, 0) >= 0.95 * count[stem] or _begins(stem, stems):
            continue  # its continuation says the same, or it is covered
        stems[stem] = None
    terms = [r["word"] for r in words]  # those that begin with a stem too: only terms are matched with edits
    # Log odds of the term against the clean base, as a share of the most that so many texts can show.
    top = np.log((n_toxic + 0.5) / (n_toxic + 1) / 0.5 * (n_clean + 1))
    worth = {r["word"]: float(np.clip(np.log((r["toxic"] + 0.5) / (n_toxic + 1) / (r["clean"] + 0.5) * (n_clean + 1))
                                      / top, 0.01, 1)) for r in (*heads, *words)}
    return terms, list(stems), {w: worth[w] for w in (*terms, *stems)}


def _gain(hits: str, others: str, share: float) -> Column:
    """Log likelihood of hits among hits and others at their own share, over the one at ``share``; 0 below it."""
    n, m = F.col(hits), F.col(others)
    own = n / (n + m)
    part = lambda k, p, q: F.when(k > 0, k * F.log(p / q)).otherwise(0.0)
    return F.when(own > share, part(n, own, F.lit(share)) + part(m, 1 - own, F.lit(1 - share))).otherwise(0.0)


def _begins(word: str, stems: dict[str, None]) -> bool:
    return any(word[:k] in stems for k in STEM_LENGTHS if k <= len(word))


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the bias is not penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty),
                               x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and weights from the labelled rows (labels: doc_id, toxic).

    Rows without doc_id or label teach nothing; a document labelled more than
    once is toxic if any label says so; labels other than 0 and 1 are left
    out.  Word counts cover every labelled text, copies of a text once; the regression takes the
    ``sample_rows`` labelled documents of smallest hash.  Without toxic or
    without clean texts nothing can be learnt, and all scores are the share of
    toxic labels.
    """
    labels = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    labels = written(labels, "labels")
    n_labels = labels.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = F.broadcast if n_labels <= BROADCAST_LABELS else lambda df: df
    rows = texts.join(small(labels), "doc_id").select("text", "toxic")
    counts = written(_word_counts(rows), "words")
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sampled = texts.join(F.broadcast(sample), "doc_id").select("text", "toxic")

    n = counts.where("word = ''").collect()
    n_toxic, n_clean = (n[0]["toxic"], n[0]["clean"]) if n else (0, 0)
    terms, stems, worth = _lexicon(counts, n_toxic, n_clean)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(terms, stems)
        for batch in batches:
            found = [w for w in batch.column("word").to_pylist() if automaton.match(w) == FUZZY]
            yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string())})

    # Words one or two edits from a term that clean texts use more than terms are used there, beyond chance:
    # bounded by the lexicon's neighbourhoods.
    allowed = RATE * n_clean / max(RATE * n_clean + n_toxic, 1)
    clean = frozenset(r["word"] for r in counts.where(_gain("clean", "toxic", allowed) >= ORDINARY).select("word")
                      .mapInArrow(near, "word string").collect())

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, stems, clean, worth)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "x": pa.array([matcher.features(t) for t in texts_of(batch)], pa.list_(pa.float64())),
                "y": batch.column("toxic")})

    got = sampled.mapInArrow(measure, "x array<double>, y int").collect()  # sample_rows rows of five numbers
    y = np.array([r["y"] for r in got], float)
    if len(set(y)) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Model(terms, stems, clean, worth, np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    return Model(terms, stems, clean, worth, _regression(np.array([r["x"] for r in got]), y))


def score(docs: DataFrame, model: Model, name: str = "_toxicity") -> DataFrame:
    """The columns of ``docs`` and the score from 0 to 1 as ``name``, which ``docs`` must not have.

    Null texts score as empty ones do.
    """
    terms, stems, clean, worth = model.terms, model.stems, model.clean, model.worth

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, stems, clean, worth)
        for batch in batches:
            x = np.array([matcher.features(t) for t in texts_of(batch)]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(x))], ["row", name])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    schema = rows.select("row").schema.add(name, "double")
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], name)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score stays under ``threshold``."""
    model = fit(docs, labels.where(~held_out()))
    name = fresh(docs, "_toxicity")
    return score(docs, model, name).where(F.col(name) < threshold).select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))
