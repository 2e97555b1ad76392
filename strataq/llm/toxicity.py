"""Toxicity: a Levenshtein automaton run along a lexicon trie, with context windows.

The lexicon has the terms and word beginnings that a bounded sample of labelled
documents shows to be toxic.  The union of the terms' Levenshtein automata, with a
swap of neighbours as one edit, is intersected with their trie and made
deterministic as words come, so a word is matched in one walk.  Hits are then read
in context: those inside quotation marks or behind words that report speech count
apart, those that crowd a window weigh more, and a word that might as well be
another one (a letter exchanged, or another first letter) counts only beside a
surer hit.  A logistic model fitted on the sample turns this into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import forget, worker_cache, written

# Words that report speech, and quotation marks.
REPORTS = frozenset("called calls cited quote quoted quotes quoting said says saying term word words wrote".split())
QUOTES_OPEN, QUOTES_CLOSE = "\"“«„'‘", "\"”»“'’"

#: labelled documents that the lexicon and the model are fitted on, at most
SAMPLE_TOXIC, SAMPLE_CLEAN = 2500, 6000
#: words whose match a worker keeps before it starts anew
CACHE_ENTRIES = 150_000
#: terms of the sample that a task counts before it returns them
TERMS = 50_000
#: states of the automaton that a worker keeps before it starts anew
STATES = 50_000
#: words on either side that a hit is read with; words of the longest quotation
WINDOW, QUOTED = 10, 100
_PARTS = re.compile(r"[\W\d_]+")
_STRIP = ".,;:!?()[]{}<>|*_~`\"'“”«»„‘’#$%&/\\-+=@^"
_LEET = str.maketrans("013457@$", "oieastas")
WORD, STEM, FUZZY, LIKE = 0, 1, 2, 3


class Lexicon:
    """``match(word)`` gives (kind, weight) of the best term within the allowed edits.

    Terms are (text, weight, kind): a stem matches any word that begins with it,
    a word matches itself, and from five letters on any word one edit away.  An
    edit is a letter more, less or exchanged, or two neighbours swapped.  FUZZY
    hits keep the first letter and exchange none; other hits by an edit are LIKE.
    """

    def __init__(self, terms: list[tuple[str, float, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[dict[int, float]] = [{}]
        self.deep = [0]
        for text, weight, kind in sorted(terms):
            node = 0
            for ch in text:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append({})
                    self.deep.append(self.deep[node] + 1)
                node = self.next[node][ch]
            self.ends[node][kind] = max(weight, self.ends[node].get(kind, -math.inf))
        self._ids: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._moves: list[dict[str, int]] = []
        self._accept: list[tuple | None] = []
        self._start = self._state({(0, 0, "")})

    def _state(self, places: set[tuple[int, int, str]]) -> int:
        """Places are (node, edit, pending): no edit yet (0), a sure one (FUZZY) or a doubtful one
        (LIKE); a pending letter is the one that must come next for a swap."""
        todo = list(places)
        while todo:  # a term's letter may be missing from the word
            node, edit, _ = todo.pop()
            if not edit:
                for child in self.next[node].values():
                    places.add((child, FUZZY if node else LIKE, ""))
        key = frozenset(places)
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(key)
            self._moves.append({})
            self._accept.append(self._value(key))
        return self._ids[key]

    def _value(self, key: frozenset) -> tuple | None:
        found = []
        for node, edit, pending in key:
            for kind, weight in () if pending else self.ends[node].items():
                if not edit:
                    found.append((-kind, weight))
                elif kind == WORD and self.deep[node] >= 5:
                    found.append((-edit, weight))
        return (-max(found)[0], max(found)[1]) if found else None

    def _step(self, state: int, ch: str) -> int:
        places = set()
        for node, edit, pending in self._sets[state]:
            if pending:
                if pending == ch:
                    places.add((node, edit, ""))
                continue
            child = self.next[node].get(ch)
            if child is not None:
                places.add((child, edit, ""))
            if not edit:
                places.add((node, FUZZY if node else LIKE, ""))  # a letter more
                for c, other in self.next[node].items():
                    places.add((other, LIKE, ""))  # exchanged
                    swapped = self.next[other].get(ch)
                    if swapped is not None and c != ch:
                        places.add((swapped, FUZZY if node else LIKE, c))
        return self._state(places) if places else -1

    def match(self, word: str) -> tuple[int, float] | None:
        state, stem = self._start, None
        for ch in word:
            moves = self._moves[state]
            if ch not in moves:
                if len(self._sets) > STATES:  # made anew, so that odd words cannot fill memory
                    return Lexicon._fresh(self).match(word)
                moves[ch] = self._step(state, ch)
            state = moves[ch]
            if state < 0:
                return stem
            got = self._accept[state]
            if got and got[0] == STEM:
                stem = got
        return self._accept[state] or stem

    def _fresh(self) -> Lexicon:
        self._ids, self._sets, self._moves, self._accept = {}, [], [], []
        self._start = self._state({(0, 0, "")})
        return self


class Scorer:
    """Features of a text by a lexicon; one a worker process and lexicon."""

    NAMES = ("bias", "weight", "hits", "density", "kinds", "stems", "fuzzy", "quoted", "crowd", "like")

    def __init__(self, terms: list[tuple[str, float, int]]):
        self.lexicon = Lexicon(terms)
        self.known: dict[str, tuple | None] = {}

    def _look(self, token: str) -> tuple | None:
        """The best hit of a token: as a whole, by the letters that digits stand for, or in its parts."""
        word = token.strip(_STRIP).lower()
        got = self.lexicon.match(word) if len(word) > 2 else None
        if not word.isalpha() and len(word) > 2 and (got is None or got[0] > STEM):
            plain = self.lexicon.match(word.translate(_LEET))
            found = [got, (FUZZY, plain[1]) if plain and plain[0] != STEM else None]
            found += [self.lexicon.match(x) for x in _PARTS.split(word) if len(x) > 2 and x != word]
            got = min((x for x in found if x), key=lambda x: (x[0], -x[1]), default=None)
        if len(token) <= 64:
            self.known[token] = got
        return got

    def features(self, text: str) -> list[float]:
        words = text.split()
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known, look = self.known, self._look
        hits = [(i, got) for i, w in enumerate(words) if (got := known[w] if w in known else look(w))]
        sure = np.array([i for i, g in hits if g[0] != LIKE])
        # the nearest surer hits of each place
        after = np.searchsorted(sure, [i for i, _ in hits])
        near = lambda i, k: any(0 <= j < len(sure) and abs(int(sure[j]) - i) <= WINDOW for j in (k - 1, k))
        hits = [(i, g) for (i, g), k in zip(hits, after.tolist()) if g[0] != LIKE or near(i, k)]
        if not hits:
            return [1.0, *[0.0] * (len(self.NAMES) - 1)]
        marks, places = set(), {i for i, _ in hits}
        opened = -1  # a quotation that never ends, or not soon, is none
        for i, w in enumerate(words):
            if opened < 0 and (w[0] in QUOTES_OPEN or len(w) > 1 and w[0] in "([" and w[1] in QUOTES_OPEN):
                opened = i
            if i in places and any(x.strip(_STRIP).lower() in REPORTS for x in words[max(0, i - 3) : i]):
                marks.add(i)
            if opened >= 0 and any(c in QUOTES_CLOSE for c in w[-3:]) and (i > opened or len(w) > 1):
                marks.update(places.intersection(range(opened, i + 1)) if i - opened <= QUOTED else ())
                opened = -1
        free = [(i, g) for i, g in hits if i not in marks]
        crowd, at = 0, 0
        for j, (i, _) in enumerate(free):
            while i - free[at][0] > 2 * WINDOW:
                at += 1
            crowd = max(crowd, j - at + 1)
        weight = sum(g[1] * (1 if g[0] < FUZZY else 0.5) for _, g in free)
        count = lambda kind: math.log1p(sum(g[0] == kind for _, g in free))
        return [
            1.0, math.log1p(weight), math.log1p(len(free)), 100 * len(free) / (len(words) + 20), math.log1p(len({words[i].strip(_STRIP).lower() for i, _ in free})),
            count(STEM), count(FUZZY), math.log1p(len(marks)), math.log1p(crowd), count(LIKE),
        ]


def _scorer(terms: list) -> Scorer:
    return worker_cache(("terms", *terms), lambda: Scorer(terms))


def _terms_of(text: str) -> set[tuple[str, int]]:
    words = {w for t in text.split() if 3 <= len(w := t.strip(_STRIP).lower()) <= 40 and w.isalpha()}
    return {(w, WORD) for w in words} | {(w[:n], STEM) for w in words for n in range(4, 9) if len(w) >= n}


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of texts and 0 or 1: how many clean and toxic documents have a term, in parts to be summed."""
    forget()
    found: dict[tuple[str, int], list[int]] = {}

    def flush() -> pa.RecordBatch:
        terms, kinds = zip(*found)
        clean, toxic = zip(*found.values())
        found.clear()
        return pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "kind": pa.array(kinds, pa.int32()), "toxic": pa.array(toxic, pa.int64()), "clean": pa.array(clean, pa.int64())})

    for b in batches:
        for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
            for term in _terms_of(text.as_py() or ""):
                found.setdefault(term, [0, 0])[toxic] += 1
            if len(found) > TERMS:
                yield flush()
    if found:
        yield flush()


def _sample(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled documents to learn from, a bounded number by hash order."""
    known = labels.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(F.col("toxic").isNotNull() & train)
    order = F.xxhash64("doc_id", F.lit(11))
    toxic = known.where("toxic = 1").orderBy(order).limit(SAMPLE_TOXIC)
    clean = known.where("toxic = 0").orderBy(order).limit(SAMPLE_CLEAN)
    found = docs.join(F.broadcast(toxic.unionByName(clean)), "doc_id")
    # copies would lend their accidental words the weight of many documents
    return found.withColumn("_text", F.xxhash64("text")).dropDuplicates(["_text"]).drop("_text")


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> tuple[list[tuple[str, float, int]], list[float]]:
    """Terms and model weights from labelled rows for which ``train`` holds.

    Without labelled documents of both classes there are no terms, and every text
    has the same low score.
    """
    nothing = [-4.0, *[0.0] * (len(Scorer.NAMES) - 1)]
    sample = written(_sample(docs, labels, train), "toxic-sample")
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return [], nothing

    least = 4
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1.0)) - F.log((F.col("c") + 0.5) / (n[0] + 1.0))
    table = sample.select("text", "toxic").mapInArrow(_counts, "term string, kind int, toxic long, clean long")
    table = table.groupBy("term", "kind").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).withColumn("odds", odds)
    table = table.where((F.col("t") >= least) & (F.col("odds") >= 3.2) & (F.col("c") <= 0.1 * F.col("t")))
    rows = [(r.term, r.kind, round(r.odds, 4), r.t) for r in table.collect()]
    stems: dict[str, float] = {}
    for term, kind, weight, t in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        if kind == STEM and t >= 2 * least and not any(term[:k] in stems for k in range(4, len(term))):
            stems[term] = weight
    words = {term: w for term, kind, w, _ in rows if kind == WORD and not any(term[:k] in stems for k in range(4, len(term)))}
    # a stem that is only one word's beginning is that word
    begun: dict[str, set[str]] = {x: set() for x in stems}
    for term, kind, weight, t in rows:
        for x in (term[:k] for k in range(4, len(term) + 1)) if kind == WORD else ():
            if x in begun:
                begun[x].add(term)
    for x, found in begun.items():
        if len(found) == 1:
            words[found.pop()] = stems.pop(x)
    terms = sorted([(w, x, WORD) for w, x in words.items()] + [(s, x, STEM) for s, x in stems.items()])

    rows = _features(sample.select("doc_id", "text", "toxic"), terms, "toxic").collect()
    x = np.array([r.x for r in rows])
    y = np.array([r.extra for r in rows], float)
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(60):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return terms, [float(v) for v in w]


def _features(rows: DataFrame, terms: list, extra: str) -> DataFrame:
    schema = pa.schema([("extra", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scorer(terms)
        for b in batches:
            xs = [s.features(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(xs, schema[1].type)], schema=schema)

    return rows.select(F.col(extra).cast("long"), "text").mapInArrow(run, "extra long, x array<double>")


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, carry: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; with ``carry`` all its columns too, as the struct ``carried``.

    Labels are learnt only from documents for which crc32(doc_id as text) mod 3 is
    not 1; nothing but the text enters a score.  Null and empty texts get the
    score of a text without hits; a null id counts as held out; repeated rows
    each have a row, and a document with contrary labels counts as toxic; empty
    tables give no rows, or no terms.  Columns of any name may be carried.  The
    sample (a documented bound) is the only thing the driver sees, as counts and
    features.
    """
    share = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    terms, weights = learn(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), share != 1)
    whole = F.struct(*docs.columns) if carry else F.struct("text")
    chosen = docs.select("doc_id", F.coalesce(share == 1, F.lit(True)).alias("held_out"), whole.alias("carried"))
    text_at = docs.columns.index("text") if carry else 0
    fields = chosen.schema.fields[: 3 if carry else 2]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"
    w = np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _scorer(terms)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = np.array([s.features(t or "") for t in part.column(2).flatten()[text_at].to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                cols = [part.column(i) for i in range(len(fields))] + [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=[*[f.name for f in fields], "score", "predicted"])

    return chosen.mapInArrow(run, ddl)
