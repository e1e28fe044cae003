"""Toxicity: Levenshtein automata over a lexicon trie, scored in context windows.

1. The lexicon is induced from labelled documents outside the held-out fold: words
   and word stems that toxic texts have far more often than others. Texts count
   once each, so copies add no evidence. At most ``TRAIN_ROWS`` labelled rows, chosen
   by a hash of their id, are read for this.
2. Entries form a trie. Its product with the Levenshtein automaton (one edit for
   entries of 5 letters or more, two from 9 on) is determinised as words come by, so
   a word costs one step for each letter. Stems match exactly, whatever follows.
   Words that clean training texts have themselves are never taken for misspellings.
3. A hit counts in full where it abuses and a quarter where the words around it
   mark a quotation (it stands between quotation marks, or a word of reporting
   precedes it in the window).
4. A logistic model over the document's hits (strength, density, misspelled share,
   quoted share) gives the score. Its few weights are fitted on other training rows
   than those the lexicon comes from, so they see how often hits mislead.

Every whole text is scored; labels, language, source and id are no inputs.

Defined results: null, empty and wordless texts get the model's score of no hit;
without labels of both kinds nothing can be learnt and every score is near 0; a
null doc_id is scored and not held out; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import CACHE_BYTES, Cache
from .words import distinct, keys, text_slices, words_of

TRAIN_ROWS = 20_000
#: How many times more often toxic texts must have an entry.
LIFT = 20.0
#: Chance, at most, that any of the terms looked at gets into the lexicon without meaning.
CHANCE = 0.01
STEM_LETTERS = range(4, 8)
#: Words around a hit that tell quotation from abuse.
CONTEXT_WORDS = 4
QUOTED_SHARE = 0.25
#: Words of reporting. Fixed values.
REPORTING = frozenset("said says called calls quoted quotes word term wrote writes sagte schrieb wort dit écrit mot dijo escribió palabra".split())
QUOTES = re.compile("[\"'“”„«»‘’`]")
_LETTERS = re.compile(r"[^\W_]+(?:[@$!|][^\W_]+)*")


class Lexicon(NamedTuple):
    """Weights of words and stems, words that are no misspellings, and the model."""

    words: dict[str, float]
    stems: dict[str, float]
    safe: frozenset[str]
    model: tuple[float, ...]


class Matcher:
    """The lexicon's trie with the Levenshtein automaton, determinised step by step."""

    #: States kept; beyond that the automaton starts over.
    MOST_STATES = 200_000

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[float | None] = [None]
        self.stem: list[float | None] = [None]
        self.edits: list[int] = [0]
        for entries, mark in ((words, self.word), (stems, self.stem)):
            for entry, weight in entries.items():
                node, edits = 0, self.allowed(entry) if mark is self.word else 0
                for letter in entry:
                    self.edits[node] = max(self.edits[node], edits)
                    if letter not in self.child[node]:
                        self.child[node][letter] = len(self.child)
                        for column, empty in ((self.child, {}), (self.word, None), (self.stem, None), (self.edits, 0)):
                            column.append(empty if empty is None or empty == 0 else {})
                    node = self.child[node][letter]
                mark[node] = weight
                self.edits[node] = max(self.edits[node], edits)
        self.length = {0: 0}
        queue = [0]
        for node in queue:
            for n in self.child[node].values():
                self.length[n] = self.length[node] + 1
                queue.append(n)
        self.clear()

    @staticmethod
    def allowed(entry: str) -> int:
        return 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2

    def clear(self) -> None:
        self.sets: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, int]] = []
        self.start = self.state({0: 0})

    def state(self, found: dict[int, int]) -> int:
        """The number of a set of (trie node, edits so far), closed under letters left out of the word."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if found[node] != e:
                continue
            for n in self.child[node].values():
                if e + 1 <= self.edits[n] and e + 1 < found.get(n, 99):
                    found[n] = e + 1
                    todo.append((n, e + 1))
        key = tuple(sorted(found.items()))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(self.word[n], e) for n, e in key if self.word[n] is not None and e <= self.allowed_at(n)]
            self.ends.append(min(ends, key=lambda x: (x[1], -x[0])) if ends else (0.0, 0))
        return number

    def allowed_at(self, node: int) -> int:
        n = self.length[node]
        return 0 if n < 5 else 1 if n < 9 else 2

    def step(self, number: int, letter: str) -> int:
        """Where a letter leads; -1 where no entry is in reach any more."""
        found: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.edits[node] and e < found.get(node, 99):
                found[node] = e

        for node, e in self.sets[number]:
            for own, n in self.child[node].items():
                if own == letter:
                    found[n] = min(e, found.get(n, 99))
                else:
                    reach(n, e + 1)
            reach(node, e + 1)
        to = self.state(found) if found else -1
        self.steps[number][letter] = to
        return to

    def match(self, word: str) -> tuple[float, int]:
        """Weight of the entry that a word is, begins with or misspells, and the edits; (0, 0) for none."""
        if len(self.sets) > self.MOST_STATES:
            self.clear()
        node = 0
        for letter in word:
            node = self.child[node].get(letter, -1)
            if node < 0:
                break
            if self.stem[node] is not None:
                return self.stem[node], 0
        number, steps = self.start, self.steps
        for letter in word:
            to = steps[number].get(letter)
            if to is None:
                to = self.step(number, letter)
            if to < 0:
                return 0.0, 0
            number = to
        return self.ends[number]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def terms_of(text: str) -> set[str]:
    """Words of a text, and its stems written with a star."""
    words = {w for w in _LETTERS.findall(text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in STEM_LETTERS if len(w) >= n}


def beyond_chance(a: int, b: int, share: float, terms: int) -> bool:
    """Whether ``a`` toxic texts among ``a + b`` are beyond what ``share`` gives by chance in one of ``terms`` trials (Chernoff's bound on the binomial tail)."""
    n = a + b
    if not n or a <= n * share:
        return False
    gain = a * math.log(a / (n * share)) + (b * math.log(b / (n * (1 - share))) if b else 0.0)
    return gain >= math.log(terms / CHANCE)


def choose_entries(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their weights, from (term, toxic texts, clean texts). A stem is taken where it covers clearly more texts than any entry that begins with it."""
    base = (toxic + 1) / (clean + 1)
    weight = {t: math.log((a + 0.5) / (b + 0.5) / base) for t, a, b in rows if beyond_chance(a, b, toxic / (toxic + clean), len(rows))}
    support = {t: a for t, a, _ in rows}
    good = sorted((t for t in weight if weight[t] >= math.log(LIFT)), key=lambda t: (t.endswith("*"), -len(t), t))
    words, stems, covered = {}, {}, {}
    for t in good:
        body = t.rstrip("*")
        if t.endswith("*") and support[t] < 1.3 * covered.get(body, 0):
            continue
        (stems if t.endswith("*") else words)[body] = min(weight[t], 6.0)
        for n in STEM_LETTERS:
            if len(body) >= n:
                covered[body[:n]] = max(covered.get(body[:n], 0), support[t])
    return words, stems


class Scorer:
    """Scores whole texts by a lexicon."""

    FEATURES = 5

    def __init__(self, lexicon: Lexicon, cache_bytes: int = CACHE_BYTES // 2):
        self.lexicon = lexicon
        self.matcher = Matcher(lexicon.words, lexicon.stems)
        self.cache = Cache(cache_bytes)

    def word(self, raw: str) -> float:
        """Weight of a word as it stands between blanks: positive for an entry, negative for a misspelled one."""
        best = 0.0
        for w in _LETTERS.findall(raw.lower()):
            weight, edits = self.matcher.match(w)
            if weight and edits and w in self.lexicon.safe:
                continue
            if weight > abs(best):
                best = -weight if edits else weight
        return best

    def features(self, texts: list[bytes | None]):
        """For each text: strength of hits, their density, misspelled and quoted shares, and one."""
        import numpy as np

        words = words_of(texts, fold=True)
        out = np.zeros((len(words.first) - 1, self.FEATURES))
        out[:, -1] = 1
        if not len(words.begin):
            return out
        _, where, which = distinct(*keys(words))
        data = words.folded.tobytes()
        chunks = [data[a:b] for a, b in zip(words.begin[where].tolist(), words.end[where].tolist())]
        weights = self.cache.results(chunks, lambda new: [self.word(c.decode("utf-8")) for c in new], lambda _: 32)
        weights = np.array(weights, dtype=np.float64)[which]
        hits = np.flatnonzero(weights)
        row = np.searchsorted(words.first, hits, side="right") - 1
        counts = np.diff(words.first)
        quoted = np.fromiter((self.quoted(words, int(h), int(words.first[r]), int(words.first[r + 1])) for h, r in zip(hits, row)), dtype=bool, count=len(hits))
        strength = np.abs(weights[hits]) * np.where(quoted, QUOTED_SHARE, 1.0) * np.where(weights[hits] < 0, 0.5, 1.0)
        total = np.bincount(row, strength, len(out))
        number = np.maximum(np.bincount(row, minlength=len(out)), 1)
        out[:, 0] = np.log1p(total)
        out[:, 1] = np.log1p(100 * total / np.maximum(counts, 1))
        out[:, 2] = np.bincount(row, weights[hits] < 0, len(out)) / number
        out[:, 3] = np.bincount(row, quoted, len(out)) / number
        return out

    def quoted(self, words, hit: int, first: int, last: int) -> bool:
        """Whether the window around a hit marks it as a quotation."""
        a, b = max(first, hit - CONTEXT_WORDS), min(last, hit + CONTEXT_WORDS + 1)
        own = words.data[words.begin[hit] : words.end[hit]].decode("utf-8", "replace")
        before = words.data[words.begin[a] : words.begin[hit]].decode("utf-8", "replace") + own[: len(own) // 2]
        after = own[len(own) // 2 :] + words.data[words.end[hit] : words.end[b - 1]].decode("utf-8", "replace")
        if QUOTES.search(before) and QUOTES.search(after):
            return True
        return not REPORTING.isdisjoint(_LETTERS.findall(before.lower()))

    def scores(self, texts: list[bytes | None]):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.lexicon.model), -30, 30)))


def fit_model(x, y) -> tuple[float, ...]:
    """Weights of a logistic model with a small ridge, by Newton's method."""
    import numpy as np

    w, ridge = np.zeros(x.shape[1]), 1e-2
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """Lexicon and model from at most ``train_rows`` labelled rows outside the held-out fold."""
    import numpy as np

    usable = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # at most train_rows ids of 8 bytes are broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("text").agg(F.max("toxic").alias("toxic"))
    for_model = F.pmod(F.xxhash64("text", F.lit("model")), F.lit(3)) == 0
    train, rest = rows.filter(~for_model), rows.filter(for_model)

    def count_terms(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch, own in text_slices(batches):
            for text, toxic in zip(own, batch.column("toxic").to_pylist()):
                counts[toxic].update(terms_of(text.decode("utf-8")))
                counts[toxic][""] += 1
        terms = list(counts[1].keys() | counts[0].keys())
        for at in range(0, len(terms), 50_000):
            part = terms[at : at + 50_000]
            columns = [pa.array(part), *(pa.array([c[t] for t in part], type=pa.int64()) for c in (counts[1], counts[0]))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])

    counted = train.mapInArrow(count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # terms of the training sample that may qualify; their number is bounded by the sample's words
    found = [(r.term, r.toxic, r.clean) for r in counted.filter("term = '' or toxic >= 4 and toxic * 4 > clean").orderBy(F.desc("toxic"), "term").collect()]
    totals = next(((a, b) for t, a, b in found if t == ""), (0, 0))
    if not all(totals):
        return Lexicon({}, {}, frozenset(), (0.0, 0.0, 0.0, 0.0, -30.0))
    words, stems = choose_entries([r for r in found if r[0]], *totals)
    draft = Lexicon(words, stems, frozenset(), (0.0,) * Scorer.FEATURES)

    def near_words(batches: Iterator) -> Iterator:
        import pyarrow as pa

        matcher, found = Matcher(draft.words, draft.stems), set()
        for batch, own in text_slices(batches):
            for text, toxic in zip(own, batch.column("toxic").to_pylist()):
                if not toxic:
                    found.update(w for w in set(_LETTERS.findall(text.decode("utf-8").lower())) if matcher.match(w)[1])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), type=pa.string())], names=["term"])

    # words one or two edits away from an entry, in clean training texts: bounded by the training rows
    safe = frozenset(r.term for r in train.mapInArrow(near_words, "term string").distinct().collect())
    draft = draft._replace(safe=safe)

    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(draft)
        for batch, own in text_slices(batches):
            x = scorer.features(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    sample = rest.mapInArrow(describe, "x array<double>, toxic int").collect()  # train_rows rows of a few numbers
    x, y = np.array([r.x for r in sample]).reshape(-1, Scorer.FEATURES), np.array([r.toxic for r in sample], dtype=float)
    order = np.lexsort((*x.T, y))  # one order of summation, whatever order the rows came in
    return draft._replace(model=fit_model(x[order], y[order]))


def score_documents(docs: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """``docs`` with ``name``, the score: all columns, row by row, without a shuffle. ``name`` must be none of the columns."""
    names = docs.columns
    if name.lower() in (c.lower() for c in names):
        raise ValueError(f"docs has a column {name} already")
    spread = docs.sparkSession.sparkContext.broadcast(lexicon)  # grows with the training sample, which TRAIN_ROWS bounds

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(spread.value)
        for batch, own in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scorer.scores(own))], names=[*names, name])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema.fields), T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(score, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents`` and ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, lexicon).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
