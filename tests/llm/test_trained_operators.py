"""Neighbours, toxicity and the pipeline."""

import collections
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docweave.llm import ann, near_dup, pii, toxicity


def exact_neighbours(rows, queries, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in queries:
        own = x[np.flatnonzero(ids == q)[0]]
        keep = np.flatnonzero(ids != q)
        s = (x[keep] * own).sum(axis=1)
        out[q] = [(int(ids[keep[i]]), float(s[i])) for i in np.lexsort((ids[keep], -s))[:k]]
    return out


def test_neighbours_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    good += [(i, good[7][1]) for i in range(300, 400)]  # one vector that many rows share
    bad = [(900, None), (920, [0.0] * 8), (940, [1.0, None] + [0.0] * 6), (960, [float("nan")] * 8), (980, [1.0] * 3), (None, [1.0] * 8), (1000, [float("inf")] * 8)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).repartition(3)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, visited=99.0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact_neighbours(good, range(0, 400, 20))
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(found[q], want[q]))


def test_neighbours_among_many_tied_vectors(spark):
    unit = lambda j: [0.6] + [0.8 if i == j else 0.0 for i in range(1, 8)]
    rows = [(0, [1.0] + [0.0] * 7)] + [(1 + i, unit(1 + i % 7)) for i in range(7 * 25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = ann.nearest(df, F.col("vec_id") == 0, visited=99.0).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 21))


def test_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    found = {}
    for r in ann.op1_ann(spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact_neighbours(rows, sorted(found))
    assert np.mean([len(found[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_neighbours_of_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_matcher_edits_and_stems():
    m = toxicity.Matcher({"idiot": 3.0, "disgusting": 2.0, "bad": 1.0}, {"vequ": 4.0})
    assert m.match("idiot") == (3.0, 0) and m.match("idi0t") == (3.0, 1) and m.match("idiiot") == (3.0, 1) and m.match("diot") == (3.0, 1)
    assert m.match("disgustnig") == (2.0, 2) and m.match("dsgstng") == (0.0, 0)
    assert m.match("bat") == (0.0, 0) and m.match("vequaire") == (4.0, 0) and m.match("vexu") == (0.0, 0) and m.match("") == (0.0, 0)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    plain = "river stone cloud paper window garden letter summer winter market".split()
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(40), rng.choice(["scoundrel", "buffoon", "vermin", "buffooon" if i % 8 == 0 else "buffoon"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, ""), (1001, None), (1002, 'she said "you buffoon" to the river'), (None, "buffoon vermin scoundrel")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(7)), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    lexicon = toxicity.fit(docs, labels)
    assert {"scoundrel", "buffoon", "vermin"} <= set(lexicon.words) | set(lexicon.stems) or lexicon.stems
    scored = toxicity.score_documents(docs, lexicon, "p")
    rows = scored.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).filter("toxic is not null").collect()
    assert len(rows) > 80 and np.mean([(r.p >= 0.5) == bool(r.toxic) for r in rows]) > 0.97
    rest = {r.doc_id: r.p for r in scored.filter("doc_id >= 1000 or doc_id is null").collect()}
    assert rest[1000] == rest[1001] < 0.5 < rest[None] and all(0 <= p <= 1 for p in rest.values())


def test_quotation_counts_less(labelled):
    scorer = toxicity.Scorer(toxicity.Lexicon({"buffoon": 4.0}, {}, frozenset(), (1.0, 0.0, 0.0, 0.0, 0.0)))
    abuse, quote, report = scorer.features([b"you buffoon there", b'the word "buffoon" is old', b"he said buffoon again"])[:, 0]
    assert abuse > quote and abuse > report


def test_no_labels(spark, labelled):
    docs, labels = labelled
    lexicon = toxicity.fit(docs, labels.filter("toxic = 2"))
    assert toxicity.score_documents(docs, lexicon, "p").agg(F.max("p")).first()[0] < 1e-9
    none = docs.filter("doc_id < 0")
    assert toxicity.score_documents(none, toxicity.fit(none, labels), "p").count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage takes out what it should, leaves the rest, and the last packs all of it."""
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(plain) for _ in range(n)]
    docs = {i: " ".join(text(60)) for i in range(120)}
    passage = " ".join(text(14))
    for i in range(0, 60, 3):
        docs[i] = " ".join([*docs[i].split()[:30], "scoundrel", "vermin", "scoundrel", *docs[i].split()[30:]])
    docs |= {200: docs[1], 201: docs[1] + " tail", 202: docs[2] + " " + passage, 203: docs[4] + " me@x.org", 204: "", 205: None}
    docs[204 + 2] = " ".join(text(60)) + " write me@x.org now"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()] + [(None, "no id at all", "en", "s", 12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60 and i % 3 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = table.columns
        table = stage(spark, table, str(tmp_path))
        assert name == "packing" or table.columns == columns
        table.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in table.select("doc_id").collect()}
    assert kept["toxicity"] == {*docs, None} - set(range(0, 60, 3))
    near = brute.near({d: t for d, t in docs.items() if d in kept["toxicity"]}, 5)
    assert kept["near_duplicates"] == {d for d, v in near.items() if v[2]} | {None}
    assert kept["decontamination"] == kept["near_duplicates"] - {202}
    assert kept["pii"] == kept["decontamination"] == kept["packing"]
    clean = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(f"{tmp_path}/pii").collect()}
    assert clean[206][0] == docs[206].replace("me@x.org", "[EMAIL]") and clean[206][1] == len(clean[206][0]) and clean[5][0] == docs[5]
    assert 202 in brute.contamination(docs, [(1, passage)]) and spark.read.parquet(f"{tmp_path}/packing").agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


def test_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(100)]
    rows += [rows[20]] * 40 + [(20, rows[30][1]), (30, rows[30][1])] + [rows[7]] * 50
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, visited=99.0).orderBy("rank").collect():
        found.setdefault((r.query_id, r.query_tag), []).append((r.vec_id, round(r.score, 9)))
    assert len(found) == 6 and all(len(v) == 20 for v in found.values())
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    for (q, _), got in found.items():
        tried = []
        for v in [v for i, v in distinct if i == q]:
            near = sorted((-round(sum(a * b for a, b in zip(v, w)), 9), i) for i, w in distinct if (i, w) != (q, v))[:20]
            tried.append([(i, -s) for s, i in near])
        assert got in tried


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_matcher_against_plain_edit_distance():
    rng = random.Random(6)
    word = lambda least, most: "".join(rng.choice("abcd") for _ in range(rng.randrange(least, most)))
    for _ in range(30):
        words = {word(1, 13): rng.choice([1.0, 2.0, 3.0]) for _ in range(12)}
        stems = {word(4, 7): 9.0 for _ in range(2)}
        matcher = toxicity.Matcher(words, stems)
        tried = [word(0, 15) for _ in range(150)]
        for w in words:  # close ones, too
            letters = list(w)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randrange(2)] = [rng.choice("abcd")] * rng.randrange(2)
            tried += [w, "".join(letters), w + "x"]
        for w in tried:
            stem = next((stems[w[:n]] for n in range(1, len(w) + 1) if w[:n] in stems), None)
            near = [(e, -v) for entry, v in words.items() if (e := edits_between(entry, w)) <= matcher.allowed(entry)]
            want = (stem, 0) if stem else (-min(near)[1], min(near)[0]) if near else (0.0, 0)
            assert matcher.match(w) == want, (w, words, stems)


def test_no_cap_on_the_lexicon():
    rows = [(f"word{i}", 500, 0) for i in range(5_000)] + [(f"plain{i}", 500, 4_000) for i in range(5_000)] + [("chance", 4, 0)]
    words, stems = toxicity.choose_entries(rows, 1_000, 9_000)
    assert set(words) == {f"word{i}" for i in range(5_000)} and not stems


def plain_discovery(rows, rounds=3):
    """What bootstrapped contexts add, from tokens and base spans of each document."""
    strip = ".,;!?()[]\"'<>"
    seen = []
    for r in rows:
        base = sorted((b.start, b.end, b.kind) for b in r.base)
        for t in r.tokens:
            kind = None
            before = [b for b in base if b[0] <= t.start]
            after = [b for b in base if b[0] > t.start]
            if before and before[-1][1] > t.start:
                kind = before[-1][2]
            elif after and after[0][0] < t.end:
                kind = after[0][2]
            instance = t.token.strip(strip)
            if instance:
                word = lambda c: c if c and not re.search("[0-9@]", c) else None
                left, right = word(t.left), word(t.right)
                patterns = [f"<{left}"] * bool(left) + [f">{right}"] * bool(right) + [f"<>{left} {right}"] * bool(left and right)
                seen.append((r.doc, t, instance, patterns, kind))
    edges = {(i, p) for _, _, i, patterns, _ in seen for p in patterns}
    seeds = {(i, k): 1.0 for _, _, i, _, k in seen if k is not None}
    scores = dict(seeds)
    for _ in range(rounds):
        support, number = collections.Counter(), collections.Counter(p for _, p in edges)
        for i, p in edges:
            for k in range(4):
                support[p, k] += scores.get((i, k), 0.0)
        sure = {(p, k): s / (number[p] + 1) for (p, k), s in support.items() if s >= pii.LEAST_SEEDS and s / (number[p] + 1) >= pii.CONFIDENT}
        reached = {}
        for i, p in edges:
            for k in range(4):
                if (p, k) in sure:
                    rest, agree = reached.get((i, k), (1.0, 0))
                    reached[i, k] = rest * (1 - sure[p, k]), agree + 1
        scores = dict(seeds)
        for key, (rest, agree) in reached.items():
            if agree >= pii.LEAST_PATTERNS:
                scores[key] = max(scores.get(key, 0.0), 1 - rest)
    best = {}
    for (i, k), s in scores.items():
        best[i] = max(best.get(i, (0.0, 0)), (s, -k))
    out = set()
    for doc, t, i, _, kind in seen:
        signs = [c for c in i if c.isalnum()]
        enough = len(signs) >= pii.LEAST_DIGITS or re.search(r"[^\W_]@[^\W_]", i)
        if kind is None and enough and i in best and best[i][0] >= pii.ACCEPT:
            lead = len(t.token) - len(t.token.lstrip(strip))
            out.add((doc, t.start + lead, -best[i][1], t.start + lead + len(i)))
    return out


def test_discovery_against_a_plain_version(spark):
    rng = random.Random(12)
    docs, planted = [], {}
    for i in range(240):
        words = [rng.choice("river stone cloud paper window garden letter summer".split()) for _ in range(12)]
        at = rng.randrange(3, 9)
        if i % 5 < 3:
            words[at : at + 1] = ["kontakt", f"user{i}@mail.example.com" + rng.choice(["", ",", "."]), "today"]
        elif i % 5 == 3:
            token = f"agent_{rng.randrange(10_000, 99_999)}" if i % 2 else f"mail.{i}@host"
            words[at : at + 1] = ["kontakt", token, "today"]
            planted[i] = token
        else:
            words[at : at + 1] = ["year", str(rng.randrange(1_000, 9_999)), rng.choice(["was", "and", "today"])]
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = pii.base_spans(df)
    found = {(r.doc, r.start, r.kind, r.end) for r in pii.discover(spans).collect()}
    assert found == plain_discovery(spans.collect())
    texts = dict(docs)
    caught = {d for d, a, _, b in found if planted.get(d) == texts[d][a:b]}
    # recall and precision on planted identifiers, where known ones outnumber them in the same contexts
    assert len(planted) == 48 and len(caught) >= 0.95 * len(planted) and len(found) <= 1.05 * len(caught)


def test_recall_of_near_duplicates_at_the_threshold(spark):
    """Pairs at a similarity of 0.80 to 0.83, the hardest for banding: each must be linked."""
    rng = random.Random(9)
    rows, pairs = [], 0
    for i in range(400):
        # one changed word of n takes two of the n - 1 pairs of words away on either side
        n = rng.choice([20, 21, 22, 39, 40])
        words = [f"w{i}_{j}" for j in range(n)]
        other = list(words)
        for at in [n // 3] if n < 30 else [n // 3, 2 * n // 3]:
            other[at] = f"x{i}_{at}"
        a, b = ({tuple(w[j : j + 2]) for j in range(n - 1)} for w in (words, other))
        if 100 * len(a & b) >= 80 * len(a | b):
            pairs += 1
            rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    assert pairs > 200 and found.filter("doc_id % 2 = 1 and component_id = doc_id - 1").count() == pairs


def test_pipeline_on_hard_tables(spark, tmp_path):
    """Extra columns with names that stages use, repeated and null rows, and no rows at all."""
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, "other words here"), (2, text), (None, text), (None, None), (3, ""), (4, None), (5, "mail a@b.co"), (5, "mail a@b.co")]
    names = {"toxicity": 0.9, "score": 7, "dropped": 1, "hit_id": 2, "hit_tag": 3, "doc": "d", "tag": "t", "row": 4, "base": 5, "spans": 6, "kept": False, "clean": "c", "n_chars": None}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table = table.select("*", *(F.lit(v).cast("long" if v is None else "string" if isinstance(v, str) else "double").alias(k) for k, v in names.items()))
    for i, (docs, labels) in enumerate(((table, [(1, 0), (5, 0)]), (table.limit(0), []))):
        d = f"{tmp_path}/{i}"
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "no such passage"), (None, text), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs.columns
            docs = spark.createDataFrame(stage(spark, docs, d).collect(), docs.schema)
            assert docs.columns == before
        left = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
        # document 2 is a copy of document 1, whose rows stay together
        want = [r for r in rows if r[0] != 2]
        assert left == (sorted([(a, b.replace("a@b.co", "[EMAIL]") if b else b) for a, b in want], key=repr) if not i else [])
        assert corpus_pipeline.run(spark, d).count() == len(left)
