"""Text operators against plain versions, on hard, odd and empty tables."""

import array
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from docweave.llm import decontaminate, near_dup, orc_tokens, packing, pii, sharding, substring_dedup, token_counts
from docweave.llm.shared import scratch_path
from docweave.llm.tokens import load_tokenizer, tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}


def expected_ids(texts):
    tok = load_tokenizer(WORD)
    return {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}


def crc(ids):
    return zlib.crc32(array.array("I", ids).tobytes())


@pytest.mark.parametrize("few", [True, False])
def test_contamination(spark, hard_docs, hard_texts, few, monkeypatch):
    if not few:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 2)
    items = [(1, " ".join(hard_texts[55].split()[110:140])), (2, hard_texts[3][:200]), (3, "Two, words"), (4, None), (5, ""), (6, "word"), (7, " ".join(hard_texts[58].split()[:12])), (8, "漢字 🙂 ı")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = by_id(decontaminate.contamination(hard_docs, bench), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == brute.contamination(hard_texts, items)


def test_personal_data(spark, hard_texts):
    texts = dict(hard_texts) | {
        100: "a@b.c_d@e.f x@y..z q@w.e. 1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0004",
        101: "4111 1111 1111 1111-4 4111-1111-1111-1111 41111111111111112222222222222 1 2 3",
        102: "+1 (555) 123-4567 +12 +4 49 30 1234567 +1-2-3-4-5-6-7-8-9-",
        103: "1" * 20_000,
        104: "x@" + "a." * 20_000 + "b " + "a." * 20_000 + "@x.y",
        105: "\u0001\u0002 1\u00012 a\u0002b@c.d 🙂 a@b.co",
        106: "1.1.1.1 " * 1500,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = pii.personal_data(docs)
    named = found.select(F.col("doc").alias("doc_id"), F.sha2(pii.written(F.col("base")), 256).alias("sha"))
    assert {d: v[0] for d, v in by_id(named, "sha").items()} == {d: v[4] for d, v in brute.personal(texts).items()}


def test_contexts_find_new_identifiers(spark):
    rows = [(i, f"please mail kontakt user{i}@mail.example.com today") for i in range(12)] + [(50, "please mail kontakt nobody77123 today"), (51, "the year 19884 was fine")]
    found = {r.doc: [tuple(s) for s in r.added] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[50] == [(20, 0, 31)] and found[51] == [] and found[3] == []
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[50] == "please mail kontakt [EMAIL] today" and clean[3] == "please mail kontakt [EMAIL] today" and clean[51] == rows[-1][1]


def test_contexts_find_identifiers_with_few_digits(spark):
    new = {50: "user@localhost", 51: "jane@intranet", 52: "a@b", 53: "agent7", 54: "x12", 55: "@"}
    rows = [(i, f"please mail kontakt user{i}@mail.example.com today") for i in range(12)] + [(i, f"please mail kontakt {t} today") for i, t in new.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc: [tuple(s) for s in r.added] for r in pii.personal_data(docs).collect()}
    assert {i: found[i] for i in new} == {i: [(20, 0, 20 + len(t))] if i < 54 else [] for i, t in new.items()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(clean[i] == (f"please mail kontakt {'[EMAIL]' if i < 54 else t} today") for i, t in new.items())


def test_overlapping_spans_leave_nothing_in_clear(spark):
    texts = {
        "call +49 30 1234567 77jane@ex.org now": "call [PHONE] now",
        "4111 1111 1111 1111@ex.com": "[CARD]",
        "+49 30 1234567 77jane@ex.org, me@x.org and 10.0.0.1": "[PHONE], [EMAIL] and [IP]",
        "me@10.0.0.1 a@b.co": "[EMAIL] [EMAIL]",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == dict(enumerate(texts.values()))


@pytest.mark.parametrize("group", [2, substring_dedup.GROUP_SUFFIXES])
def test_repeats(hard_docs, hard_texts, group):
    found = by_id(substring_dedup.remove_repeats(hard_docs, group_suffixes=group), "n_words", "n_removed", "kept_sha256")
    assert found == brute.repeats(hard_texts)


@pytest.mark.parametrize("k, block", [(2, near_dup.BLOCK), (5, 2)])
def test_near_duplicates(hard_docs, hard_texts, k, block, monkeypatch):
    monkeypatch.setattr(near_dup.block_links, "__defaults__", (block,))
    found = by_id(near_dup.near_duplicates(hard_docs, k=k), "n_shingles", "component_id", "kept")
    assert found == brute.near(hard_texts, k)


def test_packing(hard_docs, hard_texts):
    rows = packing.pack_documents(hard_docs, WORD, keep_ids=True).collect()
    ids = expected_ids(hard_texts)
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == crc(r.ids) and r.length == len(r.ids)
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [4096 * r.piece for r in own] and sum((r.ids for r in own), []) == ids[d]
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(places) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_plan_is_best_fit_and_bounded():
    counts = {n: 1 + n % 7 for n in range(1, 4097)}
    runs = packing.plan_slots(counts)
    assert sum(r.number for r in runs) == sum(counts.values()) and len(runs) < 5 * len(counts)
    packed = max(r.sequence + -(-r.number // r.each) for r in runs)
    assert packed <= 1.01 * sum(n * c for n, c in counts.items()) / 4096 + 1


def test_token_orc(spark, hard_docs, hard_texts):
    path = scratch_path(spark, "orc")
    orc_tokens.write_token_orc(hard_docs, path, WORD, files=3, row_stride=1000)
    ids = expected_ids(hard_texts)
    start, want = 0, {}
    for d in sorted(ids):
        want[d] = (start, len(ids[d]), crc(ids[d]))
        start += len(ids[d])
    assert by_id(orc_tokens.token_positions(spark, path), "start", "n_tokens", "ids_crc32") == want
    found = orc_tokens.lookup_tokens(spark, path, [5, 66])
    assert {r.doc_id: list(r.tokens) for r in found.collect()} == {d: ids[d] for d in (5, 66)}
    assert "doc_id" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_token_counts(hard_docs, hard_texts):
    tok = load_tokenizer(BYTE)
    want = {d: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in hard_texts.items()}
    assert by_id(token_counts.count_tokens(hard_docs, BYTE), "n_bytes", "n_tokens") == want
    stored = token_counts.count_tokens(hard_docs, BYTE, store_prefixes=True).cache()
    assert by_id(stored, "n_bytes", "n_tokens") == want
    cut = by_id(token_counts.truncate_to_budget(stored.filter("doc_id < 60"), 20), "keep_bytes", "n_tokens")
    for d, (size, n) in cut.items():
        assert n <= 20 and n == len(tok.encode(hard_texts[d].encode()[:size].decode(), add_special_tokens=False).ids)
    assert all(v[0] <= want[d][1] for d, v in by_id(token_counts.tokens_at(stored, 50), "n_tokens").items())


def test_prefix_counts_are_exact():
    counter, tok = token_counts.PrefixCounter(BYTE), load_tokenizer(BYTE)
    for piece in (" international", "aaaaaaaaaaa", " $$$###", "Übergrößenträger", "1234567"):
        counts = counter.prefix_counts(piece)
        data = piece.encode()
        for i in range(len(data) + 1):
            try:
                prefix = data[:i].decode()
            except UnicodeDecodeError:
                continue
            if len(counter.split.findall(prefix)) <= 1:
                assert counts[i] == len(tok.encode(prefix, add_special_tokens=False).ids)


def test_every_prefix_has_its_count(spark):
    tok = load_tokenizer(BYTE)
    texts = [
        "漢字仮名交じり文をそのまま切らずに書き続ける文章です🙂" * 3,
        "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ" * 4,
        "function(a,b){return a==b?internationalization:0}//======================================================x",
        "They're here, we've seen 'll and don't; it's 'relaxed. Übergrößenträger.\nNext line, of plain words.",
        "a  b   \t c \n\n d\r\n\u3000\u3000e \x85\x85f\u00a0 g\x1c\x1c h\u200b\ufeff i  ",
        "one  <|endoftext|> two<|endoftext|><|endoftext|>  three <|endoftex",
        "-" * 300 + " " * 200 + "x",
        "",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = token_counts.count_tokens(docs, BYTE, store_prefixes=True).cache()
    sizes = [[len((t or "")[:i].encode()) for i in range(len(t or "") + 1)] for t in texts]
    want = [dict(zip(sizes[d], (len(e.ids) for e in tok.encode_batch([(t or "")[:i] for i in range(len(t or "") + 1)], add_special_tokens=False)))) for d, t in enumerate(texts)]
    rows = {r.doc_id: r for r in stored.collect()}
    for d, own in enumerate(want):
        totals, steps = token_counts.counter(BYTE).prefix_steps([texts[d].encode() if texts[d] is not None else None])
        assert totals[0] == rows[d].n_tokens == own[sizes[d][-1]] and steps[0] == rows[d].steps
        width = len(steps[0]) // max(rows[d].n_bytes, 1)
        coded = [int.from_bytes(steps[0][i : i + width], "little", signed=True) for i in range(0, len(steps[0]), max(width, 1))]
        counts = [0]
        for c in coded:
            counts.append(counts[-1] + (c >> 1))
        assert {n: counts[n] for n in own} == own
        assert [i + 1 for i, c in enumerate(coded) if not c & 1] == sizes[d][1:]
    for n in (0, 12, 27, 60):
        found = by_id(token_counts.tokens_at(stored, n), "n_tokens")
        assert all(found[d][0] == own[n] for d, own in enumerate(want) if n in own) and found[8] == (0,)
    for budget in (0, 1, 7, 20, 10_000):
        best = {d: max((n, c) for n, c in own.items() if c <= budget) for d, own in enumerate(want)}
        assert by_id(token_counts.truncate_to_budget(stored, budget), "keep_bytes", "n_tokens") == best


def test_token_count_query_stores_prefixes(spark, sf_dir):
    rows = token_counts.op10_token_counts(spark, sf_dir).select("n_bytes", "n_tokens", "steps").collect()
    assert rows and all(len(r.steps) in (r.n_bytes, 2 * r.n_bytes) for r in rows)


def test_sharding(spark, hard_docs, hard_texts):
    rows = sharding.shard(hard_docs, limit=3000).collect()
    sizes = {}
    for r in rows:
        sizes[r.depth, r.shard] = sizes.get((r.depth, r.shard), 0) + r.n_bytes
    assert len(rows) == len(hard_texts)
    assert all(r.shard_bytes == sizes[r.depth, r.shard] and (r.shard_bytes <= 3000) != r.oversized for r in rows)
    assert [r.doc_id for r in rows if r.oversized] == [70]
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.lit("k").alias("source"))
    split = sharding.shard(hot, limit=500, key="source")
    assert split.filter("shard_bytes > 500").count() == 0 and split.count() == 3000


def test_odd_rows(odd_docs, spark):
    found = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd_docs).collect()), key=repr)
    assert found == sorted([(None, 21, 0), (None, 0, 0), (1, 21, 21), (1, 21, 21), (1, 3, 0), (2, 22, 21), (3, 0, 0), (3, 0, 0)], key=repr)
    near = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(odd_docs, k=2).collect()), key=repr)
    assert near == sorted([(None, None, True)] * 2 + [(1, 1, True)] * 3 + [(2, 1, False)] + [(3, 3, True)] * 2, key=repr)
    bench = spark.createDataFrame([(1, "other text here"), (None, "one two three")], "item_id long, text string")
    assert sorted((r.n_hit for r in decontaminate.contamination(odd_docs, bench).collect())) == [0] * 7 + [3]
    assert pii.personal_data(odd_docs).count() == 8 and pii.redact(odd_docs).count() == 8
    assert sharding.shard(odd_docs).count() == 8
    assert token_counts.count_tokens(odd_docs, BYTE).count() == 8
    assert packing.pack_documents(odd_docs, WORD).count() == 8
    path = scratch_path(spark, "orc")
    orc_tokens.write_token_orc(odd_docs, path, WORD)
    assert orc_tokens.token_positions(spark, path).agg(F.max(F.col("start") + F.col("n_tokens")), F.sum("n_tokens")).first() == tuple([orc_tokens.token_positions(spark, path).agg(F.sum("n_tokens")).first()[0]] * 2)


@pytest.mark.parametrize("parts", [1, 6])
def test_repeated_rows_keep_their_text(spark, parts):
    unique = " ".join(f"u{i}" for i in range(50))
    inner = " ".join([*(f"v{i}" for i in range(30))] * 2)
    rows = [(1, unique)] * 4 + [(2, inner)] * 4 + [(None, unique + " w")] * 2 + [(3, " ".join(f"x{i}" for i in range(40)))] * 2 + [(4, " ".join(f"x{i}" for i in range(25)))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    for group in (1, substring_dedup.GROUP_SUFFIXES):
        found = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, group_suffixes=group).collect()), key=repr)
        assert found == sorted([(1, 50, 50)] * 4 + [(2, 60, 30)] * 4 + [(None, 51, 0)] * 2 + [(3, 40, 0)] * 2 + [(4, 25, 25)] * 2, key=repr)


def test_empty_tables(no_docs, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert pii.redact(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert near_dup.near_duplicates(no_docs).count() == 0
    assert packing.pack_documents(no_docs, WORD).count() == 0
    assert token_counts.count_tokens(no_docs, BYTE).count() == 0
    assert sharding.shard(no_docs).count() == 0
    path = scratch_path(spark, "orc")
    orc_tokens.write_token_orc(no_docs, path, WORD)
    assert orc_tokens.token_positions(spark, path).count() == 0
