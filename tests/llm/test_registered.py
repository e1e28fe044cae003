"""The registered queries themselves: columns, types and sense, on the smallest tables."""

import collections
import hashlib

import brute
import duckdb
import pytest
from test_text_operators import BYTE, crc, expected_ids

from docweave.llm import queries
from docweave.llm.tokens import load_tokenizer

SCHEMAS = {
    "op1_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op3_pii": {"doc_id": "bigint", **{f"n_{k}": "bigint" for k in ("email", "ip", "card", "phone")}, "base_sha256": "string", "spans": "string"},
    "op4_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op5_sharding": {"doc_id": "bigint", "n_bytes": "bigint", "depth": "int", "shard": "bigint", "shard_bytes": "bigint", "oversized": "boolean"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_near_dup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_token_orc": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    made = {}

    def get(name):
        if name not in made:
            df = queries.queries()[name](spark, sf_dir)
            made[name] = (dict(df.dtypes), df.collect())
        return made[name]

    return get


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_columns(results, name, texts):
    types, rows = results(name)
    assert {c: types.get(c) for c in SCHEMAS[name]} == SCHEMAS[name]
    assert name in ("op1_ann", "op8_packing") or sorted(r.doc_id for r in rows) == sorted(texts)


def test_text_queries_against_plain_versions(spark, results, texts, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    pick = lambda name, *columns: {r.doc_id: tuple(r[c] for c in columns) for r in results(name)[1]}
    assert pick("op2_decontaminate", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination(texts, items)
    assert pick("op3_pii", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == brute.personal(texts)
    assert pick("op4_substring_dedup", "n_words", "n_removed", "kept_sha256") == brute.repeats(texts)
    assert pick("op7_near_dup", "n_shingles", "component_id", "kept") == brute.near(texts, 2)


def test_spans_hold_the_base_spans(results):
    for r in results("op3_pii")[1]:
        spans = r.spans.split(",") if r.spans else []
        counts = collections.Counter(s.split(":")[0] for s in spans)
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
        assert all(counts[k] >= r[f"n_{k}"] for k in ("email", "ip", "card", "phone"))
        if not r.n_added:
            assert hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256


def test_sharding_against_sql(results, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    result = con.execute(queries.oracle_sql()["op5_sharding"])
    columns = [c[0] for c in result.description]
    assert sorted(tuple(r[c] for c in columns) for r in results("op5_sharding")[1]) == sorted(result.fetchall())


def test_toxicity_query(spark, results, sf_dir):
    types, rows = results("op6_toxicity")
    from zlib import crc32

    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic is not null").collect()}
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert not judged or sum(p == t for p, t in judged) >= 0.8 * len(judged)


def test_token_queries(results, texts):
    ids, tok = expected_ids(texts), load_tokenizer(BYTE)
    start = 0
    by_id = {r.doc_id: r for r in results("op9_token_orc")[1]}
    for d in sorted(texts):
        r = by_id[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[d]), crc(ids[d]))
        start += len(ids[d])
    for r in results("op10_token_counts")[1]:
        n = len(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 1024)
    places = collections.defaultdict(list)
    for r in results("op8_packing")[1]:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.ids_crc32 == crc(part) and len(part) == r.length
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(places) <= 1.05 * -(-sum(map(len, ids.values())) // 4096) + 1


def test_queries_are_registered():
    import __spark_entry__

    assert {*SCHEMAS, "pipeline"} <= set(__spark_entry__.queries())



def test_sharding_splits_oversized_buckets_alone(spark, sf_dir):
    from docweave.llm import sharding

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    limit = 12_000
    result = con.execute(sharding.OP5_SQL.replace(str(sharding.LIMIT), str(limit)))
    columns = [c[0] for c in result.description]
    rows = [tuple(r[c] for c in columns) for r in sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), limit).collect()]
    # texts above the limit stand alone in shards of their own; the rest is what SQL says
    assert sorted(r for r in rows if not r[-1]) == sorted(result.fetchall()) and all(r[1] > limit for r in rows if r[-1])
