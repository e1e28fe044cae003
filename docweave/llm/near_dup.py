"""Near-duplicate groups: SuperMinHash signatures, banding, exact links, components.

1. Every text becomes its set of word shingles and a SuperMinHash signature. Texts of
   the same words in a row (A-Z folded; told by a 128-bit BLAKE2b digest) form one
   class, and only a class's smallest id goes on.
2. Signatures are cut into bands; documents that agree in one band share a bucket.
   With 32 bands of 5 a pair at a similarity of 0.8 is missed with a probability
   of 3 in a million, and less above. That loss is the method's; no exact path
   stands behind it.
3. Links are confirmed on the words of full sets, not on hashes. Pairs of a bucket
   are not listed: the member that shares most buckets leads it, and all others are
   compared with the leader. Whoever links to it is connected. The rest of a leader's
   surroundings is compared with all of them in blocks, as one matrix product for
   each pair of blocks, of which only a spanning forest comes out. So no link that
   connects anything is lost, and rows grow with a group's size, not its square.
4. Components by minimum labels.

A leader's members are dealt to shares of about ``SHARE`` rows, and its text goes
once to each share; nothing is joined on a leader alone.

Defined results: empty texts (no words) have no shingles and link to nothing;
texts with fewer words than a shingle are one shingle; rows that share an id are
one document; rows without an id are never linked and keep a null component.
Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import CELLS, materialize, shuffle_width
from .superminhash import band_keys, signatures
from .words import distinct, keys, run_codes, run_ranks, text_slices, words_of

BANDS, BAND_WIDTH = 32, 5
#: Documents on either side of a block comparison.
BLOCK = 512
#: Members that are compared with a leader in one place, about.
SHARE = 256


def shingle_sets(texts: list, k: int, with_codes: bool = False) -> list:
    """Distinct shingles of each text, A-Z in lower case, as sorted numbers: equal numbers are the same words in all of ``texts``. ``with_codes`` adds their codes, which mean the same everywhere."""
    import numpy as np

    words = words_of(texts, fold=True)
    code, _, which = distinct(*keys(words))
    ranks = run_ranks(which, k)
    run = run_codes(code, k) if with_codes else None
    # a text of fewer words is one shingle: its number is beyond all others
    short: dict[bytes, int] = {}
    out = []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
        if b - a >= k:
            own, at = np.unique(ranks[a : b - k + 1], return_index=True)
            codes = run[a : b - k + 1][at] if with_codes else None
        elif b > a:
            number = short.setdefault(which[a:b].tobytes(), len(short))
            own = np.array([np.iinfo(np.uint64).max - np.uint64(number)], dtype=np.uint64)
            codes = run_codes(code[a:b], b - a) if with_codes else None
        else:
            own = np.empty(0, dtype=np.uint64)
            codes = own
        out.append((own, codes) if with_codes else own)
    return out


def linked(a, b, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct numbers."""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True)) if len(a) and len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def sign(docs: DataFrame, k: int) -> DataFrame:
    """doc, n_shingles, a 128-bit digest of the folded words and the band keys of every row."""

    def made(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch, texts in text_slices(batches):
            sets = shingle_sets(texts, k, with_codes=True)
            size = np.array([len(own) for own, _ in sets], dtype=np.int64)
            first = np.concatenate([[0], np.cumsum(size)])
            code = np.concatenate([codes for _, codes in sets]) if sets else np.empty(0, dtype=np.uint64)
            del sets
            same = [hashlib.blake2b(b" ".join((t or b"").lower().split()), digest_size=16).digest() for t in texts]
            made_keys = band_keys(signatures(code, first, BANDS * BAND_WIDTH), BANDS).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, made_keys.size + 1, BANDS, dtype=np.int32)), pa.array(made_keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(size), pa.array(same, type=pa.binary()), bands], names=["doc", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(made, "doc long, n_shingles long, digest binary, bands array<long>")


def star_pairs(classes: DataFrame) -> DataFrame:
    """Distinct (leader, member) over all buckets with at least two members."""
    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(rows.join(sizes, "bucket"), "buckets")
    standing = members.groupBy("rep").agg(F.sum("n").alias("standing"))
    ranked = members.join(standing, "rep")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("standing", (-F.col("rep")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("leader"))
    return members.select("bucket", "rep").join(leaders, "bucket").filter("rep <> leader").select("leader", F.col("rep").alias("member")).distinct()


def dealt_pairs(pairs: DataFrame, share: int = SHARE) -> DataFrame:
    """``pairs`` with ``n``, the members of the leader, and ``share``, which deals them.

    Counts go from cells (a hash of the member) up to the leader and back to its
    cells, so no join meets all of a leader's members in one place.
    """
    celled = pairs.withColumn("cell", F.pmod(F.xxhash64("member"), F.lit(CELLS)).cast("int"))
    cells = celled.groupBy("leader", "cell").agg(F.count("*").alias("n"))
    totals = cells.groupBy("leader").agg(F.sum("n").alias("n"))
    sized = cells.select("leader", "cell").join(totals, "leader")
    shares = F.pmod("cell", F.ceil(F.col("n") / share).cast("int"))
    return celled.join(sized.select("leader", "cell", "n", shares.alias("share")), ["leader", "cell"]).drop("cell")


def confirm_stars(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """leader, member, n, share and whether the two are linked, on full sets."""

    def checked(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        now, leaders = None, []  # the texts of the leader whose members follow
        for batch, texts in text_slices(batches):
            leader, share, role = (batch.column(c).to_pylist() for c in ("leader", "share", "role"))
            kept = len(leaders)
            sets = shingle_sets([*leaders, *texts], k)
            own, ok, at = list(range(kept)), [], []
            for i, key in enumerate(zip(leader, share)):
                if key != now:
                    now, own = key, []
                if role[i] == 0:
                    own.append(kept + i)
                else:
                    at.append(i)
                    ok.append(any(linked(sets[j], sets[kept + i], percent) for j in own))
            leaders = [leaders[j] if j < kept else texts[j - kept] for j in own]
            rows = pa.array(np.array(at, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("leader", "member", "n", "share")), pa.array(ok, type=pa.bool_())], names=["leader", "member", "n", "share", "ok"])

    members = pairs.join(texts.select(F.col("doc").alias("member"), "text"), "member").select("leader", "share", F.lit(1).alias("role"), "member", "n", "text")
    once = pairs.select("leader", "share").distinct().join(texts.select(F.col("doc").alias("leader"), "text"), "leader")
    leaders = once.select("leader", "share", F.lit(0).alias("role"), F.lit(None).cast("long").alias("member"), F.lit(None).cast("long").alias("n"), "text")
    # a leader's text comes first, then the members of its share
    ordered = leaders.union(members).repartition(shuffle_width(pairs.sparkSession), "leader", "share").sortWithinPartitions("leader", "share", "role", "member")
    return ordered.mapInArrow(checked, "leader long, member long, n long, share int, ok boolean").groupBy("leader", "member", "n", "share").agg(F.max("ok").alias("ok"))


def block_links(stars: DataFrame, texts: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) inside each leader's surroundings that involve a member not linked to the leader, as a spanning forest for each pair of blocks."""
    # counted share by share and brought back to the shares: one row for each
    shares = stars.groupBy("leader", "share").agg(F.count_if(~F.col("ok")).alias("loose"))
    around = shares.groupBy("leader").agg(F.sum("loose").alias("loose")).filter("loose > 0")
    loose = shares.select("leader", "share").join(around, "leader")
    parts = stars.filter("n > 1").join(loose, ["leader", "share"]).select(
        "leader",
        "member",
        "ok",
        F.ceil(F.col("n") / block).cast("int").alias("all_blocks"),
        F.ceil(F.col("loose") / block).cast("int").alias("loose_blocks"),
        F.pmod(F.xxhash64("member", F.lit("block")), F.lit(1 << 40)).alias("h"),
    )
    in_all = F.pmod("h", F.col("all_blocks")).cast("int")
    in_loose = F.pmod("h", F.col("loose_blocks")).cast("int")
    # every member stands in its block against all blocks of loose members; loose ones also come as those blocks
    right = parts.select("leader", "member", F.lit(False).alias("probe"), in_all.alias("y"), F.explode(F.sequence(F.lit(0), F.col("loose_blocks") - 1)).alias("x"))
    left = parts.filter(~F.col("ok")).select("leader", "member", F.lit(True).alias("probe"), in_loose.alias("x"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("y"))
    dealt = left.select("leader", "x", "y", "probe", "member").union(right.select("leader", "x", "y", "probe", "member"))
    with_text = dealt.join(texts.select(F.col("doc").alias("member"), "text"), "member")

    def compared(table):
        import numpy as np
        import pyarrow as pa

        sets = shingle_sets(table.column("text").cast(pa.large_binary()).to_pylist(), k)
        ids, probe = (table.column(c).to_numpy() for c in ("member", "probe"))
        size = np.array([len(s) for s in sets], dtype=np.int64)
        rows = np.repeat(np.arange(len(sets)), size)
        _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = often[column] > 1
        rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
        p, q = np.flatnonzero(probe), np.flatnonzero(~probe)
        exact = np.zeros((len(p), len(q)), dtype=np.int64)
        place = np.zeros(len(sets), dtype=np.int64)
        place[p], place[q] = np.arange(len(p)), np.arange(len(q))
        on_probe = probe[rows]
        width = 4096
        order = np.argsort(column, kind="stable")
        rows, column, on_probe = rows[order], column[order], on_probe[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            at = slice(*np.searchsorted(column, [low, low + width]))
            r, c, o = rows[at], column[at] - low, on_probe[at]
            left, right = np.zeros((len(p), width), dtype=np.float32), np.zeros((len(q), width), dtype=np.float32)
            left[place[r[o]], c[o]] = 1
            right[place[r[~o]], c[~o]] = 1
            exact += (left @ right.T).astype(np.int64)
        x, y = np.nonzero((exact > 0) & (100 * exact >= percent * (size[p][:, None] + size[q][None, :] - exact)))
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        kept = []
        for a, b in zip(ids[p[x]].tolist(), ids[q[y]].tolist()):
            u, v = find(a), find(b)
            if u != v:
                root[max(u, v)] = min(u, v)
                kept.append((a, b))
        a, b = zip(*kept) if kept else ((), ())
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return with_text.groupBy("leader", "x", "y").applyInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    named = rows.filter("doc is not null")
    signed = materialize(sign(rows, k), "signed")
    some = signed.filter("doc is not null and n_shingles > 0")
    classes = some.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")
    member_of = signed.select("doc", "n_shingles", "digest").join(classes.filter("n > 1").select("digest", "rep"), "digest", "left")
    member_of = member_of.select("doc", "n_shingles", F.when(F.col("doc").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("rep", "doc")).otherwise(F.col("doc")).alias("rep"))
    same_id = member_of.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z")
    by_id = member_of.join(same_id.select("doc", "a"), "doc").select("a", F.col("rep").alias("b"))

    pairs = materialize(dealt_pairs(star_pairs(classes.select("rep", "bands"))), "pairs")
    wanted = pairs.select(F.col("leader").alias("doc")).union(pairs.select(F.col("member").alias("doc"))).distinct()
    # one plan at every size: texts are dealt by id once, and the ids wanted are the hashed side
    texts = materialize(named.join(wanted.hint("shuffle_hash"), "doc", "left_semi"), "texts")
    stars = materialize(confirm_stars(pairs, texts, k, percent), "stars")
    links = stars.filter("ok").select(F.col("leader").alias("a"), F.col("member").alias("b")).union(block_links(stars, texts, k, percent)).union(by_id)
    found = connected_components(links)
    out = member_of.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``: shingles of two words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)
