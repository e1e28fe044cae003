"""Benchmark decontamination by winnowing, with DataFrame functions alone.

A window is ``window`` words of a benchmark item. Documents and items keep the
least hash of each ``window - GRAM + 1`` neighbouring runs of ``GRAM`` words. Two
equal windows keep the same run at the same place, so every shared window shows
as a shared fingerprint. Fingerprints are joined, and each meeting is extended
word by word to both sides: the words of all whole windows around it are hit.
Hashes only nominate; words decide.

Items shorter than a window are one window of their own length and are found by
the hash of that many words, again decided on the words.

The benchmark's fingerprints are broadcast while there are at most
``BROADCAST_ROWS`` of them (counted first); beyond, the same join shuffles.

Defined results: null, empty and wordless texts have no words, no hits and the
digest of the empty string; items without words occur nowhere; repeated rows of
``documents`` with one id and text count once each and get equal rows; items that
share an id count as one item; a null item id is no item; a null doc_id is its
own key. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, spread_join

WINDOW = 10
GRAM = 4
#: Fingerprints of a benchmark that may be broadcast (about 100 bytes each).
BROADCAST_ROWS = 200_000
#: What stands between words. Fixed value.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLACE = (1 << 31) - 1


def words_column(text: Column) -> Column:
    """Words of a text, A-Z in lower case; an empty array for none."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)).otherwise(F.translate(plain, _UPPER, _UPPER.lower()))
    # the separators split on are single signs after this, so the ends alone can be empty
    return F.filter(F.split(low, NO_WORD), lambda w: w != "")


def _shifted(array: Column, by: int) -> Column:
    return F.slice(array, F.lit(by + 1), F.size(array))


def _paired(df: DataFrame, column: str, by: int, f) -> DataFrame:
    """``column`` with each element joined to the one ``by`` further; the last ``by`` elements mean nothing."""
    return df.withColumn(column, F.zip_with(column, _shifted(F.col(column), by), f))


def fingerprints(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """``df`` (with ``words``) with ``prints``: kept hashes, each with its place in the low 31 bits."""
    df = df.withColumn("prints", F.transform("words", lambda w: F.xxhash64(w)))
    have = 1
    while have < GRAM:
        df = _paired(df, "prints", have, lambda a, b: F.xxhash64(a, b))
        have *= 2
    df = df.withColumn("prints", F.transform("prints", lambda h, i: h.bitwiseAND(~_PLACE).bitwiseOR(i.cast("long"))))
    wide, have = window - GRAM + 1, 1
    while have < wide:
        by = min(have, wide - have)
        df = _paired(df, "prints", by, lambda a, b: F.least(a, b))
        have += by
    return df.withColumn("prints", F.array_distinct(F.slice("prints", 1, F.greatest(F.size("words") - window + 1, F.lit(0)))))


def _hits_of_windows(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """doc, item_id, first and last word of hits on windows of full length."""
    theirs = fingerprints(items.filter(F.size("words") >= window), window).select("item_id", F.col("words").alias("item_words"), F.explode("prints").alias("p"))
    theirs = theirs.select("item_id", F.shiftright("p", 31).alias("print"), p_to_place("p").alias("at"), "item_words")
    # the words around a fingerprint that a window may reach
    reach = window - GRAM
    theirs = theirs.select(
        "item_id",
        "print",
        F.slice("item_words", F.greatest(F.col("at") - reach + 1, F.lit(1)), F.least(F.col("at"), F.lit(reach))).alias("item_left"),
        F.slice("item_words", F.col("at") + 1, F.lit(window)).alias("item_right"),
    ).distinct()
    few = theirs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # explode_outer: for explode, Spark would filter on all the array work once more
    ours = fingerprints(docs, window).select("doc", "words", F.explode_outer("prints").alias("p"))
    ours = ours.select("doc", "words", F.shiftright("p", 31).alias("print"), p_to_place("p").alias("at"))
    if few:
        met = ours.join(F.broadcast(theirs), "print")
    else:
        # documents' words stay behind: meetings go back to them by document; a passage that many share is dealt to shares
        places = materialize(ours.filter("print is not null").select("doc", "print", "at"), "prints")
        met = spread_join(places, theirs, "print", ["doc", "at"]).drop("print").join(docs, "doc")
    left = F.slice("words", F.greatest(F.col("at") - reach + 1, F.lit(1)), F.least(F.col("at"), F.lit(reach)))
    right = F.slice("words", F.col("at") + 1, F.lit(window))
    # in an array of one, so that no part of this moves into the join, which stays with the explode in one piece of code that never copies the words
    both = F.struct(_common(F.reverse(left), F.reverse("item_left")).alias("a"), _common(right, F.col("item_right")).alias("b"))
    met = met.select("doc", "item_id", "at", F.explode(F.array(both)).alias("both")).select("doc", "item_id", "at", "both.a", "both.b")
    # windows begin `d` words before the fingerprint, for each d with d <= a and window - d <= b
    return met.filter(F.col("a") + F.col("b") >= window).select("doc", "item_id", (F.col("at") - F.col("a")).alias("begin"), (F.col("at") + F.col("b")).alias("end"))


def p_to_place(p: str) -> Column:
    return F.col(p).bitwiseAND(F.lit(_PLACE)).cast("int")


def _common(x: Column, y: Column) -> Column:
    """How many leading words two arrays have in common."""
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _hits_of_short(docs: DataFrame, items: DataFrame, window: int) -> DataFrame | None:
    """doc, item_id, first and last word of hits on items shorter than a window."""
    short = items.filter((F.size("words") > 0) & (F.size("words") < window)).withColumn("n", F.size("words"))
    lengths = [r.n for r in short.select("n").distinct().collect()]  # at most window - 1 numbers
    out = None
    for n in sorted(lengths):
        theirs = short.filter(F.col("n") == n).select("item_id", F.col("words").alias("item_words"), F.xxhash64("words").alias("print")).distinct()
        few = theirs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        runs = F.when(F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda i: F.slice("words", i, F.lit(n))))
        ours = docs.select("doc", F.posexplode_outer(runs).alias("at", "run"))
        ours = ours.select("doc", "at", "run", F.xxhash64("run").alias("print"))
        if few:
            met = ours.join(F.broadcast(theirs), "print").filter(F.col("run") == F.col("item_words"))
        else:
            places = materialize(ours.filter("run is not null").select("doc", "at", "print"), "runs")
            met = spread_join(places, theirs, "print", ["doc", "at"]).join(docs, "doc").filter(F.slice("words", F.col("at") + 1, F.lit(n)) == F.col("item_words"))
        met = met.select("doc", "item_id", F.col("at").alias("begin"), (F.col("at") + n).alias("end"))
        out = met if out is None else out.union(met)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc (a struct of doc_id and a hash of the text), item_id and the words [begin, end) that a run of shared windows covers."""
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tag"))
    ours = docs.select(key.alias("doc"), words_column(F.col("text")).alias("words"))
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words_column(F.col("text")).alias("words"))
    found = _hits_of_windows(ours, items, window)
    short = _hits_of_short(ours, items, window)
    return found if short is None else found.union(short)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``, in a column order of their own; ``tag`` tells texts of one id apart."""
    found = hits(docs, benchmark, window)
    # spans first become distinct, then one list for each document: no longer than its words allow
    spans = found.groupBy("doc", "begin", "end").agg(F.collect_set("item_id").alias("items"))
    per_doc = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    union = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["end"] - F.greatest(s["begin"], acc["upto"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    per_doc = per_doc.select(F.col("doc.doc_id").alias("hit_id"), F.col("doc.tag").alias("hit_tag"), union.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.size(words_column(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tag") == F.col("hit_tag")), "left")
    return joined.select(
        "doc_id",
        "tag",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents`` and ``benchmark``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("tag")
