"""Personal data by fixed shapes and bootstrapped contexts, with DataFrame functions alone.

Base spans (email, ip, card, phone) come from regular expressions over whole
texts. They seed the contextual extraction: tokens that look like identifiers
form *instances*, the words beside them form *patterns*, and both form a graph. In
each round a pattern's confidence in a kind is the score its instances have for it
over all its instances (smoothed), and an instance's score is the chance that at
least one of its confident patterns is right, where at least two of them agree. Instances above ``ACCEPT`` that no
base span covers are added as spans of that kind.

The patterns are written so that Java's engine neither recurses nor tries a run of
letters from each of its places: separators between digits or labels become one
sign first (same length, so places stay), and runs are taken possessively from
their start.

Places are code points, ends exclusive. Running sums over a text's matches work in
blocks, so texts with very many matches stay near linear.

Defined results: a null text is an empty one, with no spans and the digest of the
empty string; repeated rows get equal rows; a null doc_id is its own key. Columns
other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: Confidence from which a pattern counts, seeds it must have, and the score from which an instance is added.
CONFIDENT, LEAST_SEEDS, ACCEPT = 0.6, 3.0, 0.8
#: Confident patterns that must agree on an instance, so that one common neighbour does not carry others along.
LEAST_PATTERNS = 2
#: Shares of a pattern's instances, or of an instance's places.
SALTS = 16
#: Letters or digits of an instance that is no base span, at least; one with some on both sides of an @ needs no more.
LEAST_DIGITS = 4
NO_ID = -(1 << 63)
_BLOCK = 256
# Stand-ins for signs between digits and between labels; such signs in a text become the third.
_JOIN, _DOT, _OTHER = "\u0001", "\u0002", "\u0003"
_LOCAL = f"[A-Za-z0-9._%+{_DOT}-]"
#: Fixed shapes; see the module's text for how they are written.
EMAIL = f"(?:(?<!{_LOCAL})|\\G){_LOCAL}++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"[0-9{_JOIN}]{{2,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"


def with_matches(df: DataFrame, name: str, text: str, pattern: str, when: str) -> DataFrame:
    """``df`` with ``name``: start, end and text of each match in column ``text``, leftmost and without overlap, where column ``when`` holds.

    Each step is a column of its own, or Spark would work out shared parts again
    for every use.
    """
    pair = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, own: F.struct(F.char_length(gap).alias("gap"), own.alias("match")))
    steps = F.transform(F.filter(pair, lambda s: s["match"].isNotNull()), lambda s: F.struct(s["gap"].alias("gap"), F.char_length(s["match"]).alias("own"), s["match"].alias("match")))
    df = df.withColumn(name, F.when(F.col(when), steps))
    length = lambda s: s["gap"] + s["own"]
    last = F.floor((F.size(name) - 1) / _BLOCK).cast("int")
    df = df.withColumn(name, F.when(F.size(name) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(name, b * _BLOCK + 1, F.lit(_BLOCK)))))
    grow = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    sums = F.transform(name, lambda block: F.aggregate(block, F.lit(0), lambda acc, s: acc + length(s)))
    df = df.withColumn("before", F.aggregate(F.slice(sums, F.lit(1), F.greatest(F.size(name) - 1, F.lit(0))), F.array(F.lit(0)), grow))
    place = lambda s, at: F.struct((at + s["gap"]).alias("start"), (at + s["gap"] + s["own"]).alias("end"), s["match"].alias("match"))
    inside = lambda block, base: F.zip_with(block, F.aggregate(block, F.array(base), lambda acc, s: grow(acc, length(s))), place)
    found = F.filter(F.flatten(F.zip_with(name, "before", inside)), lambda s: s["match"].isNotNull())
    return df.withColumn(name, found).drop("before")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _identifier(instance: Column) -> Column:
    """Whether an instance that is no base span has enough letters or digits for one."""
    signs = F.regexp_replace(instance, r"[^\p{L}\p{N}]", "")
    return (F.length(signs) >= LEAST_DIGITS) | F.regexp_like(instance, F.lit(r"[\p{L}\p{N}]@[\p{L}\p{N}]"))


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        own = F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48
        doubled = own * 2
        return F.when(i % 2 == 1, own).when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    """The test beyond the shape."""
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda part: F.regexp_like(part, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        n = F.char_length(_digits(match))
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(match)).between(9, 15)
    return F.lit(True)


def _kept(number: int) -> Column:
    """start, kind number and end of the matches of a kind that pass its test."""
    kind = KINDS[number]
    held = F.filter(kind, lambda m: _holds(kind, m["match"]))
    return F.transform(held, lambda m: F.struct(m["start"].cast("int").alias("start"), F.lit(number).alias("kind"), m["end"].cast("int").alias("end")))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc, tag, ``base`` (start, kind number, end, in order) and ``tokens`` (identifier-like ones with the words beside them) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    odd = F.regexp_like("text", F.lit(f"[{_JOIN}{_DOT}]"))
    rows = rows.withColumn("text", F.when(odd, F.translate("text", _JOIN + _DOT, _OTHER * 2)).otherwise(F.col("text")))
    rows = rows.withColumn("digit", F.regexp_like("text", F.lit("[0-9]"))).withColumn("at", F.contains("text", F.lit("@"))).withColumn("plus", F.contains("text", F.lit("+")))
    rows = rows.withColumn("dotted", F.when(F.col("at"), F.regexp_replace("text", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)))
    rows = rows.withColumn("joined", F.when(F.col("digit"), F.regexp_replace("text", r"(?<=[0-9])[\x20-](?=[0-9])", _JOIN)))
    for kind, text, pattern, when in (("email", "dotted", EMAIL, "at"), ("ip", "text", IP, "digit"), ("card", "joined", CARD, "digit"), ("phone", "text", PHONE, "plus")):
        rows = with_matches(rows, kind, text, pattern, when)
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    kept = [F.coalesce(_kept(i), nothing) for i in range(len(KINDS))]
    rows = rows.withColumn("base", F.array_sort(F.concat(*kept)))
    rows = with_matches(rows.withColumn("either", F.col("digit") | F.col("at")), "cut", "text", CANDIDATE, "either")
    blank = r"[\x20\x09-\x0D]+"
    beside = lambda m: F.struct(
        m["start"].cast("int").alias("start"),
        m["end"].cast("int").alias("end"),
        F.lower(m["match"]).alias("token"),
        # the words just before and after, within 64 signs
        F.lower(F.element_at(F.split(F.rtrim(F.substring("text", F.greatest(m["start"] - 63, F.lit(1)), F.least(m["start"], F.lit(64)))), blank), -1)).alias("left"),
        F.lower(F.element_at(F.split(F.ltrim(F.substring("text", m["end"] + 1, F.lit(64))), blank), 1)).alias("right"),
    )
    return rows.select("doc", "tag", "base", F.coalesce(F.transform("cut", beside), F.array().cast("array<struct<start:int,end:int,token:string,left:string,right:string>>")).alias("tokens"))


def _occurrences(spans: DataFrame) -> DataFrame:
    """doc, tag, start, end, token, left, right and the kind of a base span that overlaps (or null)."""
    tokens = spans.select("doc", "tag", F.explode("tokens").alias("t")).select("doc", "tag", "t.*", F.lit(None).cast("int").alias("kind"))
    base = spans.select("doc", "tag", F.explode("base").alias("b")).select("doc", "tag", "b.start", "b.end", *(F.lit(None).cast("string").alias(c) for c in ("token", "left", "right")), "b.kind")
    both = tokens.select(base.columns).union(base).distinct()
    order = Window.partitionBy("doc", "tag").orderBy("start", F.col("token").isNotNull(), "end")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("token").isNull(), F.struct("kind", "end")), ignorenulls=True).over(so_far)
    after = F.lead(F.when(F.col("token").isNull(), F.struct("kind", "start"))).over(order)
    seen = both.withColumn("last", last).withColumn("after", after).filter("token is not null")
    kind = F.when(F.col("last.end") > F.col("start"), F.col("last.kind")).when(F.col("after.start") < F.col("end"), F.col("after.kind"))
    return seen.select("doc", "tag", "start", "end", "token", "left", "right", kind.alias("kind"))


def _salted(large: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """``large`` joined to ``small``, which is what few keys are left of, on ``key``; a key's rows are dealt by a hash of ``by``."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = large.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(small.withColumn("salt", salts).hint("merge"), [key, "salt"]).drop("salt")


def discover(spans: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc, tag, start, kind and end of spans that confident patterns add."""
    seen = materialize(_occurrences(spans), "occurrences")
    plain = lambda c: F.regexp_replace(c, r"^[.,;!?()\[\]\"'<>]+|[.,;!?()\[\]\"'<>]+$", "")
    seen = seen.withColumn("instance", plain("token")).filter(F.length("instance") > 0)
    word = lambda c: F.when(F.regexp_like(c, F.lit(r"^[^0-9@]+$")), F.col(c))
    contexts = F.array_compact(F.array(F.concat(F.lit("<"), word("left")), F.concat(F.lit(">"), word("right")), F.concat(F.lit("<>"), word("left"), F.lit(" "), word("right"))))
    edges = materialize(seen.select("instance", F.explode(contexts).alias("pattern")).distinct(), "edges")
    seeds = materialize(seen.filter("kind is not null").select("instance", "kind").distinct().withColumn("score", F.lit(1.0)), "seeds")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = seeds
    for _ in range(rounds):
        support = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
        confident = support.join(sizes, "pattern").select("pattern", "kind", "support", (F.col("support") / (F.col("n") + 1)).alias("confidence"))
        confident = confident.filter((F.col("confidence") >= CONFIDENT) & (F.col("support") >= LEAST_SEEDS))
        reached = _salted(edges, confident, "pattern", "instance").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"), F.count(F.lit(1)).alias("agree"))
        reached = reached.filter(F.col("agree") >= LEAST_PATTERNS).drop("agree")
        scores = materialize(seeds.union(reached).groupBy("instance", "kind").agg(F.max("score").alias("score")), "scores")
    best = scores.groupBy("instance").agg(F.max(F.struct("score", (-F.col("kind")).alias("minus"))).alias("top"))
    added = best.filter(F.col("top.score") >= ACCEPT).select("instance", (-F.col("top.minus")).alias("kind"))
    loose = seen.filter("kind is null").filter(_identifier(F.col("instance"))).drop("kind")
    lead = F.length(F.regexp_extract("token", r"^[.,;!?()\[\]\"'<>]+", 0))
    return _salted(loose, added, "instance", "doc").select("doc", "tag", (F.col("start") + lead).alias("start"), "kind", (F.col("start") + lead + F.length("instance")).alias("end"))


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc, tag, ``base`` and ``added`` spans (start, kind number, end) of every row of ``docs``; every row is stored first."""
    spans = materialize(base_spans(docs), "spans")
    added = discover(spans, rounds).groupBy("doc", "tag").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return spans.select("doc", "tag", "base").join(added, ["doc", "tag"], "left").withColumn("added", F.coalesce("added", nothing))


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets, and ``n_chars``, where there is one, counted anew. Spans that overlap are replaced as one, by the kind of the first."""
    found = personal_data(docs, rounds).select("doc", "tag", F.array_sort(F.concat("base", "added")).alias("spans")).filter(F.size("spans") > 0).distinct()
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), key[0].alias("doc"), key[1].alias("tag")).join(found, ["doc", "tag"], "left")
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("kept"))
    grow = lambda acc, s: F.struct(s["end"].alias("upto"), F.concat(acc["kept"], F.array(s)).alias("kept"))
    last = lambda acc: F.element_at(acc["kept"], -1)
    longer = lambda acc, s: F.struct(last(acc)["start"].alias("start"), last(acc)["kind"].alias("kind"), s["end"].alias("end"))
    widen = lambda acc, s: F.struct(s["end"].alias("upto"), F.concat(F.slice(acc["kept"], F.lit(1), F.size(acc["kept"]) - 1), F.array(longer(acc, s))).alias("kept"))
    apart = F.aggregate("spans", start, lambda acc, s: F.when(s["start"] >= acc["upto"], grow(acc, s)).when(s["end"] > acc["upto"], widen(acc, s)).otherwise(acc), lambda acc: acc["kept"])
    rows = rows.withColumn("spans", apart)
    label = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col("row.text").cast("string")
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    parts = F.zip_with("spans", F.slice(ends, F.lit(1), F.size("spans")), lambda s, was: F.concat(F.substring(text, was + 1, s["start"] - was), F.element_at(label, s["kind"] + 1)))
    clean = F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text)))
    rows = rows.withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(text))
    new = {"text": F.col("clean"), "n_chars": F.coalesce(F.char_length("clean").cast("long"), F.col("row.n_chars")) if "n_chars" in names else None}
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in names))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        *counts,
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
