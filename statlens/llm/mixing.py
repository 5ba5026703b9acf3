"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents stand in key order, and the
mix takes them from the start until the source's word budget is used up, whole epochs first. Words
before a document are found by two-level prefix sums: key buckets are summed (pre-aggregated before
any shuffle), the bucket in which the budget ends is found among these sums, and only that bucket's
documents are ordered; the more rows there are, the more buckets. Texts never move: each document is compared in place
with the cut of its source.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, last
in order; an empty table gives an empty mix; a source without words has target 0. Rows with the same
id and size are interchangeable: where the budget ends within k of them, each takes the kth part,
rounded down. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: So many hexadecimal digits of the key name its bucket; one more for each 16 times that many rows beyond BUCKET_ROWS a bucket.
BUCKET_DIGITS, BUCKET_ROWS = 3, 20_000
#: Sources beyond this are joined by a shuffle, no more broadcast.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sized: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target: the budget of each source.

    Sources weigh `weights` by turns in code-point order, null last, and share the sum of all sizes;
    no target exceeds max_epochs times its source's size, and what that leaves over is shared by weight
    among the others. In order of size per weight, a source is capped if its cap is at most its
    share of what the sources before it leave. One row per source: the windows order recipe rows only.
    """
    least = 1
    for w in weights:
        least *= w
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", (big("cap") * F.lit(least) / big("w")).cast("decimal(38,0)"))
    everything = Window.partitionBy()
    s = s.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("w_rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("capped", big("cap") * big("w_rest") <= big("rest") * big("w"))
    open_ = s.filter(~F.col("capped")).agg(F.max(F.struct("w_rest", "rest")).alias("o"))
    share = F.col("o.rest").cast("double") * F.col("w").cast("double") / F.col("o.w_rest").cast("double")
    return s.crossJoin(F.broadcast(open_)).select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with, for each source: epochs (whole passes over it), and where the last, partial pass ends:
    cut_key and cut_size of the documents that it ends in, and cut_take, the words each of those gives."""
    digits, per_bucket = BUCKET_DIGITS, sized.count() / 16**BUCKET_DIGITS
    while per_bucket > BUCKET_ROWS and digits < 8:
        digits, per_bucket = digits + 1, per_bucket / 16
    few = F.broadcast if plan.count() <= BROADCAST_SOURCES else lambda x: x
    bucket = F.substring("key", 1, digits)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("part", budget - F.col("epochs") * F.col("source_size"))
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    last = sums.join(few(plan.select(F.col("source").alias("s"), "part")), F.col("source").eqNullSafe(F.col("s")))
    last = last.filter((F.col("before") < F.col("part")) & (F.col("part") <= F.col("before") + F.col("size"))).select("s", "bucket", F.col("before").alias("bucket_before"), "part")
    rows = sized.join(few(last), F.col("source").eqNullSafe(F.col("s")) & (bucket == F.col("bucket")))
    rows = rows.groupBy("s", "key", "size", "bucket_before", "part").agg(F.count("*").alias("copies"))
    in_bucket = Window.partitionBy("s").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("bucket_before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(in_bucket), F.lit(0)))
    rows = rows.filter((F.col("before") < F.col("part")) & (F.col("part") <= F.col("before") + F.col("size") * F.col("copies")))
    rows = rows.select("s", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.expr("(part - before) div copies").alias("cut_take"))
    return plan.join(rows, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "part")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs with a struct `mix`, in place of a column of that name, of size, source_size, target, taken and epochs of its source."""
    sized = cut(docs.select(F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), random_key(F.col(doc_id), seed).alias("key")), "mix")
    plan = cut(cuts(sized, cut(targets(sized, max_epochs, weights), "mix-targets")), "mix-plan", [sized])
    named = plan.select(F.struct(*plan.columns).alias("__statlens_p"))
    if plan.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    out = docs.withColumn("__statlens_size", n_words(F.col(text))).withColumn("__statlens_key", random_key(F.col(doc_id), seed))
    out = out.join(named, F.col(source).cast("string").eqNullSafe(F.col("__statlens_p.source")), "left")
    here, cut_at = F.struct("__statlens_key", "__statlens_size"), F.struct(F.col("__statlens_p.cut_key").alias("__statlens_key"), F.col("__statlens_p.cut_size").alias("__statlens_size"))
    partial = F.when(F.col("__statlens_p.cut_key").isNull(), F.lit(0)).when(here < cut_at, F.col("__statlens_size")).when(here == cut_at, F.col("__statlens_p.cut_take")).otherwise(F.lit(0))
    taken = F.col("__statlens_p.epochs") * F.col("__statlens_size") + partial
    mixed = F.struct(F.col("__statlens_size").alias("size"), F.col("__statlens_p.source_size").alias("source_size"), F.col("__statlens_p.target").alias("target"), taken.cast("long").alias("taken"))
    return out.withColumn("mix", mixed).drop("__statlens_size", "__statlens_key", "__statlens_p")


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken whole, then its first words where the budget ended in it."""
    m = F.col("mix")
    whole = F.when(m["size"] > 0, F.expr("mix.taken div mix.size")).otherwise(F.lit(0)).cast("int")
    rest = (m["taken"] - whole * m["size"]).cast("int")
    copies = F.flatten(F.array(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))))
    # Words with the space before them, so that the head is a true prefix of the text.
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("__statlens_take")), "")
    out = mixed.withColumn("__statlens_take", F.explode(copies))
    return out.withColumn(text, F.when(F.col("__statlens_take") < 0, F.col(text)).otherwise(head)).drop("__statlens_take", "mix")
