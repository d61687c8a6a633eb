"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, staged


@dataclass(frozen=True)
class MixParams:
    """Weights repeat over the sources in code-point order, null last."""

    weights: tuple[int, ...] = (5, 2, 1)
    max_epochs: int = 3
    seed: int = 7
    bucket_bits: int = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def _draw(text: Column) -> Column:
    """Seeded 60-bit number: the order in which documents get one more repetition."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, p: MixParams) -> DataFrame:
    """(source, source_size, target): one row per source.

    Water-filling in closed form.  With sources in the order of cap per weight, one is
    clamped iff its share of what earlier clamps left exceeds its cap.  Sums are whole numbers, so
    the result doesn't depend on their order.  The windows hold one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in p.weights])
    sources = (sources.withColumn("weight", F.get(weights, (rank % len(p.weights)).cast("int")).cast("long"))
               .withColumn("cap", F.col("source_size") * p.max_epochs))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sources = (sources
               .withColumn("words", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
               .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
               .withColumn("clamped", F.col("words").cast("decimal(38,0)") * F.col("weight")
                           > F.col("cap").cast("decimal(38,0)") * F.col("weights")))
    # what is left for the sources that are not clamped, from the first of them on
    left = [F.min(F.when(~F.col("clamped"), F.struct((-F.col("weights")).alias("k"), F.col("words"), F.col("weights"))))
            .over(everything).alias("left")]
    return (sources.select("*", *left).select(
        "source", "source_size",
        F.when(F.col("clamped"), F.col("cap").cast("double"))
        .otherwise(F.col("weight") * F.col("left.words").cast("double") / F.col("left.weights")).alias("target")))


def repetition_plan(sized: DataFrame, p: MixParams) -> DataFrame:
    """(source, source_size, target, whole, cut, extra): every document ``whole`` times, those drawn up to
    ``cut`` once more, and so the one drawn ``extra``, whose size fits best to what is then still missing.

    ``sized`` has source, size, draw.  The cut comes from sums per bucket of draws and the draws of the
    one bucket in which it falls, so no task ever orders a whole source.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = staged(source_targets(sized, p).withColumn("whole", whole.cast("long"))
                     .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    shift = 60 - p.bucket_bits
    bucket = F.shiftright("draw", shift)
    sums = (sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
            .withColumn("until", F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))))
    same = sums["source"].eqNullSafe(targets["source"])
    edge = (sums.join(targets, same).where("until - words <= need and need < until")
            .select(sums["source"].alias("edge_source"), F.col("bucket").alias("edge_bucket"),
                    (F.col("until") - F.col("words")).alias("before"), "need"))
    inside = (sized.join(edge, sized["source"].eqNullSafe(F.col("edge_source")) & (bucket == F.col("edge_bucket")))
              .groupBy("edge_source", "draw", "edge_bucket", "before", "need").agg(F.sum("size").alias("words"))
              .withColumn("until", F.col("before") + F.sum("words").over(
                  Window.partitionBy("edge_source").orderBy("draw"))))
    fits = F.col("until") <= F.col("need")
    cuts = (inside.groupBy("edge_source").agg(
        F.coalesce(F.max(F.when(fits, F.col("draw"))), F.min(F.shiftleft("edge_bucket", shift)) - 1).alias("cut"),
        (F.min("need") - F.coalesce(F.max(F.when(fits, F.col("until"))), F.min("before"))).alias("missing")))
    # a source without an edge needs nothing more: its target is a whole multiple
    planned = (targets.join(cuts, targets["source"].eqNullSafe(F.col("edge_source")), "left")
               .select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"), "missing"))
    open_ = planned.where("missing > 0").select(F.col("source").alias("open_source"), "cut", "missing")
    miss = F.abs(F.col("missing") - F.col("size"))
    extra = (sized.join(open_, sized["source"].eqNullSafe(F.col("open_source")))
             .where((F.col("draw") > F.col("cut")) & (miss < F.col("missing")))
             .groupBy("open_source").agg(F.min(F.struct(miss.alias("miss"), "draw")).alias("best")))
    return staged(planned.join(extra, planned["source"].eqNullSafe(F.col("open_source")), "left").select(
        "source", "source_size", "target", "whole", "cut", F.coalesce("best.draw", F.lit(-1)).alias("extra")), "repetitions")


def _packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, code): the row in one struct, so that no name of it clashes, and a hash of it all."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.xxhash64(F.to_json(row)).alias("code"))


def _repeated_ids(docs: DataFrame) -> DataFrame:
    return (docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n"))
            .where("n > 1").select("again"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``occurrence``, from 1, of each row among those with its ``code``.

    Counted within each part of the input, and from there on by the counts of the parts before, so equal rows may be any
    share of all.  Rows with one code are equal, so it doesn't matter which of them gets which number.
    """
    rows = rows.withColumn("part", F.spark_partition_id())
    by_part = Window.partitionBy("code").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("code", "part").agg(F.count("*").alias("n")).select(
        "code", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("code", "part").orderBy("code"))
    return (rows.withColumn("nth", nth).join(before, ["code", "part"])
            .withColumn("occurrence", F.col("before") + F.col("nth")).drop("part", "before", "nth"))


def drawn(rows: DataFrame, repeated: DataFrame, p: MixParams, all_told_apart: bool) -> DataFrame:
    """``rows`` (doc_id, code, others) with their ``draw``: from the id, or where that is missing or repeated from the whole
    row and its occurrence."""
    plain = _draw(F.concat(F.lit(f"{p.seed}:"), F.col("doc_id").cast("string")))
    if all_told_apart:
        return rows.withColumn("draw", plain)
    marked = rows.join(repeated, rows["doc_id"] == repeated["again"], "left").withColumn(
        "unsure", F.col("doc_id").isNull() | F.col("again").isNotNull()).drop("again")
    own = F.concat_ws(":", F.lit(p.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "code", "occurrence")
    return marked.where("not unsure").withColumn("draw", plain).drop("unsure").unionByName(
        _numbered(marked.where("unsure")).withColumn("draw", _draw(own)).drop("unsure", "occurrence"))


@dataclass(frozen=True)
class Mix:
    """What a mix takes of a corpus: ``sized`` (doc_id, source, size, draw) and the plan of its sources."""

    sized: DataFrame
    plan: DataFrame
    repeated: DataFrame
    all_told_apart: bool


def planned(docs: DataFrame, p: MixParams = MixParams()) -> Mix:
    sizes = staged(_packed(docs).drop("row"), "sizes")
    repeated = staged(_repeated_ids(sizes), "repeated")
    told_apart = repeated.isEmpty() and sizes.where("doc_id is null").isEmpty()
    sized = staged(drawn(sizes, repeated, p, told_apart).drop("code"), "sized")
    return Mix(sized, repetition_plan(sized, p), repeated, told_apart)


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source and draw) beside its source's plan, and ``copies`` of each."""
    plan = plan.withColumnRenamed("source", "plan_source")
    return (rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"])).drop("plan_source")
            .withColumn("copies", F.col("whole") + (
                (F.col("draw") <= F.col("cut")) | (F.col("draw") == F.col("extra"))).cast("long")))


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The mixed corpus: rows of ``docs`` (doc_id, text, source, any others), each as often as the mix takes it.

    Blank or null texts have size 0 and are taken with their source's whole repetitions.  Rows without id and rows that
    repeat one draw by all their columns, equal rows one by one.  Columns may have any names.  An empty table gives an
    empty one.
    """
    taken = planned(docs, p)
    rows = drawn(_packed(docs), taken.repeated, p, taken.all_told_apart)
    copied = with_copies(rows, taken.plan).where("copies > 0")
    return copied.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
