"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, staged

_PRIME, _LAST = 2**31 - 1, 2**31 - 1


@dataclass(frozen=True)
class WinnowParams:
    """Every passage of ``window + gram - 1`` common pieces leaves a common fingerprint.

    A piece is a word of up to ``piece`` code points, or what is left of a longer run, or else a single code point of it.
    So pieces are told by what follows them alone: text put in front changes none.  In a text without blanks, passages of
    ``window + gram - 1`` code points are found wherever they stand, up to the last ``piece`` of a run.
    """

    gram: int = 5
    window: int = 8
    piece: int = 24
    base: int = 1_000_003

    @property
    def pattern(self) -> str:
        return f"[^{SPACE}]{{1,{self.piece}}}(?![^{SPACE}])|[^{SPACE}]"


def _beside(a: Column, b: Column, far: int, n: Column, join) -> Column:
    """``join`` of each element of one array with that of another ``far`` places on; ``n`` is the size of the result."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(far + 1), n), join)


def _moved_up(lift: int):
    return lambda x, y: (x * lift + y) % _PRIME


def _with_selected(df: DataFrame, text: str, out: str, p: WinnowParams) -> DataFrame:
    """Adds ``out``: the selected grams of ``text``, each as hash * 2^32 + (2^31 - 1 - position).

    The smallest of a window is thus that of the smallest hash, the rightmost among ties.  Hashes roll by doubling:
    the hash of twice as many pieces is that of the first half, moved up, and that of the second.  The minimum of a
    window is that of two overlapping windows half as long.
    """
    n = F.size("_h1")
    pieces = F.regexp_extract_all(F.col(text), F.lit(p.pattern), F.lit(0))
    df = df.withColumn("_h1", F.transform(pieces, lambda x: F.pmod(F.xxhash64(x), F.lit(_PRIME))))
    # hashes of 1, 2, 4, ... pieces; those of the gram's length are put together from them
    size, added, helpers = 1, 0, ["_h1"]
    rest = p.gram
    gram_hash: str | None = None
    while rest:
        if rest & 1:
            if gram_hash is None:
                gram_hash, added = f"_h{size}", size
            else:
                lift = pow(p.base, added, _PRIME)
                far, df = size, df.withColumn("_gram", _beside(
                    F.col(f"_h{size}"), F.col(gram_hash), size, F.greatest(n - size - added + 1, F.lit(0)),
                    _moved_up(lift)))
                gram_hash, added = "_gram", added + far
        rest >>= 1
        if rest:
            lift = pow(p.base, size, _PRIME)
            double = f"_h{2 * size}"
            df = df.withColumn(double, _beside(
                F.col(f"_h{size}"), F.col(f"_h{size}"), size, F.greatest(n - 2 * size + 1, F.lit(0)),
                _moved_up(lift)))
            helpers.append(double)
            size *= 2
    whole = F.aggregate("_h1", F.lit(0).cast("long"), lambda acc, x: (acc * p.base + x) % _PRIME)
    short = F.array(F.shiftleft(whole, 32) + F.lit(_LAST).cast("long"))
    long = F.transform(gram_hash, lambda x, i: F.shiftleft(x, 32) + (F.lit(_LAST) - i))
    df = df.withColumn("_grams", F.when(n == 0, F.array().cast("array<long>")).when(n < p.gram, short).otherwise(long))
    m = F.size("_grams")
    seen = 1
    df = df.withColumn("_least", F.col("_grams"))
    while seen < p.window:
        step = min(seen, p.window - seen)
        # a text with fewer grams than the window has one, of all its grams
        df = df.withColumn("_least", _beside(F.col("_least"), F.col("_least"), step, F.greatest(
            F.size("_least") - step, F.lit(0)), lambda x, y: F.least(x, y)))
        seen += step
    least = F.when(m == 0, F.array().cast("array<long>")).when(m < p.window, F.array(F.array_min("_grams"))).otherwise(
        F.array_distinct("_least"))
    return df.withColumn(out, least).drop("_grams", "_least", "_gram", *helpers)


def _printed(selected: Column) -> Column:
    """``hash@position`` of every selected gram in text order, comma-joined."""
    return F.array_join(F.transform(selected, lambda x: F.concat(
        F.lower(F.hex(F.shiftright(x, 32))), F.lit("@"),
        (F.lit(_LAST) - x.bitwiseAND(F.lit(2**32 - 1))).cast("string"))), ",")


def _hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, 32)))


def _likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def fingerprints(docs: DataFrame, p: WinnowParams = WinnowParams()) -> DataFrame:
    """``docs`` with ``fingerprint``: the selected hashes with their positions; null text counts as empty."""
    text = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    found = _with_selected(text, "_text", "_selected", p).withColumn("_printed", _printed(F.col("_selected")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"],
                        F.col("_printed").alias("fingerprint"))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the id: those of a coarse table first, then those between its entries."""
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    all_, coarse = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[::step]))
    j = F.greatest(below(coarse) - 1, F.lit(0)) * step
    # rows without id are many parts, too, by the first bits of their code, greatest first
    return F.when(doc_id.isNull(), F.shiftright("code", 58).cast("int") - 32).otherwise(j + below(F.slice(all_, j + 1, F.lit(step))))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, code, others) dealt by ranges of doc_id, each row with flag ``guest`` false, plus a copy of the
    first row of the next range (flag true) in every range, for windows that look one document ahead.

    Order is descending doc_id, null last, then descending ``code``; after the last comes the first.  Ranges hold like
    numbers of documents; their number follows the shuffle partitions, and 64 more hold the rows without id.  Only
    the range bounds come to the driver.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0]
    bounds = sorted(set(found or [0]))
    # a whole number of coarse steps keeps the last slice inside the table
    placed = docs.withColumn("range", _bucket(F.col("doc_id"), bounds))
    tops = placed.groupBy("range").agg(F.max(F.struct("doc_id", "code")).alias("top"))
    order = Window.orderBy(F.col("range").desc())
    everything = Window.partitionBy()
    tops = staged(tops.withColumn("host", F.coalesce(F.lag("range").over(order), F.min("range").over(everything))), "ranges")
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    seen = F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))
    first = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("code") == F.col("top.code"))
    targets = F.when(first, F.array(own, seen)).otherwise(F.array(own))
    return (placed.join(tops, "range").withColumn("_target", F.explode(targets))
            .select(*docs.columns, F.col("_target.range").alias("range"), F.col("_target.guest").alias("guest"))
            .repartition("range"))


def next_and_edited(docs: DataFrame, p: WinnowParams = WinnowParams()) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to each other and to the next text's.

    The last third of the code points gives way to as many of the next document's first (or all it has).  Null
    text is empty; equal ids follow each other in descending order of a hash of the text, then of the text; a table of one
    row is its own next.  Texts without pieces have an empty fingerprint, alike only to another empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("code", F.xxhash64("text"))
    rows = _with_selected(with_next(docs), "text", "selected", p)
    ahead = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("code").desc(),
                                                   F.col("text").desc())
    rows = (rows.withColumn("next_text", F.lead("text").over(ahead))
            .withColumn("next_selected", F.lead("selected").over(ahead)).where(~F.col("guest"))
            .withColumn("n_chars", F.char_length("text").cast("long"))
            .withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
            .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")),
                                           F.substring("next_text", F.lit(1), F.col("cut")))))
    rows = (_with_selected(rows, "edited", "edited_selected", p)
            .withColumn("own", _hashes(F.col("selected"))).withColumn("other", _hashes(F.col("edited_selected")))
            .withColumn("following", _hashes(F.col("next_selected"))))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       _printed(F.col("selected")).alias("fingerprint"),
                       _printed(F.col("edited_selected")).alias("edited_fingerprint"),
                       _likeness("own", "other").alias("near_edited"), _likeness("own", "following").alias("near_next"))
