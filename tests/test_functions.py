from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import calendar, classify, regions, scores, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def add_years(d, n):
    try:
        return d.replace(year=d.year + n)
    except ValueError:
        return d.replace(year=d.year + n, day=28)


def chunks(start, end, years):
    out = []
    while start <= end:
        stop = min(add_years(start, years) - timedelta(days=1), end)
        out.append((start, stop))
        start = stop + timedelta(days=1)
    return out


@pytest.mark.parametrize("start,end,years", [
    ("2004-02-29", "2026-08-01", 5), ("2004-01-01", "2004-12-31", 1), ("2004-02-29", "2012-02-28", 4),
    ("2010-05-05", "2010-05-05", 3), ("2010-05-05", "2010-05-04", 3), ("2000-01-31", "2009-01-30", 3),
])
def test_year_chunks(spark, start, end, years):
    df = spark.createDataFrame([(date.fromisoformat(start), date.fromisoformat(end))], "a date, b date")
    got = [(r.chunk_start, r.chunk_end) for r in
           calendar.year_chunks(df, "a", "b", years).orderBy("chunk_start").collect()]
    assert got == chunks(date.fromisoformat(start), date.fromisoformat(end), years)


def test_calendar(spark):
    day = lambda s: F.lit(date.fromisoformat(s))
    r = one(
        spark,
        back=calendar.circular_doy(F.lit(1), -7), over=calendar.circular_doy(F.lit(366), 7),
        carry=calendar.shift_period(F.lit("2019-12"), 1),
        down=calendar.shift_period(F.lit("2020-02"), -14),
        leap=calendar.plus_years(day("2020-02-29"), 1), same=calendar.plus_years(day("2021-02-28"), 1),
        last=calendar.doy_month(F.lit(366)), feb=calendar.doy_month(F.lit(59)),
        first=calendar.lookback_start(F.lit("1m"), day("2020-03-01"), date(2004, 1, 1)),
        every=calendar.lookback_start(F.lit("all"), day("2020-03-01"), date(2004, 1, 1)),
        month=calendar.span_name(day("2020-01-01"), day("2020-02-01")),
        quarter=calendar.span_name(day("2020-01-01"), day("2020-02-02")),
        long=calendar.span_name(day("2010-01-01"), day("2020-02-02")))
    assert (r.back, r.over) == (360, 7)
    assert (r.carry, r.down) == ("2020-01", "2018-12")
    assert (r.leap, r.same) == (date(2021, 2, 28), date(2022, 2, 28))
    assert (r.last, r.feb) == (1, 2)
    assert (r["first"], r.every) == (date(2020, 2, 1), date(2004, 1, 1))
    assert (r.month, r.quarter, r.long) == ("1m", "3m", "all")


def test_classes(spark):
    zs = [-2.0, -1.9, -1.5, -1.4, 1.5, 2.0, 3.0, 74.0, None]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    assert [r[0] for r in df.select(classify.z_code(F.col("z"))).collect()] == [
        0, 1, 1, 2, 3, 4, 5, 5, 6]
    assert one(spark, c=classify.z_code(F.lit(1.0), F.lit(None).cast("string"))).c == 7
    cases = {
        classify.flashiness_class: [(0.05, "Low"), (0.1, "Moderate"), (0.3, "High"),
                                    (0.6, "Very High"), (None, None)],
        classify.proximity_class: [(24.9, "far"), (25.0, "typical"), (75.0, "near"),
                                   (95.0, "at record"), (None, None)],
        classify.rho_class: [(-0.66, "strong"), (0.58, "mid"), (0.1, "weak"), (None, None)],
    }
    for rule, pairs in cases.items():
        for value, label in pairs:
            assert one(spark, c=rule(F.lit(value).cast("double"))).c == label
    assert one(spark, c=classify.rho_size(F.lit(-0.75))).c == 14.0
    r = one(spark, yes=classify.verified_year(F.lit(2004)), no=classify.verified_year(F.lit(2005)),
            high=classify.above(F.lit(3.0), F.lit(3.0)),
            unknown=classify.above(F.lit(3.0), F.lit(None).cast("double")))
    assert (r.yes, r.no, r.high, r.unknown) == (2004, None, True, False)


def test_scores(spark):
    z = lambda s: scores.z_score(F.lit(5.0), F.lit(3.0), F.lit(s).cast("double"))
    r = one(spark, z=z(2.0), zero=z(0.0), none=z(None),
            both=scores.moves_together(F.lit(1.0), F.lit(2.0)),
            flat=scores.moves_together(F.lit(0.0), F.lit(0.0)),
            unknown=scores.moves_together(F.lit(1.0), F.lit(None).cast("double")))
    assert (r.z, r.zero, r.none) == (1.0, None, None)
    assert (r.both, r.flat, r.unknown) == (True, False, False)


def test_text(spark):
    r = one(
        spark,
        a=text.site_id(F.lit(" 01467087 ")), b=text.site_id(F.lit("usgs-01467087")),
        short=text.ellipsis(F.lit("x" * 30)), long=text.ellipsis(F.lit("a" * 28 + "  bcd")),
        empty=text.no_null_list(F.lit(None).cast("array<string>"), StringType()),
        some=text.no_null_list(F.array(F.lit("e"), F.lit(None)), StringType()),
        json=text.payload_json(F.struct(F.lit(1).alias("k"), F.lit(None).cast("string").alias("n"))),
        field=text.payload_field(F.lit('{"k": 5}'), "$.k"),
        bad=text.payload_field(F.lit("not json"), "$.k"))
    assert r.a == r.b == "USGS-01467087"
    assert r.short == "x" * 30 and r.long == "a" * 28 + "…"
    assert r.empty == [] and r.some == ["e"]
    assert r.json == '{"k":1,"n":null}' and r.field == "5" and r.bad is None


def test_regions(spark):
    rows = [("Oregon", None, None, "Pacific Northwest"), (" new york ", "06", None, "Northeast/Mid-Atlantic"),
            ("Nowhere", "06", None, "California"), ("Texas", "48", None, "Unknown"),
            (None, None, "", "Unknown"), ("Oregon", None, "Curated", "Curated")]
    df = spark.createDataFrame([r[:3] for r in rows], "name string, code string, curated string")
    got = df.select(regions.region_of(F.col("name"), F.col("code"), F.col("curated"))).collect()
    assert [r[0] for r in got] == [r[3] for r in rows]
    assert len(regions.STATES) == 51
    assert {name for name, _, region in regions.STATES if not region} == {"MICHIGAN", "OKLAHOMA", "TEXAS"}
    by_code = {code: region for _, code, region in regions.STATES}
    assert by_code["06"] == "California" and by_code["41"] == by_code["53"] == "Pacific Northwest"
    assert by_code["08"] == "Colorado River basin" and by_code["51"] == "Gulf Coast/Southeast"
