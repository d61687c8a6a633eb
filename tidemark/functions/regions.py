"""State names, codes and the regional grouping."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

# State name, two-digit state code, region.
STATES = [
    ("ALABAMA", "01", "Mississippi basin"),
    ("ALASKA", "02", "Pacific Northwest"),
    ("ARIZONA", "04", "Great Basin/Southwest"),
    ("ARKANSAS", "05", "Mississippi basin"),
    ("CALIFORNIA", "06", "California"),
    ("COLORADO", "08", "Colorado River basin"),
    ("CONNECTICUT", "09", "Northeast/Mid-Atlantic"),
    ("DELAWARE", "10", "Northeast/Mid-Atlantic"),
    ("DISTRICT OF COLUMBIA", "11", "Northeast/Mid-Atlantic"),
    ("FLORIDA", "12", "Gulf Coast/Southeast"),
    ("GEORGIA", "13", "Gulf Coast/Southeast"),
    ("HAWAII", "15", "Pacific Northwest"),
    ("IDAHO", "16", "Pacific Northwest"),
    ("ILLINOIS", "17", "Upper Midwest/Missouri"),
    ("INDIANA", "18", "Mississippi basin"),
    ("IOWA", "19", "Upper Midwest/Missouri"),
    ("KANSAS", "20", "Upper Midwest/Missouri"),
    ("KENTUCKY", "21", "Mississippi basin"),
    ("LOUISIANA", "22", "Mississippi basin"),
    ("MAINE", "23", "Northeast/Mid-Atlantic"),
    ("MARYLAND", "24", "Northeast/Mid-Atlantic"),
    ("MASSACHUSETTS", "25", "Northeast/Mid-Atlantic"),
    ("MICHIGAN", "26", None),
    ("MINNESOTA", "27", "Upper Midwest/Missouri"),
    ("MISSISSIPPI", "28", "Mississippi basin"),
    ("MISSOURI", "29", "Upper Midwest/Missouri"),
    ("MONTANA", "30", "Upper Midwest/Missouri"),
    ("NEBRASKA", "31", "Upper Midwest/Missouri"),
    ("NEVADA", "32", "Great Basin/Southwest"),
    ("NEW HAMPSHIRE", "33", "Northeast/Mid-Atlantic"),
    ("NEW JERSEY", "34", "Northeast/Mid-Atlantic"),
    ("NEW MEXICO", "35", "Great Basin/Southwest"),
    ("NEW YORK", "36", "Northeast/Mid-Atlantic"),
    ("NORTH CAROLINA", "37", "Gulf Coast/Southeast"),
    ("NORTH DAKOTA", "38", "Upper Midwest/Missouri"),
    ("OHIO", "39", "Mississippi basin"),
    ("OKLAHOMA", "40", None),
    ("OREGON", "41", "Pacific Northwest"),
    ("PENNSYLVANIA", "42", "Northeast/Mid-Atlantic"),
    ("RHODE ISLAND", "44", "Northeast/Mid-Atlantic"),
    ("SOUTH CAROLINA", "45", "Gulf Coast/Southeast"),
    ("SOUTH DAKOTA", "46", "Upper Midwest/Missouri"),
    ("TENNESSEE", "47", "Mississippi basin"),
    ("TEXAS", "48", None),
    ("UTAH", "49", "Great Basin/Southwest"),
    ("VERMONT", "50", "Northeast/Mid-Atlantic"),
    ("VIRGINIA", "51", "Gulf Coast/Southeast"),
    ("WASHINGTON", "53", "Pacific Northwest"),
    ("WEST VIRGINIA", "54", "Gulf Coast/Southeast"),
    ("WISCONSIN", "55", "Upper Midwest/Missouri"),
    ("WYOMING", "56", "Colorado River basin"),
]


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Map literal lookup; the table above is fixed, so no join is needed."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, key)


def region_of(state_name: Column, state_code: Column, curated: Column | None = None) -> Column:
    """Curated region, else by state name, else by state code, else 'Unknown'."""
    by_name = {name: region for name, _, region in STATES if region}
    by_code = {code: region for _, code, region in STATES if region}
    derived = F.coalesce(
        _lookup(by_name, F.upper(F.trim(state_name))), _lookup(by_code, state_code), F.lit(UNKNOWN)
    )
    if curated is None:
        return derived
    return F.coalesce(F.when(curated != "", curated), derived)
