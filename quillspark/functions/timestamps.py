"""Timestamps in many notations as one UTC instant (microseconds since 1970), all inside the JVM.

One regular expression is the alternation of every notation, with named groups. ``regexp_replace`` runs it once per
value and writes the groups as one separated string; everything after that is integer arithmetic on its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month names as timestamps write them.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Zone abbreviations and their offsets in minutes, by the prefix of the zone they are read in.
# "*" holds where the zone has no entry of its own.
ABBREVIATIONS = {
    "*": {
        "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60,
        "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
        "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "IST": 330,
        "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720,
        "NZDT": 780, "SAST": 120, "HKT": 480, "SGT": 480,
    },
    "Australia/": {"EST": 600, "EDT": 660, "CST": 570, "CDT": 630, "WST": 480},
    "Europe/Dublin": {"IST": 60},
    "Asia/Jerusalem": {"IST": 120, "IDT": 180},
    "Asia/Shanghai": {"CST": 480},
    "Asia/Taipei": {"CST": 480},
    "America/Havana": {"CST": -300, "CDT": -240},
    "Asia/Dhaka": {"BST": 360},
}

_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2})?)"
_MONTH = "(?:" + "|".join(MONTHS) + r")[a-z]*\.?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"

#: Every notation, tried in this order. Java wants each named group once, so each notation numbers its own.
FORMATS = [
    # 2018-01-03T12:27:52.599897Z, 2018-01-03 12:27+01, 2018-01-03, 2018-01-07 06:42:55 CEST
    rf"(?<y0>\d{{4}})-(?<m0>\d{{1,2}})-(?<d0>\d{{1,2}})(?:[T\s]+(?<h0>\d{{1,2}}):(?<i0>\d{{2}})(?::(?<s0>\d{{2}})(?:[.,](?<f0>\d{{1,9}}))?)?\s*(?<o0>{_OFFSET}|[A-Z]{{2,5}})?)?",
    # D:20180420195624+02'00', D:2018
    r"D:(?<y1>\d{4})(?:(?<m1>\d{2})(?:(?<d1>\d{2})(?:(?<h1>\d{2})(?:(?<i1>\d{2})(?:(?<s1>\d{2}))?)?)?)?)?(?<o1>Z(?:00'?(?:00'?)?)?|[+-]\d{2}'?(?:\d{2}'?)?)?",
    # 20180103T132445Z, 20180103091241
    rf"(?<y2>\d{{4}})(?<m2>\d{{2}})(?<d2>\d{{2}})T?(?<h2>\d{{2}})(?<i2>\d{{2}})(?<s2>\d{{2}})(?<o2>{_OFFSET})?",
    # 1514988385, 1515064182135, 1515064182135000
    r"(?<e3>-?\d{9,10}|-?\d{12,13}|-?\d{15,16})",
    # Wed, 03 Jan 2018 14:31:27 +0100; 13 July 2017 19:41:50
    rf"(?i:{_DAY}(?<d4>\d{{1,2}})\s+(?<n4>{_MONTH}),?\s+(?<y4>\d{{4}})(?:,?\s+(?<h4>\d{{1,2}}):(?<i4>\d{{2}})(?::(?<s4>\d{{2}}))?(?:\s*(?<p4>[AP]M))?\s*(?<o4>{_OFFSET}|[A-Z]{{2,5}})?)?)",
    # Sun Apr 15 03:12:55 2018, also with a zone before the year
    rf"(?i:{_DAY}(?<n5>{_MONTH})\s+(?<d5>\d{{1,2}})\s+(?<h5>\d{{1,2}}):(?<i5>\d{{2}}):(?<s5>\d{{2}})(?:\s+(?<o5>{_OFFSET}|[A-Z]{{2,5}}))?\s+(?<y5>\d{{4}}))",
    # Jan 12, 2018 04:37:57 AM
    rf"(?i:{_DAY}(?<n6>{_MONTH})\s+(?<d6>\d{{1,2}}),?\s+(?<y6>\d{{4}})(?:,?\s+(?<h6>\d{{1,2}}):(?<i6>\d{{2}})(?::(?<s6>\d{{2}}))?(?:\s*(?<p6>[AP]M))?\s*(?<o6>{_OFFSET}|[A-Z]{{2,5}})?)?)",
    # 03/01/2018 11:38, 11/04/2018 01:45 AM: day or month first, as the source writes it
    rf"(?i:(?<a7>\d{{1,2}})/(?<b7>\d{{1,2}})/(?<y7>\d{{4}})(?:,?\s+(?<h7>\d{{1,2}}):(?<i7>\d{{2}})(?::(?<s7>\d{{2}}))?(?:\s*(?<p7>[AP]M))?\s*(?<o7>{_OFFSET}|[A-Z]{{2,5}})?)?)",
    # 03.01.2018 10:44:43
    rf"(?<d8>\d{{1,2}})\.(?<m8>\d{{1,2}})\.(?<y8>\d{{4}})(?:,?\s+(?<h8>\d{{1,2}}):(?<i8>\d{{2}})(?::(?<s8>\d{{2}}))?\s*(?<o8>{_OFFSET}|[A-Z]{{2,5}})?)?",
]
PATTERN = r"^\s*(?:" + "|".join(FORMATS) + r")\s*$"
#: The parts, in the order the separated string holds them.
PARTS = ["y", "m", "d", "h", "i", "s", "f", "o", "e", "n", "p", "a", "b"]


def _template() -> str:
    out = []
    for p in PARTS:
        out.append("".join(f"${{{p}{k}}}" for k, pattern in enumerate(FORMATS) if f"(?<{p}{k}>" in pattern))
    return "\u0001".join(out)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, by integer arithmetic: years start in March, so the leap day is last."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    mp = (m + 9) % 12
    doy = F.floor((mp * 153 + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def _once(df: DataFrame) -> DataFrame:
    """``df`` behind a one-element generator: the optimizer neither merges the projections on its two sides nor pushes
    filters through, so what is computed below is computed once and no generated method outgrows the JVM's limit."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def _abbreviation(zone: Column, name: Column) -> Column:
    """Offset in minutes of an abbreviation read in a zone; null if it is unknown."""
    entries = {f"{prefix} {k}": v for prefix, table in ABBREVIATIONS.items() for k, v in table.items()}
    offsets = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.lit(v))])
    group = F.lit("*")
    for prefix in ABBREVIATIONS:
        if prefix != "*":
            group = F.when(zone.startswith(prefix), prefix).otherwise(group)
    return F.coalesce(offsets[F.concat_ws(" ", group, name)], offsets[F.concat(F.lit("* "), name)])


def with_instant(df: DataFrame, value: str, zone: str, slash_order: str, out: str = "instant_us") -> DataFrame:
    """``df`` with column ``out``: microseconds since 1970 UTC of the timestamp in column ``value``.

    ``zone`` and ``slash_order`` name columns with the time zone for values without one and ``dmy`` or ``mdy`` for
    slashed dates. The result is null for null, blank and unreadable values, for impossible calendar parts (month 13,
    30 February, hour 25), and for wall-clock values whose ``zone`` is null. A wall time that occurs twice is the first;
    one that is skipped moves forward by the gap. Slashed dates with a null order are read day first. Columns of
    ``df`` keep their names; working columns start with ``__ts_`` and are dropped.
    """
    raw = F.col(value)
    # the one run of the expression; a value that it doesn't match stays in one piece
    work = _once(df.withColumn("__ts_p", F.when(~raw.contains("\u0001"), F.split(F.regexp_replace(raw, PATTERN, _template()), "\u0001"))))
    work = work.withColumn("__ts_p", F.when(F.size("__ts_p") == len(PARTS), F.col("__ts_p")))
    part = {p: F.col("__ts_p")[k] for k, p in enumerate(PARTS)}

    def number(p: str) -> Column:
        return F.when(part[p] != "", part[p].cast("long"))

    name = F.substring(F.lower(part["n"]), 1, 3)
    by_name = F.create_map(*[x for k, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(k + 1))])[name]
    a, b = number("a"), number("b")
    month_first = F.coalesce(F.col(slash_order), F.lit("dmy")) == "mdy"
    month = F.coalesce(by_name.cast("long"), number("m"), F.when(month_first, a).otherwise(b), F.lit(1))
    day = F.coalesce(number("d"), F.when(month_first, b).otherwise(a), F.lit(1))
    half = F.upper(part["p"])
    hour = F.coalesce(number("h"), F.lit(0))
    work = work.select(
        *df.columns,
        number("y").alias("__ts_y"), month.alias("__ts_m"), day.alias("__ts_d"),
        F.when((half != "") & ((hour < 1) | (hour > 12)), None)
        .when(half == "PM", hour % 12 + 12).when(half == "AM", hour % 12).otherwise(hour).alias("__ts_h"),
        F.coalesce(number("i"), F.lit(0)).alias("__ts_i"), F.coalesce(number("s"), F.lit(0)).alias("__ts_s"),
        F.rpad(F.coalesce(part["f"], F.lit("")), 6, "0").cast("long").alias("__ts_f"),
        F.upper(part["o"]).alias("__ts_o"), part["e"].alias("__ts_e"),
    )
    work = _once(work)
    y, m, d, h, i, s = (F.col(f"__ts_{p}") for p in "ymdhis")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    # ISO allows 24:00:00 as the end of a day; a leap second 60 is the next minute's start.
    valid = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= length) & (i <= 59) & (s <= 60) & (
        (h <= 23) | ((h == 24) & (i == 0) & (s == 0) & (F.col("__ts_f") == 0)))
    wall = (((_days(y, m, d) * 24 + h) * 60 + i) * 60 + s) * 1000000 + F.col("__ts_f")
    work = work.withColumn("__ts_w", F.when(valid, wall)).withColumn("__ts_t", F.regexp_replace("__ts_o", "[:']", ""))
    work = _once(work)
    o, digits = F.col("__ts_o"), F.col("__ts_t")
    sign = F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1)
    minutes = F.when(digits.rlike("^[+-]"), sign * (F.substring(digits, 2, 2).cast("long") * 60 + F.coalesce(
        F.when(F.length(digits) >= 5, F.substring(digits, 4, 2).cast("long")), F.lit(0)))
    ).when(digits.rlike("^Z0*$"), F.lit(0)).otherwise(_abbreviation(F.col(zone), o))
    stated = F.when(F.abs(minutes) <= 18 * 60, F.col("__ts_w") - minutes * 60000000)
    epoch = F.col("__ts_e")
    seconds = F.length(F.regexp_replace(epoch, "-", ""))
    scale = F.when(seconds <= 10, 1000000).when(seconds <= 13, 1000).otherwise(1)
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("__ts_w")), F.col(zone)))
    instant = F.when(epoch != "", epoch.cast("long") * scale).when(o != "", stated).otherwise(
        F.when(F.col(zone).isNotNull(), local))
    return _once(work.select(*[F.col(f"`{c}`") for c in df.columns if c != out], instant.alias(out)))
