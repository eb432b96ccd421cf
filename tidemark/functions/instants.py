"""Time stamps of many formats as arrays of possible UTC instants."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
THREE_HOURS = 3 * 3600 * 1_000_000
_CLOCK = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?"
_ZONE = r"\s*(Z|z|UTC|GMT|[+-]\d{2}(?::?\d{2})?|\[?[A-Za-z]+(?:/[A-Za-z_0-9+-]+)+\]?)?$"
#: pattern, order of year|month|day|hour|minute|second|fraction|am-pm|zone
FORMATS = [
    (rf"^(\d{{4}})([-/])(\d{{1,2}})\2(\d{{1,2}})(?:T|\s+){_CLOCK}{_ZONE}", "$1|$3|$4|$5|$6|$7|$8||$9"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})\s+{_CLOCK}{_ZONE}", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日\s*(\d{{1,2}})时(\d{{1,2}})分(\d{{1,2}})秒(){_ZONE}", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{4}})\s+{_CLOCK}{_ZONE}", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),\s*(\d{{4}})\s+{_CLOCK}\s*([AaPp][Mm])?{_ZONE}", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    (rf"^(\d{{1,2}})-(\d{{1,2}})\s+{_CLOCK}{_ZONE}", "|$1|$2|$3|$4|$5|$6||$7"),
    (rf"^(\d{{2}})(\d{{2}})\s+{_CLOCK}{_ZONE}", "|$1|$2|$3|$4|$5|$6||$7"),
    (rf"^([A-Za-z]{{3}})[a-z]*\s+(\d{{1,2}})\s+{_CLOCK}{_ZONE}", "|$1|$2|$3|$4|$5|$6||$7"),
    # day or month first: only other records of the source can tell
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+{_CLOCK}{_ZONE}", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s+{_CLOCK}{_ZONE}", "$3|$1|$2|$4|$5|$6|$7||$8"),
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: a stamp without year is looked for in this many years (29 February may need eight)
YEARS_BACK = 8


def known_zones() -> list[str]:
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT"))


def _micros(ntz: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ntz)


def _to_utc(ntz: Column, zone: Column) -> Column:
    """Instant of a local time: the earlier of two, and in a skipped hour by the offset before the change."""
    return _micros(F.convert_timezone(zone, F.lit("UTC"), ntz))


def _to_local(us: Column, zone: Column) -> Column:
    ntz = F.timestamp_add("MICROSECOND", us, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
    return _micros(F.convert_timezone(F.lit("UTC"), zone, ntz))


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def stamp_parts(text: Column) -> Column:
    """year|month|day|hour|minute|second|fraction|am-pm|zone as an array of nine texts; null for no known layout."""
    out = None
    for pattern, order in FORMATS:
        hit = F.when if out is None else out.when
        out = hit(text.rlike(pattern), F.regexp_replace(text, pattern, order))
    return F.split(out, r"\|")


def stamp_readings(text: Column) -> Column:
    """Every layout that a stamp can be read by: array<struct<format int, parts array<string>>> with the parts of stamp_parts."""
    ways = [F.when(text.rlike(p), F.struct(F.lit(i).alias("format"), F.split(F.regexp_replace(text, p, order), r"\|").alias("parts"))) for i, (p, order) in enumerate(FORMATS)]
    return F.filter(F.array(*ways), lambda x: x.isNotNull())


def epoch_instant(text: Column) -> Column:
    """Pure digits as seconds (to 11 digits), milliseconds (12 to 14) or microseconds (15 to 17); seconds may have a fraction."""
    whole = F.regexp_extract(text, r"^(\d+)(?:\.(\d+))?$", 1)
    part = F.regexp_extract(text, r"^(\d+)(?:\.(\d+))?$", 2)
    n = F.length(whole)
    value = whole.try_cast("bigint")
    micros = F.substring(F.rpad(part, 6, "0"), 1, 6).try_cast("bigint")
    return (
        F.when((n >= 1) & (n <= 11), value * 1_000_000 + F.coalesce(micros, F.lit(0)))
        .when(part != "", None)
        .when((n >= 12) & (n <= 14), value * 1000)
        .when((n >= 15) & (n <= 17), value)
    )


def with_interpretations(df: DataFrame, raw: str | Column, zone: str, collected: str, out: str = "instants") -> DataFrame:
    """Adds the possible instants of a stamp: array<struct<early, late>> in microseconds, most recent year first.

    raw is the stamp, read by the first layout that fits, or one of its readings' parts.

    early and late differ where a local time occurs twice. zone is that of a stamp without offset or zone, collected the
    instant (timestamp) that a stamp without year is bound by. A stamp that is no valid date and time gives an empty
    array, as does null. Each step is a projection of its own, so that no part is evaluated twice.
    """
    zones = known_zones()
    parts, printed = F.col("_tm_parts"), F.col("_tm_printed")
    month = F.lower(parts[1])
    number = month.try_cast("int")
    for i, name in enumerate(MONTHS, 1):
        number = F.when(month == name, i).otherwise(number)
    clock = printed.rlike(r"^[+-]\d{2}(:?\d{2})?$")
    hours = F.substring(printed, 2, 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(printed, r"^[+-]\d{2}:?(\d{2})$", 1).try_cast("int"), F.lit(0))
    sign = F.when(F.substring(printed, 1, 1) == "-", -1).otherwise(1)
    hour, half, second = parts[3].try_cast("int"), F.upper(parts[7]), parts[5].try_cast("int")
    in_day = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    fields = {
        "year": F.when(parts[0] != "", parts[0].try_cast("int")),
        "no_year": parts[0] == "",
        "month": number,
        "day": parts[2].try_cast("int"),
        "hour": in_day,
        "minute": parts[4].try_cast("int"),
        "second": (
            F.when(second < 60, second)
            + F.coalesce(F.substring(F.rpad(parts[6], 6, "0"), 1, 6).try_cast("int"), F.lit(0)).cast("decimal(16,6)") / 1_000_000
        ).cast("decimal(16,6)"),
        "offset": F.when(printed.isin("Z", "z", "UTC", "GMT"), 0).when(
            clock & (hours <= 18) & (minutes < 60), sign * (hours * 3600 + minutes * 60)
        ).cast("bigint") * 1_000_000,
        "zone": F.when(printed == "", F.when(F.col(zone).isin(zones), F.col(zone))).when(printed.isin(zones), printed),
        "collected": F.unix_micros(F.col(collected)),
        "collected_year": F.year(F.col(collected)),
    }
    # columns, not a struct: the optimiser would inline a struct's fields into the lambdas
    s = {name: F.col(f"_tm_{name}") for name in fields}
    back = F.sequence(s["collected_year"] + 1, s["collected_year"] - YEARS_BACK, F.lit(-1))
    years = F.when(s["no_year"], F.when(s["collected"].isNotNull(), back)).when(s["year"] >= 1, F.array(s["year"]))

    def local(year: Column) -> Column:
        return F.try_make_timestamp_ntz(year, s["month"], s["day"], s["hour"], s["minute"], s["second"])

    def early(x: Column) -> Column:
        by_offset = _micros(x) - s["offset"]
        return F.struct(_micros(x).alias("wall"), F.when(s["offset"].isNotNull(), by_offset).otherwise(_to_utc(x, s["zone"])).alias("early"))

    def late(x: Column) -> Column:
        # by the offset that holds three hours on: after a change that repeats an hour, this is the later instant
        ahead = x["early"] + THREE_HOURS
        return F.struct(
            x["wall"].alias("wall"),
            x["early"].alias("early"),
            F.when(s["offset"].isNull(), x["wall"] - (_to_local(ahead, s["zone"]) - ahead)).alias("late"),
        )

    def both(x: Column) -> Column:
        twice = (x["late"] > x["early"]) & (_to_local(x["late"], s["zone"]) == x["wall"])
        return F.struct(x["early"].alias("early"), F.when(twice, x["late"]).otherwise(x["early"]).alias("late"))

    bound = lambda x: x["early"].isNotNull() & (~s["no_year"] | (x["early"] <= s["collected"] + DAY_US))
    none = F.array().cast("array<struct<early:bigint,late:bigint>>")
    return (
        df.withColumn("_tm_parts", stamp_parts(F.col(raw)) if isinstance(raw, str) else raw)
        .withColumn("_tm_printed", F.regexp_replace(F.col("_tm_parts")[8], r"[\[\]]", ""))
        .withColumns({f"_tm_{name}": field for name, field in fields.items()})
        .withColumn("_tm_dates", F.transform(years, local))
        .withColumn("_tm_dates", F.filter(F.transform("_tm_dates", early), bound))
        .withColumn("_tm_dates", F.transform("_tm_dates", late))
        .withColumn(out, F.coalesce(F.transform("_tm_dates", both), none))
        .drop("_tm_parts", "_tm_printed", "_tm_dates", *[f"_tm_{name}" for name in fields])
    )
