"""Opening hours: structured periods, weekday profile, text schedules and what they say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import flag, let

_GAP = r"[\s\p{Z}]*"  # blanks of any width, as the texts use narrow ones
SHIFT = (
    rf"(\d{{1,2}}):?(\d{{2}})?{_GAP}(AM|PM|am|pm)?{_GAP}[-\u2013\u2014]{_GAP}"
    rf"(\d{{1,2}}):?(\d{{2}})?{_GAP}(AM|PM|am|pm)?"
)


def _int(x: Column) -> Column:
    return x.cast("int")


# --- structured periods -------------------------------------------------------

def open_days(periods: Column) -> Column:
    """Sorted distinct opening days of array<struct<open<day..>, close<..>>>."""
    days = F.transform(F.filter(periods, lambda p: p["open"]["day"].isNotNull()), lambda p: p["open"]["day"])
    return F.coalesce(F.array_sort(F.array_distinct(days)), F.array().cast("array<int>"))


def closing_times(periods: Column) -> Column:
    """map<day, 'HH:MM'>; the last period of a day wins, a missing day is 0."""

    def closes(ps: Column) -> Column:
        entries = F.transform(
            F.filter(ps, lambda p: p["close"].isNotNull()),
            lambda p: F.struct(
                F.coalesce(p["close"]["day"], F.lit(0)).alias("day"),
                F.concat(
                    F.lpad(F.coalesce(p["close"]["hour"], F.lit(0)).cast("string"), 2, "0"),
                    F.lit(":"),
                    F.lpad(F.coalesce(p["close"]["minute"], F.lit(0)).cast("string"), 2, "0"),
                ).alias("at"),
            ),
        )
        return let(
            entries,
            lambda es: F.map_from_entries(
                F.transform(
                    F.array_distinct(F.transform(es, lambda e: e["day"])),
                    lambda d: F.struct(
                        d, F.element_at(F.filter(es, lambda e: e["day"] == d), -1)["at"]
                    ),
                )
            ),
        )

    return closes(F.coalesce(periods, F.array()))


def weekday_close(closing: Column) -> Column:
    """struct<early, hour>: upper median of the Monday to Friday closing hours."""
    hours = F.array_sort(
        F.filter(
            F.transform(
                F.sequence(F.lit(1), F.lit(5)),
                lambda d: F.split_part(F.try_element_at(closing, d), F.lit(":"), F.lit(1)).try_cast("int"),
            ),
            lambda h: h.isNotNull(),
        )
    )
    typical = let(hours, lambda h: F.try_element_at(h, F.floor(F.size(h) / 2).cast("int") + 1))
    return F.struct(flag((typical < 22) & (typical > 12)).alias("early"), typical.alias("hour"))


def day_profile(days: Column) -> Column:
    """struct<days_open_count, closed_weekends, closed_sunday, weekdays_only>; 0 is Sunday."""
    known = flag(F.size(days) > 0)
    sat, sun = F.array_contains(days, 6), F.array_contains(days, 0)
    weekend_off = known & flag(~sat & ~sun)
    within_week = flag(F.size(F.array_except(days, F.array(*[F.lit(d) for d in range(1, 6)]))) == 0)
    return F.struct(
        F.when(known, F.size(F.array_distinct(days))).alias("days_open_count"),
        weekend_off.alias("closed_weekends"),
        (known & flag(~sun & sat)).alias("closed_sunday"),
        (known & within_week).alias("weekdays_only"),
    )


# --- text schedules -----------------------------------------------------------

def _shift(o: Column, om: Column, c: Column, cm: Column) -> Column:
    """Opening and closing hour on a 24 h clock; past midnight counts on from 24."""
    noon_safe = F.when(o != 12, o + 12).otherwise(o)
    opens = (
        F.when(om == "PM", noon_safe)
        .when(om == "AM", F.when(o == 12, F.lit(0)).otherwise(o))
        .when(cm == "PM", noon_safe)
        .when(cm == "AM", F.when(o >= 6, o + 12).otherwise(o))
        .otherwise(o)
    )
    closes = (
        F.when((cm == "PM") & (c != 12), c + 12).when((cm == "AM") & (c == 12), F.lit(0)).otherwise(c)
    )
    return let(
        F.struct(opens.alias("o"), closes.alias("c")),
        lambda s: F.struct(
            s["o"].alias("o"), F.when(s["c"] < s["o"], s["c"] + 24).otherwise(s["c"]).alias("c")
        ),
    )


def day_shifts(text: Column) -> Column:
    """array<struct<o, c>> of one day's text."""
    def parts(t: Column) -> Column:
        groups = [F.regexp_extract_all(t, F.lit(SHIFT), F.lit(g)) for g in (1, 3, 4, 6)]
        return F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("o", "om", "c", "cm"))])

    return F.transform(
        let(text, parts),
        lambda p: _shift(_int(p["o"]), F.upper(p["om"]), _int(p["c"]), F.upper(p["cm"])),
    )


def _day(shifts: Column) -> Column:
    latest = F.array_max(F.transform(shifts, lambda s: s["c"]))
    first, second = F.try_element_at(shifts, F.lit(1)), F.try_element_at(shifts, F.lit(2))
    return F.struct(
        F.aggregate(shifts, F.lit(0), lambda acc, s: acc + F.greatest(F.lit(0), s["c"] - s["o"])).alias("hours"),
        latest.alias("latest"),
        flag(first["c"].between(13, 16) & second["o"].between(17, 20)).alias("split"),
    )


def schedule(hours: Column) -> Column:
    """Summary of seven day texts; null hours give ``parsed`` = false."""
    days = F.transform(
        F.filter(hours, lambda t: t.isNotNull() & ~t.contains("Closed") & ~t.contains("closed")),
        lambda t: let(day_shifts(t), _day),
    )

    def count(ds: Column, cond) -> Column:
        return F.size(F.filter(ds, lambda d: flag(cond(d))))

    def summary(ds: Column) -> Column:
        n_open = F.size(ds)
        last = F.array_max(
            F.transform(ds, lambda d: F.when(d["latest"] > 24, d["latest"] - 24).otherwise(d["latest"]))
        )
        return F.struct(
            n_open.alias("days_open"),
            F.aggregate(ds, F.lit(0), lambda acc, d: acc + d["hours"]).alias("total_hours_per_week"),
            F.coalesce(last, F.lit(0)).alias("latest_close_hour"),
            (count(ds, lambda d: d["split"]) >= 3).alias("has_split_service"),
            (count(ds, lambda d: d["latest"] >= 25) >= 3).alias("closes_late"),
            ((count(ds, lambda d: d["latest"] <= 17) >= 4) & (n_open >= 4)).alias("is_lunch_only"),
            F.lit(True).alias("parsed"),
        )

    nothing = F.struct(
        F.lit(0).alias("days_open"),
        F.lit(0).alias("total_hours_per_week"),
        F.lit(0).alias("latest_close_hour"),
        F.lit(False).alias("has_split_service"),
        F.lit(False).alias("closes_late"),
        F.lit(False).alias("is_lunch_only"),
        F.lit(False).alias("parsed"),
    )
    return F.when(hours.isNull(), nothing).otherwise(let(days, summary))


def rhythm_bonus(rating: Column, summary: Column) -> Column:
    """struct<score, kind>: short or split weeks ('lark') and late nights ('owl')."""

    def both(s: Column) -> Column:
        week = s["total_hours_per_week"]
        lark = (
            F.when(s["has_split_service"], 1.0)
            .when((week > 0) & (week < 30), 0.8)
            .when(s["is_lunch_only"], 0.7)
            .when(s["days_open"].between(1, 4), 0.6)
            .otherwise(0.0)
        )
        return F.struct(lark.alias("lark"), F.when(s["closes_late"], 0.8).otherwise(0.0).alias("owl"))

    def better(b: Column) -> Column:
        kind = F.when((b["lark"] > 0) & (b["lark"] >= b["owl"]), "lark").when(b["owl"] > 0, "owl")
        return F.struct(F.greatest(b["lark"], b["owl"]).alias("score"), kind.cast("string").alias("kind"))

    # schedules of venues below the rating bar are never parsed
    none = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("kind"))
    return F.when(flag(rating >= 4.0), let(let(summary, both), better)).otherwise(none)


def open_on(hours: Column, day: str) -> Column:
    """Unknown hours count as open; a schedule that does not name the day counts as closed."""
    entry = F.try_element_at(F.filter(hours, lambda h: h.startswith(day)), F.lit(1))
    return (
        F.when(hours.isNull() | (F.size(hours) == 0), F.lit(True))
        .when(entry.isNull(), F.lit(False))
        .otherwise(~entry.contains("Closed"))
    )
