"""Date column expressions.  Dates travel as ``YYYY-MM-DD`` strings; instants are
rendered in UTC (the session time zone is pinned by :mod:`tidepool.session`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool import contracts as C
from tidepool.functions.text import let, py_strip

# RFC 2822 forms after the optional weekday is removed (pattern letter E is
# refused when parsing, so the weekday is stripped first).
_RFC2822_PATTERNS = (
    "d MMM yyyy H:mm:ss Z",
    "d MMM yyyy H:mm:ss z",
    "d MMM yyyy H:mm Z",
    "d MMM yyyy H:mm z",
)


def _fmt(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def parse_pub_date(pub: Column, run_date: str = C.RUN_DATE) -> Column:
    """Feed date → UTC ``YYYY-MM-DD``; the run date where :func:`pub_date` finds none."""
    return F.coalesce(pub_date(pub, run_date), F.lit(run_date))


def pub_date(pub: Column, run_date: str = C.RUN_DATE) -> Column:
    """Feed date → UTC ``YYYY-MM-DD``, or null where nothing fits.

    Order: RFC 2822 and what feeds make of it (short or full names of days and
    months, two-digit years, ``Month d, yyyy``, no time, no zone: midnight,
    UTC), then ISO 8601 / plain dates, then free forms (:func:`free_form_date`).
    """
    s = py_strip(F.coalesce(pub, F.lit("")))

    def parsed(text: Column) -> Column:
        rfc = F.coalesce(*[F.try_to_timestamp(_rfc_shape(text), F.lit(p)) for p in _RFC2822_PATTERNS])
        return F.coalesce(_fmt(F.coalesce(rfc, text.try_cast("timestamp"))), free_form_date(text, run_date))

    return let(s, lambda text: F.when(text != "", parsed(text)))


# Names of months and days, and hours from UTC of the zone names feeds use.
_MONTHS = ("jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?")
_DAYS = "mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:r(?:s(?:day)?)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
_ZONES = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}

_CLOCK = r"(?:^|(?<=[\s,t]))(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*([ap])\.?m\b\.?)?"
_HOUR = r"\b(\d{1,2})()()\s*([ap])\.?m\b\.?"
_OFFSET = r"@\s*(?:utc|gmt)?\s*([+-])(\d{2}):?(\d{2})\b"


def free_form_date(text: Column, run_date: str = C.RUN_DATE) -> Column:
    """A date written in words or numbers, in any order, → UTC ``YYYY-MM-DD``; null where words remain that mean nothing here.

    Tokens: a clock time (12 or 24 hours), a zone (offset or name), a day's name, a month's
    name, ordinals, ``at``, ``on``, ``of`` and ``and``; the numbers left over are
    day and year, or without a month's name year-month-day, month-day-year, or
    day-month-year where the first cannot be a month.  What is missing comes
    from the run date; a day past its month's end is the month's last.
    """
    run_year, _, run_day = (int(x) for x in run_date.split("-"))
    month_name = rf"\b(?:{'|'.join(_MONTHS)})\b\.?"

    def tokens(s: Column) -> Column:
        clock = F.when(s.rlike(_CLOCK), F.lit(_CLOCK)).when(s.rlike(_HOUR), F.lit(_HOUR))
        part = lambda k: F.when(s.rlike(_CLOCK), F.regexp_extract(s, _CLOCK, k)).otherwise(F.regexp_extract(s, _HOUR, k))
        timed = F.when(clock.isNotNull(), F.regexp_replace(s, clock, F.lit(" @ "))).otherwise(s)
        return F.struct(timed.alias("rest"), *[part(k + 1).alias(n) for k, n in enumerate(("hour", "minute", "second", "half"))])

    def placed(t: Column) -> Column:
        rest = t["rest"]
        zone = F.regexp_extract(rest, rf"@\s*\b({'|'.join(_ZONES)})\b", 1)
        hours = F.create_map(*[F.lit(x) for kv in _ZONES.items() for x in kv])
        named = F.coalesce(F.try_element_at(hours, zone), F.lit(0)) * 3600
        sign = F.regexp_extract(rest, _OFFSET, 1)
        minutes = F.regexp_extract(rest, _OFFSET, 2).try_cast("int") * 60 + F.regexp_extract(rest, _OFFSET, 3).try_cast("int")
        offset = F.when(sign == "", named).otherwise(F.when(sign == "-", -minutes).otherwise(minutes) * 60)
        starts = F.array(*[F.lit(m[:3]) for m in _MONTHS])
        month = F.nullif(F.array_position(starts, F.substring(F.regexp_extract(rest, month_name, 0), 1, 3)).cast("int"), F.lit(0))
        left = F.regexp_replace(rest, _OFFSET, " ")
        left = F.regexp_replace(left, rf"@\s*\b(?:{'|'.join(_ZONES)})\b|\([^)]*\)|@", " ")
        left = F.regexp_replace(left, month_name, " ")
        left = F.regexp_replace(left, rf"\b(?:{_DAYS})\b\.?|\b(?:at|on|of|and)\b", " ")
        left = F.regexp_replace(left, r"(?<=\d)(?:st|nd|rd|th)\b|(?<=\d)t(?=\s|$)", " ")
        numbers = F.regexp_extract_all(left, F.lit(r"\d+"), F.lit(0))
        clean = ~left.rlike(r"[^\d\s,./'-]") & (F.size(numbers) <= 3)
        hour = F.coalesce(t["hour"].try_cast("int"), F.lit(0))
        hour = F.when(t["half"] == "p", hour % 12 + 12).when(t["half"] == "a", hour % 12).otherwise(hour)
        clock = hour * 3600 + F.coalesce(t["minute"].try_cast("int"), F.lit(0)) * 60 + F.coalesce(t["second"].try_cast("int"), F.lit(0))
        return F.struct(F.when(clean, numbers).alias("n"), month.alias("month"), (clock - offset).alias("seconds"))

    def dated(p: Column) -> Column:
        num = lambda i: F.get(p["n"], i).try_cast("int")
        is_year = lambda i: (F.length(F.get(p["n"], i)) == 4) | (num(i) > 31)
        count, month = F.size(p["n"]), p["month"]
        ymd = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
        year, none = F.lit(run_year), F.lit(None).cast("int")
        worded = (F.when((count == 2) & is_year(0), ymd(num(0), month, num(1))).when(count == 2, ymd(num(1), month, num(0)))
                  .when((count == 1) & is_year(0), ymd(num(0), month, none)).when(count == 1, ymd(year, month, num(0)))
                  .when(count == 0, ymd(year, month, none)))
        whole = F.get(p["n"], 0)
        at = lambda i, k: F.substring(whole, i, k).try_cast("int")
        swapped = lambda y, a, b: F.when(a > 12, ymd(y, b, a)).otherwise(ymd(y, a, b))
        numeric = (F.when((count == 3) & is_year(0), swapped(num(0), num(1), num(2))).when(count == 3, swapped(num(2), num(0), num(1)))
                   .when((count == 2) & is_year(0), ymd(num(0), num(1), none)).when((count == 2) & is_year(1), ymd(num(1), num(0), none))
                   .when(count == 2, swapped(year, num(0), num(1)))
                   .when((count == 1) & F.length(whole).isin(8, 14), ymd(at(1, 4), at(5, 2), at(7, 2))))
        return F.struct(F.when(month.isNotNull(), worded).otherwise(numeric).alias("f"), p["seconds"].alias("seconds"))

    def rendered(x: Column) -> Column:
        y = x["f"]["y"]
        full = F.when(y >= 100, y).when(y + 2000 < run_year + 50, y + 2000).otherwise(y + 1900)
        first = F.try_make_timestamp(full, x["f"]["m"], F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        day = F.coalesce(x["f"]["d"], F.least(F.lit(run_day), F.day(F.last_day(first))))
        start = F.try_make_timestamp(full, x["f"]["m"], day, F.lit(0), F.lit(0), F.lit(0))
        return F.when((x["seconds"] >= -86_400) & (x["seconds"] < 172_800), _fmt(F.timestamp_seconds(F.unix_seconds(start) + x["seconds"])))

    return let(F.lower(text), lambda s: let(tokens(s), lambda t: let(placed(t), lambda p: let(dated(p), rendered))))


def _rfc_shape(s: Column) -> Column:
    """Free forms of a date written as ``d Mon yyyy HH:mm[:ss] zone``; others unchanged."""
    t = F.regexp_replace(s, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    t = F.regexp_replace(t, r"^([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})", "$2 $1 $3")
    t = F.regexp_replace(t, r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?[ -](\d{2,4})\b", "$1 $2 $3")
    t = F.regexp_replace(t, r"^(\d{1,2} [A-Za-z]{3}) ([0-6]\d)(?=\s|$)", "$1 20$2")
    t = F.regexp_replace(t, r"^(\d{1,2} [A-Za-z]{3}) ([7-9]\d)(?=\s|$)", "$1 19$2")
    t = F.regexp_replace(t, r"^(\d{1,2} [A-Za-z]{3} \d{4}),?$", "$1 00:00:00 GMT")
    t = F.regexp_replace(t, r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}(?::\d{2})?)$", "$1 GMT")
    return F.concat(F.substring(t, 1, F.instr(t, " ")), F.initcap(F.substring(t, F.instr(t, " ") + 1, F.lit(3))),
                    F.substring(t, F.instr(t, " ") + 4, F.length(t)))


def utc_date(ts: Column) -> Column:
    return _fmt(ts)


def yyyymmdd_to_iso(c: Column, run_date: str = C.RUN_DATE) -> Column:
    """8-char value → ``YYYY-MM-DD``; other lengths unchanged; empty → run date."""
    v = F.coalesce(c, F.lit(""))
    iso = F.when(F.char_length(v) == 8,
                 F.concat(F.substring(v, 1, 4), F.lit("-"), F.substring(v, 5, 2), F.lit("-"),
                          F.substring(v, 7, 2))).otherwise(v)
    return F.coalesce(F.nullif(iso, F.lit("")), F.lit(run_date))


def strip_date_prefix(file_stem: Column) -> Column:
    """Remove one leading ``YYYY-MM-DD - `` from a file name stem."""
    return F.regexp_replace(file_stem, r"^\d{4}-\d{2}-\d{2} - ", "")


def file_stem(file_name: Column) -> Column:
    """File name without its ``.md`` suffix and date prefix."""
    return strip_date_prefix(F.regexp_replace(file_name, r"\.md$", ""))


def published_month(published: Column) -> Column:
    """``YYYY-MM`` partition value; rows without a date share '__none__'."""
    p = F.coalesce(published, F.lit(""))
    return F.when(p.rlike(r"^\d{4}-\d{2}"), F.substring(p, 1, 7)).otherwise(F.lit("__none__"))
