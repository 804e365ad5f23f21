"""RFC 5322 dates. A zone is never invented: without one the instant is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailstrata import rules
from mailstrata.functions.common import SPACE, let

_MONTH = "(?:" + "|".join(f"{m}|{m[:3]}" for m in rules.MONTHS) + ")"
_WEEKDAY = "(?:" + "|".join(rules.WEEKDAYS) + ")"
_MONTH_INDEX = "".join(m[:3] for m in rules.MONTHS)

# Rewrites that bring the tolerated field orders to "day month year time zone". Each is anchored and
# leaves other text alone.
_REWRITES = (
    # weekday, with or without comma
    (rf"(?i)^(?:\S*, |{_WEEKDAY} |\S*,(?=\S))", ""),
    # RFC 850: 06-Oct-26 10:00:00 GMT
    (r"^([^\s-]+)-([^\s-]+)-([^\s-]+) (\S+) (\S+)\z", "$1 $2 $3 $4 $5"),
    # zone glued to the time
    (r"^(\S+ \S+ \S+ [^\s+-]+)([+-]\S*)\z", "$1 $2"),
    # month before day
    (rf"(?i)^({_MONTH}) (\S+) ", "$2 $1 "),
    # time before year
    (r"^(\S+ \S+) ([^\s:]+:\S*) (\S+)", "$1 $3 $2"),
    # zone before year
    (r"^(\S+ \S+) ([^\d\s]\S*) (\S+) (\S+)", "$1 $4 $3 $2"),
)
_FIELDS = (
    rf"(?i)^(\d+),? ({_MONTH}) (\d+),? "
    r"(?:(\d+):(\d+)(?::(\d+))?|(\d+)\.(\d+)(?:\.(\d+))?),? (\S+).*\z"
)
# Fixed places: "Mon, 01 Jan 2024 10:00:00 +0100". Every field but the day is within its range.
_USUAL = (
    rf"^[A-Za-z]{{3}}, [0-9]{{2}} (?:{'|'.join(m[:3].capitalize() for m in rules.MONTHS)}) [12][0-9]{{3}} "
    r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9] (?:\+|-(?!0000))(?:[01][0-9]|2[0-3])[0-5][0-9]\z"
)


def _zone_seconds(zone: Column) -> Column:
    """Offset in seconds; NULL when there is no usable zone. ``-0000`` says "no zone"."""
    named = F.create_map(
        *[F.lit(v) for name, hhmm in rules.ZONE_HHMM.items() for v in (name, str(hhmm))]
    )
    digits = F.coalesce(F.try_element_at(named, F.upper(zone)), zone)

    def seconds(n: Column) -> Column:
        size = F.abs(n)
        return F.signum(n).cast("int") * (
            F.floor(size / 100).cast("int") * 3600 + (size % 100) * 60)

    numeric = digits.rlike(r"^[+-]?\d{1,6}\z") & ~digits.rlike(r"^-0+\z")
    return F.when(numeric, let(digits.try_cast("int"), seconds))


def rfc5322_epoch(text: Column) -> Column:
    """Seconds since 1970 UTC of a mail date, or NULL when it is invalid or has no zone.

    The usual spelling is read by the places of its fields, every other one by rewriting; the results are the same.
    """
    return F.when(text.rlike(_USUAL), _usual_epoch(text)).otherwise(_rewritten_epoch(text))


def _usual_epoch(text: Column) -> Column:
    def num(start: int, length: int = 2) -> Column:
        return F.substring(text, start, length).cast("bigint")

    month = ((F.instr(F.lit(_MONTH_INDEX), F.lower(F.substring(text, 9, 3))) + 2) / 3).cast("int")
    day = F.concat_ws("-", F.substring(text, 13, 4), month.cast("string"), F.substring(text, 6, 2)).try_cast("date")
    zone = num(28) * 3600 + num(30) * 60
    return (F.unix_date(day).cast("bigint") * 86400 + num(18) * 3600 + num(21) * 60 + num(24)
            - F.when(F.substring(text, 27, 1) == "-", -zone).otherwise(zone))


def _rewritten_epoch(text: Column) -> Column:
    s = F.btrim(F.regexp_replace(text, rf"(?U)[{SPACE}]+", " "))
    for pattern, replacement in _REWRITES:
        s = F.regexp_replace(s, pattern, replacement)
    fields = let(s, lambda x: F.when(
        x.rlike(_FIELDS),
        F.split(F.regexp_replace(x, _FIELDS, "$1/$2/$3/$4$7/$5$8/$6$9/$10"), "/")))

    def instant(f: Column) -> Column:
        def num(i: int) -> Column:
            return F.get(f, F.lit(i)).try_cast("int")

        name = F.lower(F.left(F.get(f, F.lit(1)), F.lit(3)))
        month = ((F.instr(F.lit(_MONTH_INDEX), name) + 2) / 3).cast("int")
        year = (F.when(num(2) > 99, num(2)).when(num(2) > 68, num(2) + 1900)
                .otherwise(num(2) + 2000))
        second = F.when(F.get(f, F.lit(5)) == "", F.lit(0)).otherwise(num(5))
        day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"),
                          num(0).cast("string")).try_cast("date")
        zone = _zone_seconds(F.get(f, F.lit(6)))
        clock = F.when((num(3) < 24) & (num(4) < 60) & (second < 60),
                       num(3) * 3600 + num(4) * 60 + second)
        return F.when(
            F.abs(zone) < 86400,
            F.unix_date(day).cast("bigint") * 86400 + clock - zone)

    return let(fields, instant)


def rfc5322_ts(text: Column) -> Column:
    """The same instant as TIMESTAMP."""
    return F.timestamp_seconds(rfc5322_epoch(text))


def iso_utc(epoch: Column) -> Column:
    """ISO 8601 text of an epoch, independent of the session time zone."""
    day = F.date_from_unix_date(F.floor(epoch / 86400).cast("int"))
    rest = F.pmod(epoch, F.lit(86400))

    def two(c: Column) -> Column:
        return F.lpad(c.cast("int").cast("string"), 2, "0")

    return F.when(epoch.isNotNull(), F.concat(
        day.cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"),
        two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("+00:00")))
