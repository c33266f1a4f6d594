"""Mixed timestamp strings to one unambiguous form.

Plain Python on one value; operators.timestamps applies it to Arrow batches of distinct values. Built-in functions
cannot express it: the pattern decides the order of the parts, and a zone abbreviation chooses between the two instants
of a repeated local time.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names and their usual short forms in English, German, French, Spanish, Italian and Portuguese.
MONTH_NAMES = {
    1: "january jan januar janner jaenner janvier janv enero ene gennaio gen janeiro",
    2: "february feb februar fevrier fevr fev febrero febbraio fevereiro",
    3: "march mar marz maerz mrz mars marzo marco",
    4: "april apr avril avr abril abr aprile",
    5: "may mai mayo maggio mag maio",
    6: "june jun juni juin junio giugno giu junho",
    7: "july jul juli juillet juil julio luglio lug julho",
    8: "august aug aout agosto ago",
    9: "september sep sept septembre septiembre setiembre settembre set setembro",
    10: "october oct oktober okt octobre octubre ottobre ott outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez decembre diciembre dic dicembre dezembro",
}
MONTHS = {n: m for m, names in MONTH_NAMES.items() for n in names.split()}

TIME = r"(?P<H>\d{1,2})[:.h](?P<M>\d{2})(?:[:.](?P<S>\d{2})(?:[.,](?P<F>\d{1,9}))?)?\s*(?P<P>[AaPp]\.?[Mm]\.?)?"
ZONE = r"\s*(?P<O>[Zz]|(?:UTC|GMT)?\s?[+\-−]\d{2}:?'?(?:\d{2})?'?)?\s*(?P<N>\[?[A-Za-z]+(?:/[A-Za-z_\-]+)+\]?|\(?[A-Z]{2,5}\)?)?"
AFTER = rf"(?:(?:[Tt]|,?\s+|,)(?:at |um |à )?{TIME}{ZONE})?$"
FORMS = tuple(
    re.compile(p)
    for p in (
        rf"(?P<y>\d{{4}})([-/.:])(?P<m>\d{{1,2}})\2(?P<d>\d{{1,2}}){AFTER}",
        rf"(?:D:)?(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[Tt ]?(?P<H>\d{{2}}):?(?P<M>\d{{2}})(?::?(?P<S>\d{{2}})(?:[.,](?P<F>\d{{1,9}}))?)?(?P<P>)?{ZONE})?$",
        rf"(?P<a>\d{{1,2}})([-/.])(?P<b>\d{{1,2}})\2(?P<y>\d{{4}}|\d{{2}}){AFTER}",
        rf"(?:[^\W\d_]{{2,}}\.?,?\s+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th|er|º|°|\.)?[\s\-/]*(?:(?:de|di|of|do)\s+)?(?P<w>[^\W\d_]{{3,}})\.?[,\s\-/]*(?:(?:de|del|do)\s+)?(?P<y>\d{{4}}|\d{{2}}){AFTER}",
        rf"(?:[^\W\d_]{{2,}}\.?,\s+)?(?P<w>[^\W\d_]{{3,}})\.?[\s\-]+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?[\s\-]+(?P<y>\d{{4}}|\d{{2}}){AFTER}",
        rf"(?P<y>\d{{4}})[\s\-]+(?P<w>[^\W\d_]{{3,}})\.?[\s\-]+(?P<d>\d{{1,2}}){AFTER}",
    )
)


@lru_cache(maxsize=512)
def zone_of(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


@lru_cache(maxsize=4096)
def abbreviations(zone: str, year: int) -> dict[str, timedelta]:
    """Every abbreviation a zone uses in a year, with its offset."""
    z, out = zone_of(zone), {}
    for month in range(1, 13):
        t = datetime(year, month, 15, 12, tzinfo=z)
        out.setdefault(t.tzname(), t.utcoffset())
    return out


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def _day(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def _utc(t: datetime) -> str | None:
    try:
        t = t.astimezone(timezone.utc)
    except (OverflowError, ValueError):
        return None
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{t.hour:02d}:{t.minute:02d}:{t.second:02d}.{t.microsecond:06d}Z"


def normal_form(value: str | None, zone: str | None, order: str | None) -> str | None:
    """The unambiguous form of one written date or time, or None where it is missing, incomplete or impossible.

    zone: IANA zone of the place, for times that name none; None leaves such times without a result. order: 'DMY' or
    'MDY' for numeric day and month (anything else counts as DMY); the other order is used only where this gives no real
    date. A repeated local time is the first, a skipped one moves forward by the gap.
    """
    if value is None:
        return None
    s = " ".join(value.split())
    if not s or not s.isascii() and not any(c.isalnum() for c in s):
        return None
    if s.isdecimal() and s.isascii():
        if len(s) == 10 or len(s) == 13:
            n = int(s) * (1_000_000 if len(s) == 10 else 1_000)
            return _utc(datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=n))
        if len(s) != 8:
            return None
    for form in FORMS:
        if (m := form.match(s)) is None:
            continue
        g = m.groupdict()
        if len(g["y"]) == 2:
            y = 2000 + int(g["y"])
        else:
            y = int(g["y"])
        if "a" in g:
            a, b = int(g["a"]), int(g["b"])
            mdy = (order or "").upper() == "MDY"
            day = _day(y, a, b) if mdy else _day(y, b, a)
            day = day or (_day(y, b, a) if mdy else _day(y, a, b))
        else:
            month = int(g["m"]) if "m" in g else MONTHS.get(_plain(g["w"]), 0)
            day = _day(y, month, int(g["d"]))
        if day is None:
            return None
        if g.get("H") is None:
            return day.isoformat() if day.year >= 1000 else f"{day.year:04d}{day.isoformat()[-6:]}"
        return _instant(day, g, zone)
    return None


def _instant(day: date, g: dict[str, str | None], zone: str | None) -> str | None:
    h, mi, se = int(g["H"]), int(g["M"]), int(g["S"] or 0)
    if g.get("P"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["P"][0] in "pP" else 0)
    us = int(((g["F"] or "") + "000000")[:6])
    try:
        local = datetime(day.year, day.month, day.day, h, mi, se, us)
    except ValueError:
        return None
    offset, name = g.get("O"), (g.get("N") or "").strip("[]()")
    if offset:
        digits = re.sub(r"[^0-9]", "", offset)
        delta = timedelta(hours=int(digits[:2] or 0), minutes=int(digits[2:4] or 0))
        if delta > timedelta(hours=18) or int(digits[2:4] or 0) > 59:
            return None
        return _utc(local.replace(tzinfo=timezone(-delta if "-" in offset or "−" in offset else delta)))
    if "/" in name:
        if zone_of(name) is not None:
            zone = name
    elif name:
        found = abbreviations(zone, min(max(day.year, 1), 9998)).get(name) if zone and zone_of(zone) else None
        if found is not None:
            return _utc(local.replace(tzinfo=timezone(found)))
        if name in ("UTC", "GMT", "UT", "WET"):
            return _utc(local.replace(tzinfo=timezone.utc))
    z = zone_of(zone) if zone else None
    if z is None:
        return None
    return _utc(local.replace(tzinfo=z))
