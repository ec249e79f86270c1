"""Numerals, dates, versions, colours and JSON properties as Column functions."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and their numbers.
LETTERS = {"ת": 400, "ש": 300, "ר": 200, "ק": 100, "צ": 90, "פ": 80, "ע": 70, "ס": 60, "נ": 50, "מ": 40, "ל": 30, "כ": 20, "יט": 19, "יח": 18, "יז": 17, "טז": 16, "טו": 15, "י": 10, "ט": 9, "ח": 8, "ז": 7, "ו": 6, "ה": 5, "ד": 4, "ג": 3, "ב": 2, "א": 1}
# Spellings that are put in another order, one after the other.
SWAPS = [("יה", "טו"), ("יו", "טז"), ("רעב", "ערב"), ("רעד", "עדר"), ("רע", "ער"), ("רצח", "רחצ"), ("תשמד", "תדשם"), ("שמד", "שדמ"), ("שד", "דש")]


def _swapped(c: Column) -> Column:
    for a, b in SWAPS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _below_thousand(n: Column) -> Column:
    pick = lambda letters, i: F.element_at(F.array(F.lit(""), *[F.lit(x) for x in letters]), i.cast("int") + 1)
    rest = n % 400
    return F.concat(F.repeat(F.lit("ת"), F.floor(n / 400).cast("int")), pick("קרש", F.floor(rest / 100)), pick("יכלמנסעפצ", F.floor(rest % 100 / 10)), pick("אבגדהוזחט", rest % 10))


def to_numeral(n: Column) -> Column:
    """Hebrew numeral of a positive integer below a thousand million, `` for others; thousands are parted by U+05F3."""
    n = n.cast("long")
    part = lambda size: F.floor(n / size) % 1000
    # Each level's spelling is put in order before the next one is appended, and then as a whole.
    out = F.when(n >= 1_000_000, F.concat(_swapped(_below_thousand(part(1_000_000))), F.lit("׳"))).otherwise("")
    out = F.when(n >= 1000, F.concat(_swapped(F.concat(out, _below_thousand(part(1000)))), F.lit("׳"))).otherwise(out)
    return F.when(n > 0, _swapped(F.concat(out, _below_thousand(part(1))))).otherwise("")


def from_numeral(c: Column) -> Column:
    """Sum of a numeral's letters, read from its end, which must grow strictly; else -1. Empty is 0."""
    value = F.create_map(*[F.lit(x) for k, v in LETTERS.items() for x in (k[::-1], v)])
    parts = F.regexp_extract_all(F.reverse(c), F.lit("טי|חי|זי|זט|וט|."), F.lit(0))
    state = F.struct(F.lit(0).alias("last"), F.lit(0).alias("total"))

    def step(acc: Column, p: Column) -> Column:
        v = F.coalesce(F.try_element_at(value, p), F.lit(0))
        bad = (acc["total"] < 0) | (v <= acc["last"])
        return F.struct(v.alias("last"), F.when(bad, -1).otherwise(acc["total"] + v).alias("total"))

    return F.aggregate(parts, state, step, lambda acc: acc["total"])


# Names of days and months.
_DAYS = ["יום שני", "יום שלישי", "יום רביעי", "יום חמישי", "יום שישי", "שבת", "יום ראשון"]
_MONTHS = ["ניסן", "אייר", "סיון", "תמוז", "אב", "אלול", "תשרי", "חשון", "כסלו", "טבת", "שבט", "אדר", "אדר ב"]


def _elapsed(year: int) -> int:
    """Days from the epoch to the new year of a Hebrew year."""
    months = (235 * year - 234) // 19
    parts = 12_084 + 13_753 * months
    day = 29 * months + parts // 25_920
    return day + 1 if 3 * (day + 1) % 7 < 3 else day


def _new_year(year: int) -> int:
    before, now, after = _elapsed(year - 1), _elapsed(year), _elapsed(year + 1)
    return -1_373_427 + now + (2 if after - now == 356 else 1 if now - before == 382 else 0)


def hebrew_date(d: date) -> tuple[int, int, int]:
    """(year, month from Nisan = 1, day) of a Gregorian date."""
    n = d.toordinal()
    year = int((n + 1_373_429) * 98_496 / 35_975_351) + 2
    while _new_year(year) > n:
        year -= 1
    size = _new_year(year + 1) - _new_year(year)
    leap = (7 * year + 1) % 19 < 7
    days = [(7, 30), (8, 30 if size % 10 == 5 else 29), (9, 29 if size % 10 == 3 else 30), (10, 29), (11, 30)]
    days += [(12, 30), (13, 29)] if leap else [(12, 29)]
    days += [(1, 30), (2, 29), (3, 30), (4, 29), (5, 30), (6, 29)]
    left = n - _new_year(year)
    for month, length in days:
        if left < length:
            return year, month, left + 1
        left -= length
    raise ValueError(d)


def _numeral(n: int) -> str:
    out = ""
    for letters, v in LETTERS.items():
        while n >= v:
            out, n = out + letters, n - v
    return out


def _spelled(d, weekday: bool) -> str | None:
    if pd.isna(d):
        return None
    year, month, day = hebrew_date(d.date())
    leap = (7 * year + 1) % 19 < 7
    name = "אדר א" if leap and month == 12 else _MONTHS[month - 1]
    return (f"{_DAYS[d.weekday()]} " if weekday else "") + f"{_numeral(day)} {name} {_numeral(year % 1000)}"


def hebrew_date_text(c: Column, weekday: bool = False) -> Column:
    """Day, month and year of a timestamp in the Hebrew calendar, after the day of the week on request."""

    def spelled(s: pd.Series) -> pd.Series:
        # Each day once, however often it occurs.
        place, days = pd.factorize(s.dt.normalize())
        text = pd.Series([_spelled(d, weekday) for d in days] + [None], dtype=object)
        return text.take(place).reset_index(drop=True)

    return F.pandas_udf(spelled, "string")(c)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by numbers where both are dotted numbers below 2^31 (a leading v aside), else by the lower-case text."""
    clean = lambda c: F.regexp_replace(c, "^[vV]+", "")
    a, b = clean(a), clean(b)
    parts = lambda c: F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    dotted = lambda c: c.rlike(r"^\d+(\.\d+){1,3}$") & F.forall(parts(c), lambda x: x.isNotNull())
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(dotted(a) & dotted(b), sign(parts(a), parts(b))).otherwise(sign(F.lower(a), F.lower(b)))


def _byte(hex6: Column, at: int) -> Column:
    return F.conv(F.substring(hex6, at, 2), 16, 10).cast("int")


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, "^#+", "")


def hex_to_bgr(c: Column) -> Column:
    """#RRGGBB as the integer with blue in the high byte."""
    h = _plain(c)
    return F.when(is_hex(h), _byte(h, 5) * 65536 + _byte(h, 3) * 256 + _byte(h, 1))


def bgr_to_hex(c: Column) -> Column:
    h = F.lpad(F.hex(c.cast("long")), 6, "0")
    return F.concat(F.lit("#"), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def is_hex(c: Column) -> Column:
    return c.rlike("^[0-9A-Fa-f]{6}$")


def _let(value: Column, made) -> Column:
    """made(value) with the value evaluated once."""
    return F.get(F.transform(F.array(value), lambda x: made(x)), F.lit(0))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    """Struct (h, s, l) of numbers from 0 to 1."""
    given = F.struct(*[(x.cast("double") / 255).alias(n) for n, x in (("r", r), ("g", g), ("b", b))])

    def ranged(x: Column) -> Column:
        return F.struct(x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b"), F.greatest(x["r"], x["g"], x["b"]).alias("top"), F.least(x["r"], x["g"], x["b"]).alias("low"))

    def made(x: Column) -> Column:
        r, g, b, top, low = (x[n] for n in ("r", "g", "b", "top", "low"))
        d, light = top - low, (top + low) / 2
        sat = F.when(d == 0, 0.0).when(light > 0.5, d / (2.0 - top - low)).otherwise(d / (top + low))
        hue = F.when(d == 0, 0.0).when(top == r, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
        return F.struct(hue.alias("h"), sat.alias("s"), light.alias("l"))

    return _let(_let(given, ranged), made)


def hsl_to_rgb(h: Column, s: Column, light: Column) -> Column:
    """Struct (r, g, b) of integers from 0 to 255."""

    def ends(x: Column) -> Column:
        q = F.when(x["l"] < 0.5, x["l"] * (1 + x["s"])).otherwise(x["l"] + x["s"] - x["l"] * x["s"])
        return F.struct(x["h"].alias("h"), x["s"].alias("s"), x["l"].alias("l"), q.alias("q"))

    def part(x: Column, shift: float) -> Column:
        q, p = x["q"], 2 * x["l"] - x["q"]
        turned = x["h"] + shift
        t = F.when(turned < 0, turned + 1).when(turned > 1, turned - 1).otherwise(turned)
        v = _let(t, lambda t: F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p))
        return F.floor(F.when(x["s"] == 0, x["l"]).otherwise(v) * 255 + 0.5).cast("int")

    given = F.struct(h.alias("h"), s.alias("s"), light.alias("l"))
    return _let(_let(given, ends), lambda x: F.struct(part(x, 1 / 3).alias("r"), part(x, 0.0).alias("g"), part(x, -1 / 3).alias("b")))


def tint(c: Column, amount: Column) -> Column:
    """#RRGGBB lightened (amount over 0) or darkened (under 0): lightness l becomes l * |amount|, plus 1 - amount when lightened."""
    h = _plain(c)
    light = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["l"] * F.abs(amount) + F.when(amount > 0, 1 - amount).otherwise(0.0)))
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    rgb = _let(rgb_to_hsl(_byte(h, 1), _byte(h, 3), _byte(h, 5)), lambda x: hsl_to_rgb(x["h"], x["s"], light(x)))
    spelled = _let(rgb, lambda x: F.concat(F.lit("#"), two(x["r"]), two(x["g"]), two(x["b"])))
    return F.when(amount == 0, c).otherwise(spelled)


#: High byte of each theme colour, by its index. Fixed values.
THEME_BYTES = [0xDD, 0xDC, 0xDF, 0xDE, 0xD4, 0xD5, 0xD9, 0xD7, 0xD8, 0xD6]


def theme_encode(index: Column, amount: Column) -> Column:
    """Signed 32-bit theme colour of an index from 0 to 9; null for others. Shade in the second lowest byte, tint in the lowest, 255 for unchanged."""
    byte = F.when((index >= 0) & (index <= 9), F.get(F.array(*[F.lit(x) for x in THEME_BYTES]), index.cast("int")))
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 255 + 0.5).cast("int")))
    shade = F.when(amount < 0, clamp(amount + 1)).otherwise(255)
    light = F.when(amount > 0, clamp(1 - amount)).otherwise(255)
    return (byte.cast("long") * 16777216 + shade * 256 + light - F.lit(1 << 32)).cast("int")


def theme_decode(c: Column) -> Column:
    """Struct (index, amount, prefix) of a negative theme colour whose high byte begins with D or F; else null."""
    u = c.cast("long") + F.lit(1 << 32)
    high, shade, light = F.floor(u / 16777216) % 256, F.floor(u / 256) % 256, u % 256
    half_up = lambda x: F.floor(x * 100 + 0.5) / 100
    amount = F.when(light != 255, half_up(1 - light / 255)).when(shade != 255, half_up(shade / 255 - 1)).otherwise(0.0)
    prefix = F.when(F.floor(high / 16) == 13, "D").when(F.floor(high / 16) == 15, "F")
    return F.when((c < 0) & prefix.isNotNull(), F.struct((high % 16).cast("int").alias("index"), amount.alias("amount"), prefix.alias("prefix")))


def contrast_colour(c: Column) -> Column:
    """Black on light colours, white on dark ones."""
    h = _plain(c)
    light = (0.299 * _byte(h, 1) + 0.587 * _byte(h, 3) + 0.114 * _byte(h, 5)) / 255
    return F.when(light > 0.5, "#000000").otherwise("#ffffff")


def json_property(c: Column, *names: str, kind: str = "string", default=None) -> Column:
    """The first of some properties that a JSON text has, cast, or a default."""
    got = F.coalesce(*[F.get_json_object(c, f"$.{n}") for n in names])
    out = got if kind == "string" else got.try_cast(kind)
    return out if default is None else F.coalesce(out, F.lit(default))


def popularity(count: Column, last: Column, first: Column, now: Column) -> Column:
    """Ten a use, a bonus for a recent one, and twenty times the uses a day; rounded half up."""
    days = lambda t: (F.unix_micros(now.cast("timestamp")) - F.unix_micros(t.cast("timestamp"))) / F.lit(86_400_000_000.0)
    ago, age = days(last), days(first)
    bonus = F.when(ago < 1, 50).when(ago < 7, 25).when(ago < 30, 10).otherwise(0)
    return F.floor(count * 10 + bonus + F.when(age > 0, count / age * 20).otherwise(0.0) + 0.5).cast("long")
