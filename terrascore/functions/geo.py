"""Column expressions on coordinates, dates, keys and rates. Distances are metres; dates are relative to an explicit day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth, metres a degree of latitude, metres a degree of longitude at the city's latitude.
EARTH_M, LAT_M, LON_M = 6_371_008.8, 111_320.0, 85_000.0
#: Fixed value: the alphabet of geohashes.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Fixed value: the URL namespace of name-based identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def half_width(radius_m: float) -> float:
    """Half the side, in degrees, of the box that a circle query looks into."""
    return max(radius_m / LAT_M, radius_m / LON_M)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null where a coordinate is


def gauss(distance: Column, sigma: float) -> Column:
    """exp(-(d / sigma)^2), without a half in the exponent."""
    return F.exp(-F.pow(distance / sigma, 2))


def decay(day: Column, as_of: Column, half_life: float = 180.0) -> Column:
    """Half every half_life days; 1 for days to come and 0.5 for an unreadable (null) day."""
    return F.when(day.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), F.greatest(F.datediff(as_of, day), F.lit(0)) / half_life))


def eb_rate(count: Column, units: Column, prior: Column, k: float) -> Column:
    """Rate shrunk towards the prior with the weight of k units; the raw rate if there is no prior. Larger places sort a hair lower."""
    u = F.greatest(units, F.lit(1.0))
    return F.when(prior.isNull(), count / u).otherwise((count + k * prior) / (u + k)) - 1e-6 * F.log1p(u)


def half_even(x: Column, places: int) -> Column:
    """x rounded to some decimal places, halves of its scaled value to the even neighbour."""
    return F.rint(x * 10.0**places) / 10.0**places


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: it is bound by a lambda, not copied into each place where it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """The geohash of a point; null where a coordinate is."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.lpad(F.bin(F.greatest(F.lit(0), F.least(F.lit(2**n - 1), F.floor((v - low) / span * 2**n))).cast("long")), n, "0")
    both = F.struct(cell(lon, -180.0, 360.0, n_lon).alias("x"), cell(lat, -90.0, 180.0, n_lat).alias("y"))
    mixed = _let(both, lambda b: F.concat(*(F.substring(b["x" if i % 2 == 0 else "y"], i // 2 + 1, 1) for i in range(bits))))
    letter = lambda m, i: F.substring(F.lit(BASE32), F.conv(F.substring(m, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1))
    known = _let(mixed, lambda m: F.concat(*(letter(m, i) for i in range(precision))))
    return F.when(lat.isNotNull() & lon.isNotNull(), known)


def uuid5(name: Column) -> Column:
    """The name-based UUID of a string in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def bbl(borough: Column, block: Column, lot: Column) -> Column:
    """The ten-digit building key; null unless all parts are numbers."""
    part = lambda c: F.expr("null").cast("long") if c is None else c.cast("string").try_cast("double").cast("long")
    b, k, x = part(borough), part(block), part(lot)
    return F.when(b.isNotNull() & k.isNotNull() & x.isNotNull(), F.concat(b.cast("string"), F.lpad(k.cast("string"), 5, "0"), F.lpad(x.cast("string"), 4, "0")))


def parse_day(text: Column) -> Column:
    """A day from ISO text (its first ten characters), YYYYMMDD or M/D/YYYY; null if it is none of these."""
    t = F.trim(text)
    return F.coalesce(
        F.try_to_date(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10)), "yyyy-MM-dd"),
        F.try_to_date(F.when(t.rlike(r"^\d{8}$"), t), "yyyyMMdd"),
        F.try_to_date(F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), t), "M/d/yyyy"),
    )


def number(text: Column) -> Column:
    """A number from text; blank or junk is null."""
    return F.nullif(F.trim(text.cast("string")), F.lit("")).try_cast("double")


def clean_name(text: Column) -> Column:
    """Upper case, without what isn't a letter A-Z, digit or space, single spaces; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9 ]+", ""), " +", " ")), F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, nulls and zeros counting as 50."""
    x, y = (F.transform(v, lambda s: F.coalesce(F.nullif(s, F.lit(0.0)), F.lit(50.0))) for v in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    norm = F.sqrt(total(F.transform(x, lambda e: e * e))) * F.sqrt(total(F.transform(y, lambda e: e * e)))
    return F.when(norm == 0, 0.0).otherwise(total(F.zip_with(x, y, lambda p, q: p * q)) / norm)


def street_danger_score(rate: Column) -> Column:
    return 100 * F.exp(-rate / 8)


def bedbug_score(rate: Column) -> Column:
    return 100 * F.pow(F.lit(0.5), rate / 0.05)


def road_score(index: Column) -> Column:
    return F.when(index.isNotNull(), F.greatest(F.lit(0.0), 100 - 6 * index))


def air_score(index: Column) -> Column:
    """92 at an index of 8 or less, 22 at 20 or more, straight between."""
    return F.when(index.isNotNull(), 92 - 70 * (F.least(F.greatest(index, F.lit(8.0)), F.lit(20.0)) - 8) / 12)
