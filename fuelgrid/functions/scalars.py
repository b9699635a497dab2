"""Scalar rules as column expressions: units, prices, codes, dates, text keys, bins. All stay in generated code.

Missing is NULL throughout; :func:`missing` turns NaN into it at a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
EARTH_KM = 6371.0088
BARREL_L = 158.987294928
GALLON_L = 3.785411784
MAD_TO_SIGMA = 1.4826
FRENCH_MONTHS = {
    "janv": 1, "jan": 1, "févr": 2, "fevr": 2, "fév": 2, "fev": 2, "mars": 3, "avr": 4, "mai": 5, "juin": 6,
    "juil": 7, "août": 8, "aout": 8, "sept": 9, "oct": 10, "nov": 11, "déc": 12, "dec": 12,
}
#: Departments of each region of mainland France without Corsica, by their official codes.
REGIONS = {
    "11": "75 77 78 91 92 93 94 95",
    "24": "18 28 36 37 41 45",
    "27": "21 25 39 58 70 71 89 90",
    "28": "14 27 50 61 76",
    "32": "02 59 60 62 80",
    "44": "08 10 51 52 54 55 57 67 68 88",
    "52": "44 49 53 72 85",
    "53": "22 29 35 56",
    "75": "16 17 19 23 24 33 40 47 64 79 86 87",
    "76": "09 11 12 30 31 32 34 46 48 65 66 81 82",
    "84": "01 03 07 15 26 38 42 43 63 69 73 74",
    "93": "04 05 06 13 83 84",
}
#: A map's colours of an excess in cents: up to each edge, beyond the last, and of what isn't a finite number.
COLOUR_EDGES = (-5.0, 0.0, 5.0, 10.0, 20.0)
COLOURS = ("#1a9850", "#91cf60", "#ffffbf", "#fdae61", "#f46d43", "#d73027")
NO_COLOUR = "#9e9e9e"
BOX = {"lat": (41.0, 52.0), "lon": (-6.0, 10.0)}


def missing(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def fair_price(quote: Column, margin: Column, excise: Column, vat: Column) -> Column:
    return (quote + margin + excise) * (1 + vat)


def implied_margin(price: Column, quote: Column, excise: Column, vat: Column) -> Column:
    return price / (1 + vat) - excise - quote


def usd_per_barrel_to_eur_per_litre(usd: Column, usd_per_eur: Column) -> Column:
    """Fails where the exchange rate isn't positive."""
    rate = F.when(usd_per_eur > 0, usd_per_eur).otherwise(F.raise_error(F.lit("exchange rate must be positive")).cast("double"))
    return usd / rate / BARREL_L


def usd_per_gallon_to_eur_per_litre(usd: Column, usd_per_eur: Column) -> Column:
    return usd / usd_per_eur / GALLON_L


def crude_spread(refined_eur_l: Column, crude_usd_bbl: Column, usd_per_eur: Column) -> Column:
    return refined_eur_l - usd_per_barrel_to_eur_per_litre(crude_usd_bbl, usd_per_eur)


def binned(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: the label of the first edge that x doesn't exceed, the last label beyond; NULL stays NULL."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(x <= edge, label)
    return out.otherwise(labels[-1])


def freshness(age_days: Column) -> Column:
    return F.when(age_days > 30, "VERY_OLD").when(age_days > 7, "OLD").when(age_days.isNotNull(), "CURRENT")


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays in [start, end), 0 if end isn't after start."""
    monday = F.lit("1970-01-05").cast("date")

    def before(d: Column) -> Column:
        n = F.datediff(d, monday)
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return F.greatest(before(end) - before(start), F.lit(0)).cast("long")


def coordinate(raw: Column, limit: float) -> Column:
    """Degrees; values beyond ``limit`` are read as 1e-5 degrees, and are NULL if still beyond."""
    x = raw.try_cast("double")
    x = F.when(F.abs(x) > limit, x / 1e5).otherwise(x)
    return F.when(F.abs(x) <= limit, x)


def coordinates(latitude: Column, longitude: Column) -> tuple[Column, Column]:
    """Both NULL unless both are valid."""
    lat, lon = coordinate(latitude, 90), coordinate(longitude, 180)
    both = lat.isNotNull() & lon.isNotNull()
    return F.when(both, lat), F.when(both, lon)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def price(raw: Column) -> Column:
    """A price as text: decimal commas, thousandths above 20, and NULL outside [0.2, 5]."""
    x = F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")
    x = F.when(x > 20, x / 1000).otherwise(x)
    return F.when(x.between(0.2, 5.0), x)


def postcode_department(raw: Column) -> Column:
    return F.substring(F.regexp_replace(raw, "[^0-9]", ""), 1, 2)


def padded_code(raw: Column) -> Column:
    return F.lpad(raw.try_cast("int").cast("string"), 2, "0")


def road_type(raw: Column) -> Column:
    return F.when(F.upper(raw) == "A", "AUTOROUTE").when(F.upper(raw) == "R", "ROUTE").otherwise("UNKNOWN")


def text_key(raw: Column) -> Column:
    """Equal for texts that differ in accents, compatible forms of a letter, case, kind of apostrophe or spacing alone.

    Unicode's compatible decomposition is that of the library that Spark brings along; ASCII alone is spared it."""
    apart = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(raw, F.lit("")), F.lit(True))
    x = F.when(raw.isNull() | raw.rlike(r"^[\x00-\x7F]*$"), raw).otherwise(F.regexp_replace(apart, r"\p{M}", ""))
    for letter, folded in (("ß", "ss"), ("ς", "σ"), ("’", "'")):
        x = F.replace(x if letter != "ß" else F.lower(x), F.lit(letter), F.lit(folded))
    return F.btrim(F.regexp_replace(x, r"\s+", " "))


def slug(raw: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), F.lit("_"))


def effective_date(status: Column, otherwise: Column) -> Column:
    """The date that a status names (provisional_to_2026-05-31), else another."""
    found = F.regexp_extract(status, r"provisional_to_(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.when(found != "", found).try_cast("date"), otherwise)


def french_month(token: Column) -> Column:
    """janv-26, févr. 2026 ... as the month's first day; two digits of a year are of this century."""
    parts = r"^([a-zàâäéèêëîïôöùûüç]+)[-\s]?(\d{4}|\d{2})"
    clean = F.trim(F.replace(F.lower(token), F.lit(".")))
    name, year = F.regexp_extract(clean, parts, 1), F.regexp_extract(clean, parts, 2).try_cast("int")
    month = F.coalesce(*[F.when(name.startswith(k), v) for k, v in FRENCH_MONTHS.items()])
    return F.make_date(F.when(year < 100, year + 2000).otherwise(year), month, F.lit(1))


def decimal_comma(raw: Column) -> Column:
    return F.replace(F.regexp_replace(raw, r"[\s ]", ""), F.lit(","), F.lit(".")).try_cast("double")


def mixed_date(raw: Column) -> Column:
    """A date as text, or a spreadsheet's serial number."""
    serial = F.date_add(F.lit("1899-12-30").cast("date"), raw.try_cast("int"))
    return F.when(raw.rlike(r"^\d{1,6}$"), serial).otherwise(raw.try_cast("date"))


def wall_time_to_utc(local: Column, zone: str = "Europe/Paris") -> Column:
    """UTC of a local wall time; NULL for a time that the zone skips or has twice."""
    utc = F.to_utc_timestamp(local, zone)
    skipped = F.from_utc_timestamp(utc, zone) != local
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(utc + hour, zone) == local) | (F.from_utc_timestamp(utc - hour, zone) == local)
    return F.when(~(skipped | twice), utc)


def unit_confidence(stations: Column, high: int = 100, medium: int = 30, low: int = 10) -> Column:
    return F.when(stations >= high, "HIGH").when(stations >= medium, "MEDIUM").when(stations >= low, "LOW").otherwise("INSUFFICIENT")


def least_confidence(*labels: Column) -> Column:
    order = ["INSUFFICIENT", "LOW", "MEDIUM", "HIGH"]
    rank = lambda c: F.coalesce(*[F.when(c == x, k) for k, x in enumerate(order)], F.lit(0))
    return F.element_at(F.array(*map(F.lit, order)), F.least(*[rank(c) for c in labels], F.lit(3)) + 1)


def months_confidence(months: Column, high: int = 18, medium: int = 12, low: int = 6) -> Column:
    return unit_confidence(months, high, medium, low)


def bias_status(bias: Column, months: Column, needed: int = 12) -> Column:
    """How high a lasting bias in cents is; only an excess counts, and only after enough months."""
    size = F.when(bias > 15, "VERY_HIGH").when(bias > 10, "HIGH").when(bias > 5, "ELEVATED").otherwise("NORMAL")
    return F.when(months < needed, "PROVISIONAL").otherwise(size)


def region_of(department: Column) -> Column:
    """The region's code of a department's, UNKNOWN for any other."""
    code = F.lpad(department.cast("string"), 2, "0")
    out = F.lit("UNKNOWN")
    for region, departments in REGIONS.items():
        out = F.when(code.isin(departments.split()), region).otherwise(out)
    return out


def in_mainland(postcode: Column) -> Column:
    """Whether a postcode lies on the mainland, without Corsica and overseas."""
    dep = postcode_department(postcode)
    return F.coalesce((F.length(dep) == 2) & ~dep.isin("20", "97", "98"), F.lit(False))


def or_unknown(label: Column) -> Column:
    return F.coalesce(label.cast("string"), F.lit("UNKNOWN"))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def colour(x: Column) -> Column:
    """A map's colour of an excess in cents."""
    return F.when(finite(x), binned(x, COLOUR_EDGES, COLOURS)).otherwise(NO_COLOUR)


def on_map(lat: Column, lon: Column) -> Column:
    """Whether a point lies in the map's box, edges included."""
    return F.coalesce(lat.between(*BOX["lat"]) & lon.between(*BOX["lon"]), F.lit(False))


def fixed(x: Column, digits: int) -> Column:
    """A number with that many digits after the point; n/a where it isn't finite."""
    return F.when(finite(x), F.format_string(f"%.{digits}f", x)).otherwise("n/a")


def html(raw: Column) -> Column:
    out = raw
    for plain, safe in {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}.items():
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out
