"""Column expressions: cleaning rules, calendar keys, geometry and labels.

Every function returns a Column, so a whole cleaning step fuses into one
code-generated projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- missing values and physical rules -------------------------------------


def null_normalise(c: str | Column) -> Column:
    """NaN becomes NULL; infinities are kept so they can be counted."""
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def is_nonfinite(c: str | Column) -> Column:
    return F.abs(_c(c)) == F.lit(float("inf"))


def is_marker(c: str | Column) -> Column:
    """Text that stands for a missing value, compared after trimming."""
    markers = sorted({m.strip() for m in S.DISGUISED_MARKERS})
    return F.trim(_c(c)).isin(markers)


def is_sentinel(c: str | Column) -> Column:
    return _c(c).isin(list(S.SENTINELS))


def parsed_number(text: str | Column) -> Column:
    """Numeric text to double; markers, NaN and unparsable text become NULL.

    No marker parses as a number, so the cast alone empties them; the operand
    appears once, which keeps the generated code small.
    """
    return null_normalise(F.trim(_c(text)).try_cast("double"))


def undisguised(text: str | Column) -> Column:
    """parsed_number with the numeric sentinels removed as well."""
    n = parsed_number(text)
    for code in S.SENTINELS:
        n = F.nullif(n, F.lit(code))
    return n


def nonnegative(c: str | Column) -> Column:
    """Concentrations: below zero (sentinels included) becomes NULL, zero stays."""
    c = _c(c)
    return F.when(c >= 0, c)


def within_weather_bounds(name: str, c: str | Column) -> Column:
    """Canonical bounds per weather variable; directions above 360 wrap instead of failing."""
    c = _c(c)
    if name == "wind_direction":
        return F.when(c < 0, None).when(c > 360, F.pmod(c, F.lit(360.0))).otherwise(c)
    low, high = S.CANONICAL_BOUNDS[name]
    if name in ("wind_speed", "precipitation"):
        return F.when(c >= low, c)
    return F.when(c.between(low, high), c)


def weather_loss_cause(name: str, raw: str | Column) -> Column:
    """Why a raw text value is lost: sentinel, unparsable, out_of_bounds; NULL when the cell rule keeps it, or absent."""
    raw = _c(raw)
    n = raw.try_cast("double")
    outside = within_weather_bounds(name, n).isNull()
    return (
        F.when(raw.isNull(), None)
        .when(is_sentinel(n), "sentinel")
        .when(n.isNull() | F.isnan(n), "unparsable")
        .when(outside, "out_of_bounds")
    )


def inverted(fine: str | Column, coarse: str | Column) -> Column:
    """Fine fraction above the coarse one; NULL when either side is missing."""
    return _c(fine) > _c(coarse)


def qc_status(raw, qc=None, unit=None, duration=None) -> Column:
    """Ordered row verdict: qc, then unit, then duration, then value."""
    ladder = None

    def add(cond: Column, value) -> None:
        nonlocal ladder
        ladder = F.when(cond, value) if ladder is None else ladder.when(cond, value)

    if qc is not None:
        flag = F.lower(F.trim(F.coalesce(_c(qc), F.lit("Missing"))))
        add(flag != "valid", F.concat(F.lit("qc_"), flag))
    if unit is not None:
        text = F.lower(F.trim(F.coalesce(_c(unit), F.lit(""))))
        add(~text.isin(list(S.VALID_UNITS)), "invalid_unit")
    if duration is not None:
        text = F.lower(F.trim(F.coalesce(_c(duration), F.lit(""))))
        add(~text.isin(list(S.VALID_DURATIONS)), "invalid_duration")
    add(nonnegative(undisguised(_c(raw).cast("string"))).isNull(), "sentinel_or_invalid_value")
    return ladder.otherwise("valid")


def humidity_flag(rh: str | Column, limit: float = S.HUMIDITY_LIMIT) -> Column:
    return F.coalesce((_c(rh) > limit).cast("int"), F.lit(0))


# --- time -------------------------------------------------------------------


def parsed_time(text: str | Column, zone: str = S.LOCAL_TZ) -> Column:
    """Text to instant: offset-aware text is converted, naive text is localised to the zone."""
    t = F.trim(_c(text))
    aware = t.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$")
    iso = F.replace(t, F.lit(" "), F.lit("T"))
    return F.when(aware, F.try_to_timestamp(iso)).otherwise(
        F.to_utc_timestamp(F.try_to_timestamp(iso), S.require_named_zone(zone))
    )


def parsed_agency_time(text: str | Column) -> Column:
    """12-hour agency layout first, ISO text as fallback, row by row."""
    t = F.trim(_c(text))
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd hh:mm a")), F.try_to_timestamp(t)
    )


def local_time(ts: str | Column, zone: str = S.LOCAL_TZ) -> Column:
    """Wall clock of an instant in the zone, carried in a UTC session."""
    return F.from_utc_timestamp(_c(ts), S.require_named_zone(zone))


def season(local: str | Column) -> Column:
    m = F.month(_c(local))
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .otherwise("Autumn")
    )


def season_long(local: str | Column) -> Column:
    """Second label vocabulary with the months spelled out."""
    m = F.month(_c(local))
    return (
        F.when(m.isin(12, 1, 2), "Winter (Dec-Feb)")
        .when(m.isin(3, 4, 5), "Spring (Mar-May)")
        .when(m.isin(6, 7, 8), "Summer (Jun-Aug)")
        .otherwise("Autumn (Sep-Nov)")
    )


def season_year(local: str | Column) -> Column:
    """December counts towards the winter of the next year."""
    local = _c(local)
    return F.year(local) + (F.month(local) == 12).cast("int")


def winter_year(local: str | Column) -> Column:
    return F.when(season(local) == "Winter", season_year(local))


def iso_week_key(date: str | Column) -> Column:
    date = _c(date)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), date).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(date).cast("string"), 2, "0"),
    )


def period_keys(local: str | Column) -> dict[str, Column]:
    """Local calendar keys; weekday 0 is Monday."""
    local = _c(local)
    date = local.cast("date")
    return {
        "date": date,
        "hour": F.hour(local),
        "dow": F.weekday(date),
        "is_weekend": (F.weekday(date) >= 5).cast("int"),
        "year_month": F.date_format(local, "yyyy-MM"),
        "iso_week": iso_week_key(date),
    }


def cyclical_time(local: str | Column) -> dict[str, Column]:
    """Sine and cosine of the hour in the day and the month in the year."""
    local = _c(local)
    hour_angle = F.hour(local) * (2 * F.pi()) / 24
    month_angle = F.month(local) * (2 * F.pi()) / 12
    return {
        "hour_sin": F.sin(hour_angle),
        "hour_cos": F.cos(hour_angle),
        "month_sin": F.sin(month_angle),
        "month_cos": F.cos(month_angle),
    }


# --- labels, bins and geometry ---------------------------------------------


def tier(c: str | Column) -> Column:
    """Left-closed regulatory tier of a mean."""
    c = _c(c)
    ladder = F.when(c.isNull(), None)
    for edge, label in zip(S.TIER_EDGES, S.TIER_LABELS):
        ladder = ladder.when(c < edge, label)
    return ladder.otherwise(S.TIER_LABELS[-1])


def sector16(degrees: str | Column) -> Column:
    """Compass sector 0..15, sector 0 centred on north."""
    return F.floor(F.pmod(_c(degrees) + 11.25, F.lit(360.0)) / 22.5).cast("int")


def calm(wind: str | Column) -> Column:
    return (_c(wind) < 0.5).cast("int")


def persistence_probability(x: str | Column, fallback: Column | float) -> Column:
    """Logistic score around the alert threshold; missing values take the train median."""
    z = (F.coalesce(_c(x), fallback if isinstance(fallback, Column) else F.lit(fallback)) - 50.0) / 15.0
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return 1.0 / (1.0 + F.exp(-z))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat = (p2 - p1) / 2
    half_lon = (F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    return 2 * S.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def in_box(lat, lon, box: tuple[float, float, float, float]) -> Column:
    """Inclusive (south, west, north, east) box; NULL coordinates are outside."""
    south, west, north, east = box
    return F.coalesce(_c(lat).between(south, north) & _c(lon).between(west, east), F.lit(False))


def draw32(*parts) -> Column:
    """Deterministic 32-bit draw from its parts; the seeded random source of every resampler."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def file_period(path: str | Column) -> dict[str, Column]:
    """Period type and month encoded in an agency file name."""
    name = F.upper(F.trim(_c(path)))
    mtd = F.regexp_extract(name, r"_(\d{2})_MTD", 1)
    return {
        "period_type": F.when(name.rlike(r"_YTD"), "YTD").when(mtd != "", "MTD"),
        "period_month": F.when(mtd != "", mtd.cast("int")),
    }


def normalised_text(c: str | Column) -> Column:
    return F.lower(F.trim(_c(c)))


# --- moments ------------------------------------------------------------------


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL where a side is constant."""
    x, y = _c(x), _c(y)
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys)))


def sample_skewness(c: str | Column) -> Column:
    """Bias-corrected skewness G1; NULL below three values."""
    c = _c(c)
    n = F.count(c)
    return F.when(
        (n > 2) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2)
    )


def sample_kurtosis(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis G2; NULL below four values."""
    c = _c(c)
    n = F.count(c)
    return F.when(
        (n > 3) & (F.var_pop(c) > 0),
        (n - 1) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * F.kurtosis(c) + 6),
    )
