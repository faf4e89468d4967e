"""Solar geometry as column expressions: they stay in the JVM and in generated code.

Angles are degrees and times are minutes or hours as named.  Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _deg(c: Column) -> Column:
    return F.radians(c)


def eot_duffie(day_of_year: Column) -> Column:
    """Equation of time in minutes, after Duffie and Beckman."""
    b = _deg((day_of_year - 1) * 360.0 / 365.0)
    # Fixed values of the series.
    return 229.2 * (0.000075 + 0.001868 * F.cos(b) - 0.032077 * F.sin(b) - 0.014615 * F.cos(2 * b) - 0.04089 * F.sin(2 * b))


def eot_da_rosa(day_of_year: Column) -> Column:
    """Equation of time in minutes, after da Rosa."""
    b = _deg((day_of_year - 81) * 360.0 / 364.0)
    return 9.87 * F.sin(2 * b) - 7.53 * F.cos(b) - 1.5 * F.sin(b)


def declination_cooper(day_of_year: Column) -> Column:
    """Declination in degrees, after Cooper."""
    return 23.45 * F.sin(_deg((day_of_year + 284) * 360.0 / 365.0))


def declination_spencer(day_of_year: Column) -> Column:
    """Declination in degrees, after Spencer."""
    b = _deg((day_of_year - 1) * 360.0 / 365.0)
    return F.degrees(
        0.006918 - 0.399912 * F.cos(b) + 0.070257 * F.sin(b) - 0.006758 * F.cos(2 * b) + 0.000907 * F.sin(2 * b) - 0.002697 * F.cos(3 * b) + 0.00148 * F.sin(3 * b)
    )


def sunset_hour_angle(latitude: Column, declination: Column) -> Column:
    """Hour angle of sunset in degrees; null in polar day and night."""
    x = -F.tan(_deg(latitude)) * F.tan(_deg(declination))
    return F.when(x.between(-1, 1), F.degrees(F.acos(x)))


def daylight_hours(latitude: Column, declination: Column) -> Column:
    return sunset_hour_angle(latitude, declination) * 2.0 / 15.0


def clock_minus_solar_hours(longitude: Column, gmt_offset: Column, eot: Column) -> Column:
    """Hours to add to solar time to get standard clock time."""
    return (15.0 * gmt_offset - longitude) * 4.0 / 60.0 - eot / 60.0


def sunrise_sunset_hours(latitude: Column, longitude: Column, gmt_offset: Column, day_of_year: Column) -> tuple[Column, Column]:
    """Clock hours of sunrise and sunset."""
    half = daylight_hours(latitude, declination_spencer(day_of_year)) / 2
    noon = 12 + clock_minus_solar_hours(longitude, gmt_offset, eot_duffie(day_of_year))
    return noon - half, noon + half


def hour_angle(clock_hours: Column, longitude: Column, gmt_offset: Column, eot: Column) -> Column:
    """Hour angle in degrees, 0 at solar noon, negative in the morning."""
    return 15.0 * (clock_hours - clock_minus_solar_hours(longitude, gmt_offset, eot) - 12.0)


def cos_incidence(declination: Column, latitude: Column, tilt: Column, azimuth: Column, omega: Column) -> Column:
    """Cosine of the angle of incidence on a tilted plane; azimuth 0 is towards the equator's south, west is positive."""
    d, la, b, g, w = (_deg(c) for c in (declination, latitude, tilt, azimuth, omega))
    return (
        F.sin(d) * F.sin(la) * F.cos(b)
        - F.sin(d) * F.cos(la) * F.sin(b) * F.cos(g)
        + F.cos(d) * F.cos(la) * F.cos(b) * F.cos(w)
        + F.cos(d) * F.sin(la) * F.sin(b) * F.cos(g) * F.cos(w)
        + F.cos(d) * F.sin(b) * F.sin(g) * F.sin(w)
    )


def longitude_from_noon(noon_minutes: Column, gmt_offset: Column, eot: Column) -> Column:
    """Longitude that puts solar noon at this clock minute."""
    return (720.0 - noon_minutes - eot) / 4.0 + 15.0 * gmt_offset


def latitude_from_daylight(hours: Column, declination: Column) -> Column:
    """Latitude that has this many hours of daylight at this declination."""
    return F.degrees(F.atan(-F.cos(_deg(7.5 * hours)) / F.tan(_deg(declination))))


def solstice_index(day_of_year: Column) -> Column:
    """Days from the winter solstice, counted towards the nearer one: 0 at day 355, 182 in June."""
    shifted = F.pmod(day_of_year + 10, F.lit(365))
    return F.when(shifted <= 182, shifted).otherwise(365 - shifted)


def solar_position(declination: Column, latitude: Column, omega: Column) -> tuple[Column, Column]:
    """(elevation, azimuth clockwise from north) in degrees."""
    d, la, w = _deg(declination), _deg(latitude), _deg(omega)
    elevation = F.asin(F.sin(la) * F.sin(d) + F.cos(la) * F.cos(d) * F.cos(w))
    azimuth = F.atan2(F.sin(w), F.cos(w) * F.sin(la) - F.tan(d) * F.cos(la))
    return F.degrees(elevation), F.pmod(F.degrees(azimuth) + 180.0, F.lit(360.0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the sphere in metres."""
    a = F.pow(F.sin(_deg(lat2 - lat1) / 2), 2) + F.cos(_deg(lat1)) * F.cos(_deg(lat2)) * F.pow(F.sin(_deg(lon2 - lon1) / 2), 2)
    return 2 * 6_371_000.0 * F.asin(F.sqrt(a))


def round_to(c: Column, multiple: float) -> Column:
    """Nearest multiple, halves to the even one."""
    return F.lit(multiple) * F.bround(c / F.lit(multiple))
