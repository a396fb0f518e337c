"""Positions on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in km between two positions given in degrees."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_dphi = F.sin((phi2 - phi1) / 2)
    half_dlam = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    h = half_dphi * half_dphi + F.cos(phi1) * F.cos(phi2) * half_dlam * half_dlam
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    """The position as a point on the unit sphere, so that poles and date line need no special case."""
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)
