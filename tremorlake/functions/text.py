"""Sample arrays as text, display text and channel keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_half_up_2

NULL_WORD = "None"


def array_to_text(values) -> Column:
    """Ten decimals per value, the null word for nulls, a blank after each; an empty array gives ''."""
    words = F.transform(
        values,
        lambda v: F.concat(F.when(v.isNull(), F.lit(NULL_WORD)).otherwise(F.format_string("%.10f", v)), F.lit(" ")),
    )
    return F.array_join(words, "")


def text_to_array(text) -> Column:
    """The inverse of :func:`array_to_text`; a word that is no number is an error."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w == NULL_WORD, F.lit(None)).otherwise(w).cast("double"))


def number_text(v: Column) -> Column:
    """The number as text without a trailing '.0' and without an exponent (from 1e-18 to below 1e20)."""
    text = v.cast("string")
    plain = F.regexp_replace(v.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(text.contains("E"), F.coalesce(plain, text)).otherwise(F.regexp_replace(text, r"\.0$", ""))


def clip_text(v: Column, chars: int) -> Column:
    """The first characters of the number's text; truncates, does not round."""
    return F.substring(number_text(v), 1, chars)


def channel_key(channel="channel", station="station") -> Column:
    return F.concat_ws("_", channel, station)


def split_channel_key(key) -> tuple[Column, Column]:
    """(channel, station) of a key; parts beyond two are dropped."""
    parts = F.split(key, "_")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


# The words of the popup.
def alert_text(lat: Column, lon: Column, magnitude: Column, depth: Column, station: Column) -> Column:
    """The popup text of the alert map, with values rounded to two decimals."""
    lat, lon, magnitude, depth = (number_text(round_half_up_2(v)) for v in (lat, lon, magnitude, depth))
    return F.concat(
        F.lit("Koordinat: "), lat, F.lit(","), lon, F.lit(" Magnitude; "), magnitude,
        F.lit(" Kedalaman: "), depth, F.lit(" KM"), F.lit(" Stasiun Pendeteksi: "), station,
    )
