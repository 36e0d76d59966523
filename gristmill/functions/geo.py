"""Geohashes and bounding boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _folded(moved, shift: int, keep: int):
    return lambda v: v.bitwiseOR(moved(v, shift)).bitwiseAND(F.lit(keep))


def _spread(c: Column) -> Column:
    """Puts a gap of one bit before each of the low 30 bits."""
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = _let(c, _folded(F.shiftleft, shift, keep))
    return c


def _gather(c: Column) -> Column:
    """Inverse of _spread."""
    c = c.bitwiseAND(F.lit(0x5555555555555555))
    for shift, keep in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        c = _let(c, _folded(F.shiftright, shift, keep))
    return c


def _cell(value: Column, span: float, bits: int) -> Column:
    """Number of the cell of 2**bits equal ones that value (from 0 to span) lies in."""
    return F.least(F.floor(value / F.lit(span) * F.lit(float(1 << bits))), F.lit((1 << bits) - 1)).cast("bigint")


def geohash(lat: Column, lon: Column, precision: int = 12) -> Column:
    """Geohash of a point; null where a coordinate is null. Coordinates out of range raise an error."""
    bits = 5 * precision
    lat_bits, lon_bits = bits // 2, (bits + 1) // 2
    valid = F.assert_true(lat.isNull() | lon.isNull() | (lat.between(-90, 90) & lon.between(-180, 180)), "coordinates out of range")
    x, y = _spread(_cell(lon + 180, 360.0, lon_bits)), _spread(_cell(lat + 90, 180.0, lat_bits))
    code = F.shiftleft(x, 1).bitwiseOR(y) if bits % 2 == 0 else x.bitwiseOR(F.shiftleft(y, 1))
    letter = lambda v, k: F.substring(F.lit(ALPHABET), (F.shiftright(v, 5 * (precision - 1 - k)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    text = _let(code, lambda v: F.concat(*[letter(v, k) for k in range(precision)]))
    return F.when(valid.isNull() & lat.isNotNull() & lon.isNotNull(), text)


def decode_geohash(code: Column) -> Column:
    """Struct (lat, lon) of the centre of a geohash's cell."""
    n = F.length(code)
    number = F.aggregate(F.filter(F.split(code, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda acc, c: F.shiftleft(acc, 5).bitwiseOR((F.instr(F.lit(ALPHABET), c) - 1).cast("bigint")))
    odd = (n * 5) % 2 == 1
    lon_cell = F.when(odd, _gather(number)).otherwise(_gather(F.shiftright(number, 1)))
    lat_cell = F.when(odd, _gather(F.shiftright(number, 1))).otherwise(_gather(number))
    lat_bits, lon_bits = F.floor(n * 5 / 2), F.floor((n * 5 + 1) / 2)
    centre = lambda cell, bits, span: (cell + 0.5) / F.pow(F.lit(2.0), bits) * span - span / 2
    return F.struct(centre(lat_cell, lat_bits, 180.0).alias("lat"), centre(lon_cell, lon_bits, 360.0).alias("lon"))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Whether a point lies strictly within the bounds; false where a coordinate is null."""
    return F.coalesce((lat > south) & (lat < north) & (lon > west) & (lon < east), F.lit(False))


def any_in_box(locations: Column, south: float = 34.986544, north: float = 71.424593, west: float = -13.165017, east: float = 33.633585) -> Column:
    """Whether any of an array of structs with lat and lon lies within the bounds (Europe's by default)."""
    return F.coalesce(F.exists(locations, lambda p: in_box(p["lat"], p["lon"], south, north, west, east)), F.lit(False))


def valid_point(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
