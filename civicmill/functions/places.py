"""Places: parcels, shapes and how precise a location is. Boxes are (south, west, north, east)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def in_box(lat: Column, lng: Column, box: Box) -> Column:
    return lat.between(box[0], box[2]) & lng.between(box[1], box[3])


def parcel_key(section: Column, number: Column) -> Column:
    """"C" and "1213" are "0C1213"; null where either is missing or the number has other than digits."""
    section, number = F.upper(F.trim(section)), F.trim(number)
    padded = lambda c, n: F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)  # noqa: E731  lpad alone would cut
    return F.when((section != "") & number.rlike("^[0-9]+$"), F.concat(padded(section, 2), padded(number, 4)))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Mean of the vertices of an array of (x, y) arrays; nulls for an empty one."""
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + F.get(p, k)) / F.nullif(F.size(ring), F.lit(0))
    return mean(0), mean(1)


def bounding_box(rings: Column, margin: float = 0.01) -> tuple[Column, Column, Column, Column]:
    """(south, west, north, east) around an array of rings of (lng, lat) arrays."""
    points = F.flatten(rings)
    lng, lat = F.transform(points, lambda p: F.get(p, 0)), F.transform(points, lambda p: F.get(p, 1))
    return F.array_min(lat) - margin, F.array_min(lng) - margin, F.array_max(lat) + margin, F.array_max(lng) + margin


def location_quality(kind: Column, lat: Column, lng: Column, home_business: Column, commune: Box, centre: Box) -> Column:
    """What a location is worth: the first rule that holds, of six.

    ``home_business``: a sole trader's seat that nobody has placed by hand, most often a home.
    """
    return (
        F.when(kind == "person", "hidden_person")
        .when(lat.isNull() | lng.isNull(), "missing")
        .when((kind == "business") & home_business, "hidden_home")
        .when(~in_box(lat, lng, commune), "outside")
        .when(in_box(lat, lng, centre), "approx_center")
        .otherwise("usable")
    )


def location_shown(quality: Column, kind: Column) -> Column:
    """Whether an entity is put on the public map; those in the town's centre only if they are places or services."""
    return (quality == "usable") | ((quality == "approx_center") & kind.isin("place", "service"))


def coordinates_kept(quality: Column, kind: Column) -> Column:
    """Whether coordinates stay in the public record."""
    hidden = quality.isin("hidden_person", "hidden_home")
    return ~hidden & ((quality != "approx_center") | kind.isin("place", "service"))


#: What is asked, in this order, and the score that an answer needs; of the second service it must be above.
GEOCODING = (("ign", "housenumber", 0.5, True), ("ign", "locality", 0.4, True), ("ign", "free", 0.35, True), ("ban", "address", 0.5, False), ("ban", "commune", 0.4, False))


def accepted_step(service: Column, kind: Column, score: Column) -> Column:
    """The step at which an answer is taken, from 0; null if it isn't good enough."""
    step = F.lit(None).cast("int")
    for k, (s, asked, least, equal) in reversed(list(enumerate(GEOCODING))):
        step = F.when((service == s) & (kind == asked) & ((score >= least) if equal else (score > least)), F.lit(k)).otherwise(step)
    return step
