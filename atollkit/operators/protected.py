"""Protected areas in planning units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atollkit.operators.projects import group_ids
from atollkit.operators.spatial import spatial_join
from atollkit.session import written


def protected_intersections(sites: DataFrame, units: DataFrame, size: float | None = None) -> DataFrame:
    """Distinct (iucn_cat, puid) of sites (iucn_cat, other) and the units (id, geometry) they meet."""
    return spatial_join(units.select("id", "geometry"), sites.select("iucn_cat", "other"), size=size, geometries=False, distinct=True).select("iucn_cat", F.col("id").alias("puid")).distinct()


def protected_by_category(pairs: DataFrame, nested: bool = True) -> DataFrame:
    """(iucn_cat, ids), or (iucn_cat, puid) with nested off: the units of each category."""
    return group_ids(pairs, "iucn_cat", "puid", drop_zero=False, nested=nested)


def protected_for_all(sites: DataFrame, units: DataFrame, size: float | None = None) -> DataFrame:
    """protected_intersections of all grids (units: grid_id, id, geometry) in one job."""
    return spatial_join(units.select("grid_id", "id", "geometry"), sites.select("iucn_cat", "other"), size=size, geometries=False, distinct=True).select("grid_id", "iucn_cat", F.col("id").alias("puid")).distinct()


def changed_sites(old: DataFrame, new: DataFrame) -> DataFrame:
    """(other) of the sites (site_id, iucn_cat, other) that only one of two releases has in this form, by a digest of each site."""
    form = lambda df: df.select("other", F.sha2(F.to_json(F.struct("site_id", "iucn_cat", "other")), 256).alias("form"))
    a, b = form(old), form(new)
    gone, come = a.join(b.select("form").hint("merge"), "form", "left_anti"), b.join(a.select("form").hint("merge"), "form", "left_anti")
    return gone.select("other").unionByName(come.select("other"))


def redone_intersections(existing: DataFrame, old: DataFrame, new: DataFrame, units: DataFrame, size: float | None = None) -> DataFrame:
    """protected_for_all() of a new release, from that of the old one: only units that a changed site meets are worked out again.

    existing: (grid_id, iucn_cat, puid); old and new: (site_id, iucn_cat, other); units: (grid_id, id, geometry). Equal to the full redo: what a
    unit has depends on the sites that meet it alone. Changed sites and the units that they meet are written once: joins look at their sides several times."""
    changed = written(changed_sites(old, new).distinct())
    met = written(spatial_join(units.select("grid_id", "id", "geometry"), changed, size=size, geometries=False).select("grid_id", "id").distinct())
    again = protected_for_all(new, units.join(met.hint("merge"), ["grid_id", "id"], "left_semi"), size)
    kept = existing.join(met.select("grid_id", F.col("id").alias("puid")).hint("merge"), ["grid_id", "puid"], "left_anti")
    return kept.select("grid_id", "iucn_cat", "puid").unionByName(again)
