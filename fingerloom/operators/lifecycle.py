"""Derived tables of a catalog: directory index, pairs and groups, with their provenance.

Provenance is dropped before a table is rebuilt and written after it, so that a table that was
cut short has none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fingerloom.functions.metadata import now_iso
from fingerloom.operators import grouping, similarity
from fingerloom.operators.index import build_index
from fingerloom.sources.catalog import Catalog


class Refused(LookupError):
    """A stage that the stored tables can't answer."""


def rebuild_index(catalog: Catalog, no_junk: bool = False) -> None:
    if not catalog.has("files"):
        raise Refused("no inventory (no files table)")
    catalog.drop_meta("index")
    catalog.write("index", build_index(catalog.files(), no_junk))
    catalog.set_meta("index", no_junk=no_junk, built_at=now_iso())


def rebuild_pairs(catalog: Catalog, fn: str = similarity.DEFAULT_FN, max_df: int | None = None, min_sim: float = 0.0, name_match: bool = False) -> int:
    """Returns the document-frequency cap that was taken (0: every pair was scored)."""
    if not catalog.has("index"):
        raise Refused("no directory index; run --index first")
    index = catalog.read("index")
    cap = similarity.choose_max_df(index.select("dir_id").distinct().count(), max_df)
    catalog.drop_meta("pairs")
    catalog.write("pairs", similarity.scored_pairs(index, fn, max_df=cap, name_match=name_match, min_sim=min_sim))
    catalog.set_meta("pairs", fn=fn, max_df=cap, min_sim=min_sim, name_match=name_match, built_at=now_iso())
    return cap


def rebuild_groups(catalog: Catalog, threshold: float, fn: str | None = None) -> None:
    pairs = catalog.meta("pairs")
    if pairs is None or not catalog.has("pairs"):
        raise Refused("no stored pairs; run --pairs first")
    if fn is not None and fn != pairs["fn"]:
        raise Refused(f"stored pairs were built with --fn {pairs['fn']}; rerun --pairs --fn {fn} to switch functions")
    if threshold < (pairs["min_sim"] or 0.0):
        raise Refused(f"stored pairs were built with --min-sim {pairs['min_sim']:g}; pairs below it were not kept -- rerun --pairs with --min-sim {threshold:g} or lower to group at this threshold")
    table = catalog.read("pairs")
    if "matched" not in table.columns:
        raise Refused("stored pairs predate the matched-file tie-break; rerun --pairs to rebuild them")
    catalog.drop_meta("groups")
    catalog.write("groups", grouping.build_groups(table, threshold))
    catalog.set_meta("groups", fn=pairs["fn"], threshold=threshold, built_at=now_iso())


def groups_current(catalog: Catalog, threshold: float, fn: str | None = None) -> bool:
    """Whether the stored groups are what rebuild_groups would make."""
    groups, pairs = catalog.meta("groups"), catalog.meta("pairs")
    if groups is None or not catalog.has("groups"):
        return False
    same = groups["threshold"] == threshold and fn in (None, groups["fn"])
    return same and not (pairs is not None and pairs["built_at"] > groups["built_at"])


def staleness(catalog: Catalog) -> list[str]:
    """Notes on tables that are newer than what was made from them."""
    index, pairs, groups = (catalog.meta(k) for k in ("index", "pairs", "groups"))
    out = []
    if pairs and groups and pairs["built_at"] > groups["built_at"]:
        out.append("note: pair table is newer than this grouping; rerun --threshold to refresh")
    if index and pairs and index["built_at"] > pairs["built_at"]:
        out.append("note: directory index is newer than the pair table; rerun --pairs (then --threshold) to rebuild on it")
    return out


def group_weights(catalog: Catalog, sort: str):
    """Statistics for a report's sort; refuses to sort by sizes that aren't there. (stats, note)."""
    groups, index = catalog.read("groups"), catalog.read("index")
    stats = grouping.tree_stats(catalog.files(), index, groups) if sort == "tree-size" else grouping.group_stats(index, groups)
    row = stats.agg(F.coalesce(F.sum("unsized"), F.lit(0)), F.coalesce(F.sum("n_files"), F.lit(0))).first()
    note = None
    if sort != "files" and row[0]:
        if row[0] == row[1]:
            raise Refused("no stored file sizes to sort by; run a stamp with --locate first")
        note = f"note: {row[0]} of {row[1]} files have no stored size (a --locate run fills it); size totals undercount"
    return stats, note
