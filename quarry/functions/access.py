"""Rights and access labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rights policies that allow a source to be stored and processed.
APPROVING = ("personal_reference", "owner_approved", "public_domain")


def acl_labels(source_id: Column, owner: Column, visibility: Column) -> Column:
    return F.array_compact(
        F.array(
            F.concat(F.lit("source:"), source_id),
            F.concat(F.lit("owner:"), owner),
            F.when(visibility == "public", "public").when(visibility == "shared", F.concat(F.lit("shared:"), source_id)),
        )
    )


def may_process(rights_policy: Column) -> Column:
    return rights_policy.isin(*APPROVING)


def may_read(labels: Column, grants: Column) -> Column:
    """Label sets meet. An empty or null set of grants reads nothing."""
    return F.coalesce(F.arrays_overlap(labels, grants), F.lit(False))


def in_sources(source_id: Column, source_ids: Column) -> Column:
    """An empty list narrows nothing; a list never grants access."""
    return (F.size(source_ids) == 0) | F.array_contains(source_ids, source_id)


def access_class(labels: Column, source_id: Column) -> Column:
    """One string for all rows that the same requests can read: sources have few of them, rows many."""
    return F.concat_ws("|", source_id, F.array_join(F.array_sort(labels), "|"))
