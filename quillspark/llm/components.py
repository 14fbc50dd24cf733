"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillspark.operators.graph import components


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, root): each node that has an edge, with the smallest node it reaches.

    Self-edges and nulls are ignored; an empty input gives an empty result.
    """
    return components(edges.where("a <> b").select("a", "b"))
