"""Whole flows over pages of lines, boxes and signals."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirespan.functions.params import DEFAULT, Params
from wirespan.operators import boxes as bx
from wirespan.operators import fuse, graph, search
from wirespan.sources.tables import counted_table, merged_in


@dataclass
class GraphFlow:
    """From lines, boxes (page_id, kind, box_idx, corners) and signals to connections; each step is built when asked for.

    What several later steps read is written to the shared folder once, and counted in ``counts`` by the same job. Lines
    are not deduplicated here.
    """

    raw_lines: DataFrame
    raw_boxes: DataFrame
    signals: DataFrame
    p: Params = DEFAULT
    counts: dict[str, int] = field(default_factory=dict)

    def _kept(self, df: DataFrame, **counts) -> DataFrame:
        table, seen = counted_table(df, **counts)
        self.counts |= seen
        return table

    @cached_property
    def boxes(self) -> DataFrame:
        return self._kept(bx.named_boxes(self.raw_boxes, self.signals, self.p), boxes=F.count(F.lit(1)))

    @cached_property
    def lines(self) -> DataFrame:
        return self._kept(graph.with_auxiliary(self.raw_lines.where(F.col("score") >= self.p.line_score), self.signals, self.boxes, self.p), lines=F.count(F.lit(1)), auxiliary_lines=F.count_if("is_auxiliary"))

    @cached_property
    def ends(self) -> DataFrame:
        return self._kept(graph.clustered(self.lines, self.p), line_ends=F.count(F.lit(1)))

    @cached_property
    def junctions(self) -> DataFrame:
        return graph.junctions(self.ends)

    @cached_property
    def entries(self) -> DataFrame:
        return self._kept(graph.entry_points(self.junctions, self.boxes, self.lines, self.p), entries=F.count(F.lit(1)))

    @cached_property
    def nodes(self) -> DataFrame:
        return merged_in(self.junctions.select("page_id", "jid", "x", "y").unionByName(self.entries.select("page_id", "jid", "x", "y")))

    @cached_property
    def rebuilt(self) -> DataFrame:
        return self._kept(graph.splice(graph.edges(self.ends), self.entries, self.nodes, self.lines, self.p), rebuilt_edges=F.count(F.lit(1)))

    @cached_property
    def contracted(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = graph.contract(self.nodes, self.rebuilt, self.lines, self.signals, self.boxes, self.p)
        return self._kept(nodes, nodes=F.count(F.lit(1))), self._kept(edges, contracted_edges=F.count(F.lit(1)))

    @cached_property
    def paths(self) -> DataFrame:
        return self._kept(search.paths(self.entries, self.contracted[1], self.boxes, self.p), paths=F.count(F.lit(1)))

    @cached_property
    def connections(self) -> DataFrame:
        return search.connections(self.paths, self.contracted[0], self.signals, self.boxes, self.p)


def fuse_flow(lines: DataFrame, signals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Lines of a fair score, each kept once, to links between texts."""
    return fuse.pin_links(fuse.dedup_lines(lines.where(F.col("score") >= p.fuse_line_score), p), signals, p)
