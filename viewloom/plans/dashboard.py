"""All views of one frame, with one selection over them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from viewloom.operators import graph, hierarchy, incidence, links, selection, series
from viewloom.operators.staging import stored
from viewloom.plans import mixed
from viewloom.plans.specs import GraphSpec, HierarchySpec, LinkSpec, SeriesSpec


class Dashboard:
    """The bound views of a frame. Every spec is checked against the schema on creation.

    Reduced tables that several views build on (entities, link pairs, tree) are computed
    once per dashboard and stored in the session's shared folder; nothing else is kept.
    """

    def __init__(
        self,
        df: DataFrame,
        series: SeriesSpec | None = None,
        links: LinkSpec | None = None,
        graph: GraphSpec | None = None,
        hierarchy: HierarchySpec | None = None,
    ) -> None:
        self.df = df
        self.specs = {"series": series, "links": links, "graph": graph, "hierarchy": hierarchy}
        for spec in self.specs.values():
            if spec is not None:
                spec.check(df)

    @classmethod
    def over_variants(
        cls,
        records: DataFrame,
        series: SeriesSpec | None = None,
        links: LinkSpec | None = None,
        graph: GraphSpec | None = None,
        hierarchy: HierarchySpec | None = None,
        record: str = "record",
    ) -> Dashboard:
        """The views of mixed records, held in a VARIANT column as `read_variants` gives them.

        The specs name fields of the records. Categories, entities, nodes and names are keys of
        kind and value (`columns.KEY`), each row's as it stands there; nothing is widened.
        """
        frame, bound = mixed.bind(records, record, {"series": series, "links": links, "graph": graph, "hierarchy": hierarchy})
        return cls(frame, **bound)

    def _spec(self, view: str):
        spec = self.specs[view]
        if spec is None:
            raise ValueError(f"no fields are bound to the {view} view")
        return spec

    # category series

    @cached_property
    def series_rows(self) -> DataFrame:
        return series.rows(self.df, self._spec("series"))

    @cached_property
    def categories(self) -> DataFrame:
        return series.summary(self.series_rows)

    def bands(self) -> DataFrame:
        return series.bands(self.categories)

    def bars(self) -> DataFrame:
        return series.bars(self.series_rows, self.categories)

    def visible_bars(self) -> DataFrame:
        return series.overlay(self.categories)

    # links between entities

    @cached_property
    def link_tally(self) -> DataFrame:
        return links.tally(self.df, self._spec("links"))

    @cached_property
    def entities(self) -> DataFrame:
        if "link_tally" in self.__dict__:  # else the records alone tell, without their links
            return stored(links.entities(self.link_tally))
        return stored(links.first_rows(self.df, self._spec("links")))

    @cached_property
    def link_pairs(self) -> DataFrame:
        tallied = self.link_tally
        return stored(links.pairs(tallied, self.entities))

    def link_matrix(self) -> DataFrame:
        return links.matrix(self.link_pairs)

    def arcs(self) -> DataFrame:
        paired = self.link_pairs
        return links.arcs(paired, self.entities)

    @cached_property
    def chords(self) -> DataFrame:
        tallied = self.link_tally
        return stored(links.chords(tallied, self.entities))

    def subarcs(self) -> DataFrame:
        return links.subarcs(self.chords)

    def ribbons(self) -> DataFrame:
        return links.ribbons(self.chords, self.arcs())

    # node/link graph

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.nodes(self.df, self._spec("graph"))

    @cached_property
    def graph_links(self) -> DataFrame:
        return graph.links(self.df, self._spec("graph"), self.nodes)

    def neighbours(self) -> DataFrame:
        return graph.neighbours(self.graph_links)

    # hierarchy

    @cached_property
    def tree(self) -> DataFrame:
        spec = self._spec("hierarchy")
        kinds = hierarchy.kinds(self.df, spec)
        return stored(hierarchy.tree(hierarchy.leaves(self.df, spec), len(spec.levels), kinds))

    def slices(self) -> DataFrame:
        return hierarchy.slices(self.laid_out_tree)

    @cached_property
    def laid_out_tree(self) -> DataFrame:
        return hierarchy.layout(self.tree, len(self._spec("hierarchy").levels))

    def drill(self, prefix: list[object]) -> DataFrame:
        return hierarchy.subtree(self.df, self._spec("hierarchy"), prefix)

    @cached_property
    def tree_intervals(self) -> DataFrame:
        """The tree with the numbers by which a node holds those below it."""
        return stored(hierarchy.intervals(self.tree))

    def _path(self, prefix: list[object]):
        spec = self._spec("hierarchy")
        if not 0 < len(prefix) <= len(spec.levels):
            raise ValueError(f"prefix: one to {len(spec.levels)} names are needed")
        return hierarchy.path_key(prefix, hierarchy.kinds(self.df, spec))

    def zoom(self, prefix: list[object]) -> DataFrame:
        """As `drill`, from the stored tree: the records are not read again."""
        depth = len(self._spec("hierarchy").levels)
        return hierarchy.zoomed(self.tree_intervals, self._path(prefix), len(prefix), depth)

    def way_to(self, prefix: list[object]) -> DataFrame:
        """The node at `prefix` and its ancestors, from the stored tree."""
        return hierarchy.above(self.tree_intervals, self._path(prefix))

    # links by their ends

    @cached_property
    def chord_index(self) -> incidence.LinkIndex:
        return incidence.index(self.chords.select("source", "target", "value"))

    @cached_property
    def link_index(self) -> incidence.LinkIndex:
        return incidence.index(self.graph_links)

    # shared selection

    def select(self, selected: DataFrame) -> dict[str, DataFrame]:
        """Every bound view with a `lit` column for one set of keys, which is looked at once."""
        views, selected = {}, selection.picked(selected)
        if self.specs["series"] is not None:
            views["series"] = selection.flag_series(self.series_rows, selected)
        if self.specs["links"] is not None:
            views["chords"] = selection.flag_links(self.chords, selected)
            views["entities"] = selection.flag_entities(self.entities, selected)
        if self.specs["graph"] is not None:
            views["nodes"] = selection.flag_nodes(self.nodes, selected)
            views["links"] = selection.flag_links(self.graph_links, selected, ["ord", "pos"])
        if self.specs["hierarchy"] is not None:
            views["tree"] = selection.flag_tree(self.laid_out_tree, selected)
        return views

    def key_dictionary(self) -> DataFrame:
        """One number per key over all bound views."""
        bound = self.specs
        return selection.key_dictionary(
            self.categories if bound["series"] is not None else None,
            self.entities if bound["links"] is not None else None,
            self.nodes if bound["graph"] is not None else None,
            self.laid_out_tree if bound["hierarchy"] is not None else None,
        )
