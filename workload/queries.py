"""One query per operator, each over whole tables. Angles and shares are rounded to nine
digits, money is summed as decimals; both only so that results compare with other engines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from viewloom import Dashboard, GraphSpec, HierarchySpec, SeriesSpec
from viewloom.operators import graph, hierarchy, links, profile, selection, series
from viewloom.operators.staging import scratch
from viewloom.plans import specs
from viewloom.sources.arrays import read_array
from viewloom.sources.records import BAD_RECORD, parse_variants, read_records, read_variants
from viewloom.sources.versions import Refused, Store
from viewloom.streaming import clicks
from workload import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ENTITY, NODE, BRAND = "NATION_3", "la", "Brand#7"
YEAR, YEAR_TEXT = 1995, "1995"
FILES_PER_TASK = 5_000  # a task writes its files one after the other


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r9(column: str | Column, name: str | None = None) -> Column:
    source = F.col(column) if isinstance(column, str) else column
    return F.round(source.cast("double"), 9).alias(name or column)


def text(path: str = "path", name: str = "path") -> Column:
    return F.array_join(path, "/").alias(name)


# series


@query
def series_values(spark, folder):
    return series.rows(b.parts(spark, folder), b.SERIES)


@query
def series_map_sum(spark, folder):
    return series.rows(b.events(spark, folder), b.ENTRY_SERIES)


@query
def series_max(spark, folder):
    return series.largest(b.series_board(spark, folder).categories)


@query
def series_categories(spark, folder):
    return b.series_board(spark, folder).categories.select("category", "first_seen")


@query
def series_bands(spark, folder):
    bands = b.series_board(spark, folder).bands()
    return bands.select("category", "index", r9("start", "start_angle"), r9("width"))


@query
def series_lengths(spark, folder):
    board = b.series_board(spark, folder)
    rows = series.lengths(board.series_rows, board.categories)
    return rows.select("ord", "category", "value", r9("length"))


@query
def series_overlay(spark, folder):
    bars = b.series_board(spark, folder).visible_bars()
    return bars.select("category", "value", "n_rows", r9("length"))


@query
def series_bars(spark, folder):
    bars = b.event_board(spark, folder).bars()
    return bars.select(
        "ord", "category", "value", r9("length"), r9("start", "start_angle"), r9("end", "end_angle")
    )


# links between entities


@query
def link_entities(spark, folder):
    return links.indexed(b.link_board(spark, folder).entities)


@query
def link_matrix(spark, folder):
    return b.link_board(spark, folder).link_matrix()


@query
def link_pages(spark, folder):
    """Links among pages: lists of several targets, most of which name no page."""
    return b.page_link_board(spark, folder).link_matrix()


@query
def link_labels(spark, folder):
    """Arcs of names that are too long to be printed whole."""
    arcs = Dashboard(b.long_names(spark, folder), links=b.LONG_LINKS).arcs()
    return arcs.select("entity", "index", "total", "label")


@query
def link_totals(spark, folder):
    board = b.link_board(spark, folder)
    return links.totals(board.link_pairs, board.entities).select("entity", "total", r9("share"))


@query
def link_arcs(spark, folder):
    return b.link_board(spark, folder).arcs().select(
        "entity", "index", "total", "label", r9("start", "start_angle"), r9("end", "end_angle")
    )


@query
def link_pairs(spark, folder):
    return b.link_board(spark, folder).chords.select("source", "target", "value")


@query
def link_subarcs(spark, folder):
    return b.link_board(spark, folder).subarcs()


@query
def link_ribbons(spark, folder):
    angles = ["source_start", "source_end", "target_start", "target_end"]
    return b.link_board(spark, folder).ribbons().select("source", "target", "value", *[r9(a) for a in angles])


@query
def link_incident(spark, folder):
    chords = b.link_board(spark, folder).chords.select("source", "target", "value")
    return links.touching(chords, ENTITY)


# node/link graph


@query
def graph_nodes(spark, folder):
    return b.graph_board(spark, folder).nodes.select("id", "value", r9("norm"), r9("size"))


@query
def graph_links(spark, folder):
    return b.graph_board(spark, folder).graph_links


@query
def graph_nodes_numeric(spark, folder):
    return b.supply_board(spark, folder).nodes.select("id", "value", r9("norm"), r9("size"))


@query
def graph_links_numeric(spark, folder):
    return b.supply_board(spark, folder).graph_links


@query
def graph_nodes_missing(spark, folder):
    """Orders that are done have no strength: it counts 0, for the scale as well."""
    nodes = graph.nodes(b.orders(spark, folder), b.OPEN_SUPPLY)
    return nodes.select("id", "value", r9("norm"), r9("size"))


@query
def graph_neighbors(spark, folder):
    return b.graph_board(spark, folder).neighbours()


@query
def graph_neighbor_text(spark, folder):
    """Strengths with a fraction: the pages' lengths in sixteenths of a thousand."""
    board = b.graph_board(spark, folder)
    nodes = board.nodes.withColumn("value", F.col("value") / 16)
    return graph.neighbour_text(nodes, board.graph_links, part_size=100)


@query
def graph_incident(spark, folder):
    return graph.incident(b.graph_board(spark, folder).graph_links, NODE)


@query
def graph_drawn(spark, folder):
    board = b.graph_board(spark, folder)
    nodes, found = graph.drawable(board.nodes, board.graph_links)
    counts = found.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n_links"))
    return nodes.join(counts, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


# hierarchy


@query
def tree_leaves(spark, folder):
    leaves = hierarchy.leaves(b.customers(spark, folder), b.TREE)
    return leaves.select(text(), r9("value"), "first_seen")


@query
def tree_rollup(spark, folder):
    return b.tree_board(spark, folder).tree.select(
        text(), "depth", "name", text("parent", "parent"), r9("value"), "first_seen", "n_children", "is_leaf"
    )


@query
def tree_partition(spark, folder):
    return b.tree_board(spark, folder).slices().select(
        text(), "depth", r9("value"), r9("x0"), r9("x1"), r9("y0"), r9("y1")
    )


@query
def tree_labels(spark, folder):
    tree = b.tree_board(spark, folder).tree
    return hierarchy.labels(hierarchy.slices(tree)).select("label", r9("value"))


@query
def tree_subtree(spark, folder):
    below = b.tree_board(spark, folder).drill(["EUROPE"])
    return below.select(text(), "depth", r9("value"), r9("x0"), r9("x1"), r9("y0"), r9("y1"))


@query
def tree_ancestors(spark, folder):
    chain = hierarchy.ancestors(b.tree_board(spark, folder).tree)
    return chain.select(text(), "step", text("ancestor", "ancestor"), "name")


@query
def tree_text(spark, folder):
    """Sizes that come as text, some of which is no number."""
    tree = b.text_board(spark, folder).tree
    return tree.select(text(), "depth", r9("value"))


@query
def tree_year(spark, folder):
    """Drill-down to a level of numbers."""
    below = Dashboard(b.orders(spark, folder), hierarchy=b.YEAR_TEXT_TREE).drill([YEAR_TEXT])
    return below.select(text(), "depth", r9("value"), r9("x0"), r9("x1"))


# shared selection


@query
def select_series(spark, folder):
    rows = series.rows(b.parts(spark, folder), b.SERIES)
    return selection.flag_series(rows, selection.keys(spark, [BRAND, "Brand#9"]))


@query
def select_entities(spark, folder):
    board = b.link_board(spark, folder)
    return selection.flag_entities(board.entities, selection.keys(spark, [ENTITY, "NATION_11"]))


@query
def select_chords(spark, folder):
    chords = b.link_board(spark, folder).chords.select("source", "target", "value")
    return selection.flag_links(chords, selection.keys(spark, [ENTITY, "NATION_11"]))


@query
def select_nodes(spark, folder):
    nodes = b.graph_board(spark, folder).nodes.select("id", "value")
    return selection.flag_nodes(nodes, selection.keys(spark, [NODE, "the"]))


@query
def select_links(spark, folder):
    found = b.graph_board(spark, folder).graph_links
    return selection.flag_links(found, selection.keys(spark, [NODE, "the"]), ["ord", "pos"])


@query
def select_tree(spark, folder):
    laid = b.tree_board(spark, folder).laid_out_tree
    flagged = selection.flag_tree(laid, selection.keys(spark, ["BUILDING", "NATION_7"]))
    return flagged.select(text(), "name", "lit")


@query
def select_empty(spark, folder):
    chords = b.link_board(spark, folder).chords.select("source", "target", "value")
    return selection.flag_links(chords, selection.keys(spark, []))


@query
def select_toggle(spark, folder):
    """Pick the nations of the large buyers, then click those of the large sellers."""
    nation = b.table(spark, folder, "nation")
    buyers = b.table(spark, folder, "customer").where("c_acctbal > 5000")
    sellers = b.table(spark, folder, "supplier").where("s_acctbal > 5000")
    chosen = buyers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"))
    clicked = sellers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("key"))
    return selection.toggle(chosen, clicked)


@query
def select_remove(spark, folder):
    """Brands added in two steps, then some removed, and the rows that stay lit."""
    rows = series.rows(b.parts(spark, folder), b.SERIES)
    cheap = rows.where("value < 1000").select(F.col("category").alias("key"))
    dear = rows.where("value > 1090").select(F.col("category").alias("key"))
    keys = selection.remove(selection.add(cheap, dear), selection.keys(spark, [BRAND]))
    return selection.only(rows, ["category"], keys, ["ord"])


@query
def select_clear(spark, folder):
    rows = series.rows(b.parts(spark, folder), b.SERIES)
    return selection.flag_series(rows, selection.clear(selection.keys(spark, [BRAND])))


def _lit(chosen: str, views: dict[str, DataFrame]) -> DataFrame:
    """What is lit in each view, as text."""
    items = {
        "series": F.col("ord").cast("string"),
        "entities": F.col("entity"),
        "chords": F.concat_ws("/", "source", "target"),
        "nodes": F.col("id").cast("string"),
        "links": F.concat_ws("/", F.col("ord").cast("string"), F.col("pos").cast("string")),
        "tree": F.array_join("path", "/"),
    }
    lit = [
        views[view].where("lit").select(F.lit(chosen).alias("chosen"), F.lit(view).alias("view"), item.alias("item"))
        for view, item in items.items()
    ]
    return reduce(DataFrame.unionByName, lit)


@query
def select_all_views(spark, folder):
    """One selection of numbers and one of texts, each over all views of one dashboard."""
    board = b.order_board(spark, folder)
    numbers = board.select(selection.keys(spark, [YEAR, 3, 7], "bigint"))
    texts = board.select(selection.keys(spark, [ENTITY, "1-URGENT", YEAR_TEXT]))
    return _lit("numbers", numbers).unionByName(_lit("texts", texts))


@query
def key_dictionary(spark, folder):
    """Years as numbers in the series, as text in the tree: each is a key of its own."""
    records = b.orders(spark, folder)
    board = Dashboard(records, series=b.YEARS, links=b.LINKS, graph=b.SUPPLY, hierarchy=b.YEAR_TEXT_TREE)
    return board.key_dictionary()


# sources, profile, roles


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _written(records: DataFrame, name: str) -> str:
    """A folder in the session's shared folder with the records as JSON Lines, or their one text column."""
    path = scratch(records.sparkSession, name)
    if records.columns == ["line"]:
        records.write.text(path)
    else:
        records.write.json(path)
    return path


def _events(spark, folder) -> DataFrame:
    """The events with their times as text, which JSON would cut to milliseconds."""
    return b.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("string"))


@query
def ingest_lines(spark, folder):
    """The events written as JSON Lines and read back as records."""
    path = _written(_events(spark, folder), "events")
    return read_records(spark, path, lines=True, schema=EVENTS).drop("row_order")


@query
def ingest_arrays(spark, folder):
    """The conversations as one JSON array per line, of up to fifty turns each."""
    turns = b.table(spark, folder, "conversations")
    part = F.floor(F.col("turn") / 50).alias("part")
    lists = turns.groupBy("conv_id", part).agg(F.collect_list(F.struct("*")).alias("turns"))
    path = _written(lists.select(F.to_json("turns").alias("line")), "conversations")
    schema = "conv_id bigint, turn bigint, role string, text string"
    return read_records(spark, path, lines=True, schema=schema).drop("row_order")


@query
def ingest_bad(spark, folder):
    """The events as JSON Lines, every tenth cut short: it is set aside as text."""
    line = F.to_json(F.struct("*"))
    cut = F.when(F.col("event_id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    path = _written(_events(spark, folder).select(cut.alias("line")), "bad")
    found = read_records(spark, path, lines=True, schema=EVENTS, keep_bad=True)
    told = F.regexp_extract(BAD_RECORD, r'"event_id":(\d+)', 1).cast("bigint")
    bad = F.col(BAD_RECORD).isNotNull()
    values = [F.when(~bad, F.col(c)).alias(c) for c in ("ts", "user_id", "event_type", "value", "props")]
    return found.select(F.when(bad, told).otherwise(F.col("event_id")).alias("event_id"), bad.alias("bad"), *values)


@query
def ingest_variants(spark, folder):
    """The events without a schema: fields and kinds found in the written records."""
    records = b.events(spark, folder).withColumn("ts", F.col("ts").cast("string"))
    found = read_variants(spark, _written(records, "events"), lines=True)
    found = found.withColumn("event_id", F.variant_get("record", "$.event_id", "bigint"))
    return profile.variant_profile(found, "record", ["event_id"]).select("key", "kind", "is_numeric", "first_seen")


@query
def profile_typed(spark, folder):
    return profile.typed_profile(b.events(spark, folder), ["event_id"])


@query
def profile_variant(spark, folder):
    records = parse_variants(b.table(spark, folder, "events"), "props")
    return profile.variant_profile(records, "record", ["event_id"])


@query
def roles(spark, folder):
    found = profile.typed_profile(b.events(spark, folder), ["event_id"])
    return profile.roles(found).select("view", "part", "field", "agg", "label", "bindable")


@query
def bindings(spark, folder):
    """Which field of the events, a list among them, is accepted for which part."""
    events = b.events(spark, folder).withColumn("tags", F.array("event_type"))
    present = profile.typed_profile(events, ["event_id"]).select("key", "first_seen")
    told = spark.createDataFrame(specs.accepted(events), "view string, part string, agg string, field string, accepted boolean")
    return told.join(present, F.col("field") == F.col("key")).select("view", "part", "agg", "field", "accepted", "first_seen")


def _mixed_board(spark, folder) -> Dashboard:
    """All four views over records of mixed shape, written as JSON Lines and read as VARIANT."""
    records = read_variants(spark, _written(b.mixed_lines(spark, folder), "mixed"), lines=True)
    records = records.withColumn("event_id", F.variant_get("record", "$.event_id", "bigint"))
    return Dashboard.over_variants(records, series=b.MIXED_SERIES, links=b.MIXED_LINKS, graph=b.MIXED_GRAPH, hierarchy=b.MIXED_TREE)


def _key(column: str, name: str) -> Column:
    return F.concat_ws(":", F.col(column)["kind"], F.col(column)["value"]).alias(name)


@query
def mixed_series(spark, folder):
    bars = _mixed_board(spark, folder).bars()
    return bars.select("ord", _key("category", "category"), "value", r9("length"), r9("start", "start_angle"))


@query
def mixed_links(spark, folder):
    matrix = _mixed_board(spark, folder).link_matrix()
    return matrix.select(_key("source", "source"), _key("target", "target"), "value")


@query
def mixed_arcs(spark, folder):
    return _mixed_board(spark, folder).arcs().select(_key("entity", "entity"), "index", "total", "label", r9("end", "end_angle"))


@query
def mixed_nodes(spark, folder):
    return _mixed_board(spark, folder).nodes.select(_key("id", "id"), "value", r9("norm"), r9("size"))


@query
def mixed_graph_links(spark, folder):
    found = _mixed_board(spark, folder).graph_links
    return found.select("ord", "pos", _key("source", "source"), _key("target", "target"))


@query
def mixed_tree(spark, folder):
    tree = _mixed_board(spark, folder).tree
    names = F.array_join("names", "/", "-").alias("names")
    return tree.select(names, F.array_join("kinds", "/", "-").alias("kinds"), "depth", r9("value"), "n_children")


@query
def mixed_select(spark, folder):
    """The number 3, then the text "3", over all views but the tree."""
    board = _mixed_board(spark, folder)
    lit = []
    for chosen, keys in (("number", selection.keys(spark, [3], "bigint")), ("text", selection.keys(spark, ["3"]))):
        views = board.select(keys)
        items = {"series": F.col("ord").cast("string"), "entities": _key("entity", "item"), "nodes": _key("id", "item"),
                 "chords": F.concat(_key("source", "a"), F.lit("/"), _key("target", "b"))}
        for view, item in items.items():
            lit.append(views[view].where("lit").select(F.lit(chosen).alias("chosen"), F.lit(view).alias("view"), item.alias("item")))
    return reduce(DataFrame.unionByName, lit)


@query
def ingest_array_file(spark, folder):
    """The conversations as one file that holds one JSON array, read back range by range."""
    turns = b.table(spark, folder, "conversations")
    rows = turns.select("conv_id", "turn", F.to_json(F.struct("*")).alias("line"))
    first = turns.agg(F.min(F.struct("conv_id", "turn")).alias("k")).first()["k"]
    lead = F.when((F.col("conv_id") == first[0]) & (F.col("turn") == first[1]), "[").otherwise(",")
    lines = rows.select(F.lit(0).alias("part"), "conv_id", "turn", F.concat(lead, "line").alias("line"))
    end = spark.range(1).select(F.lit(1).alias("part"), F.lit(None).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("turn"), F.lit("]").alias("line"))
    one = lines.union(end).repartition(1).sortWithinPartitions("part", "conv_id", "turn")  # a file has one writer
    schema = "conv_id bigint, turn bigint, role string, text string"
    return read_array(spark, _written(one.select("line"), "array"), schema).drop("row_order")


@query
def ingest_objects(spark, folder):
    """Every supplier as a file of its own, which holds one object on several lines."""
    path = scratch(spark, "objects")
    suppliers = b.table(spark, folder, "supplier")
    pretty = F.to_json(F.struct("*"), {"pretty": "true"})
    tasks = max(spark.sparkContext.defaultParallelism, suppliers.count() // FILES_PER_TASK)
    one_each = suppliers.select(pretty.alias("line")).repartition(tasks).write.option("maxRecordsPerFile", 1)
    # each task moves its own files to their place, instead of the driver all of them; nobody reads the folder before
    one_each.option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    found = read_records(spark, path, schema="s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    return found.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query
def ingest_versions(spark, folder):
    """Three loads: the even events, the odd ones cut short, the odd ones whole. What is current after each, and the
    first version after all."""
    store = Store(spark, scratch(spark, "versions"))
    line, odd = F.to_json(F.struct("*")), F.col("event_id") % 2
    cut = F.when(F.col("event_id") % 1000 == 1, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    seen = []
    for step, (part, text) in enumerate([(0, line), (1, cut), (1, line)]):
        path = _written(_events(spark, folder).where(odd == part).select(text.alias("line")), "load")
        try:
            store.load(read_records(spark, path, lines=True, schema=EVENTS, keep_bad=True, numbered=False))
        except Refused:
            pass  # the version before it stays
        seen.append((step, store.current()))
    seen.append((3, store.versions()[0]))
    shown = [
        store.read(version).select(F.lit(step).alias("step"), F.lit(version).alias("version"), "event_id", "event_type", "value")
        for step, version in seen
    ]
    return reduce(DataFrame.unionByName, shown)


# links of one node, from links stored by their ends


@query
def link_incident_stored(spark, folder):
    return b.link_board(spark, folder).chord_index.incident(ENTITY)


@query
def graph_incident_stored(spark, folder):
    return b.graph_board(spark, folder).link_index.incident(NODE)


@query
def graph_empty(spark, folder):
    """Links none of which names a node: nothing is drawn."""
    records = b.orders(spark, folder).withColumn("nowhere", F.transform("others", lambda x: -x - 1))
    board = Dashboard(records, graph=GraphSpec("supplier", "nowhere", "o_totalprice", "o_orderkey"))
    nodes, found = graph.drawable(board.nodes, board.graph_links)
    count = lambda frame, name: frame.agg(F.count(F.lit(1)).alias(name))
    counts = [count(board.nodes, "n_nodes"), count(nodes, "n_shown"), count(found, "n_links")]
    return spark.range(1).select(*[c.scalar().alias(c.columns[0]) for c in counts])


# the stored tree, by intervals


@query
def tree_zoom(spark, folder):
    """As `tree_subtree`, without reading the records again."""
    below = b.tree_board(spark, folder).zoom(["EUROPE"])
    return below.select(text(), "depth", r9("value"), r9("x0"), r9("x1"), r9("y0"), r9("y1"))


@query
def tree_way(spark, folder):
    found = b.tree_board(spark, folder).way_to(["EUROPE", "NATION_3"])
    return found.select(text(), "depth", "name", r9("value"))


@query
def tree_intervals(spark, folder):
    return b.tree_board(spark, folder).tree_intervals.select(text(), "enter", "leave")


@query
def select_tree_intervals(spark, folder):
    """As `select_tree`, with the lit branches found by ranges."""
    board = b.tree_board(spark, folder)
    laid = hierarchy.layout(board.tree_intervals, len(b.TREE.levels))
    flagged = selection.flag_tree(laid, selection.keys(spark, ["BUILDING", "NATION_7"]))
    return flagged.select(text(), "name", "lit")


# keys over loads, clicks


@query
def key_dictionary_grown(spark, folder):
    """The brands of the dear parts, then those of all parts by their first row: numbers once given stay."""
    parts = b.parts(spark, folder)
    first = Dashboard(parts.where("p_retailprice > 990"), series=b.SERIES).key_dictionary()
    later = Dashboard(parts, series=b.SERIES, hierarchy=HierarchySpec(["p_brand", "p_size"], "p_retailprice", "p_partkey")).key_dictionary()
    return selection.extended_dictionary(first, later)


@query
def key_numbers(spark, folder):
    """Small and large numbers as keys: as doubles in the series, as decimals in the tree; equal ones are one key."""
    key = F.col("p_partkey")
    parts = b.parts(spark, folder).select(
        "p_partkey", "p_retailprice", (key / F.lit(1000000.0)).alias("tiny"), (key.cast("decimal(18,6)") * F.lit("0.000001").cast("decimal(7,6)")).alias("tiny_exact"),
        (key.cast("decimal(20,0)") * F.lit(10**15).cast("decimal(16,0)")).alias("huge"),
    )
    series_spec = SeriesSpec("tiny", "p_retailprice", "p_partkey")
    return Dashboard(parts, series=series_spec, hierarchy=HierarchySpec(["tiny_exact", "huge"], "p_retailprice", "p_partkey")).key_dictionary()


def _clicks(spark, folder) -> DataFrame:
    """The events as a log of clicks: fifty sessions, keys that are added, taken out and cleared."""
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "remove").when((kind == "error") & (F.col("user_id") % 5 == 0), "clear").otherwise("add")
    events = b.table(spark, folder, "events")
    return events.select(
        (F.col("user_id") % 50).cast("string").alias("session"), F.col("event_id").alias("at"), action.alias("action"),
        F.concat(F.lit("k"), (F.col("event_id") % 23).cast("string")).alias("key"),
    )


@query
def select_clicks(spark, folder):
    return clicks.selected(_clicks(spark, folder))


@query
def select_click_stream(spark, folder):
    """As `select_clicks`, with the clicks arriving as files."""
    log = _written(_clicks(spark, folder), "clicks")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, clicks.ROCKSDB)
    table = scratch(spark, "selected")
    arriving = spark.readStream.schema("session string, at bigint, action string, key string").json(log)
    clicks.watch_clicks(arriving, table, scratch(spark, "progress"), once=True).awaitTermination()
    return clicks.selected(spark.read.parquet(table)).select("session", "key", "at")


@query
def profile_key_order(spark, folder):
    """Records of mixed shape whose fields are in no order of names: their place in the record."""
    records = parse_variants(b.mixed_lines(spark, folder), "line")
    records = records.withColumn("event_id", F.variant_get("record", "$.event_id", "bigint"))
    return profile.variant_profile(records, "record", ["event_id"], text="line")
