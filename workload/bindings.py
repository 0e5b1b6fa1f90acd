"""Records made of the driver's tables, one frame and one set of bindings per view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from viewloom import Dashboard, GraphSpec, HierarchySpec, LinkSpec, Measure, SeriesSpec

SERIES = SeriesSpec("p_brand", "p_retailprice", "p_partkey")
EVENT_SERIES = SeriesSpec("event_type", "value", "event_id")
ENTRY_SERIES = SeriesSpec("event_type", Measure("entries", "entry_sum"), "event_id")
LINKS = LinkSpec("customer_nation", "supplier_nations", "o_orderkey")
LONG_LINKS = LinkSpec("long_name", "long_names", "o_orderkey")
PAGES = GraphSpec("node", "links", "strength", "page_id")
PAGE_LINKS = LinkSpec("node", "links", "page_id")
SUPPLY = GraphSpec("supplier", "others", "o_totalprice", "o_orderkey")
OPEN_SUPPLY = GraphSpec("supplier", "others", "open_price", "o_orderkey")
YEARS = SeriesSpec("year", "o_totalprice", "o_orderkey")
YEAR_TREE = HierarchySpec(["year", "o_orderpriority", "customer_nation"], "o_totalprice", "o_orderkey")
YEAR_TEXT_TREE = HierarchySpec(["year_text", "o_orderpriority"], "cents", "o_orderkey")
TEXT_TREE = HierarchySpec(["r_name", "n_name", "c_mktsegment"], "balance_text", "c_custkey")
MIXED_SERIES = SeriesSpec("label", "strength", "event_id")
MIXED_LINKS = LinkSpec("label", "near", "event_id")
MIXED_GRAPH = GraphSpec("label", "near", "strength", "event_id")
MIXED_TREE = HierarchySpec(["label", "type"], "strength", "event_id")
TREE = HierarchySpec(["r_name", "n_name", "c_mktsegment"], "balance", "c_custkey")


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables. Its footers are read for the schema once, not once per query."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part")


def events(spark: SparkSession, folder: str) -> DataFrame:
    entries = F.from_json("props", "map<string,double>")
    return table(spark, folder, "events").withColumn("entries", entries)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """A record per order: its customer's nation, and who supplies it from where, as lists.

    The first supplier of an order is its node, the others are the node's links. An order
    has few line items, so the lists are short.
    """
    nation = table(spark, folder, "nation")
    items = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "n_name"))).alias("items"))
    )
    suppliers = F.col("items.l_suppkey")
    return (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            "o_orderkey",
            F.col("n_name").alias("customer_nation"),
            F.col("items.n_name").alias("supplier_nations"),
            F.get(suppliers, F.lit(0)).alias("supplier"),
            F.slice(suppliers, F.lit(2), F.greatest(F.size(suppliers), F.lit(1))).alias("others"),
            "o_totalprice",
            F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("open_price"),
            F.round(F.col("o_totalprice") * 100).cast("decimal(18,0)").alias("cents"),
            F.year("o_orderdate").alias("year"),
            F.year("o_orderdate").cast("string").alias("year_text"),
            "o_orderpriority",
        )
    )


def long_names(spark: SparkSession, folder: str) -> DataFrame:
    """The orders' nations under names of more than fifteen letters."""
    longer = lambda name: F.concat(F.lit("The customers of "), name)
    return orders(spark, folder).withColumns(
        {"long_name": longer(F.col("customer_nation")), "long_names": F.transform("supplier_nations", longer)}
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """A record per page: its first link, in lower case, names the page; the others are its links."""
    targets = F.regexp_extract_all(F.lower("html"), F.lit('href="/([^"]*)"'), 1)
    # explode a list of one list: filters on the targets then stay above, so that each
    # page is searched once and not once per use
    found = table(spark, folder, "pages").select(
        "page_id", F.length("html").alias("strength"), F.explode(F.array(targets)).alias("targets")
    )
    others = F.slice("targets", F.lit(2), F.greatest(F.size("targets"), F.lit(1)))
    return found.select("page_id", F.get("targets", F.lit(0)).alias("node"), others.alias("links"), "strength")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """A record per customer with region, nation and segment; balances as exact decimals."""
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("balance", F.col("c_acctbal").cast("decimal(18,2)"))
        .withColumn(
            "balance_text",
            F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.floor("c_acctbal").cast("string"))),
        )
        .select("c_custkey", "r_name", "n_name", "c_mktsegment", "balance", "balance_text")
    )


def mixed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The events as JSON text of mixed shape: `label` is text, a number, true or false, null or missing, `strength`
    a number, text or missing, and `near` lists values of all kinds."""
    text = lambda column: F.concat(F.lit('"'), column, F.lit('"'))
    user = (F.col("user_id") % 7).cast("string")
    label = (
        F.when(F.col("event_id") % 6 == 0, text(F.col("event_type")))
        .when(F.col("event_id") % 12 == 1, F.concat(user, F.lit(".0")))
        .when(F.col("event_id") % 6 == 1, user)
        .when(F.col("event_id") % 6 == 2, text(user))
        .when(F.col("event_id") % 6 == 3, (F.col("event_id") % 4 == 1).cast("string"))
        .when(F.col("event_id") % 6 == 4, "null")
    )
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    strength = F.when(F.col("event_id") % 10 == 0, text(cents)).when(F.col("event_id") % 9 != 0, cents)
    near = F.concat(text(F.col("event_type")), F.lit(","), user, F.lit(",null,true,"), text(user))
    line = F.concat(
        F.lit('{"near":['), near, F.lit('],"event_id":'), F.col("event_id").cast("string"), F.lit(',"type":'), text(F.col("event_type")),
        F.coalesce(F.concat(F.lit(',"label":'), label), F.lit("")), F.coalesce(F.concat(F.lit(',"strength":'), strength), F.lit("")), F.lit("}"),
    )
    return table(spark, folder, "events").select(line.alias("line"))


def series_board(spark: SparkSession, folder: str) -> Dashboard:
    return Dashboard(parts(spark, folder), series=SERIES)


def event_board(spark: SparkSession, folder: str) -> Dashboard:
    return Dashboard(events(spark, folder), series=EVENT_SERIES)


def link_board(spark: SparkSession, folder: str) -> Dashboard:
    return Dashboard(orders(spark, folder), links=LINKS)


def graph_board(spark: SparkSession, folder: str) -> Dashboard:
    return Dashboard(pages(spark, folder), graph=PAGES)


def supply_board(spark: SparkSession, folder: str) -> Dashboard:
    return Dashboard(orders(spark, folder), graph=SUPPLY)


def tree_board(spark: SparkSession, folder: str) -> Dashboard:
    return Dashboard(customers(spark, folder), hierarchy=TREE)


def page_link_board(spark: SparkSession, folder: str) -> Dashboard:
    return Dashboard(pages(spark, folder), links=PAGE_LINKS)


def order_board(spark: SparkSession, folder: str) -> Dashboard:
    """All four views of the orders, with numbers for categories, nodes and a level."""
    return Dashboard(orders(spark, folder), series=YEARS, links=LINKS, graph=SUPPLY, hierarchy=YEAR_TREE)


def text_board(spark: SparkSession, folder: str) -> Dashboard:
    return Dashboard(customers(spark, folder), hierarchy=TEXT_TREE)
