"""The small frames of FIXTURES.md."""

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

F2 = [(0, "A", ["B", "B", "Z"]), (1, "B", ["B", "C"]), (2, "A", ["C"]), (3, "C", None), (4, "D", [])]
F3 = [
    (0, "a", 10.0, ["b", "c", "b"]),
    (1, "b", None, ["a", "b"]),
    (2, "a", 99.0, ["b"]),
    (3, "", -10.0, ["a"]),
    (4, "c", 30.0, ["", "q"]),
]
F4 = [
    (0, "A", "x", 5.0),
    (1, "A", "y", 3.0),
    (2, "A", "x", 2.0),
    (3, "B", "A", 4.0),
    (4, "B", "z", None),
    (5, None, "x", 1.0),
    (6, "B", "w", 1.0),
]
F6 = [
    (0, "A", 4.0, {"jan": 1.0, "feb": 2.5}),
    (1, "B", 16.0, {"jan": None}),
    (2, "A", 9.0, {}),
    (3, "C", None, None),
]
F5 = [
    (0, '{"a":{"x":1,"y":2},"b":null,"e":{}}'),
    (1, '{"a":{"x":"s"},"b":[1],"c":true,"d":1.5}'),
]


def frame(spark, data, schema):
    """A small frame held by the JVM, so that no Python worker runs when it is read."""
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*data)) if data else [[] for _ in fields]
    arrays = []
    for values, field in zip(columns, arrow):
        plain = [list(v.items()) if isinstance(v, dict) and pa.types.is_map(field.type) else v for v in values]
        arrays.append(pa.array(plain, type=field.type))
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=fields)


def link_frame(spark):
    return frame(spark, F2, "ord int, c string, l array<string>")


def graph_frame(spark):
    return frame(spark, F3, "ord int, id string, v double, l array<string>")


def tree_frame(spark):
    return frame(spark, F4, "ord int, l1 string, l2 string, v double")


def series_frame(spark):
    return frame(spark, F6, "ord int, c string, v double, m map<string,double>")


def rows(df, *columns):
    """Rows as a sorted list of plain tuples; None sorts first."""
    picked = [tuple(r[c] for c in columns) for r in df.collect()]
    return sorted(picked, key=lambda t: [(v is not None, str(type(v)), v if v is not None else 0) for v in t])
