import json

from tests.frames import rows
from viewloom import Dashboard, LinkSpec
from viewloom.streaming.arrivals import watch_folder


def test_each_file_replaces_the_last(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spec = LinkSpec("c", "l", "row_order")
    seen = {}

    def derive(records, number):
        seen[number] = rows(Dashboard(records, links=spec).link_matrix(), "source", "target", "value")

    def run():
        query = watch_folder(
            spark, str(folder), "c string, l array<string>", derive, str(tmp_path / "done"), once=True
        )
        assert query.awaitTermination(120)

    first = [{"c": "A", "l": ["B"]}, {"c": "B", "l": []}]
    second = [{"c": "A", "l": ["A", "B"]}]
    (folder / "1.json").write_text("".join(json.dumps(r) + "\n" for r in first))
    run()
    (folder / "2.json").write_text("".join(json.dumps(r) + "\n" for r in second))
    run()
    assert seen == {0: [("A", "B", 1), ("B", "A", 1)], 1: [("A", "A", 2)]}
