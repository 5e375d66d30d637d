"""Item sets survive their text form."""

from shelfmark.sources.retail import items_from_text
from shelfmark.sources.sinks import items_as_text


def test_items_with_quotes_are_read_back(spark):
    sets = [["bag", "children's mug"], ["a"], ['both \' and "'], ["x, y", "z's"]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, items array<string>")
    back = df.select("i", items_from_text(items_as_text("items")).alias("back")).orderBy("i").collect()
    assert [r["back"] for r in back] == [sorted(s) for s in sets]
