"""Services by name and by search, against plain loops and by hand."""

from coffer.operators import services

ROWS = [(0, "brand-apple-music", "applemusic"), (0, "brand-apple-music", "music"), (1, "brand-apple", "apple"), (2, "brand-apple-two", "apple"), (3, "brand-hulu", "hulu"), (3, "brand-hulu", "")]


def _known(spark):
    return spark.createDataFrame(ROWS, "entry long, service string, alias string")


def test_names_resolve_in_order(spark):
    names = [
        (1, None, None, "Apple Music*123", "brand-apple-music"),
        (2, None, "Hulu LLC", "Apple", "brand-apple-two"),  # an equal alias of a later name is better than a beginning
        (3, None, None, "Apple.com", "brand-apple"),  # shared alias: the earliest for a beginning
        (4, "brand-hulu", "Apple", "Apple", "brand-hulu"),
        (5, " ", None, "", None),
        (6, "music", "Hulu", None, "brand-apple-music"),
        (7, None, None, "my HÜLU", "brand-hulu"),
        (8, None, "zz hulu", "my apple music", "brand-hulu"),
        (8, None, "zz hulu", "my apple music", "brand-hulu"),
        (9, None, None, None, None),
    ]
    df = spark.createDataFrame(names, "id int, identifier string, canonical string, display string, service string")
    got = services.resolved(df, _known(spark))
    assert got.columns == ["id", "identifier", "canonical", "display", "service"]
    assert sorted((r["id"], r["service"]) for r in got.collect()) == sorted((n[0], n[4]) for n in names)
    assert services.resolved(df, _known(spark).where("false")).where("service IS NULL").count() == len(names)


def test_search_ranks(spark):
    asked = spark.createDataFrame([("Apple",), ("app",), ("lem",), ("le Mu",), ("two",), ("my hulu account",), ("--",), (None,), ("Apple",)], "query string")
    got = {}
    for r in services.search(asked, _known(spark)).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["service"], r["score"]))
    assert got == {
        "Apple": [("brand-apple", 0), ("brand-apple-two", 0), ("brand-apple-music", 1005)],
        "app": [("brand-apple", 1002), ("brand-apple-two", 1002), ("brand-apple-music", 1007)],
        "lem": [("brand-apple-music", 2007)],
        "le Mu": [("brand-apple-music", 2006)],
        "two": [("brand-apple-two", 3000)],
        "my hulu account": [("brand-hulu", 2009)],
    }
    assert services.search(asked, _known(spark), shown=1).count() == 6
