from resalelens.operators import facets


def test_town_and_month_facets(spark):
    df = spark.createDataFrame([("2024-02", "YISHUN"), ("2024-01", "BISHAN"), ("2024-02", None)],
                               "month string, town string")
    assert facets.facet_list(facets.town_facets(df), "town") == ["All", "BISHAN", "YISHUN"]
    assert facets.facet_list(facets.month_facets(df), "month") == ["2024-01", "2024-02"]


def test_tags(spark):
    posts = spark.createDataFrame([
        (1, "2024-01-01", True, "a", ["x", "y"]), (2, "2024-02-01", True, "b", ["x", "x"]),
        (3, "2024-03-01", False, "c", ["y"]), (4, "2024-02-01", True, "d", []),
    ], "post_id long, date string, published boolean, title string, tags array<string>")
    assert {r.tag: r.n for r in facets.tag_counts(posts).collect()} == {"x": 2, "y": 2}
    rows = facets.tag_rows(posts, "x").collect()
    assert sorted(r.post_id for r in rows) == [1, 2] and {r.n for r in rows} == {2}
    assert [r.post_id for r in facets.recent(posts, 3).collect()] == [4, 2, 1]
