import os

from newsmill.functions import nodes
from newsmill.operators import pages
from newsmill.session import drop_stored, passing, stored


def test_rows_of_the_table_function(spark):
    found = [(1, "<div><p>a<p>b</div>c<br>d"), (2, None), (3, ""), (4, "no tags"), (5, "<p></p><p></p>"),
             (6, "<![x"), (7, "<ul><li><b>x</b><li><b>x</b></ul>" * 3), (8, "</p></div><i>é")]
    df = spark.createDataFrame(found, "page_id long, html string")
    df.createOrReplaceTempView("odd_pages")
    name = nodes.register(spark)
    got = spark.sql(f"SELECT p.page_id, n.* FROM odd_pages p, LATERAL {name}(p.html) n")
    want = pages.node_table(pages.with_dom(df, own=True), "page_id")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def folder(df):
    return {f.removeprefix("file://").rsplit("/", 1)[0] for f in df.inputFiles()}.pop()


def test_what_a_scope_stores_goes_with_it(spark):
    with passing(spark):
        outer = folder(stored(spark.range(3), "outer"))
        with passing(spark):
            inner = folder(stored(spark.range(3), "inner"))
            kept = stored(spark.range(5), "kept", last=True)
        assert not os.path.exists(inner) and os.path.exists(outer) and kept.count() == 5
        final = stored(spark.range(7), "final", last=True)
    assert not os.path.exists(outer) and final.count() == 7
    at = folder(final)
    drop_stored(final)
    assert not os.path.exists(at)


def test_a_scope_ends_with_an_error(spark):
    try:
        with passing(spark):
            at = folder(stored(spark.range(3), "lost"))
            raise ValueError
    except ValueError:
        assert not os.path.exists(at)
