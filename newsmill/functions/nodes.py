"""Parsed pages as a table function: one row per element, for SQL with LATERAL."""

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from newsmill.functions.dom import Page

NODE = "pos int, parent_pos int, grandparent_pos int, tag string, own_text string"
NAME = "page_nodes"


@udtf(returnType=NODE)
class PageNodes:
    """The rows of ``pages.node_table`` for one page; none where there is no page or it can't be read."""

    def eval(self, html: str):
        if html is None:
            return
        try:
            page = Page(html)
        except AssertionError:  # the tokenizer's word for markup it rejects
            return
        for pos, (tag, parent, own) in enumerate(zip(page.tag, page.parent, page.own)):
            # what is above the document is nowhere; equal markup counts as one element
            above = page.parent[parent] if parent >= 0 else -2
            yield pos, parent, page.twin[above] if above >= 0 else above, tag, own


def register(spark: SparkSession, name: str = NAME) -> str:
    """Make the function known to SQL: ``FROM pages p, LATERAL page_nodes(p.html) n``."""
    spark.udtf.register(name, PageNodes)
    return name
