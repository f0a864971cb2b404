"""Declared record shapes. Readers use these instead of schema inference."""

from pyspark.sql import types as T

ARTICLE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("article", T.StringType()),
    T.StructField("highlights", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("stage", T.StringType()),
    T.StructField("emissions_kg", T.DoubleType()),
    T.StructField("emissions_g", T.DoubleType()),
])

# the nested single-file form of the ledger
REPORT = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("total_kg", T.DoubleType()),
    T.StructField("total_g", T.DoubleType()),
    T.StructField("records", T.ArrayType(T.StructType([
        T.StructField("timestamp", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("emissions_kg", T.DoubleType()),
        T.StructField("emissions_g", T.DoubleType()),
    ]))),
])

# one parsed page: parallel arrays, one entry per element / per text string
PARSED = T.StructType([
    T.StructField("tag", T.ArrayType(T.StringType())),      # element names in document order
    T.StructField("parent", T.ArrayType(T.IntegerType())),  # position of the parent, -1 = the document
    T.StructField("last", T.ArrayType(T.IntegerType())),    # position of the last descendant
    T.StructField("twin", T.ArrayType(T.IntegerType())),    # first element with equal markup
    T.StructField("s_from", T.ArrayType(T.IntegerType())),  # first string inside the element
    T.StructField("s_to", T.ArrayType(T.IntegerType())),    # one past the last string inside it
    T.StructField("text", T.ArrayType(T.StringType())),     # text strings in document order
    T.StructField("owner", T.ArrayType(T.IntegerType())),   # element that holds each string
    T.StructField("size", T.ArrayType(T.IntegerType())),    # length of each element's stripped text
    T.StructField("lines", T.ArrayType(T.IntegerType())),   # length of all earlier strings as lines
])

# the same, with the strings that each element holds itself
PARSED_WITH_OWN = T.StructType([*PARSED, T.StructField("own", T.ArrayType(T.StringType()))])

SUMMARY_RESPONSE = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("full_article", T.StringType()),
])
