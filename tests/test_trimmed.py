"""Strings that end with digits keep them: a function passed to transform whose second parameter is no index would trim the element's number."""

import json

from pyspark.sql import functions as F

from loomnote.operators import models, narrative


def test_narrative_strings_keep_digits(spark):
    said = json.dumps({"news": ["card 10", " 1 is 1 ", "2 of 22", "  "]})
    got = spark.createDataFrame([(said,)], "reply string").select(narrative._strings(F.col("reply"), "news").alias("s")).first()["s"]
    assert got == ["card 10", "1 is 1", "2 of 22"]


def test_extracted_facts_keep_digits(spark):
    rows = spark.createDataFrame([("a", 0, 9, "ation", "station 100\n1 nation 11\nother")], "path string, start long, end long, entity string, text string")
    assert [r["facts"] for r in models.extracted_facts(rows, models.line_model)[0].collect()] == [["station 100", "1 nation 11"]]
