"""Small reference tables for the driver's queries; every name here is invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODIFIERS = [
    {"spelling": "B9", "category": "number", "gloss": "many", "asPrefix": ["many"]},
    {"spelling": "B10", "category": "number", "gloss": "two", "asPrefix": ["two"]},
    {"spelling": "B11", "category": "number", "gloss": "three", "asPrefix": ["three"]},
    {"spelling": "B10/B117", "category": "number", "gloss": "double", "asPrefix": ["twice"]},
    {"spelling": "B449", "category": "negation", "gloss": "without", "asPrefix": ["not", "without"]},
    {"spelling": "B449/B401", "category": "negation", "gloss": "never", "asPrefix": ["never"]},
    {"spelling": "B368", "category": "intensity", "gloss": "much", "asPrefix": ["very"]},
    {"spelling": "B368/B368", "category": "intensity", "gloss": "most", "asPrefix": ["most"]},
]
#: A sequence that doesn't count before a character.
EXCEPTIONS = [("B10", "B4")]
INDICATORS = [("B81", "verbal", "doing", "marks an action"), ("B86", "adjectival", "being", "marks a quality"), ("B97", "nominal", "thing", "marks something concrete")]


def indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDICATORS, "code string, group string, name string, purpose string")
