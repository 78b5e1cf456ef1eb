"""Views of the driver's tables as the engine's inputs: a lexicon out of orders, submissions out of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.answers import latest_reviews
from lexiloom.operators.lexicon import Lexicon
from lexiloom.plans import references
from lexiloom.sources.tables import table


#: Size of the alphabet: characters are part numbers modulo this; None for the part numbers themselves, an alphabet that grows with the data.
GLYPHS: int | None = 500


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """One word for each order of at most five lines, a character for each line, and one shape-coded character for each part below 500."""
    line, orders, part = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    number = F.col("l_partkey") if GLYPHS is None else F.col("l_partkey") % GLYPHS
    # only numbers are gathered, and a word is spelled before it meets the other tables
    gathered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", number.alias("number"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("marked"))))
    mark = lambda x: F.when(F.col("l_orderkey") % 53 == 0, ";B423").when(x["marked"], ";B97").otherwise("")
    glyph = lambda x: F.concat(F.lit("B"), x["number"].cast("string"), mark(x))
    lines = line.groupBy("l_orderkey").agg(gathered.alias("a")).where(F.size("a") <= 5).select("l_orderkey", F.array_join(F.transform("a", glyph), "/").alias("glyphs"), F.col("a")[0]["l_partkey"].alias("first_part"))
    words = lines.join(orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey")).join(part.select("p_partkey", "p_name", "p_brand", "p_type"), F.col("p_partkey") == F.col("first_part"))
    status, key, name, kind = F.col("o_orderstatus"), F.col("l_orderkey"), F.col("p_name"), F.lower("p_type")
    second = F.split_part(name, F.lit(" "), F.lit(2))
    gloss = F.when(key % 6 == 0, name).when(key % 6 == 1, F.concat(name, F.lit(", "), "p_brand")).when(key % 6 == 2, F.concat(name, F.lit(" ("), kind, F.lit(")")))
    gloss = gloss.when(key % 6 == 3, F.concat(second, F.lit("(s)"))).when(key % 6 == 4, F.concat(name, F.lit(" - ("), kind, F.lit(")"))).otherwise(F.concat(F.lit("grey "), second, F.lit("; centre "), "p_brand"))
    ending = F.when(status == "F", ";;B81").when(status == "P", ";;B86").otherwise("")
    word = words.select(
        F.concat(F.lit("B"), (key + 100000).cast("string")).alias("id"), (key + 100000).alias("numeric_id"), F.concat("glyphs", ending).alias("code"),
        F.concat(F.when(status == "F", "to ").otherwise(""), gloss).alias("gloss"), F.when(status == "F", "action").when(status == "P", "description").otherwise("noun").alias("pos"),
        (key % 37 == 0).alias("is_char"), (key % 23 != 0).alias("is_word"), (key % 101 == 0).alias("is_indicator"), (key % 29 == 0).alias("is_non_preferred"),
        F.concat(name, F.lit("_ from  "), "p_brand").alias("explanation"),
    )
    number_of = F.col("p_partkey")
    shape = part.where(number_of < 500).select(
        F.concat(F.lit("B"), number_of.cast("string")).alias("id"), number_of.alias("numeric_id"), F.concat(F.lit("VL"), F.col("p_size").cast("string"), F.lit(":0,8")).alias("code"),
        F.col("p_name").alias("gloss"), F.lit("noun").alias("pos"), F.lit(True).alias("is_char"), F.lit(False).alias("is_word"), F.lit(False).alias("is_indicator"), F.lit(False).alias("is_non_preferred"), F.lit(None).cast("string").alias("explanation"),
    )
    return word.unionByName(shape).withColumn("ordinal", F.col("numeric_id"))


def raw_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a snapshot has them: numbers as ids, flags that are only there where they hold, and some entries without gloss."""
    e = entries(spark, sf)
    flag = lambda c, name: F.when(F.col(c), True).alias(name)
    return e.select(F.col("numeric_id").alias("id"), F.when(F.col("numeric_id") % 13 != 0, F.col("gloss")).alias("gloss"), "code", F.when(F.col("pos") != "noun", F.col("pos")).alias("pos"), "explanation", flag("is_char", "isChar"), flag("is_word", "isWord"), flag("is_indicator", "isIndicator"), flag("is_non_preferred", "isNonPreferred"))


_LEXICONS: dict[tuple, Lexicon] = {}


def lexicon(spark: SparkSession, sf: str) -> Lexicon:
    """The lexicon of a folder, parsed once in a session."""
    key = (spark.sparkContext.applicationId, sf, GLYPHS)
    if key not in _LEXICONS:
        _LEXICONS.clear()  # one at a time: its tables stay in the shared folder until they're dropped
        _LEXICONS[key] = Lexicon(entries(spark, sf), references.indicators(spark), references.MODIFIERS, references.EXCEPTIONS, latest_reviews(table(spark, sf, "answer_alias_curation")))
    return _LEXICONS[key]


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """A submission for each event about one of the lexicon's words: lists, prose, objects, empty and mixed lists, some without a target; a tenth is sent twice."""
    events, orders, part = table(spark, sf, "events"), table(spark, sf, "orders"), table(spark, sf, "part")
    sizes = orders.agg(F.count(F.lit(1)).alias("n_orders")).crossJoin(part.agg(F.count(F.lit(1)).alias("n_part")))  # one row
    lex = entries(spark, sf).select("numeric_id", F.col("gloss").alias("own"))
    e = events.select("event_id", "user_id", "event_type").crossJoin(F.broadcast(sizes)).withColumn("no", 100000 + (F.col("event_id") * 7919) % F.col("n_orders"))
    e = e.join(part.select("p_partkey", F.col("p_name").alias("b")), F.col("p_partkey") == F.col("event_id") % F.col("n_part")).join(lex, F.col("numeric_id") == F.col("no"), "left").withColumn("a", F.coalesce("own", "b"))
    q = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts)])
    k = F.col("event_id") % 5
    sent = F.when(k == 0, q('["', "a", '","', "b", '"]')).when(k == 1, q('Guess: ["', "a", '"] Note: [x: y]')).when(k == 2, q('{"candidates":["', "b", '"]}')).when(k == 3, F.lit("[]")).otherwise(q('["', "b", '",1,["', "a", '"]]'))
    one = e.select(
        F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", None).otherwise(F.concat(F.lit("B"), F.col("no").cast("string"))).alias("targetId"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("runner"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("promptVersion"), sent.alias("candidates"), F.lit(None).cast("string").alias("rawResponseText"),
    )
    again = one.where(F.col("ord") % 10 == 0).select((F.col("ord") + 1_000_000_000).alias("ord"), "targetId", "runner", "promptVersion", F.lit('["unknown"]').alias("candidates"), "rawResponseText")
    return one.unionByName(again)
