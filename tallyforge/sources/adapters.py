"""The driver's tables as decks, cards, teachers, reviews, runs and pages, each with the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task sorts at most, if keys are spread evenly.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df in as many partitions by keys as its rows need, so that what a task sorts does not grow with the table.

    Where spark.sql.shuffle.partitions are enough, df as it is: later steps shuffle it by themselves.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for each line item: an equation a*x + b = c and its exact answer."""
    item = table(spark, sf_dir, "lineitem")
    item = spread(item, item.count(), "l_orderkey")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = item.select(
        F.col("l_orderkey").alias("deck_id"), number.cast("long").alias("number"), F.col("l_linenumber").cast("long").alias("a"), F.floor("l_quantity").cast("long").alias("b"), (F.col("l_partkey") % 100).alias("c"),
        F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"),
    )
    question = F.concat(F.col("a").cast("string"), F.lit("x + "), F.col("b").cast("string"), F.lit(" = "), F.col("c").cast("string"))
    return rows.withColumns({"card_id": F.col("deck_id") * 1000 + F.col("number"), "question": question, "n_alts": F.col("part") % 3, "misses": F.col("part") % 4})


CARDS = """cards AS (
  SELECT *, deck_id * 1000 + number AS card_id, CAST(a AS VARCHAR) || 'x + ' || CAST(b AS VARCHAR) || ' = ' || CAST(c AS VARCHAR) AS question,
    part % 3 AS n_alts, part % 4 AS misses,
    CASE WHEN (c - b) % a = 0 THEN 'x = ' || CAST((c - b) // a AS VARCHAR)
      ELSE 'x = ' || CAST((c - b) // gcd(c - b, a) AS VARCHAR) || '/' || CAST(a // gcd(c - b, a) AS VARCHAR) END AS solved
  FROM (SELECT l_orderkey AS deck_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS number,
    CAST(l_linenumber AS BIGINT) AS a, CAST(floor(l_quantity) AS BIGINT) AS b, l_partkey % 100 AS c, l_partkey AS part, l_returnflag AS flag FROM lineitem)
)"""


def decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("deck_id"), F.col("o_custkey").alias("owner_id"), F.concat(F.lit("Deck "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("subject"),
        F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") == "F").alias("published"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("C"), (F.col("o_orderkey") % 10).cast("string"))).otherwise("").alias("class_code"),
    )


DECKS = """decks AS (
  SELECT o_orderkey AS deck_id, o_custkey AS owner_id, 'Deck ' || CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS subject, o_orderdate AS created, o_orderstatus = 'F' AS published,
    CASE WHEN o_orderkey % 3 = 0 THEN 'C' || CAST(o_orderkey % 10 AS VARCHAR) ELSE '' END AS class_code FROM orders
)"""


def teachers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two customers of three are teachers, so that some decks have an owner that is not known."""
    rows = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    return rows.select(F.col("c_custkey").alias("teacher_id"), F.lower("c_name").alias("username"), F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("disabled"))


TEACHERS = """teachers AS (
  SELECT c_custkey AS teacher_id, lower(c_name) AS username, c_name AS name, c_acctbal < 0 AS disabled FROM customer WHERE c_custkey % 3 <> 0
)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 3).when(F.col("event_type") == "click", 4).otherwise(5)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("student_id"), (F.col("event_id") % 7).alias("card_id"), F.col("event_id").alias("seq"), "ts", grade.alias("grade"))


REVIEWS = """reviews AS (
  SELECT user_id AS student_id, event_id % 7 AS card_id, event_id AS seq, ts,
    CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS grade FROM events
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("student_id"), (F.col("event_id") % 40).alias("deck_id"), F.col("ts").alias("finished_at"), F.floor(F.col("value")).cast("long").alias("seconds")
    )


RUNS = """runs AS (
  SELECT event_id AS run_id, user_id AS student_id, event_id % 40 AS deck_id, ts AS finished_at, CAST(floor(value) AS BIGINT) AS seconds FROM events
)"""


def sheets(cards: DataFrame) -> DataFrame:
    """Cards numbered within sheets of 99, as problem numbers have two digits at most; deck_id becomes the sheet's."""
    return cards.withColumns({"deck_id": F.col("deck_id") * 1000 + F.floor((F.col("number") - 1) / 99), "number": (F.col("number") - 1) % 99 + 1})


SHEETS = "sheets AS (SELECT * REPLACE (deck_id * 1000 + (number - 1) // 99 AS deck_id, (number - 1) % 99 + 1 AS number) FROM cards)"


def worksheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worksheet text for each sheet of a deck: its problems as lines, then a key with the answers of returned items."""
    deck = sheets(cards(spark, sf_dir))
    line = F.concat(F.col("number").cast("string"), F.lit(") "), F.col("question"))
    key = F.when(F.col("flag") == "R", F.concat(F.col("number").cast("string"), F.lit(") K"), F.col("c").cast("string")))
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct("number", c.alias("line"))))), lambda x: x["line"]), "\n")
    return deck.groupBy("deck_id").agg(F.concat(ordered(line), F.lit("\nAnswer Key\n"), ordered(key)).alias("text"))
