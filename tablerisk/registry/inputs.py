"""Private-table views of the driver's tables, shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerisk.functions.durable import durable
from tablerisk.functions.keyed import STREAM_QUERY, keyed_hash, with_hashes
from tablerisk.operators.nearest import achilles_scores
from tablerisk.operators.prep import discretize, minmax_normalize, prepare_table
from tablerisk.sources.tables import load_table
from tablerisk.spec import ID, TableSpec

PART = TableSpec(("p_brand", "p_type"), ("p_size", "p_retailprice"), ("p_retailprice",))
STATUS = ("F", "O", "P")
PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ORDERS = TableSpec(
    ("o_orderstatus", "o_orderpriority"),
    ("band",),
    (),
    {"o_orderstatus": (0, 1, 2), "o_orderpriority": (0, 1, 2, 3, 4)},
    ("o_orderstatus", "o_orderpriority", "band"),
)
CUSTOMER_COLUMNS = ("c_nationkey", "c_mktsegment", "band")
CUSTOMERS = TableSpec(
    ("c_nationkey", "c_mktsegment"),
    ("band",),
    (),
    {"c_nationkey": tuple(range(25)), "c_mktsegment": (0, 1, 2, 3, 4)},
    CUSTOMER_COLUMNS,
)
EVENTS = TableSpec(
    ("event_type",),
    ("value", "hour"),
    (),
    {"event_type": (0, 1, 2, 3, 4, 5)},
    ("event_type", "value", "hour"),
)
LINE = TableSpec(("l_returnflag", "l_linestatus"), ("l_quantity", "l_discount"))
LOG_WIDTH = 6


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def part(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, f"{folder}/part.parquet", PART, id_column="p_partkey")


def part_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all parts, rounded so that ties do not hang on the last bit."""
    prepared, spec = prepare_table(part(spark, folder), PART)
    scores = achilles_scores(prepared, spec, k=5)
    return scores.withColumn("achilles_score", F.round("achilles_score", 9))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, c_nationkey, c_mktsegment (code), band of the balance."""
    df = read(spark, folder, "customer").select(
        F.col("c_custkey").alias(ID),
        F.col("c_nationkey").cast("bigint").alias("c_nationkey"),
        "c_mktsegment",
        F.floor(F.col("c_acctbal") / 1000.0).alias("band"),
    )
    coded, _ = discretize(df, ["c_mktsegment"])
    # the prepared private table is stored once, as every audit reads it many times
    return durable(coded.withColumn("c_mktsegment", F.col("c_mktsegment").cast("bigint")))


def one_record(df: DataFrame, record_id: int = 5) -> DataFrame:
    return df.filter(F.col(ID) == record_id)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, status and priority codes, band of the price."""
    df = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias(ID),
        "o_orderstatus",
        "o_orderpriority",
        F.floor(F.col("o_totalprice") / 10000.0).alias("band"),
        "o_custkey",
    )
    coded, _ = discretize(df, ["o_orderstatus", "o_orderpriority"])
    return coded.select(
        ID,
        F.col("o_orderstatus").cast("bigint").alias("o_orderstatus"),
        F.col("o_orderpriority").cast("bigint").alias("o_orderpriority"),
        "band",
        "o_custkey",
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty tables of events: target_id, dataset_id, record_id, event_type (code), value, hour."""
    df = read(spark, folder, "events").select(
        F.lit(0).cast("bigint").alias("target_id"),
        (F.col("user_id") % 20).alias("dataset_id"),
        F.col("event_id").alias(ID),
        "event_type",
        "value",
        F.hour("ts").cast("double").alias("hour"),
    )
    coded, _ = discretize(df, ["event_type"])
    return coded


def event_target(df: DataFrame) -> DataFrame:
    """The event with id 0 as the target (target_id 0)."""
    return df.filter(F.col(ID) == 0).drop("target_id", "dataset_id")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """The four audited lineitem columns, flags as codes."""
    df = read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"
    )
    coded, _ = discretize(df, ["l_returnflag", "l_linestatus"])
    return coded


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """A log of six-column count queries hashed from the events -> query_id, solution_id, conditions."""
    df = read(spark, folder, "events").select(
        F.col("event_id").alias("query_id"), (F.col("user_id") % 10).alias("solution_id")
    )
    streams = {f"__h{i}": STREAM_QUERY + i for i in range(LOG_WIDTH)}
    hashed = with_hashes(df, 17, ["query_id"], streams)
    codes = [(F.col(f"__h{i}") % 3 - 1).cast("int") for i in range(LOG_WIDTH)]
    log = hashed.select("query_id", "solution_id", F.array(*codes).alias("conditions"))
    return durable(log)  # a real log is a stored table, not an expression


def one_of_each(df: DataFrame, column: str) -> DataFrame:
    """The record with the lowest id for every value of a column: the audited targets."""
    chosen = df.groupBy(column).agg(F.min(ID).alias(ID)).select(ID)
    return df.join(chosen, ID, "left_semi")


def half(df: DataFrame, seed: int, bit: int) -> DataFrame:
    """About half of the records, by a hash bit of the id."""
    return df.filter(keyed_hash(seed, ID, 3).bitwiseAND(F.lit(1)) == bit)


def document_features(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric text features of labelled documents -> doc_id, label, phase, features."""
    docs = read(spark, folder, "documents").join(
        read(spark, folder, "labels").select("doc_id", "quality"), "doc_id"
    )
    text = F.col("text")
    size = F.greatest(F.length(text), F.lit(1))

    def share(pattern: str):
        """Characters of a class, as those that are missing once it is removed: most texts hold few of them."""
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / size

    train = keyed_hash(3, "doc_id", 5) % 4 != 0
    return docs.select(
        "doc_id",
        F.col("quality").cast("int").alias("label"),
        F.when(train, "train").otherwise("eval").alias("phase"),
        F.array(
            F.log1p(F.col("n_chars").cast("double")),
            F.size(F.split(text, " ")) / size,
            F.size(F.split(text, "\n")) / size,
            share("[0-9]"),
            share("[A-Z]"),
            share("[.,!?]"),
        ).alias("features"),
    )


def scaled_part(spark: SparkSession, folder: str) -> DataFrame:
    df = part(spark, folder)
    return minmax_normalize(df, ["p_size", "p_retailprice"], half(df, 1, 0))
