"""Event records made from the given tables.

The raw event file is not part of the test data. ``raw_events`` gives orders joined to
their customers the names, types and awkward values of raw events: missing actors, one
actor with a third of all rows, malformed, recoded and colliding codes, missing places.
``activity`` gives the user events a numeric label and features for sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.encoding import fit_dictionary
from eventloom.schemas import GEO_DEGREES, RAW
from eventloom.session import shared_dir

# Codes in slots of four characters, the last one blank.
CODE_SLOTS = (
    "010 02110420043 046 044 041 045 020 021 040 042 051 061 071 084 090 "
    "1056111 120 138 145 150 163 173 190 200 --- X   042 043 046     "
)

# Expressions both engines read alike; the types are set by the casts around them.
EXPRESSIONS = {
    "Date": "cast(year(o_orderdate)*10000 + month(o_orderdate)*100 + day(o_orderdate) as string)",
    "Source": "case when o_orderkey % 97 = 0 then null when o_orderkey % 3 = 0 then 'USA' "
    "else concat('N', cast(c_nationkey as string)) end",
    "Target": "concat(substr(c_mktsegment, 1, 3), '_', substr(o_orderpriority, 1, 1))",
    "CAMEOCode": f"nullif(trim(substr('{CODE_SLOTS}', 1 + 4*cast((o_orderkey*7) % 33 as int), 4)), '')",
    "NumEvents": "1 + o_custkey % 50",
    "NumArts": "1 + o_orderkey % 200",
    "QuadClass": "case when o_orderkey % 89 = 0 then 'x' else cast(1 + o_orderkey % 4 as string) end",
    "Goldstein": "case when o_orderkey % 83 = 0 then null "
    "else concat(cast(o_custkey % 10 as string), '.', cast(o_orderkey % 10 as string)) end",
    "SourceGeoType": "cast(nullif(c_nationkey % 6, 5) as string)",
    "SourceGeoLat": "case when o_orderkey % 13 = 0 then null else o_totalprice/500000.0*180.0 - 90.0 end",
    "SourceGeoLong": "case when o_orderkey % 13 = 0 then null else o_totalprice/500000.0*360.0 - 180.0 end",
    "TargetGeoType": "nullif(o_custkey % 7, 6)",
    "TargetGeoLat": "c_acctbal/10000.0*90.0",
    "TargetGeoLong": "c_acctbal/10000.0*180.0",
    "ActionGeoType": "nullif(o_orderkey % 5, 4)",
    "ActionGeoLat": "case when o_orderkey % 11 = 0 then null else 90.0 - o_totalprice/500000.0*180.0 end",
    "ActionGeoLong": "case when o_orderkey % 11 = 0 then null else 180.0 - o_totalprice/500000.0*360.0 end",
}
LOOKUP_CODE = (
    "case when p_partkey <= 20 then lpad(cast(p_partkey as string), 2, '0') "
    "when p_partkey < 1000 then lpad(cast(p_partkey as string), 3, '0') "
    "else cast(p_partkey as string) end"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict[tuple[str, str], DataFrame] = {}


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rid`` and the raw columns, written once per application: queries start from a raw table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = f"{shared_dir(spark)}/eventloom/raw-events-{uuid.uuid4().hex}"
        with_missing(make_raw_events(spark, sf_dir)).write.parquet(path)
        _stored[key] = spark.read.parquet(path)
    return _stored[key]


def with_missing(events: DataFrame) -> DataFrame:
    """Every second missing latitude and longitude is NaN, which the SQL knows as null."""
    odd = F.col("rid") % 2 == 1
    return events.withColumns(
        {c: F.when(odd, F.coalesce(c, F.lit(float("nan")))).otherwise(F.col(c)) for c in GEO_DEGREES}
    )


def make_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    columns = [
        f"cast({EXPRESSIONS[f.name]} as {f.dataType.simpleString()}) as {f.name}" for f in RAW.fields
    ]
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.selectExpr("o_orderkey as rid", *columns)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events: ``user_id, ts, event_id``, features ``value, hour, minute, kind`` and ``label``."""
    events = table(spark, sf_dir, "events")
    kinds = fit_dictionary(events, "event_type")
    return kinds.apply(events, "label").selectExpr(
        "user_id", "ts", "event_id", "value", "hour(ts) as hour", "minute(ts) as minute",
        "label as kind", "label",
    )


def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup (code, description): parts numbered like event codes of two to four digits."""
    return table(spark, sf_dir, "part").selectExpr(f"{LOOKUP_CODE} as code", "p_name as description")
