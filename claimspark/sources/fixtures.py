"""Claims subject tables bound to the driver's TPC-H-style test tables.

The reference runs against warehouse tables we do not have.  These frames give
the same shapes (medical events, pharmacy events, providers, demographics,
geography, plans) as lazy projections of the test tables, so every query's
work grows with the input.  The binding is stated once as SQL in FIXTURES.md;
this module builds the same frames with the DataFrame API, and the DuckDB
oracles in ``__spark_entry__`` use the SQL text, so the two sides are written
independently.

Nothing here is cached or collected: each frame is a plan over parquet scans,
so column pruning and filter pushdown reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.sources.catalog import read_parquet


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: Column, mapping: list[tuple[object, object]], default: object) -> Column:
    """``CASE col WHEN k THEN v ... ELSE default END`` as a Spark column."""
    expr = None
    for key, value in mapping:
        v = F.lit(value)
        expr = F.when(col == key, v) if expr is None else expr.when(col == key, v)
    return expr.otherwise(F.lit(default))


# Fixed values of the binding (see FIXTURES.md part B).
PROCEDURE_BY_LINE = [
    (1, "22612"), (2, "22630"), (3, "22633"), (4, "S2900"), (5, "99213"), (6, None),
]
PROCEDURE_OTHER_LINES = "27447"
SPECIALTY_BY_MOD3 = [(0, "ORTHO"), (1, "NEURO")]
SPECIALTY_OTHER = "PAIN"
PRESCRIBERS_PER_PRACTICE = 7
MONTH_NAMES = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def _lines_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order header: a join of two fact-sized tables.

    It is declared a shuffle (sort-merge) join: neither side has a size bound,
    so neither may be broadcast, whatever a small test file suggests.  With
    adaptive execution a sort-merge join whose partitions all turn out small
    is run as a shuffled hash join instead (a measured, size-checked switch).
    """
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return li.join(orders.hint("merge"), li["l_orderkey"] == orders["o_orderkey"], "inner")


def medical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per order line; the lines of one order share patient and date."""
    return events_from_lines(_lines_with_orders(spark, sf_dir))


def events_from_lines(j: DataFrame) -> DataFrame:
    """The medical-event projection of order lines joined to their orders
    (works on a batch or a streaming frame)."""
    iso = F.col("o_orderdate").cast("date").cast("string")
    year, month, day = F.substring(iso, 1, 4), F.substring(iso, 6, 2), F.substring(iso, 9, 2)
    name = F.substring(F.lit(MONTH_NAMES), month.cast("int") * 3 - 2, F.lit(3))
    date_text = (F.when(F.col("l_orderkey") % 103 == 1, F.concat_ws("/", month, day, year))
                 .when(F.col("l_orderkey") % 103 == 2, F.concat_ws("-", day, name, year)).otherwise(iso))
    return j.select(
        F.col("o_custkey").alias("patient_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("medical_event_id"),
        _case(F.col("l_linenumber"), PROCEDURE_BY_LINE, PROCEDURE_OTHER_LINES)
        .cast("string").alias("procedure_code"),
        F.when(F.col("l_orderkey") % 101 == 0, F.lit("bad-date"))
        .otherwise(date_text).alias("service_date"),
        F.when(F.col("l_linestatus") == "F", F.lit("24")).otherwise(F.lit("11"))
        .alias("place_of_service"),
        F.when(F.col("l_suppkey") % 50 == 7, F.lit(None).cast("bigint"))
        .otherwise(F.col("l_suppkey")).alias("rendering_npi"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("|M"), (F.col("l_partkey") % 40).cast("string"), F.lit("|")))
        .alias("diagnosis_codes"),
        F.when(F.col("l_returnflag") == "R", F.lit(None).cast("string"))
        .when(F.col("l_returnflag") == "A", F.lit("|HE|"))
        .when(F.col("l_linestatus") == "F", F.lit("|59|HE|"))
        .otherwise(F.lit("|59|")).alias("modifiers"),
        (F.col("l_partkey") % 30).alias("kh_plan_id"),
        ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("is_rejected"),
    )


def pharmacy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fill per order line.  Customers stand in for practices of seven
    prescribers (a sparse key, so two yearly snapshots differ); from 1998 on, one
    practice in ten does not record its prescribers."""
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(orders.hint("merge"), li["l_orderkey"] == orders["o_orderkey"], "inner")
    unknown = (F.col("o_custkey") % 10 == 3) & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("date"))
    return j.select(
        F.col("o_custkey").alias("patient_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pharmacy_event_id"),
        F.col("l_shipdate").cast("date").alias("fill_date"),
        F.when(unknown, F.lit(None).cast("bigint"))
        .otherwise(F.col("o_custkey") * 10 + F.col("l_linenumber")).alias("prescriber_npi"),
    )


def prescribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory of the prescribers of ``pharmacy_events``, plus one with a null NPI."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    c = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(PRESCRIBERS_PER_PRACTICE))))
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    listed = c.join(n, c["c_nationkey"] == n["n_nationkey"], "inner").select(
        (F.col("c_custkey") * 10 + F.col("k")).alias("npi"),
        F.concat_ws(" ", "c_name", "k").alias("first_name"),
        _case(F.col("c_custkey") % 3, SPECIALTY_BY_MOD3, SPECIALTY_OTHER).alias("primary_specialty"),
        F.col("n_name").alias("provider_state"),
        (F.lit(10000) + F.col("c_custkey") % 900).cast("string").alias("provider_zip"),
    )
    return listed.unionByName(_unlisted(spark))


def _unlisted(spark: SparkSession) -> DataFrame:
    """The directory row with a null key."""
    return spark.range(1).select(
        F.lit(None).cast("bigint").alias("npi"),
        F.lit("Unlisted").alias("first_name"),
        F.lit("UNKNOWN").alias("primary_specialty"),
        F.lit(None).cast("string").alias("provider_state"),
        F.lit(None).cast("string").alias("provider_zip"),
    )


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as providers, plus one provider with a null NPI."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    listed = s.join(n, s["s_nationkey"] == n["n_nationkey"], "inner").select(
        F.col("s_suppkey").alias("npi"),
        F.col("s_name").alias("first_name"),
        _case(F.col("s_suppkey") % 3, SPECIALTY_BY_MOD3, SPECIALTY_OTHER).alias("primary_specialty"),
        F.col("n_name").alias("provider_state"),
        (F.lit(10000) + F.col("s_suppkey") % 900).cast("string").alias("provider_zip"),
    )
    return listed.unionByName(_unlisted(spark))


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 in 97 patients has an unparseable birth date, 1 in 3 has no gender."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return c.select(
        k.alias("patient_id"),
        F.when(k % 97 == 0, F.lit("unknown"))
        .otherwise(F.concat((F.lit(1930) + k % 80).cast("string"), F.lit("-01-01")))
        .alias("patient_yob"),
        F.when(k % 3 == 0, F.lit("F")).when(k % 3 == 1, F.lit("M"))
        .otherwise(F.lit(None).cast("string")).alias("patient_gender"),
    )


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 in 10 patients missing, 1 in 20 with two rows (the fan-out case)."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    first = c.filter(k % 10 != 0).select(
        k.alias("patient_id"), F.col("c_nationkey").alias("geo_id"))
    second = c.filter(k % 20 == 1).select(
        k.alias("patient_id"), (F.col("c_nationkey") + 100).alias("geo_id"))
    return first.unionByName(second)


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"], "inner").select(
        F.col("n_nationkey").cast("bigint").alias("kh_plan_id"),
        F.concat(F.lit("Payer "), F.col("n_name")).alias("payer_name"),
        F.col("r_name").alias("parent_name"),
    )


class ClaimsTables:
    """The subject tables of one data set, as lazy frames.

    Each frame is built on first access only, so a query that touches two
    tables does not pay the (driver-side) plan construction of six.
    """

    _BUILDERS = {
        "medical_events": medical_events,
        "pharmacy_events": pharmacy_events,
        "providers": providers,
        "prescribers": prescribers,
        "demographics": demographics,
        "geography": geography,
        "plans": plans,
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._sf_dir = sf_dir
        self._built: dict[str, DataFrame] = {}

    def _get(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._BUILDERS[name](self._spark, self._sf_dir)
        return self._built[name]

    medical_events = property(lambda self: self._get("medical_events"))
    pharmacy_events = property(lambda self: self._get("pharmacy_events"))
    providers = property(lambda self: self._get("providers"))
    prescribers = property(lambda self: self._get("prescribers"))
    demographics = property(lambda self: self._get("demographics"))
    geography = property(lambda self: self._get("geography"))
    plans = property(lambda self: self._get("plans"))


def claims_tables(spark: SparkSession, sf_dir: str) -> ClaimsTables:
    """The subject tables over ``sf_dir``, defined anew: schemas and file
    listings are those of the moment, never of an earlier query."""
    return ClaimsTables(spark, sf_dir.rstrip("/"))
