"""File sources: the CSV hand-off extract (S3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The extract's schema, stated explicitly: codes and dates stay text (a code
# such as '22612' must never become a number), ids are 64-bit integers.
EXTRACT_SCHEMA = T.StructType([
    T.StructField("patient_id", T.LongType()),
    T.StructField("medical_event_id", T.LongType()),
    T.StructField("procedure_code", T.StringType()),
    T.StructField("service_date", T.StringType()),
    T.StructField("place_of_service", T.StringType()),
    T.StructField("rendering_npi", T.LongType()),
    T.StructField("diagnosis_codes", T.StringType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("primary_specialty", T.StringType()),
    T.StructField("provider_state", T.StringType()),
    T.StructField("provider_zip", T.StringType()),
    T.StructField("payer_name", T.StringType()),
    T.StructField("kh_plan_id", T.LongType()),
    T.StructField("parent_name", T.StringType()),
    T.StructField("patient_yob", T.StringType()),
    T.StructField("patient_gender", T.StringType()),
])


# The dialect of both sides: quotes are doubled, blanks are data.
CSV_DIALECT = {
    "header": "true", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_extract_csv(spark: SparkSession, path: str,
                     schema: T.StructType = EXTRACT_SCHEMA) -> DataFrame:
    """S3: read a header CSV with a fixed schema (no inference pass).

    FAILFAST makes a malformed row an error instead of a silent null row.
    Values may hold line breaks (``multiLine``), so a file is one split; the
    writer bounds the rows of a file.  An empty field is null.
    """
    return (spark.read.schema(schema)
            .options(**CSV_DIALECT)
            .option("multiLine", True)
            .option("mode", "FAILFAST")
            .csv(path))
