"""Delimited member extracts: UTF-16, tab-separated, strict schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import strip
from .utf16 import read_table

# The tokens that mean a missing field.  'Null' is not one, it is a label.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Date spellings that the extracts mix.
DATE_FORMATS = ("d MMMM yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy")


@dataclass(frozen=True)
class Extract:
    """One file: its name, its columns as source header -> canonical name, and which are dates or numbers."""

    filename: str
    columns: dict[str, str]
    dates: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Study:
    """The four tables of a study, lazily."""

    demographics: DataFrame
    weights: DataFrame
    engagement: DataFrame
    modules: DataFrame
    extra: dict = field(default_factory=dict)


# The source files' names and headers.
MODULES = Extract(
    "Data Analyst Case Study Doc 1 - 12 Weeks Weight Loss Modules Completion.csv",
    {"Readable Id": "member_id", "Questionnaire Title (All Questionnaire Records)": "questionnaire_title", "Day of Answered At (All Questionnaire Records)": "answered_at"},
    dates=("answered_at",),
)
DEMOGRAPHICS = Extract(
    "Data Analyst Case Study Doc 2 - Demographics.csv",
    {
        "Readable Id": "member_id", "Day of Start Date": "start_date", "Status (Subscriptions)": "subscription_status",
        "cancellation_date": "cancellation_date", "Sex": "sex", "ethnicity": "ethnicity"
    },
    dates=("start_date", "cancellation_date"),
)
ENGAGEMENT = Extract(
    "Data Analyst Case Study Doc 3 - Engagement Data.csv",
    {"Readable Id": "member_id", "Day of Activity Timestamp": "activity_at", "Type": "event_type"},
    dates=("activity_at",),
)
WEIGHTS = Extract(
    "Data Analyst Case Study Doc 4 - BW_Detail.csv",
    {
        "User Id": "member_id",
        "Weight-loss Member Type": "member_type",
        "Day of BW First Measurement Effective": "first_weight_at",
        "Day of BW Last Measurement Effective": "last_weight_at",
        "First": "first_weight",
        "Last": "last_weight",
        "Diff": "weight_difference",
        "BW Days between First/Last": "weight_days",
        "days in weight-loss program": "tenure_days",
    },
    dates=("first_weight_at", "last_weight_at"),
    numbers=("first_weight", "last_weight", "weight_difference", "weight_days", "tenure_days"),
)


def parse_date(text: Column) -> Column:
    """A timestamp without zone from any of the known spellings; another non-null spelling fails the query."""
    tried = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")
    return F.when(text.isNull(), F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce(tried, F.raise_error(F.concat(F.lit("not a date: "), text)).cast("timestamp_ntz")))


def read_extract(spark: SparkSession, path: str, spec: Extract) -> DataFrame:
    """The extract's columns under canonical names, trimmed and typed.

    Headers are stripped, unnamed trailing columns that hold nothing are
    dropped, further columns are ignored.  A missing file or column is an
    error that names it; a bad date or number fails the query.  A large file
    is read by many tasks, line feeds in quotes included.
    """
    raw = read_table(spark, path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    absent = sorted(set(spec.columns) - set(raw.columns))
    if absent:
        raise ValueError(f"{spec.filename} has no column {', '.join(absent)}")

    def value(source: str, name: str) -> Column:
        text = strip(F.col(f"`{source}`"))
        text = F.when(F.col(f"`{source}`").isin(*MISSING_TOKENS) | text.isin(""), F.lit(None)).otherwise(text)
        if name in spec.dates:
            return parse_date(text)
        return text.cast("double") if name in spec.numbers else text

    return raw.select(*[value(s, n).alias(n) for s, n in spec.columns.items()])


def load_study(spark: SparkSession, folder: str) -> Study:
    """The four extracts of a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for spec in (MODULES, DEMOGRAPHICS, ENGAGEMENT, WEIGHTS):
        if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{spec.filename}")):
            raise FileNotFoundError(f"{folder}/{spec.filename}")
    return Study(*[read_extract(spark, f"{folder}/{spec.filename}", spec) for spec in (DEMOGRAPHICS, WEIGHTS, ENGAGEMENT, MODULES)])
