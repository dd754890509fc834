"""Bibliographic records from dumped XML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_TEXT = T.StringType()
_MANY = T.ArrayType(_TEXT)

# Every element may repeat in such a record, so all of them are read as arrays.
_DC = T.StructType(
    [
        T.StructField(f"dc:{name}", _MANY)
        for name in (
            "title",
            "creator",
            "subject",
            "description",
            "publisher",
            "date",
            "type",
            "language",
            "source",
        )
    ]
)
RECORD_SCHEMA = T.StructType(
    [
        T.StructField(
            "header",
            T.StructType(
                [
                    T.StructField("_status", _TEXT),
                    T.StructField("identifier", _TEXT),
                    T.StructField("datestamp", _TEXT),
                    T.StructField("setSpec", _MANY),
                ]
            ),
        ),
        T.StructField("metadata", T.StructType([T.StructField("oai_dc:dc", _DC)])),
    ]
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Raw records with a fixed schema; nothing is inferred."""
    return (
        spark.read.format("xml")
        .option("rowTag", "record")
        .option("ignoreSurroundingSpaces", "false")
        .schema(RECORD_SCHEMA)
        .load(path)
    )


def select_records(
    records: DataFrame,
    set_spec: str | None = None,
    from_date: str | None = None,
    until_date: str | None = None,
) -> DataFrame:
    """Drop deleted records; keep a set and an inclusive range of days."""
    day = F.substring("header.datestamp", 1, 10)
    kept = records.where(~F.coalesce(F.col("header._status") == "deleted", F.lit(False)))
    if set_spec:
        kept = kept.where(F.array_contains("header.setSpec", set_spec))
    if from_date:
        kept = kept.where(day >= from_date)
    if until_date:
        kept = kept.where(day <= until_date)
    return kept


def _all(name: str) -> Column:
    return F.col(f"metadata.`oai_dc:dc`.`dc:{name}`")


def first_value(values: Column) -> Column:
    """First entry of a repeated field, or an empty string."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def joined_values(values: Column) -> Column:
    return F.coalesce(F.array_join(values, "; "), F.lit(""))


def to_table(records: DataFrame) -> DataFrame:
    """The ten columns of the raw table; repeated fields are joined."""
    return records.select(
        F.col("header.identifier").alias("identifier"),
        first_value(_all("title")).alias("title"),
        first_value(_all("description")).alias("abstract"),
        joined_values(_all("creator")).alias("authors"),
        first_value(_all("date")).alias("date"),
        joined_values(_all("subject")).alias("subjects"),
        first_value(_all("publisher")).alias("publisher"),
        joined_values(_all("type")).alias("types"),
        first_value(_all("language")).alias("language"),
        first_value(_all("source")).alias("source"),
    )


def load_records(
    spark: SparkSession,
    path: str,
    set_spec: str | None = None,
    from_date: str | None = None,
    until_date: str | None = None,
    max_records: int | None = None,
) -> DataFrame:
    """Records as a table; a limit takes the first ones by identifier, and by the other columns where identifiers repeat."""
    kept = select_records(read_records(spark, path), set_spec, from_date, until_date)
    table = to_table(kept)
    return table.orderBy(*table.columns).limit(max_records) if max_records else table


def list_sets(records: DataFrame) -> DataFrame:
    """Set ids found in the dump with their record counts."""
    return (
        records.select(F.explode("header.setSpec").alias("set_spec"))
        .groupBy("set_spec")
        .agg(F.count(F.lit(1)).alias("n"))
    )
