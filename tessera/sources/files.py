"""Readers and writers of the library's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_movie_files(spark: SparkSession, titles_path: str, ratings_path: str) -> tuple[DataFrame, DataFrame]:
    """titles(id, title) of a `|` file and scores(user, id, rating, ts) of a tab file; further fields are left."""
    titles = spark.read.csv(titles_path, sep="|").select(F.col("_c0").alias("id"), F.col("_c1").alias("title"))
    scores = spark.read.schema("user string, id string, rating double, ts long").csv(ratings_path, sep="\t")
    return titles, scores


def read_matches(spark: SparkSession, path: str, all_numbers: bool = True) -> DataFrame:
    """(features, match) of a headerless csv file whose last field is the class; features are doubles or text."""
    rows = spark.read.csv(path)
    kind = "double" if all_numbers else "string"
    return rows.select(F.array(*[F.col(c).cast(kind) for c in rows.columns[:-1]]).alias("features"), F.col(rows.columns[-1]).cast("int").alias("match"))


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    """Flights of a csv file origin, dest, depart, arrive, price; idx is the place in the file within a route. One
    file is one split here, so that its order is known."""
    from pyspark.sql import Window

    from tessera.functions.text import minutes

    rows = spark.read.schema("origin string, dest string, depart string, arrive string, price int").csv(path).coalesce(1).withColumn("_n", F.monotonically_increasing_id())
    idx = F.row_number().over(Window.partitionBy("origin", "dest").orderBy("_n")) - 1
    return rows.select("origin", "dest", idx.alias("idx"), minutes(F.col("depart")).alias("depart_min"), minutes(F.col("arrive")).alias("arrive_min"), "price")


def read_libsvm(spark: SparkSession, path: str, features: int | None = None) -> DataFrame:
    """(label, features) of sparse index:value lines."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", str(features)) if features else reader).load(path)


ENTRY = "title string, summary string, description string, publisher string"


def read_entries(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """(title, text, publisher) of stored feeds in XML; text is the summary, else the description, else empty."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(ENTRY).load(path)
    return rows.select("title", F.coalesce("summary", "description", F.lit("")).alias("text"), "publisher")


def xml_value(xml: Column, tag: str) -> Column:
    """The first value of a tag in a stored response, '-1' where it is absent or empty."""
    return F.coalesce(F.nullif(F.xpath_string(xml, F.lit(f"//{tag}")), F.lit("")), F.lit("-1"))


def xml_records(rows: DataFrame, xml: str, tags: list[str]) -> DataFrame:
    """A row for each record of parallel tag lists; only as many as the shortest list has."""
    lists = rows.select("*", *[F.xpath(F.col(xml), F.lit(f"//{t}/text()")).alias(f"_{t}") for t in tags])
    n = F.least(*[F.size(f"_{t}") for t in tags]) if len(tags) > 1 else F.size(f"_{tags[0]}")
    each = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(*[F.element_at(F.col(f"_{t}"), i).alias(t) for t in tags]))
    return lists.select(*rows.columns, F.explode(each).alias("r")).select(*rows.columns, "r.*")


def save_model_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the tables of a model under a folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_model_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Read them again."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
