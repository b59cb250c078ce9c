"""Queries of the file readers: tables are written to the shared folder in the format of a reader, and read by it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import matrix as M
from tessera.shared import shared_folder
from tessera.sources import files as S
from tessera.sources.tables import table


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def s2_read_matrix(spark, d):
    cells = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("row_id"), F.col("event_type").alias("col_id")).agg(F.round(F.sum("value"), 4).alias("value"))
    kinds = [r[0] for r in cells.select("col_id").distinct().orderBy("col_id").collect()]
    path = _folder(spark)
    M.write_matrix(cells, kinds, path)
    return M.read_matrix(spark, path).select("row_id", "col_id", F.round("value", 4).alias("value"))


def _classes(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("match"))


def _sums(rows, features):
    return rows.groupBy("match").agg(F.count("*").alias("n"), *[F.round(F.sum(features[i]), 2).alias(f"f{i}") for i in range(3)])


def s4_read_matches(spark, d):
    path = _folder(spark)
    _classes(spark, d).write.csv(path)
    return _sums(S.read_matches(spark, path), F.col("features"))


def s6_read_libsvm(spark, d):
    from pyspark.ml.functions import vector_to_array

    path = _folder(spark)
    line = F.concat_ws(" ", "match", *[F.concat(F.lit(f"{i}:"), c) for i, c in enumerate(("l_quantity", "l_discount", "l_tax"), 1)])
    _classes(spark, d).select(line.alias("value")).write.text(path)
    rows = S.read_libsvm(spark, path, 3).select(F.col("label").cast("int").alias("match"), vector_to_array("features").alias("features"))
    return _sums(rows, F.col("features"))


def s7_read_entries(spark, d):
    path = _folder(spark)
    parts = table(spark, d, "part")
    summary = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("s"), "p_partkey"))
    entries = parts.select(F.concat("p_name", F.lit(" "), "p_partkey").alias("title"), summary.alias("summary"), F.when(F.col("p_partkey") % 3 < 2, F.concat(F.lit("d"), "p_partkey")).alias("description"), F.lit("P").alias("publisher"))
    entries.write.format("xml").option("rowTag", "item").save(path)
    return S.read_entries(spark, path)


def s8_extract_xml_fields(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    price = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<price>"), F.col("o_custkey"), F.lit("</price>"))).otherwise(F.lit("<price></price>"))
    xml = F.concat(F.lit("<r><id>"), F.col("o_orderkey"), F.lit("</id><id>x</id>"), price, F.lit("</r>"))
    rows = orders.select("o_orderkey", xml.alias("xml"))
    told = rows.select("o_orderkey", S.xml_value(F.col("xml"), "id").alias("first_id"), S.xml_value(F.col("xml"), "price").alias("price"), S.xml_value(F.col("xml"), "none").alias("none"))
    records = S.xml_records(rows, "xml", ["id", "price"]).groupBy("o_orderkey").agg(F.count("*").alias("records"))
    return told.join(records, "o_orderkey", "left").withColumn("records", F.coalesce("records", F.lit(0)).cast("long"))


def s9_model_tables(spark, d):
    docs = table(spark, d, "documents")
    path = _folder(spark)
    S.save_model_tables({"lang": docs.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n")), "source": docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))}, path)
    tables = S.load_model_tables(spark, path, ["lang", "source"])
    return tables["lang"].withColumn("kind", F.lit("lang")).unionByName(tables["source"].withColumn("kind", F.lit("source")))


QUERIES = {f.__name__: f for f in (s2_read_matrix, s4_read_matches, s6_read_libsvm, s7_read_entries, s8_extract_xml_fields, s9_model_tables)}

_SUMS = "SELECT (l_returnflag = 'R')::INT AS match, count(*) AS n, round(sum(l_quantity), 2) AS f0, round(sum(l_discount), 2) AS f1, round(sum(l_tax), 2) AS f2 FROM lineitem GROUP BY 1"

ORACLE_SQL = {
    "s2_read_matrix": "WITH e AS (SELECT user_id::VARCHAR AS row_id, event_type AS col_id, round(sum(value), 4) AS value FROM events GROUP BY 1, 2) SELECT r.row_id, c.col_id, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT row_id FROM e) r CROSS JOIN (SELECT DISTINCT col_id FROM e) c LEFT JOIN e ON e.row_id = r.row_id AND e.col_id = c.col_id",
    "s4_read_matches": _SUMS,
    "s6_read_libsvm": _SUMS,
    "s7_read_entries": "SELECT p_name || ' ' || p_partkey::VARCHAR AS title, CASE p_partkey % 3 WHEN 0 THEN 's' || p_partkey::VARCHAR WHEN 1 THEN 'd' || p_partkey::VARCHAR ELSE '' END AS text, 'P' AS publisher FROM part",
    "s8_extract_xml_fields": "SELECT o_orderkey, o_orderkey::VARCHAR AS first_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE '-1' END AS price, '-1' AS none, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS records FROM orders",
    "s9_model_tables": "SELECT lang AS name, count(*) AS n, 'lang' AS kind FROM documents GROUP BY 1 UNION ALL SELECT source, count(*), 'source' FROM documents GROUP BY 1",
}
