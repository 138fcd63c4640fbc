"""Inputs derived from the benchmark tables by SQL that reads the same in both engines.

``$name$`` stands for a benchmark table.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from hushmap.rules import DATA_ELEMENTS
from hushmap.session import spread


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


_elements = ", ".join(
    f"({ix}, {text(category)}, {text(entity)}, {text(sensitivity)})"
    for ix, (category, entity, sensitivity) in enumerate(DATA_ELEMENTS)
)

FIXTURES = {
    "data_element": f"""
SELECT * FROM (VALUES {_elements})
  AS de(ix, parameter_name, parameter_value, parameter_sensitivity)""",
    # Two services have a hash that nothing refers to.
    "dbservice_entity": """
SELECT 'svc-' || CAST(n_nationkey AS STRING) AS id,
       n_name AS name,
       CASE n_nationkey % 4 WHEN 0 THEN 'Mysql' WHEN 1 THEN 'Postgres' WHEN 2 THEN 'Redshift'
         ELSE 'Snowflake' END AS serviceType,
       replace('{~connection~: {~config~: {~hostPort~: ~db' || CAST(n_nationkey AS STRING)
         || '.c1.ap-south-' || CAST(n_nationkey % 3 AS STRING)
         || '.rds.amazonaws.com:3306~, ~ssl~: False}}},', '~', chr(39)) AS json,
       CAST(1700000000000 + n_nationkey AS BIGINT) AS updatedAt,
       'owner' || CAST(n_nationkey % 7 AS STRING) AS updatedBy,
       0 AS deleted,
       CASE WHEN n_nationkey % 9 = 8 THEN 'x' ELSE 'h' END || CAST(n_nationkey AS STRING)
         AS nameHash
FROM $nation$""",
    # Even keys carry a dotted suffix; four rows belong to no service.
    "dbservice_entity_meta_info": """
SELECT CASE WHEN n_nationkey % 6 = 5 THEN 'gone-' ELSE 'svc-' END || CAST(n_nationkey AS STRING)
         || CASE WHEN n_nationkey % 2 = 0 THEN '.meta' ELSE '' END AS dbservice_entity_id,
       n_name AS dbservice_entity_name,
       'amazonaws' AS source,
       r_name AS region
FROM $nation$ JOIN $region$ ON n_regionkey = r_regionkey""",
    "database_schema_entity": """
SELECT 'sch-' || CAST(s_suppkey AS STRING) AS id, '{}' AS json,
       CAST(1700000000000 + s_suppkey AS BIGINT) AS updatedAt,
       'owner' || CAST(s_suppkey % 7 AS STRING) AS updatedBy, 0 AS deleted,
       'h' || CAST(s_nationkey AS STRING) || '.p' || CAST(s_suppkey % 5 AS STRING)
         || '.q' || CAST(s_suppkey % 3 AS STRING) AS fqnHash,
       'schema_' || CAST(s_suppkey % 11 AS STRING) AS name
FROM $supplier$""",
    "table_entity": """
SELECT 't' || CAST(c_custkey AS STRING) AS id, '{}' AS json,
       CAST(1700000000000 + c_custkey AS BIGINT) AS updatedAt,
       'owner' || CAST(c_custkey % 7 AS STRING) AS updatedBy, 0 AS deleted,
       'h' || CAST(c_nationkey AS STRING) || '.p' || CAST(c_custkey % 5 AS STRING)
         || '.q' || CAST(c_custkey % 3 AS STRING) || '.t' || CAST(c_custkey % 17 AS STRING)
         AS fqnHash,
       c_name AS name
FROM $customer$""",
    # Every fourth hash has three parts only.
    "profiler_data_time_series": """
SELECT 'h' || CAST(c_nationkey AS STRING) || '.p' || CAST(c_custkey % 5 AS STRING)
         || '.q' || CAST(c_custkey % 3 AS STRING)
         || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '.t' || CAST(c_custkey % 17 AS STRING) END
         AS entityFQNHash,
       'table.tableProfile' AS extension,
       CASE WHEN c_custkey % 3 = 0 THEN 'tableProfile' ELSE 'columnProfile' END AS jsonSchema,
       CASE WHEN c_custkey % 50 = 0 THEN '{broken'
            ELSE replace('{~timestamp~: ' || CAST(1700000000000 + c_custkey AS STRING)
              || ', ~rowCount~: ' || CAST(c_custkey * 10 AS STRING)
              || '.0, ~columnCount~: ' || CAST(c_custkey % 40 AS STRING)
              || '.0, ~sizeInByte~: ' || CAST(c_custkey * 100 AS STRING)
              || '.0, ~profileSample~: 100.0, ~profileSampleType~: ~PERCENTAGE~, '
              || '~sampled~: True, ~createDateTime~: ~2024-01-02T03:04:'
              || CAST(10 + c_custkey % 50 AS STRING) || '.000000Z~},', '~', chr(39)) END AS json,
       '' AS operation,
       CAST(1700000000000 + c_custkey AS BIGINT) AS timestamp
FROM $customer$""",
    "column_ner_results": f"""
SELECT CAST(o_orderkey AS STRING) AS id,
       't' || CAST(o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000 ELSE 0 END AS STRING)
         AS table_id,
       'c' || CAST(o_orderkey % 13 AS STRING) AS column_name,
       '{{"highest_label":"X"}}' AS json,
       coalesce(parameter_value, 'NA') AS detected_entity,
       CASE WHEN o_orderkey % 50 = 49 THEN 'NA' ELSE coalesce(parameter_name, 'UNKNOWN') END
         AS data_element
FROM $orders$ LEFT JOIN (VALUES {_elements})
  AS de(ix, parameter_name, parameter_value, parameter_sensitivity) ON o_orderkey % 50 = ix""",
    "ner_unstructured_data": f"""
SELECT CAST(doc_id AS STRING) AS id,
       'bucket-' || lang AS source_bucket,
       'doc' || CAST(doc_id % 700 AS STRING) || '.txt' AS file_name,
       '{{"highest_label":"E' || CAST(doc_id % 50 AS STRING)
         || '","confidence_score":0.5,"detected_entities":{{"E' || CAST(doc_id % 50 AS STRING)
         || '":1,"OTHER":1}}}}' AS json,
       coalesce(parameter_value, 'NA') AS detected_entity,
       CASE WHEN doc_id % 50 = 49 THEN 'NA' ELSE coalesce(parameter_name, 'UNKNOWN') END
         AS data_element,
       n_chars AS file_size,
       CASE doc_id % 5 WHEN 0 THEN 'TXT' WHEN 1 THEN 'PDF' WHEN 2 THEN 'DOCX' WHEN 3 THEN 'CSV'
         ELSE 'JSON' END AS file_type,
       source,
       lang AS sub_service,
       'region-' || CAST(doc_id % 4 AS STRING) AS region
FROM $documents$ LEFT JOIN (VALUES {_elements})
  AS de(ix, parameter_name, parameter_value, parameter_sensitivity) ON doc_id % 50 = ix""",
    # One row per order; its key picks the shape of the value: hits and near misses per rule.
    "value_shapes": """
SELECT k AS row_id, CAST(k % 48 AS INT) AS kind,
  CASE k % 48
    WHEN 0 THEN CAST(2 + k % 8 AS STRING) || substr(a, 2, 3) || ' ' || b || ' ' || c
    WHEN 1 THEN '1' || substr(a, 2, 3) || '-' || b || '-' || c
    WHEN 2 THEN l1 || 'BC' || l2 || 'K' || a || 'Z'
    WHEN 3 THEN l1 || 'BC' || l2 || 'K' || a || 'z'
    WHEN 4 THEN '4' || substr(a, 2, 3) || '-' || b || '-' || c || '-' || d
    WHEN 5 THEN '5' || substr(a, 1, 3) || ' ' || b || ' ' || c || ' ' || d
    WHEN 6 THEN '2' || substr(a, 1, 3) || b || c || d
    WHEN 7 THEN '34' || substr(a, 1, 2) || '-' || b || '11-' || c || '1'
    WHEN 8 THEN '37' || substr(a, 1, 2) || '-' || b || '11 ' || c || '1'
    WHEN 9 THEN CASE WHEN m % 5 = 0 THEN '508' ELSE '652' END || substr(a, 1, 1) || b || c || d
    WHEN 10 THEN '6013 ' || a || ' ' || b || ' ' || c || ' ' || substr(d, 1, 2)
    WHEN 11 THEN '5018-' || a || ' ' || b || '-' || c
    WHEN 12 THEN '10.0.' || CAST(k % 300 AS STRING) || '.' || CAST(k % 256 AS STRING)
    WHEN 13 THEN 'fe80::' || a || ':' || b
    WHEN 14 THEN '0a:1b:2c:' || substr(a, 1, 2) || ':' || substr(b, 1, 2) || ':' || substr(c, 1, 2)
    WHEN 15 THEN a || '.' || b || '.' || c
    WHEN 16 THEN l1 || l2 || 'C' || a || substr(b, 1, 3)
    WHEN 17 THEN l1 || a || substr(b, 1, 3)
    WHEN 18 THEN 'MH12' || CASE WHEN m % 3 = 0 THEN '/' ELSE ' ' END || a || b || substr(c, 1, 3)
    WHEN 19 THEN a || b || substr(c || d || a, 1, CAST(m % 12 AS INT))
    WHEN 20 THEN 'SBIN' || CAST(m % 2 AS STRING) || a || 'A7'
    WHEN 21 THEN CASE WHEN m % 4 = 0 THEN 'XX' ELSE 'KA' END || a || b || substr(c, 1, 2)
    WHEN 22 THEN 'KA-' || substr(a, 1, 2) || '-' || l1 || '-' || b
    WHEN 23 THEN 'user' || CAST(k AS STRING) || '@okbank'
    WHEN 24 THEN 'user' || CAST(k AS STRING) || '@mail.example.com'
    WHEN 25 THEN '29' || 'ABCP' || l1 || a || 'Z' || '1Z'
                 || substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(m % 36 AS INT) + 1, 1)
    WHEN 26 THEN 'John Smith met Mary Jones near ' || l1 || 'aris'
    WHEN 27 THEN CASE m % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'Female, Male' ELSE 'Others' END
    WHEN 28 THEN 'an Indian and a British citizen, not an Indiana'
    WHEN 29 THEN substr(a, 1, 3) || ' Elm Street, ' || substr(b, 1, 2) || ' Oak Rd'
    WHEN 30 THEN '5' || a || substr(b, 1, 1) || CASE WHEN m % 2 = 0 THEN '' ELSE ' x' END
    WHEN 31 THEN '5' || a || '1.25 and 5' || b || '1.6' || c || '1'
    WHEN 32 THEN 'zip ' || a || '5-' || b
    WHEN 33 THEN '  @Pass' || a || 'word@x y!'
    WHEN 34 THEN 'Pass' || a || 'word x y'
    WHEN 35 THEN 'PO Box ' || a || CASE WHEN m % 2 = 0 THEN '' ELSE '77' END
    WHEN 36 THEN '555-' || substr(a, 1, 3) || '-' || b || ' or 555.' || substr(c, 1, 3) || ' ' || d
    WHEN 37 THEN '+91-9' || a || b || substr(c, 1, 1)
    WHEN 38 THEN 'Mr and Mrs Hill, Mrx'
    WHEN 39 THEN CASE m % 5 WHEN 0 THEN '000' WHEN 1 THEN '9999' WHEN 2 THEN a
                 ELSE substr(a, 1, 3) END
    WHEN 40 THEN '35-20-99-00-' || a || substr(b, 1, 2) || '-' || substr(c, 1, 1)
    WHEN 41 THEN '40' || CAST(4 + m % 3 AS STRING) || '40' || a || b || substr(c, 1, 2)
    WHEN 42 THEN a || 'abcd-' || b || '-4' || substr(c, 1, 3) || '-8' || substr(d, 1, 3) || '-'
                 || a || b || c
    WHEN 43 THEN '2024-01-' || CAST(10 + k % 20 AS STRING) || ' 03:04:05 PM'
    WHEN 44 THEN '31.12.' || a || CASE WHEN m % 2 = 0 THEN 'x' ELSE '' END
    WHEN 45 THEN '  '
    WHEN 46 THEN 'Élodie Mère, éMr M, ' || substr(a, 1, 2) || ' Église St, 3 rue Sté'
    ELSE 'first line' || chr(10) || '--Secret' || a || '=ok.' || chr(10) || 'Last' || chr(10)
  END AS value
FROM (
  SELECT o_orderkey AS k,
         CAST(floor(o_orderkey / 48) AS BIGINT) AS m,
         lpad(CAST((o_orderkey * 7919) % 10000 AS STRING), 4, '0') AS a,
         lpad(CAST((o_orderkey * 104729) % 9973 AS STRING), 4, '0') AS b,
         lpad(CAST((o_custkey * 1299709) % 9967 AS STRING), 4, '0') AS c,
         lpad(CAST((o_orderkey * 15485863) % 9949 AS STRING), 4, '0') AS d,
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(o_orderkey % 26 AS INT) + 1, 1) AS l1,
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(o_custkey % 26 AS INT) + 1, 1) AS l2
  FROM $orders$
) AS keys""",
    # A wide table whose columns hold different shapes.
    "people": """
SELECT o_orderkey AS person_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'John Smith' ELSE 'Mary Jones' END AS full_name,
       'AB' || CAST(o_custkey AS STRING) AS code,
       '10.0.' || CAST(o_custkey % 256 AS STRING) || '.' || CAST(o_orderkey % 256 AS STRING) AS ip,
       '4' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '-1111-2222-'
         || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') AS card,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '  '
            ELSE ' 555-' || CAST(100 + o_custkey % 900 AS STRING) || '-1234 ' END AS phone,
       CASE o_orderkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Mr Indian' ELSE 'x' END AS note,
       o_custkey AS customer_no
FROM $orders$""",
    "corpus": """
SELECT 'documents' AS source, doc_id AS row_id, text AS value FROM $documents$
UNION ALL
SELECT 'conversations' AS source, conv_id * 1000 + turn AS row_id, text AS value
FROM $conversations$
UNION ALL
SELECT 'pages' AS source, page_id AS row_id, html AS value FROM $pages$""",
    "files": """
SELECT doc_id, CAST(doc_id % 7 AS INT) AS customer_id,
       'doc' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF'
         WHEN 2 THEN '.v2.docx' WHEN 3 THEN '.csv' WHEN 4 THEN '.jpeg' ELSE '.exe' END
         AS file_name,
       n_chars AS file_size, text, lang, source
FROM $documents$""",
}

# value_shapes and the text tables as one list of values.
FIXTURES["values"] = (
    f"SELECT 'shapes' AS source, row_id, value FROM ({FIXTURES['value_shapes']}) AS shapes\n"
    f"UNION ALL\n{FIXTURES['corpus']}"
)


# Fixtures that pattern scans read.
SCANNED = {"value_shapes", "people", "corpus", "files", "values"}


def duck(name: str) -> str:
    """A fixture as SQL over the benchmark views."""
    return re.sub(r"\$(\w+)\$", r"\1", FIXTURES[name])


def ctes(*names: str) -> str:
    return ",\n".join(f"{name} AS ({duck(name)})" for name in names)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.table(_view(spark, sf_dir, table))


def _view(spark: SparkSession, sf_dir: str, table: str) -> str:
    """Temporary view of a benchmark table, so that its files are listed once per session."""
    view = f"{table}_{zlib.crc32(sf_dir.encode()):08x}"
    if not spark.catalog.tableExists(view):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(view)
    return view


def sql_over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL in which ``$name$`` stands for a benchmark table."""
    return spark.sql(re.sub(r"\$(\w+)\$", lambda m: _view(spark, sf_dir, m.group(1)), sql))


def read_texts(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table about to be scanned for patterns."""
    return spread(read(spark, sf_dir, table), f"{sf_dir}/{table}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = sql_over(spark, sf_dir, FIXTURES[name])
    if name not in SCANNED:
        return df
    tables = set(re.findall(r"\$(\w+)\$", FIXTURES[name]))
    return spread(df, *[f"{sf_dir}/{table}.parquet" for table in tables])
