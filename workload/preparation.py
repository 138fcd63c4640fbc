"""Sources and sinks S, text and table preparation P."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushmap.operators import prepare
from hushmap.operators.reduce import register_unknown
from hushmap.schemas import TABLES
from hushmap.session import scratch_path
from hushmap.sources import catalog, readers, results
from hushmap.sources.files import file_metadata, list_files
from workload.fixtures import ctes, fixture, read, read_texts, sql_over, text
from workload.registry import query

# --- sources: written from the tables, then read back


# Files whose values may hold line breaks are read whole, each by one task.
ROWS_PER_FILE, TEXTS_PER_FILE = 200_000, 10_000


def _csv_path(spark, df, name: str, sep: str, rows: int = ROWS_PER_FILE) -> str:
    path = scratch_path(spark, name)
    writer = df.write.option("header", True).option("sep", sep).option("escape", '"')
    writer.option("maxRecordsPerFile", rows).csv(path)
    return path


@query(
    "s01_read_catalog_csv",
    f"WITH {ctes('profiler_data_time_series')} SELECT entityFQNHash, extension, jsonSchema, json, "
    "timestamp FROM profiler_data_time_series",
)
def _s01(spark, sf):
    df = fixture(spark, sf, "profiler_data_time_series")
    path = _csv_path(spark, df, "catalog", ";")
    back = readers.read_catalog_csv(spark, path, TABLES["profiler_data_time_series"])
    return back.drop("operation")


# Texts with the separator, quotes and line breaks inside.
_AWKWARD = "'said \"' || l.text || '\"; ' || chr(10) || l.source"


@query("s01_quoted_lines", f"SELECT doc_id AS id, {_AWKWARD} AS json FROM documents l")
def _s01_quoted(spark, sf):
    df = _awkward(spark, sf)
    path = _csv_path(spark, df, "quoted", ";", TEXTS_PER_FILE)
    return readers.read_catalog_csv(spark, path, df.schema)


def _awkward(spark, sf):
    value = F.concat(F.lit('said "'), "text", F.lit('"; \n'), "source")
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), value.alias("json"))


@query("s02_quoted_separator", f"SELECT doc_id AS id, {_AWKWARD} AS json FROM documents l")
def _s02_quoted(spark, sf):
    """The separators inside the quotes outnumber the true one."""
    path = _csv_path(spark, _awkward(spark, sf), "auto-quoted", "|", TEXTS_PER_FILE)
    return readers.read_csv_auto(spark, path).withColumn("id", F.col("id").cast("bigint"))


_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"


@query("s02_read_csv_auto", f"SELECT {_ORDER_COLUMNS} FROM orders")
def _s02(spark, sf):
    df = read(spark, sf, "orders").select(*_ORDER_COLUMNS.split(", "))
    back = readers.read_csv_auto(spark, _csv_path(spark, df, "auto", "|"))
    return back.withColumns({c: F.col(c).cast("bigint") for c in ("o_orderkey", "o_custkey")})


@query(
    "s03_read_csv_strings",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
    "o_orderstatus, o_orderpriority FROM orders",
)
def _s03(spark, sf):
    df = read(spark, sf, "orders").select(*_ORDER_COLUMNS.split(", "))
    return readers.read_csv_strings(spark, _csv_path(spark, df, "strings", ","))


@query(
    "s02_mixed_folder",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN o_orderpriority END AS priority, "
    "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN o_orderstatus END AS other "
    "FROM orders",
)
def _s02_mixed(spark, sf):
    """One folder with files of four delimiters and three headers, with columns in any order; a
    column that holds numbers in some files and letters in others."""
    base = scratch_path(spark, "auto-mixed")
    orders = read(spark, sf, "orders").where("o_orderkey IS NOT NULL")
    forms = {
        ",": ("o_orderkey AS id", "o_orderpriority AS priority", "o_custkey AS other"),
        ";": ("o_orderpriority AS priority", "o_orderkey AS id"),
        "|": ("o_orderstatus AS other", "o_orderkey AS id"),
        "\t": ("o_orderkey AS id", "'a,b;c|d' AS unused"),
    }
    for kind, (sep, columns) in enumerate(forms.items()):
        part = orders.where(F.col("o_orderkey") % 4 == kind).selectExpr(*columns).repartition(2)
        writer = part.write.mode("append").option("header", True).option("sep", sep)
        writer.option("maxRecordsPerFile", ROWS_PER_FILE).csv(base)
    back = readers.read_csv_auto(spark, base)
    return back.select(F.col("id").cast("bigint"), "priority", F.col("other").cast("string"))


def _records(spark, sf):
    """Orders as nested records with a ``name`` at several depths."""
    orders = read(spark, sf, "orders")
    customers = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"
    )
    items = F.array(
        F.struct(
            F.col("o_orderpriority").alias("name"),
            F.array(F.struct(F.col("o_orderkey").alias("name"))).alias("parts"),
        ),
        F.struct(F.lit(None).cast("string").alias("name"), F.array().alias("parts")),
    )
    return orders.join(customers, "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.col("c_mktsegment").alias("segment")).alias("trade"),
        ).alias("buyer"),
        items.alias("items"),
    )


def _records_path(spark, sf) -> str:
    path = scratch_path(spark, "records")
    _records(spark, sf).write.json(path)
    return path


_RECORDS_SQL = "FROM orders JOIN customer ON c_custkey = o_custkey"


@query(
    "s04_read_json_records",
    f"SELECT o_orderkey AS id, c_name AS buyer_name, c_mktsegment AS segment {_RECORDS_SQL}",
)
def _s04(spark, sf):
    back = readers.read_json_records(spark, _records_path(spark, sf))
    return back.select(
        "id", F.col("buyer.name").alias("buyer_name"), F.col("buyer.trade.segment").alias("segment")
    )


@query(
    "s04_mixed_folder",
    "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders",
)
def _s04_mixed(spark, sf):
    """One folder with JSON lines, an array over many lines and indented single objects."""
    base = scratch_path(spark, "mixed")
    orders = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority")
    )
    kind = F.when(F.col("id") == F.lit(1), "single").when(F.col("id") % 2 == 0, "lines").otherwise("array")
    sorted_in = orders.withColumn("kind", kind)
    sorted_in.where("kind = 'lines'").drop("kind").write.mode("append").json(base)
    body = F.to_json(F.struct("id", "priority"))
    array = F.concat(F.lit("[\n"), F.array_join(F.collect_list(body), ",\n"), F.lit("\n]"))
    arrays = sorted_in.where("kind = 'array'").groupBy(F.col("id") % 5).agg(array.alias("value"))
    arrays.select("value").repartition(5).write.mode("append").option("maxRecordsPerFile", 1).text(base)
    single = F.concat(F.lit("{\n  \"id\": "), "id", F.lit(",\n  \"priority\": \""), "priority", F.lit("\"\n}"))
    sorted_in.where("kind = 'single'").select(single.alias("value")).write.mode("append").option(
        "maxRecordsPerFile", 1
    ).text(base)
    return readers.read_json_records(spark, base)


TEXT_END = "\u0004"


def _write_each(texts, path: str) -> None:
    """Write each text, and TEXT_END, to a file of its own in the folder ``path``.

    In a file system that is mounted, tasks write the files themselves: for every file that Hadoop
    makes there it starts two processes (chmod), and the driver renames all files one by one. A
    task that runs again writes the same names. Files of other stores go through Spark's writer.
    """
    spark = texts.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        texts.write.option("maxRecordsPerFile", 1).option("lineSep", TEXT_END).text(path)
        return
    fs.mkdirs(folder)
    local, end = folder.toUri().getPath(), TEXT_END.encode()

    def write(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for value in batch.column(0):
                with open(f"{local}/part-{part:05d}-{at:07d}.txt", "wb") as file:
                    file.write((value.as_py() or b"") + end)
                at += 1
        yield from ()

    rows = texts.select(F.col(texts.columns[0]).cast("binary").alias("text"))
    rows.mapInArrow(write, "text binary").write.format("noop").mode("overwrite").save()


@query("s05_read_text_documents", "SELECT sha256(text) AS digest, length(text) AS chars FROM documents")
def _s05(spark, sf):
    """Every document written to a file of its own, read back whole."""
    path = scratch_path(spark, "texts")
    _write_each(read(spark, sf, "documents").select("text"), path)
    whole = F.regexp_replace("text", f"{TEXT_END}$", "")
    return readers.read_text_documents(spark, path).select(
        F.sha2(whole, 256).alias("digest"), F.length(whole).cast("bigint").alias("chars")
    )


_TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    "s06_list_files",
    "SELECT name || '.parquet' AS file_name, 'parquet' AS extension, TRUE AS accepted "
    f" FROM (SELECT unnest({_TABLE_NAMES!r}) AS name)",
)
def _s06(spark, sf):
    files = list_files(spark, sf, formats=("parquet",))
    # A table may be a folder of files; both forms list under the table's name.
    named = F.regexp_extract("path", r"([^/]+\.parquet)(/[^/]+)?$", 1)
    return files.select(named.alias("file_name"), "extension", "accepted").distinct()


@query(
    "s07_file_metadata",
    f"WITH {ctes('files')} SELECT 'bucket-' || lang AS source_bucket, file_name, file_size, "
    "upper(list_last(string_split(file_name, '.'))) AS file_type, source, lang AS sub_service, "
    "'eu' AS region FROM files",
)
def _s07(spark, sf):
    files = fixture(spark, sf, "files")
    kind = F.concat("source", F.lit(", "), "lang")
    bucket = F.concat(F.lit("bucket-"), "lang")
    return file_metadata(files, kind, bucket, F.lit("eu"))


# Half of the customers change, the others are new; suppliers bring ids a second time.
_BATCH = """
SELECT 't' || CAST(c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 5000000 END AS STRING) AS id,
       '{}' AS json, CAST(1800000000000 + c_custkey AS BIGINT) AS updatedAt,
       'batch' AS updatedBy, 0 AS deleted, 'h' || CAST(c_nationkey AS STRING) AS fqnHash,
       c_name AS name
FROM $customer$
UNION ALL
SELECT 't' || CAST(s_suppkey AS STRING) AS id, '{}' AS json,
       CAST(1900000000000 + s_suppkey AS BIGINT) AS updatedAt,
       'batch' AS updatedBy, 0 AS deleted, 'h' || CAST(s_nationkey AS STRING) AS fqnHash,
       s_name AS name
FROM $supplier$"""


def _batch(spark, sf):
    return sql_over(spark, sf, _BATCH)


_BATCH_SQL = _BATCH.replace("$customer$", "customer").replace("$supplier$", "supplier")
_UPSERTED = (
    "SELECT * FROM table_entity WHERE id NOT IN (SELECT id FROM batch) "
    "UNION ALL SELECT * FROM batch"
)


@query(
    "s08_upsert_by_key", f"WITH {ctes('table_entity')}, batch AS ({_BATCH_SQL}) {_UPSERTED}"
)
def _s08(spark, sf):
    return catalog.upsert_by_key(fixture(spark, sf, "table_entity"), _batch(spark, sf), "id")


_GAPS = """
SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS id,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS balance,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nation
FROM $customer$"""


@query(
    "s09_clean_batch",
    f"WITH g AS ({_GAPS.replace('$customer$', 'customer')}) SELECT CAST(id AS VARCHAR) AS id, "
    "coalesce(name, 'NA') AS name, coalesce(balance, 0) AS balance, coalesce(nation, 0) AS nation "
    "FROM g WHERE id IS NOT NULL",
)
def _s09(spark, sf):
    df = sql_over(spark, sf, _GAPS)
    return catalog.clean_batch(df, "table_entity")


_REPAIR = (
    "rtrim(replace(replace(replace(json, chr(39), '\"'), 'False', 'false'), 'True', 'true'), ',')"
)
_META_COLUMNS = "dbservice_entity_id, dbservice_entity_name, source, region"


def _meta_sql(batch: str, key: str, name: str) -> str:
    return (
        f"r AS (SELECT *, {_REPAIR} AS fixed FROM {batch}), "
        f"p AS (SELECT {key} AS dbservice_entity_id, {name} AS dbservice_entity_name, "
        "string_split(coalesce(json_extract_string(fixed, '$.connection.config.hostPort'), ''), "
        "'.') AS host FROM r WHERE json_valid(fixed)), "
        "derived AS (SELECT dbservice_entity_id, dbservice_entity_name, "
        "coalesce(host[5], 'N/A') AS source, coalesce(host[3], 'N/A') AS region FROM p) "
        f"SELECT {_META_COLUMNS} FROM dbservice_entity_meta_info WHERE dbservice_entity_id "
        f"NOT IN (SELECT {key} FROM {batch}) UNION ALL SELECT {_META_COLUMNS} FROM derived"
    )


@query(
    "s10_meta_info",
    f"WITH {ctes('dbservice_entity_meta_info', 'dbservice_entity')}, "
    + _meta_sql("dbservice_entity", "id", "name"),
)
def _s10(spark, sf):
    meta = fixture(spark, sf, "dbservice_entity_meta_info")
    return catalog.upsert_meta_info(meta, fixture(spark, sf, "dbservice_entity"), "dbservice_entity")


@query(
    "s10_meta_info_profiles",
    f"WITH {ctes('dbservice_entity_meta_info', 'profiler_data_time_series')}, "
    + _meta_sql("profiler_data_time_series", "entityFQNHash", "'N/A'"),
)
def _s10_profiles(spark, sf):
    meta = fixture(spark, sf, "dbservice_entity_meta_info")
    batch = fixture(spark, sf, "profiler_data_time_series")
    return catalog.upsert_meta_info(meta, batch, "profiler_data_time_series")


_STORED_PROFILES = """
SELECT 'h' || CAST(s_nationkey AS STRING) || '.p' || CAST(s_suppkey % 9 AS STRING) || '.q0'
         AS entityFQNHash,
       CAST(1 AS DOUBLE) AS rowCount, CAST(s_suppkey AS BIGINT) AS timestamp,
       CAST(2 AS DOUBLE) AS sizeInByte, CAST(3 AS DOUBLE) AS columnCount,
       CAST(4 AS DOUBLE) AS profileSample, CAST(5 AS BIGINT) AS createDateTime,
       'ROWS' AS profileSampleType
FROM $supplier$"""


@query(
    "s11_profiler_metadata",
    f"WITH {ctes('profiler_data_time_series')}, stored AS "
    f"({_STORED_PROFILES.replace('$supplier$', 'supplier')}), "
    f"r AS (SELECT entityFQNHash, {_REPAIR} AS j FROM profiler_data_time_series "
    "WHERE jsonSchema = 'tableProfile') "
    "SELECT * FROM stored WHERE entityFQNHash NOT IN "
    "(SELECT entityFQNHash FROM profiler_data_time_series) UNION ALL "
    "SELECT entityFQNHash, CAST(json_extract(j, '$.rowCount') AS DOUBLE), "
    "CAST(json_extract(j, '$.timestamp') AS BIGINT), "
    "CAST(json_extract(j, '$.sizeInByte') AS DOUBLE), "
    "CAST(json_extract(j, '$.columnCount') AS DOUBLE), "
    "CAST(json_extract(j, '$.profileSample') AS DOUBLE), "
    "CAST(epoch(strptime(json_extract_string(j, '$.createDateTime'), '%Y-%m-%dT%H:%M:%S.%fZ')) "
    "AS BIGINT), json_extract_string(j, '$.profileSampleType') FROM r WHERE json_valid(j)",
)
def _s11(spark, sf):
    stored = sql_over(spark, sf, _STORED_PROFILES)
    batch = fixture(spark, sf, "profiler_data_time_series")
    return catalog.upsert_profiler_metadata(stored, batch)


_RESULT_COLUMNS = "table_id, column_name, json, detected_entity, data_element"


@query(
    "s12_append_column_results",
    f"WITH {ctes('column_ner_results')} SELECT {_RESULT_COLUMNS} FROM column_ner_results "
    f"UNION ALL SELECT {_RESULT_COLUMNS} FROM column_ner_results",
)
def _s12(spark, sf):
    path = scratch_path(spark, "columns")
    rows = fixture(spark, sf, "column_ner_results").drop("id")
    for _ in range(2):
        results.append_column_results(rows, path)
    return spark.read.parquet(path).select(*_RESULT_COLUMNS.split(", "))


_FILE_COLUMNS = (
    "source_bucket, file_name, json, detected_entity, data_element, file_size, file_type, source, "
    "sub_service, region"
)


@query(
    "s13_append_file_results",
    f"WITH {ctes('ner_unstructured_data')} SELECT {_FILE_COLUMNS} FROM ner_unstructured_data",
)
def _s13(spark, sf):
    path = scratch_path(spark, "files")
    results.append_file_results(fixture(spark, sf, "ner_unstructured_data").drop("id"), path)
    return spark.read.parquet(path).select(*_FILE_COLUMNS.split(", "))


@query(
    "s14_classifier_run",
    f"WITH {ctes('files')} SELECT customer_id, file_name AS list_of_files, '[' || "
    "to_json({'file_name': file_name, 'file_size': file_size, 'source': source}) || ']' "
    "AS json_output FROM files",
)
def _s14(spark, sf):
    reports = fixture(spark, sf, "files")
    runs = results.classifier_run(reports, report=["file_name", "file_size", "source"])
    return runs.select(
        "customer_id", F.array_join("list_of_files", ",").alias("list_of_files"), "json_output"
    )


@query(
    "s14_classifier_run_stored",
    f"WITH {ctes('files')} SELECT customer_id, string_agg(file_name, ',' ORDER BY file_name) "
    "AS files FROM files GROUP BY customer_id",
)
def _s14_stored(spark, sf):
    """Runs as they are read from the result table."""
    path = scratch_path(spark, "runs")
    reports = fixture(spark, sf, "files")
    results.append_classifier_runs(
        results.classifier_run(reports, report=["file_name", "file_size"]), path
    )
    files = spark.read.parquet(path).select("customer_id", F.explode("list_of_files").alias("f"))
    listed = F.array_join(F.sort_array(F.collect_list("f")), ",")
    return files.groupBy("customer_id").agg(listed.alias("files"))


@query(
    "s15_register_unknown",
    f"WITH {ctes('data_element')}, e AS (SELECT DISTINCT 'E' || CAST(doc_id % 50 AS VARCHAR) AS v "
    "FROM documents UNION SELECT 'PERSON') "
    "SELECT parameter_name, parameter_value, parameter_sensitivity FROM data_element UNION ALL "
    "SELECT 'UNKNOWN', v, 'UNKNOWN' FROM e WHERE v NOT IN "
    "(SELECT parameter_value FROM data_element)",
)
def _s15(spark, sf):
    documents = read(spark, sf, "documents")
    entities = documents.select(
        F.explode(
            F.array(
                F.concat(F.lit("E"), (F.col("doc_id") % 50).cast("string")), F.lit("PERSON")
            )
        ).alias("entity")
    )
    return register_unknown(results.load_data_elements(spark), entities)


@query(
    "s16_write_reports_json",
    "SELECT doc_id, lang, source, n_chars FROM documents",
)
def _s16(spark, sf):
    path = scratch_path(spark, "reports")
    rows = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    results.write_reports_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


# --- table and text preparation

_PEOPLE_COLUMNS = ["full_name", "code", "ip", "card", "phone", "note", "customer_no"]
_MELTED = " UNION ALL ".join(
    f"SELECT person_id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM people"
    for c in _PEOPLE_COLUMNS
)
_STRIPPED = (
    "SELECT person_id, column_name, trim(value) AS value FROM melted WHERE trim(value) <> ''"
)


@query("p01_melt_columns", f"WITH {ctes('people')} {_MELTED}")
def _p01(spark, sf):
    return prepare.melt_columns(fixture(spark, sf, "people"), ids=["person_id"])


@query("p02_clean_values", f"WITH {ctes('people')}, melted AS ({_MELTED}) {_STRIPPED}")
def _p02(spark, sf):
    return prepare.clean_values(fixture(spark, sf, "people"), "csv", ids=["person_id"])


@query("p02_clean_values_json", f"WITH {ctes('people')}, melted AS ({_MELTED}) {_STRIPPED}")
def _p02_json(spark, sf):
    return prepare.clean_values(fixture(spark, sf, "people"), "json", ids=["person_id"])


@query(
    "p02_clean_values_xlsx",
    f"WITH {ctes('people')}, melted AS ({_MELTED}) {_STRIPPED} AND column_name <> 'customer_no'",
)
def _p02_xlsx(spark, sf):
    return prepare.clean_values(fixture(spark, sf, "people"), "xlsx", ids=["person_id"])


@query(
    "p03_extract_key",
    f"SELECT o_orderkey AS id, c_name AS value {_RECORDS_SQL} UNION ALL "
    f"SELECT o_orderkey, o_orderpriority {_RECORDS_SQL} UNION ALL "
    f"SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) {_RECORDS_SQL}",
)
def _p03(spark, sf):
    return prepare.extract_key(
        readers.read_json_records(spark, _records_path(spark, sf)), "name", ids=["id"]
    )


@query(
    "p04_sample_values",
    f"WITH {ctes('people')}, melted AS ({_MELTED}), kept AS ({_STRIPPED}) "
    "SELECT column_name, least(count(*), 500) AS n, least(count(*), 500) AS n_ids "
    "FROM kept GROUP BY column_name",
)
def _p04(spark, sf):
    values = prepare.clean_values(fixture(spark, sf, "people"), ids=["person_id"])
    sampled = prepare.sample_values(values, 500, key=["person_id"])
    return sampled.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("n_ids")
    )


@query("p04_sample_share")
def _p04_share(spark, sf):
    values = prepare.clean_values(fixture(spark, sf, "people"), ids=["person_id"])
    return prepare.sample_values(values, 0.2, key=["person_id"])


@query("p05_truncate_text", "SELECT doc_id, substr(text, 1, 1000) AS text FROM documents")
def _p05(spark, sf):
    documents = read(spark, sf, "documents").select("doc_id", "text")
    return prepare.truncate_text(documents, n=1000)


@query(
    "p06_chunk_text",
    "SELECT doc_id, i AS chunk, substr(text, i * 1000 + 1, 1000) AS text FROM (SELECT doc_id, "
    "text, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents) AS c",
)
def _p06(spark, sf):
    return prepare.chunk_text(read_texts(spark, sf).select("doc_id", "text"))


_TOKENS = "list_filter(string_split(replace(text, ' ', chr(10)), chr(10)), lambda t: length(t) >= 2)"


@query(
    "p07_tokenize",
    f"SELECT doc_id, unnest(range(len(t))) AS position, unnest(t) AS token FROM "
    f"(SELECT doc_id, {_TOKENS} AS t FROM documents) AS d",
)
def _p07(spark, sf):
    return prepare.tokenize(read_texts(spark, sf), ids=["doc_id"])


_STOPS = "[" + ", ".join(text(w) for w in prepare.STOP_WORDS) + "]"


@query(
    "p08_remove_stopwords",
    "SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, "
    f"{text(prepare.WORD_OR_PUNCTUATION)}), lambda w: NOT list_contains({_STOPS}, lower(w))), ' ') "
    "AS text FROM documents",
)
def _p08(spark, sf):
    return prepare.remove_stopwords(read_texts(spark, sf).select("doc_id", "text"))


@query(
    "p09_normalize_token",
    "SELECT DISTINCT token, translate(lower(token), '.''-_,', '') AS normal FROM "
    f"(SELECT unnest({_TOKENS}) AS token FROM documents) AS d",
)
def _p09(spark, sf):
    tokens = prepare.tokenize(read_texts(spark, sf)).select("token").distinct()
    return tokens.withColumn("normal", prepare.normalize_token(F.col("token")))


@query(
    "p10_combine_text",
    "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations "
    "GROUP BY conv_id",
)
def _p10(spark, sf):
    turns = read(spark, sf, "conversations")
    return prepare.combine_text(turns, "conv_id", "turn", "text")


@query(
    "p12_melt_tables",
    "SELECT 'customer' AS \"table\", c_custkey AS row_id, 'c_name' AS column_name, c_name AS value "
    "FROM customer UNION ALL SELECT 'customer', c_custkey, 'c_mktsegment', c_mktsegment "
    "FROM customer UNION ALL SELECT 'supplier', s_suppkey, 's_name', s_name FROM supplier",
)
def _p12(spark, sf):
    customer = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    supplier = read(spark, sf, "supplier").select("s_suppkey", "s_name")
    long = prepare.melt_tables(
        {"customer": customer, "supplier": supplier},
        ids={"customer": "c_custkey", "supplier": "s_suppkey"},
    )
    return long
