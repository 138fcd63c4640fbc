"""Inventory reports over the catalog and result tables.

Every report takes the tables it reads as DataFrames. Unmatched sides of a left join count as
'' (the stored columns are not nullable), which ``left_join_default`` takes care of.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushmap.functions.scalar import before_dot, dot_part, json_member, kilobytes

NO_ELEMENT = "NA"


def left_join_default(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which unmatched text columns of the right side are ''."""
    added = [c for c in right.columns if c not in on]
    joined = left.join(right, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in added})


def _distinct_per(rows: DataFrame, key: str, kinds: Mapping[str, str]) -> DataFrame:
    """Rows (key, kind, value) with distinct values to one row per key, one count per kind."""
    counts = [F.count_if(F.col("kind") == kind).alias(name) for kind, name in kinds.items()]
    return rows.distinct().groupBy(key).agg(*counts)


def _kinds(df: DataFrame, key: str, kinds: Mapping[str, str]) -> DataFrame:
    """Columns of a table as rows (key, kind, value)."""
    values = [
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))
        for kind, column in kinds.items()
    ]
    return df.select(key, F.inline(F.array(*values)))


def _services(dbservice: DataFrame) -> DataFrame:
    return dbservice.select("nameHash", F.col("id").alias("service_id"), "serviceType").distinct()


def _regions(meta: DataFrame) -> DataFrame:
    return meta.select(
        before_dot(F.col("dbservice_entity_id")).alias("service_id"), "region"
    ).distinct()


def _profile_parts(profiler: DataFrame, *parts: int) -> DataFrame:
    name = F.col("entityFQNHash")
    columns = [dot_part(name, n).alias(f"p{n}") for n in parts]
    return profiler.select(dot_part(name, 1).alias("nameHash"), *columns).distinct()


def structured_data_details(results: DataFrame, lookup: DataFrame) -> DataFrame:
    """Elements, entity types and categories.

    An element counts once per lookup row of its category, so elements are first counted per
    category and the count is multiplied by the category's size.
    """
    per_category = lookup.groupBy(F.col("parameter_name").alias("data_element")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    kept = results.filter(F.col("data_element") != NO_ELEMENT)
    counted = kept.groupBy("data_element", "detected_entity").agg(F.count("id").alias("_n"))
    categories = lookup.agg(F.countDistinct("parameter_name"))
    return (
        counted.join(per_category, "data_element", "left")
        .agg(
            F.coalesce(
                F.sum(F.col("_n") * F.coalesce("_rows", F.lit(1))), F.lit(0)
            ).alias("total_data_elements"),
            F.countDistinct("detected_entity").alias("total_data_element_type"),
        )
        .select("*", categories.scalar().alias("total_data_element_category"))
    )


def structured_element_categories(results: DataFrame) -> DataFrame:
    return results.groupBy("data_element").agg(
        F.count(F.lit(1)).alias("data_element_category")
    )


def structured_element_types(
    results: DataFrame,
    tables: DataFrame,
    dbservice: DataFrame,
    profiler: DataFrame,
    meta: DataFrame,
) -> DataFrame:
    """Per entity: distinct results, columns, tables, schemas, databases, systems, regions.

    Only distinct counts come out, so the chain of fan-out joins is not run row by row: tables
    are looked up for distinct (entity, table) pairs, and what lies behind the service for
    distinct (entity, service) pairs, one kind of value at a time.
    """
    key = "detected_entity"
    own = results.groupBy(key).agg(
        F.countDistinct("id").alias("count_data_element_types"),
        F.countDistinct("column_name").alias("total_columns"),
    )
    located = tables.select(
        F.col("id").alias("table_id"),
        F.col("id").alias("_table"),
        dot_part(F.col("fqnHash"), 1).alias("_key"),
    ).distinct()
    at_table = left_join_default(results.select(key, "table_id").distinct(), located, ["table_id"])
    services = _services(dbservice).withColumn("_key", F.col("nameHash"))
    at_service = left_join_default(at_table.select(key, "_key").distinct(), services, ["_key"])
    parts = left_join_default(
        at_service.select(key, "nameHash").distinct(),
        _profile_parts(profiler, 2, 3),
        ["nameHash"],
    )
    regions = left_join_default(
        at_service.select(key, "service_id").distinct(), _regions(meta), ["service_id"]
    )
    rows = _kinds(at_table, key, {"table": "_table"})
    rows = rows.unionByName(_kinds(parts, key, {"schema": "p2", "database": "p3"}))
    rows = rows.unionByName(_kinds(at_service, key, {"system": "serviceType"}))
    rows = rows.unionByName(_kinds(regions, key, {"region": "region"}))
    behind = _distinct_per(
        rows,
        key,
        {
            "table": "total_tables",
            "schema": "total_schemas",
            "database": "total_databases",
            "system": "total_data_systems",
            "region": "total_locations",
        },
    )
    return own.join(behind, key).withColumnRenamed(key, "data_element_types")


def structured_locations(
    meta: DataFrame,
    dbservice: DataFrame,
    profiler: DataFrame,
    tables: DataFrame,
    results: DataFrame,
) -> DataFrame:
    """Per region: distinct systems, tables, schemas, databases and entities.

    A service counts only if it has profiles and scanned tables. Its values of each kind are
    made distinct first and joined to the region once, instead of all kinds multiplied.
    """
    profiled = _kinds(
        _profile_parts(profiler, 2, 3, 4),
        "nameHash",
        {"schema": "p2", "database": "p3", "table": "p4"},
    )
    scanned = _service_results(tables, results, ["detected_entity"])
    values = profiled.unionByName(_kinds(scanned, "nameHash", {"entity": "detected_entity"}))
    values = values.distinct()
    both = F.bool_or(F.col("kind") == "entity") & F.bool_or(F.col("kind") != "entity")
    complete = values.groupBy("nameHash").agg(both.alias("_both")).filter("_both").drop("_both")
    services = (
        _regions(meta)
        .join(_services(dbservice), "service_id")
        .join(complete, "nameHash")
        .select("region", "nameHash", "serviceType")
        .distinct()
    )
    systems = _kinds(services, "region", {"system": "serviceType"})
    behind = services.select("region", "nameHash").distinct().join(values, "nameHash")
    rows = systems.unionByName(behind.select("region", "kind", "value"))
    return _distinct_per(
        rows,
        "region",
        {
            "system": "total_data_systems",
            "table": "total_tables",
            "schema": "total_schemas",
            "database": "total_databases",
            "entity": "total_data_elements",
        },
    ).withColumnRenamed("region", "location")


def _service_results(
    tables: DataFrame, results: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Distinct (service, result columns) of the tables that have results."""
    located = tables.select(
        F.col("id").alias("table_id"), dot_part(F.col("fqnHash"), 1).alias("nameHash")
    ).distinct()
    # Distinct before the join as well: a table has few kinds of result and many rows of them.
    found = results.select("table_id", *columns).distinct()
    return found.join(located, "table_id").select("nameHash", *columns).distinct()


def structured_management(profiler: DataFrame, dbservice: DataFrame) -> DataFrame:
    services = dbservice.select("nameHash", "serviceType", "updatedBy").distinct()
    return (
        _profile_parts(profiler, 2, 3)
        .join(services, "nameHash")
        .agg(
            F.countDistinct("serviceType").alias("total_services"),
            F.countDistinct("updatedBy").alias("total_system_owner"),
            F.countDistinct("p3").alias("total_databases"),
            F.countDistinct("p2").alias("total_schemas"),
        )
    )


def _with_sensitivity(results: DataFrame, lookup: DataFrame) -> DataFrame:
    sensitivity = lookup.select(
        F.col("parameter_value").alias("detected_entity"), "parameter_sensitivity"
    )
    return left_join_default(results, sensitivity, ["detected_entity"]).select(
        *results.columns, "parameter_sensitivity"
    )


def structured_ner(results: DataFrame, lookup: DataFrame) -> DataFrame:
    return _with_sensitivity(results, lookup)


def structured_sensitivity(lookup: DataFrame, results: DataFrame) -> DataFrame:
    entities = results.select(F.col("detected_entity").alias("parameter_value")).distinct()
    return (
        lookup.join(entities, "parameter_value")
        .groupBy(F.col("parameter_sensitivity").alias("sensitivity"))
        .agg(F.countDistinct("parameter_value").alias("sensitivity_count"))
    )


def structured_flow(
    meta: DataFrame,
    dbservice: DataFrame,
    schemas: DataFrame,
    tables: DataFrame,
    results: DataFrame,
) -> DataFrame:
    """Distinct paths from region through system and owner to category and entity."""
    services = dbservice.select(
        F.col("id").alias("service_id"), "nameHash", "serviceType", "updatedBy"
    ).distinct()
    names = schemas.select(
        dot_part(F.col("fqnHash"), 1).alias("nameHash"), F.col("name").alias("database")
    ).distinct()
    found = _service_results(tables, results, ["data_element", "detected_entity"])
    return (
        _regions(meta)
        .join(services, "service_id")
        .join(names, "nameHash")
        .join(found, "nameHash")
        .select(
            F.col("region").alias("location"),
            F.col("serviceType").alias("data_system"),
            F.col("updatedBy").alias("data_system_owner"),
            "database",
            F.col("data_element").alias("data_category"),
            F.col("detected_entity").alias("pii"),
        )
        .distinct()
    )


def structured_location_count(meta: DataFrame) -> DataFrame:
    return meta.agg(F.countDistinct("region").alias("location"))


def unstructured_details(files: DataFrame, lookup: DataFrame) -> DataFrame:
    """Like the structured details, without filter; the last column counts lookup rows."""
    per_category = lookup.groupBy(F.col("parameter_name").alias("data_element")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    counted = files.groupBy("data_element", "detected_entity").agg(
        F.count("detected_entity").alias("_n")
    )
    rows = lookup.agg(F.count(F.lit(1)))
    return (
        counted.join(per_category, "data_element", "left")
        .agg(
            F.coalesce(
                F.sum(F.col("_n") * F.coalesce("_rows", F.lit(1))), F.lit(0)
            ).alias("total_data_elements"),
            F.countDistinct("detected_entity").alias("total_data_element_type"),
        )
        .select("*", rows.scalar().alias("total_data_element_category"))
    )


def unstructured_element_listing(files: DataFrame) -> DataFrame:
    return files.groupBy(F.col("detected_entity").alias("data_element_type")).agg(
        F.count("detected_entity").alias("data_elements"),
        F.countDistinct("file_name").alias("documents"),
        F.countDistinct("source").alias("data_systems"),
        F.countDistinct("region").alias("locations"),
    )


def unstructured_management(files: DataFrame) -> DataFrame:
    return files.agg(
        F.countDistinct("file_name").alias("scanned_documents"),
        kilobytes(F.sum("file_size")).alias("scanned_volume"),
        F.countDistinct("file_type").alias("file_format_count"),
    )


def unstructured_ner(files: DataFrame, lookup: DataFrame) -> DataFrame:
    return _with_sensitivity(files, lookup).distinct()


def unstructured_sensitivity(files: DataFrame, lookup: DataFrame) -> DataFrame:
    per_entity = files.groupBy(F.col("detected_entity").alias("parameter_value")).agg(
        F.count("detected_entity").alias("_n")
    )
    return (
        lookup.join(per_entity, "parameter_value")
        .groupBy(F.col("parameter_sensitivity").alias("sensitivity"))
        .agg(F.sum("_n").alias("sensitivity_count"))
    )


def unstructured_document_listing(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("file_name").alias("document_name"),
        F.col("file_type").alias("document_type"),
        F.coalesce(json_member(F.col("json"), "detected_entities"), F.lit("")).alias("entity"),
        kilobytes(F.col("file_size")).alias("document_size_kb"),
        F.col("region").alias("location"),
        F.col("source").alias("data_source"),
        F.col("sub_service").alias("subservices"),
    )


def unstructured_format_statistics(files: DataFrame) -> DataFrame:
    return files.groupBy("file_type").agg(
        F.countDistinct("file_name").alias("total_documents"),
        F.countDistinct("source").alias("data_system_count"),
        F.countDistinct("region").alias("location_count"),
    )


def unstructured_region_statistics(files: DataFrame) -> DataFrame:
    return files.groupBy(F.col("region").alias("data_system_location_name")).agg(
        F.countDistinct("file_name").alias("document_count"),
        F.countDistinct("file_type").alias("document_type_count"),
        F.countDistinct("source").alias("data_system_count"),
    )


def unstructured_flow(files: DataFrame) -> DataFrame:
    return files.select(
        F.col("region").alias("location"),
        F.col("source").alias("data_service"),
        "sub_service",
        F.col("file_type").alias("file_format"),
    ).distinct()


def unstructured_summary(files: DataFrame) -> DataFrame:
    return files.agg(
        F.countDistinct("source").alias("total_data_system_count"),
        F.countDistinct("region").alias("total_location_count"),
    )


# Report name -> function and the stored tables it reads, in order.
VIEWS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "structured_data_details": (
        structured_data_details,
        ("column_ner_results", "data_element"),
    ),
    "structured_element_categories": (structured_element_categories, ("column_ner_results",)),
    "structured_element_types": (
        structured_element_types,
        (
            "column_ner_results",
            "table_entity",
            "dbservice_entity",
            "profiler_data_time_series",
            "dbservice_entity_meta_info",
        ),
    ),
    "structured_locations": (
        structured_locations,
        (
            "dbservice_entity_meta_info",
            "dbservice_entity",
            "profiler_data_time_series",
            "table_entity",
            "column_ner_results",
        ),
    ),
    "structured_management": (
        structured_management,
        ("profiler_data_time_series", "dbservice_entity"),
    ),
    "structured_ner": (structured_ner, ("column_ner_results", "data_element")),
    "structured_sensitivity": (structured_sensitivity, ("data_element", "column_ner_results")),
    "structured_flow": (
        structured_flow,
        (
            "dbservice_entity_meta_info",
            "dbservice_entity",
            "database_schema_entity",
            "table_entity",
            "column_ner_results",
        ),
    ),
    "structured_location_count": (structured_location_count, ("dbservice_entity_meta_info",)),
    "unstructured_details": (unstructured_details, ("ner_unstructured_data", "data_element")),
    "unstructured_element_listing": (unstructured_element_listing, ("ner_unstructured_data",)),
    "unstructured_management": (unstructured_management, ("ner_unstructured_data",)),
    "unstructured_ner": (unstructured_ner, ("ner_unstructured_data", "data_element")),
    "unstructured_sensitivity": (
        unstructured_sensitivity,
        ("ner_unstructured_data", "data_element"),
    ),
    "unstructured_document_listing": (
        unstructured_document_listing,
        ("ner_unstructured_data",),
    ),
    "unstructured_format_statistics": (
        unstructured_format_statistics,
        ("ner_unstructured_data",),
    ),
    "unstructured_region_statistics": (
        unstructured_region_statistics,
        ("ner_unstructured_data",),
    ),
    "unstructured_flow": (unstructured_flow, ("ner_unstructured_data",)),
    "unstructured_summary": (unstructured_summary, ("ner_unstructured_data",)),
}


def report(name: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    function, needed = VIEWS[name]
    return function(*[tables[table] for table in needed])


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[str]:
    """Make the reports whose tables are given available to SQL under their names."""
    names = [n for n, (_, needed) in VIEWS.items() if all(t in tables for t in needed)]
    for name in names:
        report(name, tables).createOrReplaceTempView(name)
    return names
