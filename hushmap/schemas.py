"""Schemas of the stored catalog and result tables."""

from pyspark.sql.types import (
    ArrayType,
    ByteType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "string": StringType(),
    "bigint": LongType(),
    "int": IntegerType(),
    "tinyint": ByteType(),
    "double": DoubleType(),
    "timestamp": TimestampType(),
    "strings": ArrayType(StringType()),
}


def _table(**columns: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind]) for name, kind in columns.items()])


def _entity_table() -> StructType:
    return _table(
        id="string",
        json="string",
        updatedAt="bigint",
        updatedBy="string",
        deleted="tinyint",
        fqnHash="string",
        name="string",
    )


TABLES: dict[str, StructType] = {
    "dbservice_entity": _table(
        id="string",
        name="string",
        serviceType="string",
        json="string",
        updatedAt="bigint",
        updatedBy="string",
        deleted="tinyint",
        nameHash="string",
    ),
    "database_schema_entity": _entity_table(),
    "table_entity": _entity_table(),
    "profiler_data_time_series": _table(
        entityFQNHash="string",
        extension="string",
        jsonSchema="string",
        json="string",
        operation="string",
        timestamp="bigint",
    ),
    "column_ner_results": _table(
        id="string",
        table_id="string",
        column_name="string",
        json="string",
        detected_entity="string",
        data_element="string",
        created_at="timestamp",
        updated_at="timestamp",
    ),
    "dbservice_entity_meta_info": _table(
        id="string",
        dbservice_entity_id="string",
        dbservice_entity_name="string",
        source="string",
        region="string",
    ),
    "ner_unstructured_data": _table(
        id="string",
        source_bucket="string",
        file_name="string",
        json="string",
        detected_entity="string",
        data_element="string",
        file_size="bigint",
        file_type="string",
        source="string",
        sub_service="string",
        region="string",
        created_at="timestamp",
        updated_at="timestamp",
    ),
    "instant_classifier": _table(
        id="string",
        customer_id="int",
        list_of_files="strings",
        json_output="string",
        created_at="timestamp",
        updated_at="timestamp",
    ),
    "data_element": _table(
        id="string",
        parameter_name="string",
        parameter_value="string",
        parameter_sensitivity="string",
    ),
    "profiler_metadata": _table(
        entityFQNHash="string",
        rowCount="double",
        timestamp="bigint",
        sizeInByte="double",
        columnCount="double",
        profileSample="double",
        createDateTime="bigint",
        profileSampleType="string",
    ),
}

# Key by which an uploaded batch replaces stored rows.
CATALOG_KEYS = {
    "dbservice_entity": "id",
    "database_schema_entity": "id",
    "field_relationship": "id",
    "table_entity": "id",
    "profiler_data_time_series": "entityFQNHash",
}

# Columns of a hit with offsets.
SPAN_FIELDS: list[tuple[str, DataType]] = [
    ("entity", StringType()),
    ("start", IntegerType()),
    ("end", IntegerType()),
    ("score", DoubleType()),
    ("text", StringType()),
]
