"""Reports V1-V19, checked against the plain joins they stand for."""

from __future__ import annotations

from hushmap.plans.views import VIEWS, report
from workload.fixtures import ctes, fixture
from workload.registry import query

_CHAIN = """
  JOIN dbservice_entity db ON db.id = CASE WHEN strpos(d.dbservice_entity_id, '.') > 0
    THEN substr(d.dbservice_entity_id, 1, strpos(d.dbservice_entity_id, '.') - 1)
    ELSE d.dbservice_entity_id END"""

CHECKS = {
    "structured_data_details": """
SELECT count(c.id) AS total_data_elements,
       count(DISTINCT c.detected_entity) AS total_data_element_type,
       (SELECT count(DISTINCT parameter_name) FROM data_element) AS total_data_element_category
FROM column_ner_results c LEFT JOIN data_element de ON c.data_element = de.parameter_name
WHERE c.data_element <> 'NA'""",
    "structured_element_categories": """
SELECT data_element, count(*) AS data_element_category FROM column_ner_results
GROUP BY data_element""",
    "structured_element_types": """
SELECT data_element_types, count(DISTINCT cid) AS count_data_element_types,
       count(DISTINCT column_name) AS total_columns, count(DISTINCT tid) AS total_tables,
       count(DISTINCT split_part(fqn, '.', 2)) AS total_schemas,
       count(DISTINCT split_part(fqn, '.', 3)) AS total_databases,
       count(DISTINCT service_type) AS total_data_systems,
       count(DISTINCT coalesce(d.region, '')) AS total_locations
FROM (
  SELECT b.*, coalesce(p.entityFQNHash, '') AS fqn
  FROM (
    SELECT a.*, coalesce(e.id, '') AS eid, coalesce(e.nameHash, '') AS name_hash,
           coalesce(e.serviceType, '') AS service_type
    FROM (
      SELECT c.detected_entity AS data_element_types, c.id AS cid, c.column_name,
             coalesce(t.id, '') AS tid, split_part(coalesce(t.fqnHash, ''), '.', 1) AS service
      FROM column_ner_results c LEFT JOIN table_entity t ON t.id = c.table_id) a
    LEFT JOIN dbservice_entity e ON e.nameHash = a.service) b
  LEFT JOIN profiler_data_time_series p ON split_part(p.entityFQNHash, '.', 1) = b.name_hash) x
LEFT JOIN dbservice_entity_meta_info d ON x.eid = split_part(d.dbservice_entity_id, '.', 1)
GROUP BY data_element_types""",
    "structured_locations": f"""
SELECT d.region AS location, count(DISTINCT db.serviceType) AS total_data_systems,
       count(DISTINCT split_part(p.entityFQNHash, '.', 4)) AS total_tables,
       count(DISTINCT split_part(p.entityFQNHash, '.', 2)) AS total_schemas,
       count(DISTINCT split_part(p.entityFQNHash, '.', 3)) AS total_databases,
       count(DISTINCT c.detected_entity) AS total_data_elements
FROM dbservice_entity_meta_info d {_CHAIN}
  JOIN profiler_data_time_series p ON split_part(p.entityFQNHash, '.', 1) = db.nameHash
  JOIN table_entity t ON split_part(t.fqnHash, '.', 1) = split_part(p.entityFQNHash, '.', 1)
  JOIN column_ner_results c ON c.table_id = t.id
GROUP BY d.region""",
    "structured_management": """
SELECT count(DISTINCT serviceType) AS total_services,
       count(DISTINCT updatedBy) AS total_system_owner,
       count(DISTINCT split_part(entityFQNHash, '.', 3)) AS total_databases,
       count(DISTINCT split_part(entityFQNHash, '.', 2)) AS total_schemas
FROM profiler_data_time_series p
  JOIN dbservice_entity d ON split_part(entityFQNHash, '.', 1) = d.nameHash""",
    "structured_ner": """
SELECT c.*, coalesce(d.parameter_sensitivity, '') AS parameter_sensitivity
FROM column_ner_results c LEFT JOIN data_element d ON c.detected_entity = d.parameter_value""",
    "structured_sensitivity": """
SELECT de.parameter_sensitivity AS sensitivity,
       count(DISTINCT c.detected_entity) AS sensitivity_count
FROM data_element de JOIN column_ner_results c ON c.detected_entity = de.parameter_value
GROUP BY de.parameter_sensitivity""",
    "structured_flow": f"""
SELECT DISTINCT d.region AS location, db.serviceType AS data_system,
       db.updatedBy AS data_system_owner, s.name AS database, c.data_element AS data_category,
       c.detected_entity AS pii
FROM dbservice_entity_meta_info d {_CHAIN}
  JOIN database_schema_entity s ON split_part(s.fqnHash, '.', 1) = db.nameHash
  JOIN table_entity t ON split_part(t.fqnHash, '.', 1) = split_part(s.fqnHash, '.', 1)
  JOIN column_ner_results c ON c.table_id = t.id""",
    "structured_location_count": """
SELECT count(DISTINCT region) AS location FROM dbservice_entity_meta_info""",
    "unstructured_details": """
SELECT count(n.detected_entity) AS total_data_elements,
       count(DISTINCT n.detected_entity) AS total_data_element_type,
       (SELECT count(*) FROM data_element) AS total_data_element_category
FROM ner_unstructured_data n LEFT JOIN data_element de ON n.data_element = de.parameter_name""",
    "unstructured_element_listing": """
SELECT DISTINCT detected_entity AS data_element_type, count(detected_entity) AS data_elements,
       count(DISTINCT file_name) AS documents, count(DISTINCT source) AS data_systems,
       count(DISTINCT region) AS locations
FROM ner_unstructured_data GROUP BY detected_entity""",
    "unstructured_management": """
SELECT count(DISTINCT file_name) AS scanned_documents,
       CAST(sum(file_size) AS DOUBLE) / 1024 AS scanned_volume,
       count(DISTINCT file_type) AS file_format_count
FROM ner_unstructured_data""",
    "unstructured_ner": """
SELECT DISTINCT c.*, coalesce(d.parameter_sensitivity, '') AS parameter_sensitivity
FROM ner_unstructured_data c LEFT JOIN data_element d ON c.detected_entity = d.parameter_value""",
    "unstructured_sensitivity": """
SELECT de.parameter_sensitivity AS sensitivity, count(n.detected_entity) AS sensitivity_count
FROM ner_unstructured_data n JOIN data_element de ON n.detected_entity = de.parameter_value
GROUP BY de.parameter_sensitivity""",
    "unstructured_document_listing": """
SELECT file_name AS document_name, file_type AS document_type,
       coalesce(CAST(json_extract(json, '$.detected_entities') AS VARCHAR), '') AS entity,
       CAST(file_size AS DOUBLE) / 1024 AS document_size_kb, region AS location,
       source AS data_source, sub_service AS subservices
FROM ner_unstructured_data""",
    "unstructured_format_statistics": """
SELECT file_type, count(DISTINCT file_name) AS total_documents,
       count(DISTINCT source) AS data_system_count, count(DISTINCT region) AS location_count
FROM ner_unstructured_data GROUP BY file_type""",
    "unstructured_region_statistics": """
SELECT region AS data_system_location_name, count(DISTINCT file_name) AS document_count,
       count(DISTINCT file_type) AS document_type_count,
       count(DISTINCT source) AS data_system_count
FROM ner_unstructured_data GROUP BY region""",
    "unstructured_flow": """
SELECT DISTINCT region AS location, source AS data_service, sub_service,
       file_type AS file_format
FROM ner_unstructured_data""",
    "unstructured_summary": """
SELECT count(DISTINCT source) AS total_data_system_count,
       count(DISTINCT region) AS total_location_count
FROM ner_unstructured_data""",
}


def _register(number: int, name: str) -> None:
    tables = VIEWS[name][1]

    def run(spark, sf_dir):
        return report(name, {table: fixture(spark, sf_dir, table) for table in tables})

    query(f"v{number:02d}_{name}", f"WITH {ctes(*tables)} {CHECKS[name]}")(run)


for _number, _name in enumerate(VIEWS, start=1):
    _register(_number, _name)
