"""Catalog upserts: clean a batch, replace stored rows by key, derive the side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushmap.functions.scalar import (
    NOT_AVAILABLE,
    host_region,
    host_source,
    iso_epoch_seconds,
    repair_json,
    repaired_document,
)
from hushmap.schemas import CATALOG_KEYS
from hushmap.session import scratch_path

MISSING_TEXT = "NA"
TABLE_PROFILE = "tableProfile"
#: Partitions, by hash of the key, of a table that uploads are merged into.
KEY_BUCKETS = 64


def catalog_key(entity_type: str) -> str:
    try:
        return CATALOG_KEYS[entity_type]
    except KeyError:
        raise ValueError(f"unknown entity type {entity_type!r}") from None


def clean_batch(df: DataFrame, entity_type: str) -> DataFrame:
    """Drop rows without key, make the key a string, fill other gaps with 'NA' or 0."""
    key = catalog_key(entity_type)
    if key not in df.columns:
        raise ValueError(f"batch of {entity_type} has no column {key!r}")
    if df.isEmpty():
        raise ValueError(f"batch of {entity_type} is empty")
    keyed = df.dropna(subset=[key]).withColumn(key, F.col(key).cast("string"))
    texts = [f.name for f in keyed.schema.fields if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in keyed.schema.fields if isinstance(f.dataType, T.NumericType)]
    return keyed.fillna(MISSING_TEXT, subset=texts).fillna(0, subset=numbers)


def upsert_by_key(
    target: DataFrame, batch: DataFrame, key: str, keys: DataFrame | None = None
) -> DataFrame:
    """Target without the rows whose key occurs in the batch, plus every batch row.

    ``keys`` overrides the keys to remove, for derived tables where a key may go without
    being replaced.
    """
    gone = (batch if keys is None else keys).select(key).distinct()
    return target.join(gone, key, "left_anti").select(*target.columns).unionByName(
        batch.select(*target.columns)
    )


def derive_meta_info(batch: DataFrame, entity_type: str) -> DataFrame:
    """Meta rows of a cleaned batch: id, name, and source and region told by the host name.

    Rows whose JSON does not parse add nothing.
    """
    name = F.col("name") if "name" in batch.columns else F.lit(NOT_AVAILABLE)
    host = F.try_variant_get("_document", "$.connection.config.hostPort", "string")
    return (
        _with_document(
            batch,
            F.col(catalog_key(entity_type)).alias("dbservice_entity_id"),
            name.alias("dbservice_entity_name"),
        )
        .withColumn("_host", host)
        .select(
            "dbservice_entity_id",
            "dbservice_entity_name",
            host_source(F.col("_host")).alias("source"),
            host_region(F.col("_host")).alias("region"),
        )
    )


def _with_document(batch: DataFrame, *columns: Column) -> DataFrame:
    """Rows whose repaired JSON parses, with it as ``_document``; it is parsed once per row."""
    document = F.array_compact(F.array(repaired_document(F.col("json"))))
    return batch.select(*columns, F.explode(document).alias("_document"))


def rejected_rows(batch: DataFrame) -> DataFrame:
    """Rows that a derivation skips because their JSON does not parse."""
    return batch.filter(repair_json(F.col("json")).isNull())


def upsert_meta_info(meta: DataFrame, batch: DataFrame, entity_type: str) -> DataFrame:
    """Meta rows of the batch's ids go, the derived ones come."""
    gone = batch.select(F.col(catalog_key(entity_type)).alias("dbservice_entity_id"))
    derived = derive_meta_info(batch, entity_type)
    return upsert_by_key(meta, derived, "dbservice_entity_id", keys=gone)


def derive_profiler_metadata(batch: DataFrame) -> DataFrame:
    """Profile rows of a cleaned batch. Rows whose JSON, or whose creation time, does not
    parse add nothing."""
    profile = _with_document(
        batch.filter(F.col("jsonSchema") == TABLE_PROFILE), F.col("entityFQNHash")
    )

    def member(name: str, kind: str) -> Column:
        return F.try_variant_get("_document", f"$.{name}", kind)

    created = member("createDateTime", "string")
    seconds = iso_epoch_seconds(created)
    return (
        profile.select(
            "entityFQNHash",
            member("rowCount", "double").alias("rowCount"),
            member("timestamp", "bigint").alias("timestamp"),
            member("sizeInByte", "double").alias("sizeInByte"),
            member("columnCount", "double").alias("columnCount"),
            member("profileSample", "double").alias("profileSample"),
            seconds.alias("createDateTime"),
            member("profileSampleType", "string").alias("profileSampleType"),
            created.alias("_created"),
        )
        .filter(
            F.col("createDateTime").isNotNull() | (F.coalesce("_created", F.lit("")) == "")
        )
        .drop("_created")
    )


def upsert_profiler_metadata(metadata: DataFrame, batch: DataFrame) -> DataFrame:
    derived = derive_profiler_metadata(batch)
    return upsert_by_key(metadata, derived, "entityFQNHash", keys=batch)


class UploadedRows:
    """A stored table in which the rows of an upload replace those of earlier ones by key.

    The rows lie in partitions by the hash of their key. A merge reads and writes only the
    partitions that its keys fall into, in Spark's dynamic overwrite mode. Each row keeps the
    place of its upload in the order of arrival, so of several uploads with a key the last to
    arrive wins, in whatever order their files are merged; and it keeps its writer, so a merge
    that is run again replaces its own rows. The places of uploads are listed beside the rows.

    Only one merge into a table may run at a time. A merge that dies while Spark moves its
    partitions into place is made whole by running it again, if its old partitions still stand;
    keep a copy of the table where that matters.
    """

    UPLOAD, WRITTEN = "_upload", "_written"
    ARRIVAL, WRITER, BUCKET = "_arrival", "_writer", "_bucket"

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = KEY_BUCKETS):
        """``buckets`` counts for a new table; a stored one keeps its own."""
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.uploads = f"{self.path}/_uploads"
        self.buckets = buckets

    def create(self, rows: DataFrame) -> None:
        """Store a table that comes before all uploads."""
        self._list("create", self.spark.createDataFrame([(None, 0)], "upload string, arrival long"))
        placed = rows.withColumns({self.ARRIVAL: F.lit(0).cast("long"), self.WRITER: F.lit("create")})
        self._store(self._placed(placed, self.buckets))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(self.ARRIVAL, self.WRITER, self.BUCKET)

    def merge(self, rows: DataFrame, writer: str) -> None:
        """Add rows that carry ``UPLOAD``, the name of their upload, and ``WRITTEN``, the time it
        was written.

        Rows with the same key stay together if they are of the same upload, however many merges
        bring it. Rows with a null key replace nothing and are never replaced.
        """
        step = scratch_path(self.spark, "upload")
        rows.write.parquet(step)
        rows = self.spark.read.schema(rows.schema).parquet(step)
        if rows.isEmpty():
            return
        arrivals, buckets = self._arrivals(rows, writer)
        placed = rows.join(arrivals, F.col(self.UPLOAD).eqNullSafe(F.col("upload"))).withColumns(
            {self.ARRIVAL: F.col("arrival"), self.WRITER: F.lit(writer)}
        )
        placed = self._placed(placed.drop("upload", "arrival", self.UPLOAD, self.WRITTEN), buckets)
        touched = [r[0] for r in placed.select(self.BUCKET).distinct().collect()]
        both = placed
        if self._exists(self.path, rows=True):
            stored = self.spark.read.parquet(self.path).where(
                F.col(self.BUCKET).isin(touched) & (F.col(self.WRITER) != writer)
            )
            both = stored.unionByName(placed, allowMissingColumns=True)
        last = both.groupBy(F.col(self.key).alias("_key")).agg(F.max(self.ARRIVAL).alias("_last"))
        latest = both.join(last, F.col(self.key) == F.col("_key"), "left").where(
            F.col("_key").isNull() | (F.col(self.ARRIVAL) == F.col("_last"))
        )
        self._store(latest.drop("_key", "_last"))

    def _arrivals(self, rows: DataFrame, writer: str) -> tuple[DataFrame, int]:
        """(upload, arrival) of the uploads in ``rows``, and the table's number of partitions."""
        mine = rows.groupBy(F.col(self.UPLOAD).alias("upload")).agg(F.min(self.WRITTEN).alias("written"))
        start, buckets = 0, self.buckets
        known = self.spark.createDataFrame([], "upload string, arrival long")
        if self._exists(self.uploads):
            listed = self.spark.read.parquet(self.uploads)
            others = listed.where(F.col("writer") != _folder(writer))
            start = others.agg(F.max("arrival")).first()[0] or 0
            buckets = listed.agg(F.max("buckets")).first()[0]
            known = others.groupBy("upload").agg(F.min("arrival").alias("arrival"))
        # At most one upload per file of a trigger.
        fresh = mine.join(known.where("upload IS NOT NULL").select("upload"), "upload", "left_anti")
        order = Window.orderBy("written", "upload")
        numbered = fresh.select("upload", (F.row_number().over(order) + start).cast("long").alias("arrival"))
        self._list(writer, numbered, buckets)
        own = self.spark.read.parquet(f"{self.uploads}/writer={_folder(writer)}")
        all_known = known.select("upload", "arrival").unionByName(own.select("upload", "arrival"))
        return all_known.join(mine.select(F.col("upload").alias("_mine")), F.col("upload").eqNullSafe(F.col("_mine"))).select(
            "upload", "arrival"
        ), buckets

    def _list(self, writer: str, uploads: DataFrame, buckets: int | None = None) -> None:
        rows = uploads.withColumn("buckets", F.lit(buckets or self.buckets))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.uploads}/writer={_folder(writer)}")

    def _placed(self, rows: DataFrame, buckets: int) -> DataFrame:
        place = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")
        return rows.withColumn(self.BUCKET, place)

    def _store(self, rows: DataFrame) -> None:
        """Rebalancing splits a partition that holds a hot key between several writers."""
        rows.hint("rebalance", self.BUCKET).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(self.BUCKET).parquet(self.path)

    def _exists(self, path: str, rows: bool = False) -> bool:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{self.BUCKET}=*" if rows else path)
        fs = hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return bool(fs.globStatus(hadoop_path))


def _folder(writer: str) -> str:
    return writer.replace("/", "-")
