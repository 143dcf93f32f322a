"""Archived captures: response logs, verified bytes, service pages and tabular documents, read from files.

Live collection is out of scope; every reader works on what a collector has archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESPONSE_LOG = "id string, source_id string, url string, purpose string, retrieved_at string, http_status int, final_url string, response_file string, sha256 string, bytes long, status string, error string"
RINGS = "array<array<array<double>>>"
CHUNK = 8_000_000


def response_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of responses (JSON array or lines) with a fixed schema."""
    return spark.read.schema(RESPONSE_LOG).option("multiLine", True).json(path)


def outcome(http_status: Column, body: Column, error: Column) -> Column:
    """JSON_RECEIVED, API_ERROR, HTTP_ERROR, NON_JSON or REQUEST_FAILED of a response."""
    parsed = F.try_parse_json(body)
    api_error = F.get_json_object(body, "$.error").isNotNull()
    return (
        F.when(error.isNotNull() | http_status.isNull(), "REQUEST_FAILED").when(http_status >= 400, "HTTP_ERROR")
        .when(parsed.isNull(), "NON_JSON").when(api_error, "API_ERROR").otherwise("JSON_RECEIVED")
    )


def file_signature(content: Column) -> Column:
    """Kind of a document by its first bytes: pdf, zip, sqlite, html, json or unknown."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 200), "ISO-8859-1")))
    return (
        F.when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("53514C69746520666F726D6174203300"), "sqlite")
        .when(text.startswith("<!doctype html") | text.startswith("<html"), "html").when(text.startswith("{") | text.startswith("["), "json").otherwise("unknown")
    )


def archived_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256, content) of the files of an archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def chunk_digests(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """(path, part, bytes, sha256) of the parts of large files."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / size).cast("int") - 1, F.lit(0)))
    cut = files.select("path", F.explode(parts).alias("part"), "content")
    piece = F.substring("content", F.col("part") * size + 1, F.lit(size))
    return cut.select("path", "part", F.length(piece).alias("bytes"), F.sha2(piece, 256).alias("sha256"))


def verify_archive(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Violations (id, reason) of a manifest (id, file, bytes, sha256) against files (file, bytes, sha256)."""
    found = files.select(F.col("file").alias("_file"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    joined = manifest.join(found, F.col("file") == F.col("_file"), "left")
    reason = F.when(F.col("_file").isNull(), "missing").when(F.col("bytes") != F.col("_bytes"), "size").when(F.col("sha256") != F.col("_sha"), "digest")
    bad = joined.select("id", reason.alias("reason")).filter("reason is not null")
    twice = manifest.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select("id", F.lit("duplicate").alias("reason"))
    return bad.unionByName(twice)


def reassembled(parts: DataFrame) -> DataFrame:
    """(file, content) from (file, part, content): parts in order. A file must fit into a task, as any blob does."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: F.hex(x["content"]))
    return parts.groupBy("file").agg(F.unhex(F.array_join(ordered, "")).alias("content"))


def feature_pages(pages: DataFrame, body: str = "body", crs: str | None = "4326") -> DataFrame:
    """Features of GeoJSON FeatureCollection pages: (page columns, ordinal, feature text, properties, geometry text).

    A page that names another coordinate system than expected is an error, not a guess.
    """
    text = F.col(body)
    named = F.get_json_object(text, "$.crs.properties.name")
    wrong = named.isNotNull() & ~F.coalesce(named.endswith(crs or ""), F.lit(False)) if crs else F.lit(False)
    features = F.when(wrong, F.raise_error(F.lit("unexpected coordinate system"))).otherwise(F.from_json(F.get_json_object(text, "$.features"), "array<string>"))
    rows = pages.select("*", F.posexplode(features).alias("ordinal", "feature"))
    return rows.select(*pages.columns, "ordinal", "feature", F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>").alias("properties"), F.get_json_object("feature", "$.geometry").alias("geometry"))


def ring_features(pages: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Features of ring-based service pages: (object_id, attributes, rings)."""
    features = F.from_json(F.get_json_object(F.col(body), "$.features"), f"array<struct<attributes: map<string,string>, geometry: struct<rings: {RINGS}>>>")
    rows = pages.select(F.explode(features).alias("f"))
    return rows.select(F.element_at("f.attributes", key).cast("long").alias("object_id"), F.col("f.attributes").alias("attributes"), F.col("f.geometry.rings").alias("rings"))


def header_rows(documents: DataFrame, body: str = "body") -> DataFrame:
    """Rows of tabular documents whose first row names the columns: (ordinal, record as a map)."""
    table = F.from_json(F.get_json_object(F.col(body), "$.Table"), "array<array<string>>")
    rows = documents.select(table.alias("t")).filter(F.size("t") > 0).select(F.col("t")[0].alias("header"), F.posexplode(F.slice("t", 2, 1 << 30)).alias("ordinal", "row"))
    return rows.select("ordinal", F.map_from_arrays("header", "row").alias("record"))


def page_drift(pages: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Ids that pages lack, repeat or have beyond the expected ids: (id, reason)."""
    seen = pages.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("_n"))
    both = expected.select(F.col(key).alias("id"), F.lit(1).alias("_want")).distinct().join(seen, "id", "full_outer")
    reason = F.when(F.col("_n").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").when(F.col("_n") > 1, "repeated")
    return both.select("id", reason.alias("reason")).filter("reason is not null")


def key_chunks(keys: DataFrame, key: str, size: int = 20) -> DataFrame:
    """Distinct keys in chunks for dependent requests: (chunk, keys); the last chunk of each partition may be smaller."""
    distinct = keys.filter(F.col(key).isNotNull()).select(key).distinct()
    ranked = distinct.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id() % (1 << 33))
    return ranked.groupBy("_p", F.floor(F.col("_n") / size).alias("_c")).agg(F.array_sort(F.collect_list(key)).alias("keys")).select(F.concat_ws("-", "_p", "_c").alias("chunk"), "keys")


def csv_members(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with a header and an optional byte order mark."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with each raw line and its digest beside the parsed record."""
    raw = spark.read.text(path).withColumnRenamed("value", "line")
    return raw.select("line", F.sha2("line", 256).alias("line_sha256"), F.from_json("line", schema).alias("record"))
