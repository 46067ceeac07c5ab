"""Tables a processed file fans out to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.operators.joins import dewey_category, dewey_ranges, tag_key

# Object bucket and vector store name written with every row.
BUCKET = "raw-data"
VECTOR_STORE = "meilisearch"


def object_key():
    """S20."""
    return F.concat_ws("/", "dewey_decimal", F.col("file_id").cast("string"), "file_name")


def build_catalog(files: DataFrame) -> dict[str, DataFrame]:
    """Files, tags, file_tags, dewey_catalog as projections of one input."""
    spark = files.sparkSession
    pairs = files.select("file_id", F.explode("tags").alias("name"),
                         F.lit("auto").alias("category")).distinct()
    classes = files.groupBy("dewey_decimal").agg(
        F.min_by(F.coalesce(F.col("title"), F.col("file_name")) if "title" in files.columns
                 else F.col("file_name"), "file_id").alias("description"))
    return {
        "files": files.select("file_id", "dewey_decimal", "file_name", "file_path",
                              F.coalesce("extension", F.lit("")).alias("file_type"), "file_size",
                              object_key().alias("object_key")),
        "tags": pairs.select("name", "category").distinct().select(
            tag_key().alias("tag_id"), "name", "category"),
        "file_tags": pairs.select("file_id", tag_key().alias("tag_id"),
                                  F.lit(1.0).alias("confidence")),
        "dewey_catalog": dewey_category(classes, dewey_ranges(spark)).select(
            "dewey_decimal", F.col("dewey_category").alias("category"), "description"),
    }


def vector_locations(files: DataFrame, vecs: DataFrame) -> DataFrame:
    """S19."""
    return files.select("file_id").join(vecs, "file_id").select(
        "file_id", F.lit(VECTOR_STORE).alias("vector_store"), F.col("file_id").alias("vector_id"),
        F.coalesce("model", F.lit("unknown")).alias("embedding_model"),
        F.size("embedding").alias("dimensions"))


def search_docs(files: DataFrame) -> DataFrame:
    """Search document with defaults for absent attributes."""
    have = set(files.columns)

    def col(name, default):
        return F.coalesce(F.col(name), default) if name in have else default

    none = F.array().cast("array<string>")
    cols = [F.col("file_id").alias("id"), "dewey_decimal", "file_name",
            col("title", F.col("file_name")).alias("title"),
            col("summary", F.lit("")).alias("summary"), col("tags", none).alias("tags"),
            col("categories", none).alias("categories"),
            col("language", F.lit("")).alias("language"),
            col("mime_type", F.lit("")).alias("mime_type"),
            col("extension", F.lit("")).alias("extension"),
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
            col("file_size", F.lit(0)).alias("file_size")]
    if "embedding" in have:
        cols.append(F.struct(F.col("embedding").alias("default")).alias("_vectors"))
    return files.select(*cols)


def graph_tables(files: DataFrame) -> dict[str, DataFrame]:
    """Nodes and edges; merging the same key twice leaves one row."""
    empty = F.create_map().cast("map<string,string>")
    file_node = F.concat(F.lit("File:"), F.col("file_id").cast("string"))
    file_nodes = files.select(
        file_node.alias("node_id"), F.lit("File").alias("kind"),
        F.col("file_id").cast("string").alias("key"),
        F.create_map(F.lit("dewey_decimal"), F.col("dewey_decimal"), F.lit("file_name"),
                     F.col("file_name"), F.lit("mime_type"), F.col("mime_type")).alias("props"))
    ends = None
    for kind, rel, col in (("Tag", "TAGGED", "tags"), ("Category", "BELONGS_TO", "categories"),
                           ("Entity", "MENTIONS", "entities")):
        if col not in files.columns:
            continue
        part = files.select(file_node.alias("src"), F.explode(col).alias("x"))
        if kind == "Entity":
            part = part.filter("x.name IS NOT NULL AND x.type IS NOT NULL")
            key, node = F.col("x.name"), F.concat_ws(":", F.lit(kind), "x.type", "x.name")
        else:
            key, node = F.col("x"), F.concat_ws(":", F.lit(kind), "x")
        part = part.select("src", node.alias("dst"), F.lit(rel).alias("rel"),
                           F.lit(kind).alias("kind"), key.alias("key"))
        ends = part if ends is None else ends.unionByName(part)
    others = ends.select(F.col("dst").alias("node_id"), "kind", "key").distinct().withColumn(
        "props", empty)
    return {"nodes": file_nodes.dropDuplicates(["node_id"]).unionByName(others),
            "edges": ends.select("src", "dst", "rel").distinct()}


def cache_rows(files: DataFrame, ttl_s: int = 3600) -> DataFrame:
    """Two keys per file; for a class number the last file written wins."""
    title = F.coalesce(F.col("title"), F.col("file_name")) if "title" in files.columns else F.col(
        "file_name")
    value = F.to_json(F.struct(
        F.col("file_id").alias("id"), "dewey_decimal", title.alias("title"), "tags", "categories",
        F.struct(F.lit(BUCKET).alias("bucket"), object_key().alias("object")).alias("storage")))
    rows = files.select("file_id", "dewey_decimal", value.alias("value"),
                        F.col("created_at").alias("written_at"), F.lit(ttl_s).alias("ttl_s"))
    by_file = rows.select(F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("key"),
                          "value", "written_at", "ttl_s")
    by_class = rows.groupBy(F.concat(F.lit("dewey:"), "dewey_decimal").alias("key")).agg(
        F.max_by(F.struct("value", "written_at", "ttl_s"),
                 F.struct("written_at", "file_id")).alias("r")).select("key", "r.*")
    return by_file.unionByName(by_class)


def lifecycle_points(files: DataFrame) -> DataFrame:
    """Started, completed and error points with tags and fields.

    ``files`` has created_at, finished_at and a nullable ``error``.
    """
    def tags(status, *extra):
        return F.create_map(F.lit("file_id"), F.col("file_id").cast("string"), F.lit("file_name"),
                            F.col("file_name"), F.lit("status"), F.lit(status), *extra)

    prio = (F.lit("priority"), F.coalesce("priority", F.lit("unknown")))
    ms = ((F.unix_micros("finished_at") - F.unix_micros("created_at")) / 1000).cast("long")
    name = F.lit("file_processing").alias("measurement")
    started = files.select(
        name, tags("started", *prio).alias("tags"),
        F.create_map(F.lit("path"), F.col("file_path"), F.lit("size"),
                     F.col("file_size").cast("string")).alias("fields"),
        F.col("created_at").alias("ts"))
    done = files.filter("error IS NULL AND finished_at IS NOT NULL").select(
        name, tags("completed", *prio, F.lit("dewey_decimal"),
                   F.coalesce("dewey_decimal", F.lit("000.00"))).alias("tags"),
        F.create_map(F.lit("processing_time_ms"), ms.cast("string")).alias("fields"),
        F.col("finished_at").alias("ts"))
    failed = files.filter("error IS NOT NULL").select(
        name, tags("error").alias("tags"), F.create_map(F.lit("error"), F.col("error")).alias("fields"),
        F.col("finished_at").alias("ts"))
    return started.unionByName(done).unionByName(failed)
