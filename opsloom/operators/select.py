"""Filters, matchers, routing and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MB_100 = 100 * 1024 * 1024


def filter_samples(df: DataFrame, name=None, start=None, end=None, collector=None,
                   newest_first: bool = True) -> DataFrame:
    """Conditions are ANDed; both time bounds are inclusive."""
    if collector is not None:
        df = df.filter(F.col("collector") == collector)
    if name is not None:
        df = df.filter(F.col("name") == name)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df.orderBy(F.col("ts").desc(), F.col("sample_id").desc()) if newest_first else df


def by_prefix(df: DataFrame, *prefixes: str, col: str = "name") -> DataFrame:
    """P02."""
    return df.filter(reduce(Column.__or__, [F.col(col).startswith(p) for p in prefixes]))


def with_label(df: DataFrame, *keys: str) -> DataFrame:
    """Keep rows that carry every label and add each as a column."""
    for key in keys:
        df = df.filter(F.map_contains_key("labels", key)).withColumn(key, F.col("labels")[key])
    return df


def match_labels(df: DataFrame, eq: Mapping[str, str] | None = None,
                 regex: Mapping[str, str] | None = None, labels: str = "labels") -> DataFrame:
    """Equality and fully anchored regular expressions on labels."""
    for key, value in (eq or {}).items():
        df = df.filter(F.col(labels)[key] == value)
    for key, pattern in (regex or {}).items():
        df = df.filter(F.col(labels)[key].rlike(f"^(?:{pattern})$"))
    return df


def between(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Inclusive time range."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def extract(df: DataFrame, predicate: Column | str, cols: Sequence[str]) -> DataFrame:
    """P06."""
    return df.filter(predicate).select(*cols)


def priority_of(name: Column) -> Column:
    """P07."""
    return (F.when(name.contains("high"), "high").when(name.contains("medium"), "medium")
            .otherwise("low"))


def route_queue(mime: Column, priority: Column, size: Column) -> Column:
    """First rule wins."""
    return (F.when(mime.startswith("text/") | mime.startswith("image/"), "embeddings_staging")
            .when(priority == "high", "raw_priority")
            .when((size > MB_100) | mime.startswith("video/"), "raw_batch")
            .otherwise("raw_normal"))


# Extensions each processor accepts.
PROCESSOR_EXTENSIONS = {
    "text": ["pdf", "txt", "doc", "docx", "odt", "rtf"],
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "tiff"],
    "audio": ["mp3", "wav", "flac", "ogg", "m4a"],
    "video": ["mp4", "avi", "mkv", "mov", "webm"],
}


def processor_by_mime(mime: Column) -> Column:
    """Image and video by mime; everything else goes to text."""
    return (F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video")
            .otherwise("text"))


def processor_by_extension(extension: Column) -> Column:
    """NULL for an extension no processor accepts."""
    return F.coalesce(*[F.when(extension.isin(exts), name)
                        for name, exts in PROCESSOR_EXTENSIONS.items()])


def embedding_model(mime: Column) -> Column:
    """P10. The two model names are fixed values."""
    return F.when(mime.startswith("image/"), "clip-vit-base-patch32").otherwise(
        "text-embedding-ada-002")


@dataclass(frozen=True)
class Route:
    prefix: str
    service: str
    priority: int
    strip: str | None = None


# Path prefix, service, priority, stripped prefix.
MODEL_ROUTES = [
    Route("/v2", "triton-service", 100, "/v2"),
    Route("/v1/models", "tensorflow-service", 90, "/v1"),
    Route("/predictions", "torchserve-service", 80),
    Route("/api/docs", "api-docs-service", 110, "/api/docs"),
]


def route_requests(log: DataFrame, routes: Sequence[Route] = MODEL_ROUTES) -> DataFrame:
    """Highest-priority matching prefix; a stripped path always starts with a slash."""
    service, upstream = F.lit(None).cast("string"), F.col("path")
    for r in sorted(routes, key=lambda r: r.priority):
        hit = F.col("path").startswith(r.prefix)
        service = F.when(hit, r.service).otherwise(service)
        upstream = F.when(hit, _strip(r.strip)).otherwise(upstream)
    return log.withColumn("service", service).withColumn("upstream_path", upstream)


def _strip(prefix: str | None) -> Column:
    path = F.col("path")
    if prefix is None:
        return path
    rest = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def band(value: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """The last step whose lower bound the value reaches; bound None is the base step."""
    out = F.lit(None).cast("string")
    for bound, label in steps:
        out = F.lit(label) if bound is None else F.when(value >= bound, label).otherwise(out)
    return out


def map_value(value: Column, mapping: Mapping[float, str]) -> Column:
    """Value mapping such as 0 -> Down, 1 -> Up."""
    return F.coalesce(*[F.when(value == k, v) for k, v in mapping.items()])


@dataclass(frozen=True)
class Relabel:
    """One relabelling rule; the regular expression is anchored at both ends."""

    action: str
    regex: str = "(.*)"
    sources: tuple[str, ...] = ()
    target: str = ""
    replacement: str = "$1"
    separator: str = ";"


def relabel(df: DataFrame, rules: Sequence[Relabel], labels: str = "labels") -> DataFrame:
    """Keep / drop / replace / labelmap in order; an empty replacement removes the label."""
    for r in rules:
        pattern = f"^(?:{r.regex})$"
        joined = F.concat_ws(r.separator, *[F.coalesce(F.col(labels)[s], F.lit(""))
                                            for s in r.sources])
        if r.action == "keep":
            df = df.filter(joined.rlike(pattern))
        elif r.action == "drop":
            df = df.filter(~joined.rlike(pattern))
        elif r.action == "replace":
            value = F.regexp_replace(joined, pattern, r.replacement)
            others = F.map_filter(labels, lambda k, _: k != r.target)  # noqa: B023
            put = F.when(value == "", others).otherwise(
                F.map_concat(others, F.create_map(F.lit(r.target), value)))
            df = df.withColumn(labels, F.when(joined.rlike(pattern), put).otherwise(F.col(labels)))
        elif r.action == "labelmap":
            hits = F.map_filter(labels, lambda k, _: k.rlike(pattern))  # noqa: B023
            renamed = F.transform_keys(
                hits, lambda k, _: F.regexp_replace(k, pattern, r.replacement))  # noqa: B023
            # A column of its own: inside a lambda the map would be built again for every key.
            df = df.withColumn("_renamed", renamed)
            kept = F.map_filter(labels, lambda k, _: ~F.map_contains_key("_renamed", k))
            df = df.withColumn(labels, F.map_concat(kept, "_renamed")).drop("_renamed")
        else:
            raise ValueError(f"unknown relabel action {r.action}")
    return df


def reject_old(df: DataFrame, now, max_age_hours: int = 168, ts: str = "ts") -> DataFrame:
    """Keep rows at most ``max_age_hours`` old."""
    limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(max_age_hours)} HOURS")
    return df.filter(F.col(ts) >= limit)


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(path_key, column expression) of every leaf of a nested report."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.`{f.name}`" if prefix else f"`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += leaf_paths(f.dataType, path)
        else:
            out.append((path.replace("`", "").replace(".", "_"), path))
    return out


def flatten_report(df: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    """Nested report -> (path_key, value) rows."""
    pairs = [F.struct(F.lit(key).alias("path_key"), F.col(col).cast("string").alias("value"))
             for key, col in leaf_paths(df.drop(*id_cols).schema)]
    return df.select(*id_cols, F.inline(F.array(*pairs)))


def pct(a: Column, b: Column) -> Column:
    """A / b * 100, 0 when b is not positive."""
    return F.when(b > 0, a / b * 100).otherwise(F.lit(0.0))


def storable(df: DataFrame, drop: Sequence[str] = ("embeddings",)) -> DataFrame:
    """Drop vectors and write times as ISO text."""
    out = df.drop(*drop)
    for f in out.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out = out.withColumn(f.name, F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss"))
    return out
