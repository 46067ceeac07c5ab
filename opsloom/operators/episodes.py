"""Alert lifecycle, history views and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.operators.ordered import MICROS, by_time, previous, running_sum


def alert_episodes(fires: DataFrame, resolves: DataFrame, by: Sequence[str]) -> DataFrame:
    """An episode opens on the first fire after a resolve and closes on the next resolve.

    The episode number is the running count of resolves; each episode is one aggregate row.
    ``fires`` has (by, us, sample_id, value), ``resolves`` has (by, us, sample_id). A resolve
    without an open episode changes nothing.
    """
    f = fires.select(*by, "us", "sample_id", F.lit(0).alias("resolve"), "value")
    r = resolves.select(*by, "us", "sample_id", F.lit(1).alias("resolve"),
                        F.lit(None).cast("double").alias("value"))
    ran = running_sum(f.unionByName(r), by, ["us", "sample_id", "resolve"],
                      {"closed": F.col("resolve")}, by_time("us"))
    fire = F.col("resolve") == 0
    order = F.when(fire, F.struct("us", "sample_id"))
    grouped = ran.withColumn("episode", F.col("closed") - F.col("resolve")).groupBy(
        *by, "episode").agg(
        F.count_if(fire).alias("fires"), F.min(F.when(fire, F.col("us"))).alias("opened_us"),
        F.max(F.when(fire, F.col("us"))).alias("last_fire_us"),
        F.max_by("value", order).alias("final_value"),
        F.max(F.when(fire, F.col("value"))).alias("peak_value"),
        F.max(F.when(~fire, F.col("us"))).alias("resolved_us"))
    return (grouped.filter("fires > 0")
            .withColumn("status", F.when(F.col("resolved_us").isNull(), "active")
                        .otherwise("resolved"))
            .withColumn("duration_s", (F.col("resolved_us") - F.col("opened_us")) / MICROS)
            .drop("episode"))


def auto_resolves(held: DataFrame, by: Sequence[str]) -> DataFrame:
    """Resolve rows at the first good sample after a violating run."""
    was = previous(held, by, ["us", "sample_id"], {"_was": F.col("violated")}, by_time("us"))
    return was.filter(~F.col("violated") & F.coalesce(F.col("_was"), F.lit(False))).select(
        *by, "us", "sample_id")


def alert_status(episodes: DataFrame, handler: str = "handler") -> DataFrame:
    """Active alerts and everything triggered, per handler type."""
    return episodes.groupBy(handler).agg(F.count_if(F.col("status") == "active").alias("active"),
                                         F.sum("fires").alias("total_triggered"))


def render_alerts(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """One message row per alert and channel.

    The wording of the two message forms is a fixed value.
    """
    chat = F.format_string(
        ":warning: Pipeline Alert: %s\n*Severity:* %s\n*Threshold:* %s\n*Current Value:* %s\n"
        "*Time:* %s", "rule", "severity", F.col("threshold").cast("string"),
        F.col("value").cast("string"), "time_text")
    mail = F.format_string(
        "<div class=\"%s\"><h2>Pipeline Alert: %s</h2><p><strong>Severity:</strong> %s</p>"
        "<p><strong>Threshold:</strong> %s</p><p><strong>Current Value:</strong> %s</p>"
        "<p><strong>Time:</strong> %s</p></div>", "severity", "rule", "severity",
        F.col("threshold").cast("string"), F.col("value").cast("string"), "time_text")
    channels = rules.select("rule", "severity", "threshold", F.explode("channels").alias("channel"))
    text = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss")
    return (alerts.select("rule", "sample_id", "us", "value").join(channels, "rule")
            .withColumn("time_text", text)
            .withColumn("message", F.when(F.col("channel") == "email", mail).otherwise(chat))
            .select("rule", "sample_id", "channel", "message"))
