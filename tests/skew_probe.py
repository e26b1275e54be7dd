"""Run as a program by ``test_skew``: the metrics whose joins meet hot order ids, over half a
million generated actions, with Spark's event log written to a folder.

    python skew_probe.py FOLDER {hot,null,plain-hot,plain-null}

Prints one JSON line: per metric, the worst ratio of the most shuffled records a task
read to the median task, over the stages that read many.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from orderlytics.operators import skew  # noqa: E402
from orderlytics.plans import economics as E  # noqa: E402
from orderlytics.plans import marketing as M  # noqa: E402
from orderlytics.session import get_session  # noqa: E402
from orderlytics.sources.params import Campaigns  # noqa: E402
from orderlytics.sources.tables import Shop  # noqa: E402

ACTIONS, ORDERS, USERS, PARTS = 500_000, 50_000, 10_000, 16
WINDOW = (dt.date(2024, 1, 1), dt.date(2024, 2, 1))


def make_shop(spark, folder: str, null: bool) -> Shop:
    """70 % of the actions on one order id, or without one."""
    random = lambda seed, n: (F.rand(seed) * n).cast("long")
    moment = lambda seed: (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
                           + F.make_dt_interval(days=random(seed, 60).cast("int"), hours=random(seed + 1, 24).cast("int")))
    often = F.lit(None).cast("long") if null else F.lit(7).cast("long")
    tables = {
        "user_actions": spark.range(0, ACTIONS, 1, 8).select(
            random(1, USERS).alias("user_id"), F.when(F.rand(2) < 0.7, often).otherwise(random(3, ORDERS)).alias("order_id"),
            F.when(F.rand(4) < 0.02, F.when(F.col("id") % 2 == 0, "cancel_order").otherwise("pay_order"))
            .otherwise("create_order").alias("action"), moment(5).alias("time")),
        "orders": spark.range(0, ORDERS, 1, 4).select(F.col("id").alias("order_id"), moment(8).alias("creation_time")),
        "order_items": spark.range(0, 3 * ORDERS, 1, 4).select(random(11, ORDERS).alias("order_id"), random(12, 500).alias("product_id")),
        "products": spark.range(500).select(F.col("id").alias("product_id"), F.concat(F.lit("p"), F.col("id") % 60).alias("name"),
                                            F.col("id").cast("decimal(12,2)").alias("price")),
    }
    # the hot order itself is never cancelled
    tables["user_actions"] = tables["user_actions"].withColumn("action", F.when(
        F.coalesce(F.col("order_id") == 7, F.lit(True)), "create_order").otherwise(F.col("action")))
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Shop.from_tables(read("user_actions"), read("orders"), read("products"), None, read("order_items"))


def ratios(log: str, spans: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Per metric the worst ratio of the most to the median records read by a task."""
    read = defaultdict(lambda: defaultdict(list))
    for line in open(log):
        if '"SparkListenerTaskEnd"' not in line:
            continue
        event = json.loads(line)
        if not event.get("Task Metrics"):
            continue
        at = event["Task Info"]["Launch Time"] / 1000
        for name, (start, end) in spans.items():
            if start <= at < end:
                read[name][event["Stage ID"]].append(event["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
    worst = {}
    for name, stages in read.items():
        large = [tasks for tasks in stages.values() if sum(tasks) >= 50_000]
        worst[name] = max((max(tasks) / max(statistics.median(tasks), sum(tasks) / PARTS / 2) for tasks in large), default=0)
    return worst


def main(folder: str, kind: str) -> None:
    if kind.startswith("plain"):
        skew.LEAST_ROWS = 1 << 60      # nothing is told apart
    log = f"{folder}/events"
    os.makedirs(log)
    spark = get_session(app="skew", master="local[4]", shuffle_partitions=PARTS, conf={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log, "spark.eventLog.rolling.enabled": "false",
        "spark.eventLog.compress": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB"})
    shop = make_shop(spark, folder, kind.endswith("null"))
    campaigns = Campaigns(spend={0: 1000, 1: 1000}, assign=F.col("user_id") % 2)
    metrics = {"m2": lambda: M.m2_roi(shop, campaigns), "m3": lambda: M.m3_avg_check(shop, campaigns, WINDOW),
               "m6": lambda: M.m6_cumulative_arppu(shop, campaigns), "e2": lambda: E.e2_arpu_arppu_aov(shop),
               "e5": lambda: E.e5_new_user_share(shop)}
    spans, digests = {}, {}
    for name, metric in metrics.items():
        start = time.time()
        digests[name] = sorted(str(tuple(r)) for r in metric().collect())
        spans[name] = (start, time.time())
    app = spark.sparkContext.applicationId
    spark.stop()
    print(json.dumps({"ratios": ratios(f"{log}/{app}", spans), "rows": digests}))


if __name__ == "__main__":
    main(*sys.argv[1:])
