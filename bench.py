"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = ("win1_dedupe", "win3_vessel_fold", "agg1_station_stats", "agg3_station_vessels", "agg8_rate", "join2_fan_out", "join5_quiet_targets", "par7_reassembly", "par9_encode_decode", "par9_messages", "win5_stamped_events", "snk1_archive", "win6_relabel", "win7_pacer")


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])
    from tidewatch import catalog

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{DIR}/events.parquet").write.format("noop").mode("overwrite").save()
    # one run of a Python stage, so that the first query doesn't pay for starting the workers
    spark.range(1000).repartition(int(CPUS)).mapInArrow(lambda batches: batches, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for name in NAMES:
        began = time.time()
        catalog.queries()[name](spark, DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(DIR)}))


if __name__ == "__main__":
    main()
