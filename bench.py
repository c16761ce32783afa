"""Wall times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

HEADLINE = [
    "k15_polygon_graph_degree", "j3_j6_polygon_neighbours", "j7_j9_all_nearest_points", "j2_mutual_filter", "r23_connected_components",
    "r25_contraction_nodes", "g1_g4_centralities", "p1_geodesic_distance", "l11_k1_split_tiles",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from geoweave.plans import catalog

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.queries()["l12_g8_common_box"](spark, sf).collect()  # start the engine
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
