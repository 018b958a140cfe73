"""Headline benchmark: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Polygon layers are checked, clustered and stored once (``load_layers``, part of
the total); the queries then run on the stored layers, as on a prepared data set.
"""

from __future__ import annotations

import json
import os
import time

from tests.session import make_session
from tidegrid.plans.layers import POLYGON_KEYS, DerivedLayers
from tidegrid.plans.registry import all_queries

HEADLINE = [
    # one layer
    "count_prefix_date",
    "avg_row_ratio",
    "sum_area_valid_zone",
    "max_area",
    "count_distinct_zones",
    "topn_by_hidden_count",
    # key joins
    "weighted_mean_topn",
    "top_year",
    "zip_join",
    # key and spatial joins
    "hospitals_in_flood_topn",
    "mixed_key_and_containment",
    "nested_exists_spatial",
    "tract_flood_intersects_avg",
    "exists_spatial_semi",
    "hospital_county_claims_sum",
    "county_rank_by_avg",
    "spatial_rule_hospitals_floodplain",
    "spatial_rule_floodplain_zcta",
    # measures
    "zcta_flood_overlap_area",
    "coverage_share",
    "within_distance",
    # retrieval and comparison
    "cosine_topk",
    "weighted_component_score",
    "multiset_jaccard",
    "frames_match",
]


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = make_session(int(os.environ.get("BENCH_CPUS", "8")))
    queries = all_queries()
    layers = DerivedLayers(spark, directory)
    seconds = {"load_layers": timed(lambda: [layers[n].count() for n in POLYGON_KEYS])}
    for name in HEADLINE:
        # results are produced in full, without being sent to the driver
        seconds[name] = timed(
            lambda: queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        )
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline query time",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": directory.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
