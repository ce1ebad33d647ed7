"""Wall time of the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query is run once to warm up code generation and
Python workers and timed on the next run; results go to Spark's no-op sink, so nothing is brought to the driver.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

HEADLINE = [
    "src_storefront_json", "src_html_product", "src_browse_filtered", "sink_catalog_upsert", "fn_aesthetic_tags", "fn_looks_english", "fn_steer_parse", "flt_steer_post", "flt_edit_rules",
    "join_hydrate_inner", "join_asof_latest_steer", "join_token_theta", "join_cross_knn", "agg_brand_best_image", "agg_centroid", "agg_click_affinity_features", "agg_soft_avoids", "agg_session_engagement",
    "win_adaptive_norm", "win_round_robin", "win_catalog_slices", "topk_vector", "topk_clustered", "topk_per_phrase_union", "set_pool_merge", "vec_project", "vec_greedy_cluster", "rank_keyword", "rank_rrf",
    "rank_hybrid", "rank_rerank_score", "rank_mmr", "rank_two_stage", "rank_session_centroid", "rank_card_score", "rank_spread_brand", "prof_user_vector", "gen_triplets", "maint_mistag_audit", "st_session_buffers", "st_windows",
]


def run(spark, fn, folder) -> float:
    t0 = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        from modiste.session import get_session
        from modiste.workload import all_queries

        spark = get_session("bench", cpus=cpus, shuffle_partitions=int(cpus))
        spark.sparkContext.setLogLevel("ERROR")
        queries, times = all_queries(), {}
        for name in names:
            run(spark, queries[name], folder)
            times[name] = round(run(spark, queries[name], folder), 3)
            print(name, times[name], file=sys.stderr, flush=True)
        spark.stop()
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
