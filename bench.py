"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mnemograph.plans import queries as registry  # noqa: E402
from mnemograph.session import get_spark  # noqa: E402

HEADLINES = [
    "log_state_fold", "session_rollup", "loops_fold_order", "branch_listing",
    "event_nodes", "thread_rollup_status", "thread_cooccurrence", "concept_fold",
    "procedure_fold", "resonance_edges", "graph_build", "incremental_graph_build", "seed_vector", "spread_2hop",
    "attend_nodes", "active_subgraph_2hop", "incubation", "tfidf_vectors", "tfidf_search",
    "bm25_search", "event_search", "dense_topk", "drift_per_session", "abstract_concepts",
    "learn_procedures", "mine_patterns", "introspect_metrics", "streaming_late_close",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    def timed(folder: str) -> dict[str, float]:
        times = {}

        def run(name, work):
            start = time.perf_counter()
            work()
            times[name] = round(time.perf_counter() - start, 3)

        # What the other queries read once per application, each timed on its own.
        run("ingest_log", lambda: registry.log_of(spark, folder))
        run("project_graph", lambda: registry.graph_of(spark, folder))
        run("settle_attention", lambda: registry.attention_of(spark, folder))
        run("index_documents", lambda: registry.document_index(spark, folder).vectors())
        run("index_events", lambda: registry.event_index(spark, folder))
        for name in HEADLINES:
            run(name, lambda: registry.REGISTRY[name](spark, folder)
                .write.format("noop").mode("overwrite").save())
        return times

    # The smaller size first; it also warms up the JVM.
    small_dir = os.path.join(os.path.dirname(os.path.normpath(sf_dir)), "sf0.01")
    small = timed(small_dir) if os.path.isdir(small_dir) and small_dir != sf_dir else {}
    times = timed(sf_dir)
    print(json.dumps({
        "metric": "memory graph queries, total wall time",
        "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
        "queries_sf0.01": small,
        "growth": {k: round(times[k] / v, 2) for k, v in small.items() if v}}))


if __name__ == "__main__":
    main()
