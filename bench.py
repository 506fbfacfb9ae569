"""Times the headline queries, and those of the llm subpackage if it is there, over BENCH_SF_DIR on local[BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from docveil.queries import QUERIES

try:
    from docveil.llm.queries import queries as llm_queries
except ImportError:
    llm_queries = dict

HEADLINE = (
    "pii_groups", "span_offsets", "pseudonymised_text", "word_score", "scan_counts", "search_plain", "page_flatten", "index_runs", "sort_files_nulls_last", "move_pages", "filename_dates", "words_to_text",
    "strip_markup", "chapter_bodies", "merge_plan", "undo_steps",
)


#: Queries of the newer modules, timed beside the headline ones.
MORE = ("language_ratios", "case_statistics", "names_by_case", "propagated_variants", "inflected_context", "catalogue_round_trip", "xhtml_bodies", "spliced_edits", "overview")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    def timed(queries: dict) -> dict[str, float]:
        took = {}
        for name, made in queries.items():
            began = time.time()
            made(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
        return took

    took, more, llm = timed({name: QUERIES[name] for name in HEADLINE}), timed({name: QUERIES[name] for name in MORE}), timed(llm_queries())
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took | more | llm, "more_total": round(sum(more.values()), 3), "training_data_total": round(sum(llm.values()), 3), "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
