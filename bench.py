"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.  Each query is timed
while it writes its whole result to the no-op sink; one short query before them starts the session."""

import json
import os
import time

from pyspark.sql import SparkSession

from quillspark.plans import QUERIES

HEADLINE = (
    "split_parts", "merge_files", "rotate_pages", "organize_pages", "watermark_tiles", "page_number_stamps", "documents_to_markdown", "line_segments", "table_cells", "redaction_search", "redaction_mask",
    "word_diff_stats", "same_streams", "custom_size", "sheet_rows", "sheet_pages", "numeric_cells", "number_formats", "wrapped_lines", "usage_summary", "usage_sessions",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("quillspark-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["split_all"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "seconds for all headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
