"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables. BENCH_CPUS: cores. BENCH_REPEAT: searches of each phrase.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")


def main() -> None:
    from pyspark.sql import SparkSession

    from lexiquarry.operators.tokenizers import LETTERS
    from lexiquarry.plans.index import Index
    from lexiquarry.sources.text import corpus

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    work = tempfile.mkdtemp(prefix="lexiquarry-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{work}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, f):
        began = time.perf_counter()
        out = f()
        took[name] = round(time.perf_counter() - began, 3)
        return out

    docs = corpus(spark.read.parquet(f"{sf}/documents.parquet"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = timed("build_index", lambda: Index.build(spark, docs, vectors, f"{work}/index", LETTERS))
    for name, s in index.timers.report().items():
        took[f"build_{name}"] = round(s, 3)
    index = Index.load(spark, f"{work}/index").cached()
    phrases = ["the of", "on the and", "to the of in", "in the"]
    timed("first_search", lambda: index.search(phrases[0]).collect())
    each = []
    for _ in range(int(os.environ.get("BENCH_REPEAT", "3"))):
        for p in phrases:
            began = time.perf_counter()
            index.search(p, 20, 0.45).collect()
            each.append(time.perf_counter() - began)
    took["soft_search_median"] = round(statistics.median(each), 3)
    took["soft_search_p95"] = round(sorted(each)[int(0.95 * (len(each) - 1))], 3)
    timed("soft_search_low", lambda: index.search("on the and", 20, 0.20).collect())
    timed("soft_search_batch_100", lambda: index.search_batch([(i, phrases[i % len(phrases)]) for i in range(100)], 20, 0.45).collect())
    timed("exact_count", lambda: index.count("on the").collect())
    timed("exact_contexts", lambda: index.contexts("on the", 10, 100).collect())
    try:
        from lexiquarry.llm.queries import QUERIES
    except ImportError:
        QUERIES = {}
    for name, q in QUERIES.items():
        timed(name, lambda q=q: q(spark, sf).write.format("noop").mode("overwrite").save())
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(v for k, v in took.items() if not k.startswith("build_") or k == "build_index"), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
