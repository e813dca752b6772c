"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query
runs once to warm up and then $BENCH_RUNS times; the median counts. Results go to
Spark's noop sink, so every row is made and none is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobloom.plans import QUERIES  # noqa: E402
from jobloom.session import local_session  # noqa: E402

HEADLINE = [
    "top_companies", "flt_vac_tech", "jn_vac_company", "jn_com_detail", "jn_match_existing", "jn_dup_pairs",
    "agg_company_metrics", "agg_dashboard", "agg_industry_bench", "agg_vac_trend", "win_latest", "win_top10_vac",
    "win_score_trend", "lim_page", "sal_extract", "js_contract", "hsh_content", "txt_tech", "txt_lang", "txt_noise",
    "txt_quality", "sc_company", "sc_vacancy", "up_vacancy", "cdc_ttl", "dq_dups", "pg_content", "pg_markdown",
    "pg_cards", "pg_complete13", "st_app_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run or runs == 0:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))


if __name__ == "__main__":
    main()
