"""Time the headline queries and print one JSON line.

Each query runs once to warm up and is then timed over all of its rows and
columns: the plan is built and written to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from siteloom.session import build_session  # noqa: E402

HEADLINE = [
    "a01_kpis",
    "a05_progress_table",
    "a07_risk_score",
    "a08_latest_notices",
    "a13_budget_summary",
    "j01_tickets_with_site",
    "j03_notice_log",
    "j04_tickets_latest_notice",
    "j08_contact_resolution",
    "j09_orphans",
    "j10_template_expansion",
    "j11_outbound_notices",
    "l05_by_priority_rank",
    "l07_next_tasks",
    "l09_urgent_tasks",
    "l10_tickets_to_unblock",
    "m10_triage_updates",
    "m16_note_append",
    "r01_dashboard_sites",
    "r02_daily_report",
    "r07_client_full_report",
    "r09_client_lists",
    "r10_foreman_cards",
    "s05_append_batch",
    "s06_budget_upsert",
    "s07_task_update",
    "s07_ticket_update",
    "s08_reply_cascade",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "siteloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - started, 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
