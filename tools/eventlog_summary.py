"""Per-query job, stage and task-time totals from a Spark event log written by
``BENCH_EVENT_LOG=1 python bench.py`` (queries are told apart by the job description).

    python tools/eventlog_summary.py /tmp/run-eventlog-XXXX
"""

from __future__ import annotations

import io
import json
import os
import sys
from collections import defaultdict


def _lines(path: str):
    """Lines of a plain or rolling (directory of events_* files, maybe zstd) event log."""
    if os.path.isdir(path):
        entries = sorted(os.listdir(path))
        subdirs = [e for e in entries if os.path.isdir(os.path.join(path, e))]
        if subdirs and not any(e.startswith("events_") for e in entries):
            path = os.path.join(path, subdirs[0])
            entries = sorted(os.listdir(path))
        files = [os.path.join(path, e) for e in entries if e.startswith("events_")]
        files.sort(key=lambda f: int(os.path.basename(f).split("_")[1]))
    else:
        files = [path]
    for f in files:
        if f.endswith(".zstd"):
            import zstandard

            with open(f, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(f) as fh:
                yield from fh


def main(path: str) -> None:
    job_query: dict[int, str] = {}
    stage_query: dict[int, str] = {}
    jobs = defaultdict(int)
    stages = defaultdict(int)
    task_ms = defaultdict(float)
    tasks = defaultdict(int)
    for line in _lines(path):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            name = (ev.get("Properties") or {}).get("spark.job.description", "?")
            job_query[ev["Job ID"]] = name
            jobs[name] += 1
            for sid in ev.get("Stage IDs", []):
                stage_query[sid] = name
        elif kind == "SparkListenerStageCompleted":
            sid = ev["Stage Info"]["Stage ID"]
            stages[stage_query.get(sid, "?")] += 1
        elif kind == "SparkListenerTaskEnd":
            name = stage_query.get(ev.get("Stage ID"), "?")
            info = ev.get("Task Info", {})
            task_ms[name] += info.get("Finish Time", 0) - info.get("Launch Time", 0)
            tasks[name] += 1
    print("| query | jobs | stages | tasks | task time (s) |")
    print("|---|---|---|---|---|")
    for name in sorted(jobs, key=lambda n: -task_ms[n]):
        print(f"| {name} | {jobs[name]} | {stages[name]} | {tasks[name]} | {task_ms[name] / 1000:.1f} |")


if __name__ == "__main__":
    main(sys.argv[1])
