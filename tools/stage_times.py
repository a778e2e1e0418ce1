"""Summarise a Spark event log: per job description (query name), the number of
jobs and stages, total task time, shuffle read/write bytes, and the slowest stage.

    python tools/stage_times.py /tmp/run-events-XXXX/<app-id>
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def _lines(path: str):
    """Event lines of a log file, or of a rolling (v2) log directory in order."""
    files = [path]
    if os.path.isdir(path):
        files = sorted((os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_")),
                       key=lambda f: int(os.path.basename(f).split("_")[1]))
    for f in files:
        if f.endswith(".zstd"):  # Spark compresses event logs with zstd by default
            import io

            import zstandard

            with open(f, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(f) as fh:
                yield from fh


def main(path: str) -> None:
    job_desc: dict[int, str] = {}
    stage_job: dict[int, int] = {}
    per = defaultdict(lambda: {"jobs": 0, "stages": 0, "task_ms": 0, "shuffle_read": 0, "shuffle_write": 0,
                               "slowest": (0, "")})
    for line in _lines(path):
        if line.strip():
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                desc = (ev.get("Properties") or {}).get("spark.job.description") or "?"
                job_desc[ev["Job ID"]] = desc
                per[desc]["jobs"] += 1
                for sid in ev.get("Stage IDs", []):
                    stage_job[sid] = ev["Job ID"]
            elif kind == "SparkListenerTaskEnd":
                desc = job_desc.get(stage_job.get(ev.get("Stage ID"), -1), "?")
                m = ev.get("Task Metrics") or {}
                per[desc]["task_ms"] += m.get("Executor Run Time", 0)
                per[desc]["shuffle_read"] += (m.get("Shuffle Read Metrics") or {}).get("Remote Bytes Read", 0) + \
                    (m.get("Shuffle Read Metrics") or {}).get("Local Bytes Read", 0)
                per[desc]["shuffle_write"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
            elif kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                desc = job_desc.get(stage_job.get(info["Stage ID"], -1), "?")
                per[desc]["stages"] += 1
                dur = (info.get("Completion Time") or 0) - (info.get("Submission Time") or 0)
                if dur > per[desc]["slowest"][0]:
                    per[desc]["slowest"] = (dur, info.get("Stage Name", "")[:60])
    print("| query | jobs | stages | task ms | shuffle read MB | shuffle write MB | slowest stage (ms) |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for desc, v in sorted(per.items(), key=lambda kv: -kv[1]["task_ms"]):
        if desc.startswith("warmup:"):
            continue
        print(f"| {desc} | {v['jobs']} | {v['stages']} | {v['task_ms']} | {v['shuffle_read'] / 1e6:.2f} | "
              f"{v['shuffle_write'] / 1e6:.2f} | {v['slowest'][0]} {v['slowest'][1]} |")


if __name__ == "__main__":
    main(sys.argv[1])
