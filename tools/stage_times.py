"""Summarise stage times from a Spark event log folder (written by
``BENCH_EVENT_LOG=... python bench.py``).

    python tools/stage_times.py /tmp/run-XXXX/events [--top 20]
"""

from __future__ import annotations

import argparse
import glob
import json
import os


def _lines(path: str):
    """Lines of one event-log file; Spark 4 writes zstd frames by default."""
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True)
            yield from io.TextIOWrapper(reader, encoding="utf-8", errors="replace")
    elif not os.path.basename(path).startswith(("appstatus", ".")):
        with open(path, errors="replace") as fh:
            yield from fh


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("log_dir")
    ap.add_argument("--top", type=int, default=20)
    args = ap.parse_args()
    files = sorted(f for f in glob.glob(os.path.join(args.log_dir, "**", "*"), recursive=True) if os.path.isfile(f))
    stages, jobs = [], 0
    for f in files:
        for line in _lines(f):
            if '"SparkListenerStageCompleted"' in line:
                info = json.loads(line)["Stage Info"]
                t0, t1 = info.get("Submission Time"), info.get("Completion Time")
                if t0 and t1:
                    stages.append(((t1 - t0) / 1000.0, info["Stage ID"], info["Number of Tasks"],
                                   info["Stage Name"][:90]))
            elif '"SparkListenerJobStart"' in line:
                jobs += 1
    stages.sort(reverse=True)
    total = sum(s[0] for s in stages)
    print(f"{jobs} jobs, {len(stages)} stages, {total:.1f} s summed stage time")
    for sec, sid, ntask, name in stages[:args.top]:
        print(f"{sec:8.2f}s  stage {sid:5d}  tasks {ntask:5d}  {name}")


if __name__ == "__main__":
    main()
