"""Summarise a Spark event log: wall time per job description and the
slowest stages (name, tasks, duration, shuffle read / write).

    python tools/stage_times.py <event-log-file-or-folder> [--top 15]
"""

from __future__ import annotations

import argparse
import collections
import json
import os


def _open(f):
    if f.endswith(".zstd"):
        import io
        import zstandard
        return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(f, "rb")), encoding="utf-8")
    return open(f)


def events(path):
    """Every event of a log file or of all files under a folder (rolling logs)."""
    files = [path]
    if os.path.isdir(path):
        files = sorted(os.path.join(r, f) for r, _, fs in os.walk(path) for f in fs
                       if not f.startswith(("appstatus", ".")) and not f.endswith(".crc"))
    for f in files:
        with _open(f) as fh:
            for line in fh:
                if line.strip():
                    yield json.loads(line)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("log")
    ap.add_argument("--top", type=int, default=15)
    a = ap.parse_args()
    job_desc, job_t = {}, {}
    stage_job, stages = {}, {}
    per_desc = collections.defaultdict(float)
    for e in events(a.log):
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            props = e.get("Properties") or {}
            job_desc[e["Job ID"]] = props.get("spark.job.description", "?")
            job_t[e["Job ID"]] = e["Submission Time"]
            for sid in e.get("Stage IDs", []):
                stage_job[sid] = e["Job ID"]
        elif ev == "SparkListenerJobEnd":
            jid = e["Job ID"]
            per_desc[job_desc.get(jid, "?")] += (e["Completion Time"] - job_t.get(jid, e["Completion Time"])) / 1000
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            acc = {x.get("Name"): x.get("Value") for x in si.get("Accumulables", [])}
            dur = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
            stages[si["Stage ID"]] = (dur, si["Stage Name"][:60], si["Number of Tasks"],
                                      acc.get("internal.metrics.shuffle.read.recordsRead", 0),
                                      acc.get("internal.metrics.shuffle.write.recordsWritten", 0))
    print("job wall time per description (s):")
    for d, t in sorted(per_desc.items(), key=lambda kv: -kv[1]):
        print(f"  {t:8.2f}  {d}")
    print(f"slowest {a.top} stages: seconds, tasks, shuffle records read / written, job description, stage")
    for sid, (dur, name, nt, rd, wr) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:a.top]:
        print(f"  {dur:7.2f}s {nt:5d} tasks  r={rd} w={wr}  [{job_desc.get(stage_job.get(sid), '?')}] {name}")


if __name__ == "__main__":
    main()
