"""Command line: compress, decompress, check, info, analyze, bench, --version."""

from __future__ import annotations

import json
import statistics
import sys
import time

from blockweave import api
from blockweave.operators.errors import CodecError, refuse

USAGE = "usage: python -m blockweave.cli compress|decompress IN OUT | check|info|analyze ARCHIVE | bench FILE [RUNS] | --version"


def analysis(archive: bytes) -> dict:
    """Counters of one archive by method, predictor and command, with shares and averages."""
    found = api.analyze(archive)
    if found["status"] != "ok":
        raise refuse(found["status"])
    return found | api.derived(found)


def bench(data: bytes, runs: int) -> dict:
    """Median seconds and MiB a second of both ways."""
    archive = api.compress(data)
    seconds = {}
    for name, call in (("compress", lambda: api.compress(data)), ("decompress", lambda: api.decompress(archive))):
        each = []
        for _ in range(runs):
            began = time.perf_counter()
            call()
            each.append(time.perf_counter() - began)
        seconds[name] = statistics.median(each)
    size = len(data) / (1 << 20)
    return {k: {"seconds": round(s, 4), "mib_per_second": round(size / s, 3) if s else None} for k, s in seconds.items()} | {"ratio_percent": len(archive) * 100 / len(data) if data else 0.0}


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    try:
        match args:
            case ["--version"]:
                print(api.VERSION)
            case ["compress", source, target]:
                print(*api.compress_file(source, target))
            case ["decompress", source, target]:
                print(*api.decompress_file(source, target))
            case ["check" | "info" | "analyze" as what, path]:
                with open(path, "rb") as f:
                    data = f.read()
                done = {"check": lambda: {"original": api.check(data)}, "info": lambda: api.info(data), "analyze": lambda: analysis(data)}[what]()
                print(json.dumps(done))
            case ["bench", path, *runs]:
                with open(path, "rb") as f:
                    data = f.read()
                print(json.dumps(bench(data, int(runs[0]) if runs else 5)))
            case _:
                print(USAGE, file=sys.stderr)
                return 1
    except (CodecError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
