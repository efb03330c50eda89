"""``python -m saddlespark --project job.json`` and so on for the other jobs."""

from __future__ import annotations

import argparse
import json
import sys

from .plans.jobs import JOBS, run
from .session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("saddlespark", description="Analyse free-energy grids, trajectories and hills.")
    for name in JOBS:
        parser.add_argument(f"--{name}", action="store_true")
    parser.add_argument("config", nargs="?", help="JSON configuration of the job")
    parser.add_argument("--master", help="Spark master; by default the one spark-submit sets")
    args = parser.parse_args(argv)
    chosen = [name for name in JOBS if getattr(args, name)]
    if args.config is None or not chosen:
        parser.print_usage(sys.stderr)
        return 1
    try:
        run(build_session(master=args.master), chosen[0], args.config)
    except (ArithmeticError, OSError, ValueError, KeyError, json.JSONDecodeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
