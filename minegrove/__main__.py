"""``python -m minegrove JOB ARGUMENTS``: runs a job on the session that spark-submit or the environment gives."""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import SparkSession

from .jobs import JOBS
from .session import DEFAULTS, clear_checkpoints


def parser() -> argparse.ArgumentParser:
    """Arguments of each job from its function: paths by position, parameters by name."""
    top = argparse.ArgumentParser(prog="minegrove")
    jobs = top.add_subparsers(dest="job", required=True)
    for name, function in JOBS.items():
        own = jobs.add_parser(name, help=(function.__doc__ or "").splitlines()[0])
        for p in list(inspect.signature(function).parameters.values())[1:]:
            kind = {"int": int, "float": float}.get(str(p.annotation), str)
            if p.kind is inspect.Parameter.KEYWORD_ONLY:
                needed = p.default is inspect.Parameter.empty
                own.add_argument(f"--{p.name.replace('_', '-')}", dest=p.name, type=kind, required=needed, default=None if needed else p.default)
            else:
                own.add_argument(p.name, type=kind)
    return top


def main(arguments: list[str] | None = None) -> None:
    chosen = vars(parser().parse_args(arguments))
    function = JOBS[chosen.pop("job")]
    builder = SparkSession.builder.appName("minegrove")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    own = SparkSession.getActiveSession() is None
    spark = builder.getOrCreate()
    try:
        function(spark, **chosen)
    finally:
        if own:
            clear_checkpoints(spark)


if __name__ == "__main__":
    main()
