"""Command line: times evaluations of generated points over all combinations of the given settings.

    python -m manybody --n 10000,100000 --degree 3,5 --distribution cube,plummer --repeats 3 --output report.json
"""

from __future__ import annotations

import argparse
import itertools
import json
import sys
import time

DISTRIBUTIONS = ("cube", "ball", "sphere", "plummer")
STRATEGIES = ("auto", "dense", "classes", "rotation")


def _list(kind, check, what):
    def parse(text: str):
        try:
            values = [kind(v) for v in text.split(",")]
        except ValueError:
            raise argparse.ArgumentTypeError(f"{text}: {what}") from None
        if not all(map(check, values)) or len(set(values)) < len(values):
            raise argparse.ArgumentTypeError(f"{text}: {what}, each once")
        return values

    return parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="manybody", description=__doc__.split("\n")[0])
    p.add_argument("--n", type=_list(int, lambda v: v > 0, "positive numbers"), default=[10_000], help="numbers of points")
    p.add_argument("--degree", type=_list(int, lambda v: 0 <= v <= 30, "degrees of 0 to 30"), default=[5])
    p.add_argument("--distribution", type=_list(str, DISTRIBUTIONS.__contains__, "of " + ", ".join(DISTRIBUTIONS)), default=["cube"])
    p.add_argument("--strategy", type=_list(str, STRATEGIES.__contains__, "of " + ", ".join(STRATEGIES)), default=["auto"])
    p.add_argument("--leaf", type=int, default=64, help="points a leaf at most")
    p.add_argument("--no-gradients", action="store_true")
    p.add_argument("--repeats", type=int, default=1, help="timed evaluations of each")
    p.add_argument("--warmup", type=int, default=0, help="evaluations of each before those")
    p.add_argument("--sample", type=int, default=0, help="targets whose errors against the direct sum are measured")
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--output", help="file for the report; standard output without it")
    return p


def sweep(args) -> list[dict]:
    """The settings of each run: all combinations, in the order given."""
    names = ("distribution", "n", "degree", "strategy")
    return [dict(zip(names, v, strict=True)) for v in itertools.product(*(getattr(args, a) for a in names))]


def statistics(seconds: list[float]) -> dict:
    """Least, median, mean, most and sample deviation (0 of one)."""
    s, n = sorted(seconds), len(seconds)
    mean = sum(s) / n
    spread = (sum((v - mean) ** 2 for v in s) / (n - 1)) ** 0.5 if n > 1 else 0.0
    return {"least": s[0], "median": (s[(n - 1) // 2] + s[n // 2]) / 2, "mean": mean, "most": s[-1], "deviation": spread}


def run(spark, args) -> list[dict]:
    """A row of the report for each run."""
    from .operators import direct, metrics
    from .plans.engine import LaplaceEngine
    from .sources import points
    from .work import saved

    out = []
    for one in sweep(args):
        rows = points.with_charges(getattr(points, one["distribution"])(spark, one["n"], args.seed), seed=args.seed + 6)
        pts = saved(rows.selectExpr("*", "point_id AS source_id"), "points")
        began = time.perf_counter()
        engine = LaplaceEngine(p=one["degree"], gradients=not args.no_gradients, strategy=one["strategy"], max_points_per_leaf=args.leaf).build(pts, pts)
        row = one | {"gradients": not args.no_gradients, "build_seconds": time.perf_counter() - began}
        times = []
        for _ in range(args.warmup + args.repeats):
            began = time.perf_counter()
            engine.evaluate(pts).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        row["evaluation_seconds"] = statistics(times[args.warmup :])
        if args.sample:
            some = saved(points.sample(pts, args.sample), "sample")
            got = engine.evaluate(pts).join(some.select("point_id"), "point_id", "left_semi")
            want = direct.laplace(some, pts, gradients=not args.no_gradients)
            row["phi_error"] = metrics.error_of(got, want, ["phi"]).first()["relative_l2"]
        out.append(row)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if min(args.repeats, args.leaf) < 1 or min(args.warmup, args.sample) < 0:
        parser().error("repeats and leaf must be positive, warmup and sample not negative")
    from pyspark.sql import SparkSession

    text = json.dumps(run(SparkSession.builder.getOrCreate(), args), indent=1)
    if args.output:
        with open(args.output, "w") as f:
            f.write(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
