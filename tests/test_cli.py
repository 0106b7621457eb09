import json

import numpy as np
import pytest
from manybody import __main__ as cli


def test_sweep_and_statistics():
    args = cli.parser().parse_args(["--n", "10,20", "--degree", "3,4", "--distribution", "ball"])
    assert [(r["n"], r["degree"]) for r in cli.sweep(args)] == [(10, 3), (10, 4), (20, 3), (20, 4)]
    v = [0.4, 0.1, 0.7, 0.2]
    s = cli.statistics(v)
    assert np.allclose([s["median"], s["mean"], s["deviation"]], [np.median(v), np.mean(v), np.std(v, ddof=1)])
    assert cli.statistics([2.0]) == {"least": 2.0, "median": 2.0, "mean": 2.0, "most": 2.0, "deviation": 0.0}


@pytest.mark.parametrize("argv", [["--n", "0"], ["--n", "x"], ["--degree", "3,3"], ["--strategy", "fast"], ["--repeats", "0"], ["--what"]])
def test_refused(argv):
    with pytest.raises(SystemExit):
        cli.main(argv)


def test_report(spark, tmp_path):
    path = f"{tmp_path}/report.json"
    assert cli.main(["--n", "400", "--degree", "6", "--leaf", "20", "--sample", "50", "--output", path]) == 0
    (row,) = json.load(open(path))
    assert row["n"] == 400 and row["build_seconds"] > 0 and row["evaluation_seconds"]["least"] > 0 and row["phi_error"] < 1e-3
