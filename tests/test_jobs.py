import json
import math

import numpy as np
import pytest

from brute import dijkstra, relax_queue
from saddlespark.__main__ import main
from saddlespark.functions.axis import Axis
from saddlespark.functions.grid import GridSpec
from saddlespark.functions.units import thermal_energy
from saddlespark.operators import search
from saddlespark.operators.histogram import Histogram
from saddlespark.operators.patches import Patch
from saddlespark.plans import jobs
from saddlespark.sources import sinks, text
from test_operators import dense, filled, hill_sum

SPEC = GridSpec.of(Axis(0.0, 4.0, 4), Axis(-180.0, 180.0, 6, True))


def lines(folder):
    return [l for p in sorted(folder.glob("part-*")) for l in p.read_text().splitlines()]


def table(folder):
    return np.array([list(map(float, l.split())) for l in lines(folder) if not l.startswith("#")])


@pytest.fixture
def go(spark, tmp_path):
    def run(job, **cfg):
        p = tmp_path / f"{job}.json"
        p.write_text(json.dumps(cfg))
        jobs.run(spark, job, str(p))

    return run


def test_project(spark, go, tmp_path):
    h = filled(spark, SPEC)
    sinks.write_grid(h, str(tmp_path / "in"))
    out = tmp_path / "out.pmf"
    go("project", **{"Input": str(tmp_path / "in"), "Output": str(out), "To axis": [1], "Unit": "kJ/mol", "Temperature": 300})
    kt = thermal_energy(300, "kJ/mol")
    p = np.exp(-dense(h) / kt).sum(axis=0)
    want = -kt * np.log(p / p.sum())
    assert lines(out)[1].split() == ["#", "-180.000000000", "60.000000000", "6", "1"]
    assert table(out)[:, 1] == pytest.approx(want - want.min())


def test_reweight_pairs_axes_by_column(spark, go, tmp_path):
    h = filled(spark, SPEC)
    sinks.write_grid(h, str(tmp_path / "in"))
    files = []
    rows = [(0.5, -170.0, 1.5, 0.2), (3.9, 170.0, 0.5, 0.9), (3.9, 500.0, 1.2, 0.1), (9.0, 0.0, 1.0, 1.0)]
    for k in range(2):
        files.append(str(tmp_path / f"t{k}"))
        (tmp_path / f"t{k}").write_text("# head\n" + "".join(f"{n} ({r[0]}, {r[1]}) {r[2]} {r[3]}\n" for n, r in enumerate(rows[k::2])))
    out = tmp_path / "out"
    axes = [
        {"Target Column": 4, "Lower bound": 0, "Upper bound": 1, "Width": 0.5},
        {"Target Column": 3, "Lower bound": 0, "Upper bound": 2, "Width": 1},
    ]
    cfg = {
        "Input": str(tmp_path / "in"), "Output": str(out), "From columns": [1, 2], "To columns": [3, 4], "Unit": "",
        "Temperature": 2, "Trajectories": files, "Reweighting Axes": axes,
    }
    go("reweight", **cfg)
    a = dense(h)
    want = np.zeros((2, 2))
    want[1, 0] += math.exp(-a[0, 0] / 2) + math.exp(-a[3, 5] / 2)
    want[0, 1] += math.exp(-a[3, 5] / 2)
    assert table(out)[:, 2] == pytest.approx(want.flatten())
    go("reweight", **cfg, **{"Convert to PMF": True})
    f = -2 * np.log(want[want > 0])
    got = table(out)[:, 2]
    assert got.max() == pytest.approx(f.max() - f.min()) and sorted(got)[0] == 0.0
    with pytest.raises(ValueError):
        go("reweight", **{**cfg, "To columns": [3]})


def test_form_rows_for_a_reweighting():
    rows = jobs.reweighting_axes(SPEC, [2, 5], [5, 7])
    assert [(r["column"], r["in_pmf"], r["reweight_to"]) for r in rows] == [(2, True, False), (5, True, True), (7, False, True)]
    assert rows[1]["axis"].periodic and rows[2]["axis"] == Axis(0.0, 1.0, 1)


def test_history(spark, go, tmp_path):
    head = "# 1\n# 0.0 1.0 2 0\n"
    (tmp_path / "h").write_text(head + "0.5 0\n1.5 3\n" + head + "0.5 4\n")
    (tmp_path / "ref").write_text(head + "0.5 0\n1.5 0\n")
    cfg = {"History PMF Files": [str(tmp_path / "h")], "Output": str(tmp_path / "o"), "Split": True, "RMSD": True}
    go("history", **cfg)
    assert table(tmp_path / "o_rmsd.dat")[:, 1] == pytest.approx([math.sqrt(8), 0])
    assert table(tmp_path / "o_frames" / "name=o_1.pmf")[:, 1].tolist() == [4, 3]
    go("history", **cfg, Reference=str(tmp_path / "ref"))
    assert table(tmp_path / "o_rmsd.dat")[:, 1] == pytest.approx([math.sqrt(4.5), math.sqrt(12.5)])


def test_namdlog(spark, go, tmp_path):
    (tmp_path / "log").write_text(
        "ETITLE: TS VDW ELECT\nENERGY: 0 1 2\nPAIR INTERACTION: STEP: 0 VDW_FORCE: 1 2 3 ELECT_FORCE: 4 5 6\n"
        "ENERGY: 1 3 4\nPAIR INTERACTION: STEP: 1 VDW_FORCE: 3 2 1 ELECT_FORCE: 0 0 0\n"
    )
    (tmp_path / "traj").write_text("0 0.5\n1 0.5\n")
    axis = {"Column": 1, "Lower bound": 0, "Upper bound": 2, "Width": 1}
    go("namdlog", **{"NAMD log": str(tmp_path / "log"), "Trajectory": str(tmp_path / "traj"), "Output": str(tmp_path / "o"), "Energies": ["VDW", "ELECT"], "Forces": ["VDW_FORCE"], "Axes": [axis]})
    assert table(tmp_path / "o_vdw.dat").tolist() == [[0.5, 2], [1.5, 0]]
    assert table(tmp_path / "o_elect.dat").tolist() == [[0.5, 3], [1.5, 0]]
    assert table(tmp_path / "o_vdw_force.dat").tolist() == [[0.5, 2, 2, 2], [1.5, 0, 0, 0]]


def test_sumhills_with_snapshots(spark, go, tmp_path):
    hills = [([0.5, 10.0], [0.5, 30.0], 1.0), ([1.5, 170.0], [0.4, 40.0], 0.5), ([3.0, -175.0], [0.3, 20.0], 0.7)]
    (tmp_path / "hills").write_text("# step\n" + "".join(f"{100 * (k + 1)} {c[0]} {c[1]} {s[0]} {s[1]} {h}\n" for k, (c, s, h) in enumerate(hills)))
    axes = [
        {"Lower bound": 0, "Upper bound": 4, "Width": 1},
        {"Lower bound": -180, "Upper bound": 180, "Width": 60, "Periodic": True},
    ]
    cfg = {"Trajectory": str(tmp_path / "hills"), "Output": str(tmp_path / "o"), "Axes": axes, "Stride": 200}
    go("sumhills", **cfg)
    f, g = hill_sum(hills, SPEC)
    assert table(tmp_path / "o.pmf")[:, 2] == pytest.approx(f.flatten(), abs=1e-12)
    assert table(tmp_path / "o.grad")[:, 3] == pytest.approx(g[1].flatten(), abs=1e-12)
    f2, g2 = hill_sum(hills[:2], SPEC)
    assert table(tmp_path / "o_snapshots_pmf" / "name=o_200.pmf")[:, 2] == pytest.approx(f2.flatten(), abs=1e-12)
    assert table(tmp_path / "o_snapshots_grad" / "name=o_200.grad")[:, 2] == pytest.approx(g2[0].flatten(), abs=1e-12)
    go("sumhills", **{**cfg, "Stride": 0, "Well tempered": True, "Bias temperature": 900, "Temperature": 300})
    assert table(tmp_path / "o.pmf")[:, 2] == pytest.approx(f.flatten() * 4 / 3, abs=1e-12)


def grid_lists(a, spec):
    """Adjacency of a grid in neighbour order, weights of the targets."""
    flat = a.flatten(order="F")
    out = {}
    for n in range(spec.size):
        out[n] = []
        for ax, s in zip(spec.axes, spec.strides):
            i = n // s % ax.bins
            for d in (-1, 1):
                j = (i + d) % ax.bins if ax.periodic else i + d
                if 0 <= j < ax.bins:
                    out[n].append((n + (j - i) * s, flat[n + (j - i) * s]))
    return out


@pytest.mark.parametrize("algorithm", [0, 1])
def test_mfep(spark, go, tmp_path, algorithm):
    h = filled(spark, SPEC, 9)
    sinks.write_grid(h, str(tmp_path / "in"))
    patch = {"Center": "2, 30", "Lengths": "2, 100", "Value": 10}
    cfg = {"Input PMF": str(tmp_path / "in"), "Output": str(tmp_path / "o"), "Start": "0.5,-150", "End": "3.5 30", "Algorithm": algorithm, "Patches": [patch]}
    go("mfep", **cfg)
    a = dense(h).copy()
    for i in range(4):
        for j in range(6):
            x, y = SPEC.axes[0].centers()[i], SPEC.axes[1].centers()[j]
            if abs(x - 2) <= 1 and abs(y - 30) <= 50:
                a[i, j] += 10
    assert table(tmp_path / "o.patched")[:, 2] == pytest.approx(a.flatten())
    adj = grid_lists(a, SPEC)
    start, end = SPEC.address_value([0.5, -150]), SPEC.address_value([3.5, 30])
    want = dijkstra(adj, start, "mfep")[end][0] if algorithm == 0 else relax_queue(adj, start, "mfep")[1][end]
    got = table(tmp_path / "o.path")
    assert [SPEC.address_value(r[:2]) for r in got.tolist()] == want
    assert got[:, 2] == pytest.approx([a.flatten(order="F")[n] for n in want])
    region = [SPEC.address_value(r) for r in table(tmp_path / "o.region").tolist()]
    assert region == sorted(region) and (end in region) == (algorithm == 1)


@pytest.mark.parametrize("seed,mode", [(1, "mfep"), (2, "mfep"), (3, "sum"), (4, "max")])
def test_paths_do_not_depend_on_the_tiles(spark, seed, mode):
    spec = GridSpec.of(Axis(0.0, 1.0, 9), Axis(0.0, 1.0, 7, True))
    h = filled(spark, spec, seed).apply(lambda x: x + 2)
    want = dijkstra(grid_lists(dense(h), spec), 4, mode)
    for tile in (9, 1000):
        r = search.find_path(h, spec.position_value(4), spec.position_value(58), mode=mode, tile_nodes=tile)
        assert [x.addr for x in r.path.orderBy("ord").collect()] == want[58][0]
        seen = sorted(x.addr for x in r.visited.collect())
        assert seen == sorted(n for n, (_, k) in want.items() if k < want[58][1])


def test_queue_search_on_an_odd_periodic_grid(spark):
    spec = GridSpec.of(Axis(0.0, 1.0, 4), Axis(0.0, 1.0, 5, True))
    h = filled(spark, spec, 12)
    _, paths = relax_queue(grid_lists(dense(h), spec), 0, "mfep")
    r = search.find_path(h, spec.position_value(0), spec.position_value(14), algorithm="spfa")
    assert [x.addr for x in r.path.orderBy("ord").collect()] == paths[14]


def test_path_ends_are_checked(spark):
    h = filled(spark, SPEC)
    with pytest.raises(ValueError):
        search.find_path(h, [9.0, 0.0], [1.0, 0.0])
    with pytest.raises(ValueError):
        search.find_path(h, [1.0], [1.0, 0.0])


def test_pathpmf_leaves_values_outside_blank(spark, go, tmp_path):
    h = filled(spark, SPEC)
    sinks.write_grid(h, str(tmp_path / "in"))
    (tmp_path / "p").write_text("# p\n0.5 -150\n9 0\n3.5 150 7.0\n")
    go("pathpmf", **{"Input PMF": str(tmp_path / "in"), "Input Path File": str(tmp_path / "p"), "Output": str(tmp_path / "o")})
    got = [l.split() for l in lines(tmp_path / "o")]
    a = dense(h)
    assert [len(g) for g in got] == [3, 2, 3]
    assert float(got[0][2]) == pytest.approx(a[0, 0]) and float(got[2][2]) == pytest.approx(a[3, 5])


def test_command_line(spark, tmp_path, capsys):
    assert main(["--project"]) == 1
    assert main([str(tmp_path / "x.json")]) == 1
    (tmp_path / "bad.json").write_text("{")
    assert main(["--project", str(tmp_path / "bad.json")]) == 1
    h = filled(spark, SPEC)
    sinks.write_grid(h, str(tmp_path / "in"))
    cfg = {"Input": str(tmp_path / "in"), "Output": str(tmp_path / "out"), "To axis": [0], "Unit": "kcal/mol", "Temperature": 300}
    (tmp_path / "j.json").write_text(json.dumps(cfg))
    assert main(["--pathpmf", "--project", str(tmp_path / "j.json")]) == 0
    assert len(table(tmp_path / "out")) == 4
