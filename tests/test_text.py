import math

import pytest
from pyspark.sql import functions as F

from saddlespark.functions.axis import Axis
from saddlespark.functions.grid import GridSpec
from saddlespark.operators.histogram import Histogram, generate
from saddlespark.operators.history import rmsd
from saddlespark.sources import mdlog, sinks, text

GRID_2D = """# 2
# 0.000000000 1.000000000 2 0
# -180.000000000 180.000000000 2 1
0.5 -90 9.0

# a remark of several words
0.5  90 1.5
1.5 -90 2.0
1.5  90 0.7
0.5 -90 0.0
"""


def put(path, content):
    path.write_text(content)
    return str(path)


def by_addr(h):
    return {r.addr: tuple(round(r[v], 9) for v in h.values) for r in h.dense().df.collect()}


def test_scalar_grid_last_row_wins_and_header_gives_axes(spark, tmp_path):
    h = text.read_grid(spark, put(tmp_path / "a grid.pmf", GRID_2D))
    assert h.spec == GridSpec.of(Axis(0.0, 2.0, 2), Axis(-180.0, 180.0, 2, True))
    assert by_addr(h) == {0: (0.0,), 1: (2.0,), 2: (1.5,), 3: (0.7,)}


def test_scalar_grid_rejects_other_shapes_and_bad_numbers(spark, tmp_path):
    for k, extra in enumerate(["0.5 90\n", "0.5 90 x\n", "5.0 90 1\n"]):
        h = text.read_grid(spark, put(tmp_path / f"bad{k}", GRID_2D + extra))
        with pytest.raises(Exception):
            h.dense().df.collect()
    with pytest.raises(ValueError):
        text.read_grid(spark, put(tmp_path / "nohead", "1 2 3\n"))


def test_vector_grid_skips_other_shapes(spark, tmp_path):
    body = "# 1\n# 0 1 2 0\n0.5 1 2 3\n1.5 4 5\n1.5 4 5 6\n"
    h = text.read_vector_grid(spark, put(tmp_path / "v", body), 3)
    assert by_addr(h) == {0: (1.0, 2.0, 3.0), 1: (4.0, 5.0, 6.0)}


def test_grids_round_trip(spark, tmp_path):
    spec = GridSpec.of(Axis(0.0, 3.0, 3), Axis(-1.0, 1.0, 4, True))
    h = generate(spark, spec, lambda x, y: x * 10 + y)
    sinks.write_grid(h, str(tmp_path / "g"))
    lines = [l for p in sorted((tmp_path / "g").glob("part-*")) for l in p.read_text().splitlines()]
    assert lines[0].split() == ["#", "2"] and [l[0] for l in lines[:3]] == ["#"] * 3
    coords = [tuple(map(float, l.split()[:2])) for l in lines[3:]]
    assert coords == sorted(coords) and len(coords) == 12
    assert len(lines[3]) == 24 * 3 + 2
    back = text.read_grid(spark, str(tmp_path / "g"))
    assert back.spec == spec and by_addr(back) == by_addr(h)
    v = generate(spark, spec, lambda x, y: x, lambda x, y: y)
    sinks.write_grid(v, str(tmp_path / "v"))
    assert by_addr(text.read_vector_grid(spark, str(tmp_path / "v"))) == by_addr(v)


def test_trajectory_splits_vectors_and_skips_comments(spark, tmp_path):
    p = put(tmp_path / "t", "# step\n\n0  ( 1.0 , 2.0 , 3.0 )  45.0\n 1 (4,5,6) 7e1\n")
    rows = text.read_trajectory(spark, p, {"a": 2, "b": 4}).collect()
    assert [tuple(r) for r in rows] == [(2.0, 45.0), (5.0, 70.0)]
    bad = put(tmp_path / "bad", "0 1\n1 x\n2\n3 4\n")
    with pytest.raises(Exception, match="is not a number"):
        text.read_trajectory(spark, bad, {"a": 1}).collect()
    assert [r.a for r in text.read_trajectory(spark, bad, {"a": 1}, text.PERMISSIVE).collect()] == [1.0, 4.0]


def test_hills_need_their_shape(spark, tmp_path):
    good = "# step cv sigma height\n100 0.5 0.25 0.1\n\n200 1.75 0.25 0.2\n"
    rows = text.read_hills(spark, put(tmp_path / "h", good), 1, with_rows=True).orderBy("row").collect()
    assert [(r.row, r.step, r.c0, r.s0, r.height) for r in rows] == [(0, 100, 0.5, 0.25, 0.1), (1, 200, 1.75, 0.25, 0.2)]
    bad = put(tmp_path / "b", good + "300 1 2\n400 1 1 x\n")
    with pytest.raises(Exception):
        text.read_hills(spark, bad, 1).select("c0").collect()
    assert text.read_hills(spark, bad, 1, text.PERMISSIVE).count() == 2


def test_rows_are_numbered_across_splits_and_files(spark, tmp_path):
    names = ["z.txt", "a.txt", "m.txt"]
    want = []
    for n, name in enumerate(names):
        body = "".join(f"{n} {k}\n" + ("# skip\n" if k % 7 == 0 else "") for k in range(500 * (n + 1)))
        put(tmp_path / name, body)
        want += [(n, k) for k in range(500 * (n + 1))]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = text.read_lines(spark, [str(tmp_path / n) for n in names])
        rows = lines.map(text.data_fields).numbered().select("row", "file", "f").orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.row for r in rows] == list(range(len(want)))
    assert [(int(r.f[0]), int(r.f[1])) for r in rows] == want
    assert all(r.file == int(r.f[0]) for r in rows)


HEAD_1D = "# 1\n# 0.0 1.0 2 0\n"


def test_history_frames_carry_bins_forward_within_a_file(spark, tmp_path):
    a = put(tmp_path / "b.hist", HEAD_1D + "0.5 0.0\n1.5 1.5\n" + HEAD_1D + "0.5 0.2\n" + HEAD_1D)
    b = put(tmp_path / "a.hist", "# 1\n" + HEAD_1D + "\n1.5 7\n1.5 8\n")
    spec, h = text.read_history(spark, [a, b])
    rows = h.orderBy("frame", "addr").collect()
    got = {}
    for r in rows:
        got.setdefault(r.frame, []).append(r.value)
    assert got == {0: [0.0, 1.5], 1: [0.2, 1.5], 2: [0.2, 1.5], 3: [0.0, 8.0]}
    dev = [r.rmsd for r in rmsd(h, spec).orderBy("frame").collect()]
    want = [math.sqrt(sum((x - y) ** 2 for x, y in zip(got[k], got[3])) / 2) for k in range(4)]
    assert dev == pytest.approx(want)
    sinks.write_frames(h, spec, str(tmp_path / "out"))
    names = sorted(p.name for p in (tmp_path / "out_frames").iterdir() if p.is_dir())
    assert names == [f"name=out_{k}.pmf" for k in range(4)]
    one = text.read_grid(spark, str(tmp_path / "out_frames" / "name=out_1.pmf"))
    assert by_addr(one) == {0: (0.2,), 1: (1.5,)}
    sinks.write_rmsd(rmsd(h, spec), str(tmp_path / "r"))
    body = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert [l.split()[0] for l in body.splitlines()] == ["0", "1", "2", "3"]


LOG = """Info: a line
ENERGY: 9 9 9 9
ETITLE: TS BOND VDW BOND ELECT
ENERGY: 0 1.0 -2.5 77 -3.5
PAIR INTERACTION: STEP: 0 VDW_FORCE: 1 2 3 ELECT_FORCE: 4 5 6
ETITLE: X Y Z
ENERGY: 10 2.0 -4.5 77 1.0E+01
PAIR INTERACTION: STEP: 10 VDW_FORCE: 10 20 30
"""


def test_log_terms(spark, tmp_path):
    log = mdlog.read_md_log(spark, put(tmp_path / "log", LOG))
    assert log.titles == ("TS", "BOND", "VDW", "ELECT") and log.size() == 2
    rows = log.energies(["TS", "BOND", "ELECT"]).orderBy("row").collect()
    assert [tuple(r) for r in rows] == [(0, 0.0, 1.0, -3.5), (1, 10.0, 2.0, 10.0)]
    assert [tuple(r) for r in log.forces("VDW_FORCE").orderBy("row").collect()] == [(0, 1.0, 2.0, 3.0), (1, 10.0, 20.0, 30.0)]
    assert log.force_titles() == ["VDW_FORCE", "ELECT_FORCE"]
    with pytest.raises(KeyError):
        log.energies(["NOPE"])


def test_log_means_ignore_rows_the_log_does_not_have(spark, tmp_path):
    log = mdlog.read_md_log(spark, put(tmp_path / "log", LOG))
    traj = text.read_lines(spark, put(tmp_path / "traj", "# t\n0 0.5\n1 0.6\n2 0.7\n3 9\n"))
    spec = GridSpec.of(Axis(0.0, 2.0, 2))
    h = mdlog.bin_log(log, traj, spec, [1], ["VDW"], ["VDW_FORCE"])
    assert by_addr(h) == {0: (-3.5, 5.5, 11.0, 16.5), 1: (0.0,) * 4}
    diluted = mdlog.bin_log(log, traj, spec, [1], ["VDW"], count_all=True)
    assert by_addr(diluted)[0] == (round(-7.0 / 3, 9),)


def test_path_positions_may_carry_a_value(spark, tmp_path):
    p = put(tmp_path / "p", "# x y\n\n0.5 90\n1.5 -90 3.0\n1 2 3 4\n7 7\n")
    rows = text.read_path(spark, p, 2)
    assert [tuple(r) for r in rows.orderBy("row").collect()] == [(0, 0.5, 90.0), (1, 1.5, -90.0), (2, 7.0, 7.0)]


def tasks_of(spark, group, work):
    """What ``work`` returns, and the numbers of tasks of the stages it ran."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [i for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds]
    return out, [tracker.getStageInfo(i).numTasks for i in stages]


def test_header_is_read_from_the_first_split_of_the_first_file(spark, tmp_path):
    rows = "".join(f"{k % 2}.5 {-90 if k % 4 < 2 else 90} {k}.25\n" for k in range(60_000))
    folder = tmp_path / "grid"
    folder.mkdir()
    put(folder / "part-00000", "")
    put(folder / "part-00001", GRID_2D + rows)
    put(folder / "part-00002", "# 1\n# 7 7 7 0\n" + rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        lines = text.read_lines(spark, str(folder))
        spec, tasks = tasks_of(spark, "header", lambda: text.read_header(lines))
        assert lines.df.rdd.getNumPartitions() > 15
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spec == GridSpec.of(Axis(0.0, 2.0, 2), Axis(-180.0, 180.0, 2, True))
    # a job for the number of axes and one for the axes; an empty file has no split
    assert tasks and max(tasks) == 1 and len(tasks) <= 2


def test_history_of_another_grid_is_refused(spark, tmp_path):
    head = "# 1\n# 0 1.0 2 0\n"
    body = head + "0.5 1\n# 1\n# 0.0 1 2 0\n# step 5 of 9 is 12\n1.5 2\n"
    a = put(tmp_path / "a", body)
    assert text.read_history(spark, [a, put(tmp_path / "c", body)])[1].count() == 8
    for other in ("# 1\n# 0 1.0 3 0\n", "# 1\n# 0.5 1.0 2 0\n", "# 2\n# 0 1.0 2 0\n# 0 1.0 2 0\n", "# 1\n# 0 1.0 2 1\n"):
        b = put(tmp_path / "b", other + "0.5 1\n")
        with pytest.raises(Exception, match="header of another grid"):
            text.read_history(spark, [a, b])
        assert text.read_history(spark, [a, b], text.PERMISSIVE)[1].count() == 6


def test_log_terms_come_from_one_scan(spark, tmp_path):
    log = mdlog.read_md_log(spark, put(tmp_path / "log", LOG))
    terms = log.terms(["VDW", "ELECT"], ["VDW_FORCE", "ELECT_FORCE"])
    plan = terms._jdf.queryExecution().toString()
    assert "FileScan" not in plan  # the parsed rows are kept, the text is not scanned again
    got = {r.row: tuple(r)[1:] for r in terms.collect()}
    assert got == {0: (-2.5, -3.5, 1, 2, 3, 4, 5, 6), 1: (-4.5, 10.0, 10, 20, 30, None, None, None)}
    bad = mdlog.read_md_log(spark, put(tmp_path / "bad", LOG + "ENERGY: 20 1 x 77 5\n"))
    assert bad.terms(["ELECT"]).count() == 3
    assert [r.VDW for r in bad.energies(["VDW"], text.PERMISSIVE).orderBy("row").collect()] == [-2.5, -4.5, None]
    with pytest.raises(Exception, match="no number for VDW: ENERGY: 20"):
        bad.energies(["VDW"]).collect()


def test_log_terms_keep_their_order_over_splits_and_files(spark, tmp_path):
    lines = ["ETITLE: TS VDW"]
    for k in range(6000):
        lines.append(f"ENERGY: {k} {k}.5")
        if k % 3 == 0:
            lines.append(f"PAIR INTERACTION: STEP: {k} VDW_FORCE: {k} 0 1 ELECT_FORCE: 0 {k} 2")
    half = len(lines) // 2
    folder = tmp_path / "log"
    folder.mkdir()
    put(folder / "part-00000", "\n".join(lines[:half]) + "\n")
    put(folder / "part-00001", "\n".join(lines[half:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = mdlog.read_md_log(spark, str(folder)).terms(["TS", "VDW"], ["ELECT_FORCE", "VDW_FORCE"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 6000
    for r in got:
        assert (r.TS, r.VDW) == (r.row, r.row + 0.5)
        forces = (r.ELECT_FORCE_x, r.ELECT_FORCE_y, r.ELECT_FORCE_z, r.VDW_FORCE_x, r.VDW_FORCE_y, r.VDW_FORCE_z)
        assert forces == ((0, 3 * r.row, 2, 3 * r.row, 0, 1) if r.row < 2000 else (None,) * 6)


def test_many_small_grids_are_written_by_several_tasks(spark, tmp_path):
    spec = GridSpec.of(Axis(0.0, 3.0, 3))
    df = spark.range(120).selectExpr("id % 40 AS g", "id % 3 AS addr", "id * 1.0D AS value").dropDuplicates(["g", "addr"])
    sinks.write_grids(df, spec, ["value"], F.concat(F.lit("g_"), F.col("g").cast("string")), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("name=g_*/part-*.txt"))
    assert len({f.parent for f in files}) == 40
    assert len({f.name.split("-")[1] for f in files}) > 1
    assert all([x[0] for x in text_of(f.parent)[2:]] == [0.5, 1.5, 2.5] for f in files)


def text_of(folder):
    return [[float(x) for x in line.strip("#").split()] for f in sorted(folder.glob("part-*.txt")) for line in f.read_text().splitlines()]


def test_filters_on_trajectory_columns_do_not_split_the_line_again(spark, tmp_path):
    (tmp_path / "t").write_text("1 2 3\n4 5 6\n")
    df = text.read_trajectory(spark, str(tmp_path / "t"), {"q": 1, "d": 2}).filter("q >= 2 AND q < 9 AND d > 1 AND d < 7")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(map(tuple, df.collect())) == [(2.0, 3.0), (5.0, 6.0)]


def test_rows_are_numbered_with_one_scan_for_the_counts(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"f{k}").write_text(f"{k}\n")
    rows = text.read_lines(spark, [str(tmp_path / "f1"), str(tmp_path / "f0")]).numbered()
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(" text") == 2
    assert [r.value for r in rows.orderBy("row").collect()] == ["1", "0"]


def test_names_of_parts_in_columns_are_those_of_python(spark):
    names = ["file:///a/part-00012-u-c000.txt", "file:/a/part-12", "hdfs://h/part-1/part-x", "/x/part-", "/x/part-1234567890123456-z", "part-5", "/x/part-7y8"]
    found = spark.createDataFrame([(n,) for n in names], "p string").select("p", text._part_column(F.col("p"))).collect()
    assert all(c == text._part_name(p) for p, c in found)
