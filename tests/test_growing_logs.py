"""Logs that grow while they are followed, and one checkpoint per folder."""

import uuid

from pyspark.sql import functions as F

from tripleloom.streaming import log_follow

FIRST = "[dbg 1.0 ms] [cu] start\n[dbg 2.5 ms] [cu] copy\nnoise\n[dbg 3.0 ms] [cu] copy\n"
SECOND = "[dbg 4.0 ms] [cu] done\n[dbg 9.5 ms] [cu] copy\n[dbg 10.0 ms] [cu] half"


def current(spark, table):
    return {(r["run"], r["tag"], r["phase"]): r["ms"] for r in log_follow.current_marks(spark, table).collect()}


def test_two_appends_to_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_follow, "SLICE_BYTES", 30)
    folder, table, name = tmp_path / "logs", str(tmp_path / "table"), f"marks-{uuid.uuid4().hex}"
    (folder / "a").mkdir(parents=True)
    (folder / "b").mkdir()
    one, other = folder / "a" / "x.log", folder / "b" / "x.log"
    one.write_text(FIRST)
    log_follow.follow_marks(spark, str(folder), table, name).awaitTermination()
    assert current(spark, table) == {("a/x", "cu", "start"): 1.0, ("a/x", "cu", "copy"): 3.0}
    with one.open("a") as f:
        f.write(SECOND)
    other.write_text("[dbg 7.0 ms] [cu] copy\n")
    log_follow.follow_marks(spark, str(folder), table, name).awaitTermination()
    grown = {("a/x", "cu", "start"): 1.0, ("a/x", "cu", "copy"): 9.5, ("a/x", "cu", "done"): 4.0, ("b/x", "cu", "copy"): 7.0}
    assert current(spark, table) == grown
    with one.open("a") as f:
        f.write("way\n[dbg 11.0 ms] [cu] start\n")
    log_follow.follow_marks(spark, str(folder), table, name).awaitTermination()
    assert current(spark, table) == grown | {("a/x", "cu", "halfway"): 10.0, ("a/x", "cu", "start"): 11.0}
    written = spark.read.parquet(table)
    log_follow.follow_marks(spark, str(folder), table, name).awaitTermination()
    assert spark.read.parquet(table).count() == written.count()


def test_slices_hold_every_line_once(tmp_path, monkeypatch):
    text = "".join(f"line {n}" + "\r\n" * (n % 3 == 0) + "\n" * (n % 3 != 0) for n in range(50)) + "open"
    (tmp_path / "x.log").write_bytes(text.encode())
    (tmp_path / "empty").write_text("")
    reader = log_follow._GrowingReader(str(tmp_path))
    for width in (1, 7, 9, 1000):
        monkeypatch.setattr(log_follow, "SLICE_BYTES", width)
        end = reader.latestOffset()
        assert end == {"x.log": len(text) - 4, "empty": 0}
        rows = [row for part in reader.partitions({}, end) for row in reader.read(part)]
        assert [r[2] for r in rows] == [f"line {n}" for n in range(50)]
        middle = {"x.log": text.index("line 20")}
        rows = [row for part in reader.partitions(middle, end) for row in reader.read(part)]
        assert [r[2] for r in rows] == [f"line {n}" for n in range(20, 50)]


def test_folders_have_checkpoints_of_their_own(spark, tmp_path):
    text = "Input A: 5 x 5, nnz = 7\nTime: 2.0 ms\n"
    for place in ("one/a", "one/b", "two"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "x.log").write_text(text)
    for folder in ("one", "two"):
        log_follow.follow_logs(spark, str(tmp_path / folder), str(tmp_path / f"table-{folder}")).awaitTermination()
    runs = {f: {r["run"] for r in log_follow.stored_results(spark, str(tmp_path / f"table-{f}")).collect()} for f in ("one", "two")}
    assert runs == {"one": {"a/x", "b/x"}, "two": {"x"}}
    assert log_follow.stored_results(spark, str(tmp_path / "table-one")).where(F.col("a_nnz") == 7).count() == 2
