"""Files read in blocks give what whole files give."""

import pathlib

import pytest
from pyspark.sql import functions as F

from borespark.plans import source_queries
from borespark.sources import files


@pytest.fixture
def small_blocks(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(map(str, df.collect()))


def las(n, null="-999.25", curves=("GR", "RT")):
    head = f"# made\n~Version\nVERS. 2.0 : v\n~Well\nSTRT.M 0 : start\nNULL. {null} : null\n~Curve\nDEPT.M : depth\n" + "".join(f"{c}.API : {c}\n" for c in curves)
    body = "".join(f"{i} " + " ".join(null if (i + k) % 7 == 0 else str(i * (k + 1)) for k in range(len(curves))) + ("\n# note\n" if i % 50 == 0 else "\n") for i in range(n))
    return head + "~ASCII\n" + body


def test_logs_in_blocks(spark, tmp_path, small_blocks):
    (tmp_path / "big.las").write_text(las(3000))
    (tmp_path / "small.las").write_text(las(3, "-1").replace("\n", "\r\n"))
    (tmp_path / "late.las").write_text("~Well\n" + "".join(f"K{i}.M {i} : x\n" for i in range(600)) + "~Curve\n" + "".join(f"C{i}.M : d{i}\n" for i in range(300)) + "~A\n" + " ".join(map(str, range(300))) + "\n1 2\n")
    (tmp_path / "none.las").write_text("no section\n1 2 3\n")
    lines = files.split_lines(spark, str(tmp_path))
    assert lines.where("file_id like '%big%'").select("block").distinct().count() > 10
    whole = files.las_tables(files.read_report_text(spark, str(tmp_path)))
    for a, b in zip(files.read_las(spark, str(tmp_path)), whole):
        assert rows(a) == rows(b) and a.count() > 3
    assert files.read_las(spark, str(tmp_path))[2].where("file_id like '%big%'").count() == 9000


def test_logs_one_behind_another(spark, tmp_path, small_blocks):
    """Each log of a bundle is read as the log alone, wherever blocks are cut."""
    sizes = [1, 700, 0, 3, 900, 2]
    logs = [las(n, null, curves).replace("NULL.", f"WELL. {i} : well\nNULL.") for i, (n, null, curves) in enumerate(zip(sizes, ["-1", "-999.25"] * 3, [("GR",), ("GR", "RT"), ("A", "B", "C")] * 2))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.las").write_text("".join(logs[:4]))
    (tmp_path / "in" / "b.las").write_text("".join(logs[4:]).replace("\n", "\r\n"))
    assert files.split_lines(spark, f"{tmp_path}/in").select("file_id", "block").distinct().count() > 5
    found = files.read_las_bundles(spark, f"{tmp_path}/in", ("WELL",))
    whole = files.las_tables(spark.createDataFrame([(str(i), t) for i, t in enumerate(logs)], "WELL string, text string"), ("WELL",))
    named = found[0].where("key = 'WELL'").select("file_id", "log_no", F.col("value").alias("WELL"))
    assert named.count() == 6
    assert rows(found[2].drop("file_id", "log_no")) == rows(whole[2]) and found[2].where("WELL = '4'").count() == 900 * 3
    for a, b in zip(found[:2], whole[:2]):
        assert rows(a.join(named, ["file_id", "log_no"]).select(*b.columns)) == rows(b) and b.count() > 6


def test_number_of_log_files_does_not_follow_wells(spark, tmp_path, monkeypatch):
    made = []
    new = source_queries.scratch.new_folder
    monkeypatch.setattr(source_queries.scratch, "new_folder", lambda s: made.append(new(s)) or made[-1])
    events = spark.range(1_200).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("ts"), (F.col("id") % 400).alias("user_id"), F.lit("click").alias("event_type"), (F.col("id") % 90 + 0.5).alias("value"), F.format_string('{"k": %d}', F.col("id") % 7).alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert rows(source_queries.las_files(spark, str(tmp_path))) == rows(source_queries.las_samples(spark, str(tmp_path)))
    assert 0 < len(list(pathlib.Path(made[0]).rglob("*.txt"))) < 40


def test_tables_in_blocks(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("MD,INC (deg),Note\nm,deg,\n\n" + "".join(f'{i},{i / 10},"x, {i}"\n' + "\n" * (i % 3 == 0) for i in range(2000)))
    (tmp_path / "b.csv").write_text("a;b\r\n1;2\r\n3\r\n")
    (tmp_path / "c.csv").write_text("only\n")
    (tmp_path / "d.csv").write_text("")
    whole = files.delimited_cells(files.read_report_text(spark, str(tmp_path)))
    found = files.read_delimited(spark, str(tmp_path))
    assert rows(found.withColumn("row_no", F.col("row_no").cast("int"))) == rows(whole) and found.count() == 6004
