"""Operators for drilling data on transcribed fixtures with known values."""

import pytest
from pyspark.sql import functions as F

from borespark.functions import scalars as S
from borespark.functions import text as T
from borespark.operators import completions, hse, logs, match, production, quality, risk, survey
from borespark.plans import pipelines
from borespark.sources import files
from borespark.streaming import ingest

SURVEYS = {
    "A": [(0, 0, 45), (500, 0.3, 45), (1000, 0.8, 46), (2000, 4.2, 47), (3000, 18.5, 48), (4000, 45.2, 49), (5000, 72.8, 50), (6000, 89.1, 51), (7000, 90, 51), (8000, 90.2, 52), (9000, 90.4, 52), (10000, 90.6, 53), (11000, 90.3, 53), (12450, 90.5, 53)],
    "B": [(0, 0, 45), (500, 0.5, 46), (1000, 15, 48), (1500, 45, 50), (2000, 85, 52), (2500, 90, 53)],
    "C": [(0, 0, 45), (1000, 5, 46), (2000, 25, 48), (3000, 85, 50), (3245, 90, 52)],
}


@pytest.fixture(scope="module")
def stations(spark):
    return spark.createDataFrame([(w, float(a), float(b), float(c)) for w, rows in SURVEYS.items() for a, b, c in rows], "well_id string, md double, inc_deg double, az_deg double")


def test_trajectories(stations):
    kpis, flags, traj = pipelines.analyze_directional(stations.repartition(7))
    got = {r.well_id: (r.total_md, r.total_tvd, r.max_inc, r.max_dls) for r in kpis.collect()}
    assert got == {"A": (12450, 4459.6, 90.6, 2.761), "B": (2500, 1651.1, 90, 8.008), "C": (3245, 2518.2, 90, 6.002)}
    b = [(r.md, r.tvd, r.north, r.east, r.dls) for r in traj.where("well_id = 'B'").orderBy("md").collect()]
    assert b[3] == (1500, 1422.2, 207.18, 239.31, 6.003) and b[5] == (2500, 1651.06, 789.55, 981.34, 1.02)
    f = {(r.code, r.position) for r in flags.where("well_id = 'B'").collect()}
    assert {("HIGH_DLS", 2000.0), ("INC_JUMP", 1000.0), ("INC_JUMP", 1500.0), ("INC_JUMP", 2000.0)} <= f and ("INC_JUMP", 2500.0) not in f
    risks = risk.score_risks(kpis, flags)
    assert {r.rule_id for r in risks.where("linked_wells[0] = 'B'").collect()} == {"K09", "K10", "K11"}


def test_pay_intervals(spark):
    rows = [("L2", 2000 + i, gr, rt) for i, (gr, rt) in enumerate([(80, 5), (70, 15), (50, 25), (85, 4), (40, 30), (65, 12), (55, 20), (72, 8), (48, 28), (60, 18), (75, 6)])]
    rows += [("L1", 2000, 80, 5), ("L1", 2001, 70, 15), ("L1", 2002, 50, 25), ("L1", 2003, 85, 4)]
    df = spark.createDataFrame([(a, float(b), float(c), float(d)) for a, b, c, d in rows], "well_id string, depth double, gr double, rt double")
    assert [(r.well_id, r.top, r.base, r.net) for r in logs.pay_intervals(df).collect()] == [("L2", 2004, 2006, 2)]
    assert ("L1", 2.0) in [(r.well_id, r.net) for r in logs.pay_intervals(df, include_step=True).collect()]


LAS = "~Version\n VERS. 2.0 : version\n~Well\n STRT.m 2000 : start\n STOP.m 2003 : stop\n NULL. -999.25 : null\n~Curve\n DEPT.m : depth\n GR.API : gamma\n RT.OHMM : resistivity\n~ASCII\n# comment\n2000 80 5\n2001 70 15\n2002 50 25\n2003 -999.25 30\n"


def test_files(spark, tmp_path):
    (tmp_path / "a.las").write_text(LAS)
    wells, curves, samples = files.read_las(spark, str(tmp_path))
    assert {(r.key, r.value, r.unit) for r in wells.collect()} >= {("STRT", "2000", "m"), ("NULL", "-999.25", None)}
    assert [r.mnemonic for r in curves.orderBy("curve_no").collect()] == ["DEPT", "GR", "RT"]
    gr = {r.depth: r.value for r in samples.where("mnemonic = 'GR'").collect()}
    assert gr == {2000: 80, 2001: 70, 2002: 50, 2003: None}
    found = files.detect_file_type(files.scan_files(spark, str(tmp_path))).first()
    assert (found.detected_type, found.confidence) == ("las_well_log", 0.99)
    text = spark.createDataFrame([("f", 'Stage;Fluid (bbls);Note\n1;1850;"a;b"\n2;1900;\n\n'), ("g", "MD,INC,AZ\nm,deg,deg\n0,0,45\n100,1,45\n")], "file_id string, text string")
    cells = files.delimited_cells(text)
    assert {(r.col_name, r.unit, r.value) for r in cells.where("file_id = 'f' and row_no = 0").collect()} == {("Stage", None, "1"), ("Fluid", "bbls", "1850"), ("Note", None, "a;b")}
    st = survey.tables_to_stations(cells.withColumn("table_id", F.lit(0)))
    assert [(r.md, r.inc_deg, r.az_deg) for r in st.orderBy("md").collect()] == [(0, 0, 45), (100, 1, 45)]
    stages = completions.tables_to_stages(cells.withColumn("table_id", F.lit(0)))
    assert [(r.stage_number, r.fluid) for r in stages.orderBy("row_no").collect()] == [(1, 1850.0), (2, 1900.0)]


def test_stream_to_folders(spark, tmp_path):
    one = spark.createDataFrame([("t1", "a", 1), ("t2", "b", 1)], "task_id string, well_name string, created_at int")
    one.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.stream_ingest(spark, str(tmp_path / "in"), "task_id string, well_name string, created_at int", ingest.batch_folder(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_texts(spark):
    docs = spark.createDataFrame([("x", "w", "Daily drilling report\nWell: A-1\nROP (avg): 145 ft/hr\nMud weight: 10.5 ppg\nNPT: 1.5 hr pump repair\nTotal NPT: 1.5 hours\nNear miss: dropped object from 3 m"), ("y", "v", "Отчет о бурении\nСкважина: 123 Куст: 5\nмеханическая скорость: 45 м/ч\nПлотность раствора: 1,18 г/см3\nНПТ: 2.5 часа прихват")], "file_id string, well_id string, text string")
    e = {r.file_id: r for r in T.extract_entities(docs).collect()}
    assert (e["x"].rop_ft_hr, e["x"].mud_weight_ppg, e["y"].rop_m_hr) == ("145", "10.5", "45")
    c = {r.file_id: (r.well_name, r.pad) for r in T.entity_context(docs).collect()}
    assert c["y"] == ("123", "5")
    assert {r.file_id: r.discipline for r in T.classify_discipline(docs).collect()} == {"x": "drilling", "y": "drilling"}
    assert {(r.file_id, r.duration_hrs) for r in T.extract_npt_events(docs).collect()} == {("x", 1.5), ("y", 2.5)}
    events = T.extract_hse_events(docs).collect()
    assert [(r.file_id, r.severity, r.sif_potential) for r in events] == [("x", "near_miss", True)]
    numbers = {(r.file_id, r.field): r.number for r in T.bucket_entities(T.extract_entities(docs)).collect()}
    assert numbers["y", "mud_weight_sg"] == 1.18


def test_rules_and_scores(spark):
    features = spark.createDataFrame([("a", 15.0, 1, 0), ("b", 7.0, 0, 2), ("c", 2.0, 0, 0)], "well_id string, npt_hours double, fatality long, lti long")
    flags = spark.createDataFrame([("c", "RANGE", "mud_weight_ppg", "mud"), ("c", "DEPTH_MISMATCH", None, "d1"), ("c", "DEPTH_MISMATCH", None, "d2")], "well_id string, code string, field string, message string")
    got = sorted((r.linked_wells[0], r.rule_id, r.risk_level) for r in risk.score_risks(features, flags).collect())
    assert got == [("a", "K01", "high"), ("a", "K12", "critical"), ("b", "K02", "medium"), ("b", "K13", "critical"), ("c", "K03", "high"), ("c", "K16", "high"), ("c", "K16", "high")]
    grid = spark.createDataFrame([(5, 5), (5, 5), (1, 1)], "probability int, impact int")
    assert {(r.probability, r.impact): r.n for r in risk.risk_matrix(grid).where("n > 0").collect()} == {(5, 5): 2, (1, 1): 1}
    assert quality.qa_scorecard(features, flags).where("domain is null").count() == 3


def test_production_and_projects(spark):
    rows = [("w", i, float(o), None) for i, o in enumerate([1050, 920, 800, 710, 640, 580], 1)]
    ip = production.ip_metrics(spark.createDataFrame(rows, "well_id string, period int, oil_rate double, gor double")).first()
    assert (ip.ip30, ip.ip365, ip.peak) == (783.3, 783.3, 1050.0)
    e = spark.createDataFrame([("f", "42-123-12345", "Well Alpha #1", "North")], "file_id string, api string, well_name string, field string")
    p = spark.createDataFrame([("P", "4212312345", "alpha 1", "north field"), ("Q", "1", "beta", "south")], "project_name string, api string, well_name string, field string")
    assert [(r.project_name, r.confidence) for r in match.best_project(match.project_match(e, p)).collect()] == [("P", 0.75)]


def test_units(spark):
    r = spark.range(1).select(S.coerce_number(F.lit("12,450")).alias("a"), S.coerce_number(F.lit("3245,6")).alias("b"), S.coerce_cell(F.lit("10,5")).alias("c"), S.normalize_depth_unit(F.lit(None).cast("string"), F.lit("Meters")).alias("d"), S.trir(F.lit(2), F.lit(0)).alias("e"), S.canonical_curve(F.lit("rhoz")).alias("f")).first()
    assert (r.a, r.b, r.c.number, r.d, r.e, r.f) == (12450, 3245.6, 10.5, "m", None, "bulk_density_gcc")


def test_registered_queries_have_rows(spark):
    from borespark.plans import registry

    assert set(registry.ORACLES) == set(registry.QUERIES)
    for name in ("critical_dogleg_risks", "risk_matrix", "routing_summary"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_whole_project_match(spark):
    """Names and fields of every pair, from class links and members, against the score of each pair."""
    e = [(1, "Well Alpha #1", "North"), (2, "beta-2", "North Field"), (3, "", "South"), (4, None, None), (5, "Alpha", "east"), (6, "alpha", "x")]
    p = [(i, n, f) for i, (n, f) in enumerate([("alpha 1", "north field"), ("BETA 2 B", "north"), ("gamma", "no"), (None, ""), ("a", "North"), ("alpha", "northern")])]
    ents, projs = (spark.createDataFrame(x, "id long, well_name string, field string") for x in (e, p))
    both = ents.select(F.col("id").alias("a"), F.struct("well_name", "field").alias("e")).crossJoin(projs.select(F.col("id").alias("b"), F.struct("well_name", "field").alias("p")))
    score = match.match_score({f: F.col(f"e.{f}") for f in ("well_name", "field")}, {f: F.col(f"p.{f}") for f in ("well_name", "field")})[0]
    want = {(r.a, r.b, r.c) for r in both.select("a", "b", score.alias("c")).where("c > 0").collect()}
    me, mp = (match.name_members(x, "id", ["well_name", "field"]) for x in (ents, projs))
    pairs = match.name_links(me, mp).join(me.toDF("field", "entity_name", "a"), ["field", "entity_name"]).join(mp.toDF("field", "project_name", "b"), ["field", "project_name"])
    assert {(r.a, r.b, r.c) for r in pairs.groupBy("a", "b").agg(F.round(F.sum("confidence"), 3).alias("c")).collect()} == want and {c for *_, c in want} == {0.15, 0.3, 0.45}


def test_all_fields_are_scored(spark):
    e = spark.createDataFrame([("f", "alpha", "North")], "file_id string, well_name string, field string")
    p = spark.createDataFrame([("P", "alpha", "north")], "project_name string, well_name string, field string")
    assert [(r.confidence, r.matched) for r in match.project_match(e, p, block=["field"]).collect()] == [(0.45, ["well_name", "field"])]


def rows_equal_twin(spark, name, d="/root/testdata/sf0.001"):
    import duckdb

    from borespark.plans import registry

    with duckdb.connect() as c:
        for t in ("customer", "supplier", "nation", "orders", "documents"):
            c.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
        return sorted(map(tuple, registry.QUERIES[name](spark, d).collect())) == sorted(c.execute(registry.ORACLES[name]).fetchall())


def test_all_customers_and_orders(spark):
    from borespark.plans import registry

    d = "/root/testdata/sf0.001"
    assert all(rows_equal_twin(spark, n) for n in ("project_match_classes", "project_match_members", "upsert_history_all"))
    members = registry.QUERIES["project_match_members"](spark, d).where("side = 'project' and field = 'field'")
    assert members.select("id").distinct().count() == spark.read.parquet(f"{d}/customer.parquet").count()
    assert registry.QUERIES["upsert_history_all"](spark, d).count() == spark.read.parquet(f"{d}/orders.parquet").count()


def test_incident_lines_of_all_documents(spark, tmp_path):
    from borespark.plans import registry

    texts = [(1, "one licence\ntwo"), (2, "x\r\na token\r\nLICENCE"), (3, "x\rhours"), (4, None), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in registry.QUERIES["extract_hse_events"](spark, str(tmp_path)).collect()} == {(1, 1, "lti"), (2, 2, "rwc"), (2, 3, "lti"), (3, 2, "unsafe")}


def test_whole_texts_are_routed(spark):
    files_ = spark.createDataFrame([("a", "text_file", "x" * 2500 + " licence"), ("b", "text_file", "x" * 3500 + " und der")], "path string, detected_type string, text string")
    own = lambda **o: {(r.path, r.domain) for r in match.route_files(files_, {"drilling": ["the"], "production": ["und", "der"]}, ["licen"], **o).where("domain in ('drilling', 'production', 'hse')").collect()}
    assert own() == {("a", "drilling"), ("a", "hse"), ("b", "production")}
    assert {("b", "drilling"), ("b", "hse")} <= own(head=(3000, 2000))
    assert rows_equal_twin(spark, "routing_summary_whole")
