import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowspark.operators import explore, governance
from flowspark.plans import scoring
from flowspark.sources import files, flowcsv


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


FLOWS = (
    " Total Length of Fwd Packets, min_seg_size_forward,Label",
    "10,1,BENIGN",
    "20,2,DDoS",
    "Infinity,3,BENIGN",
)
NEEDED = ["Fwd Packets Length Total", "Fwd Seg Size Min"]
SCORER = scoring.expression_scorer("CASE WHEN `Fwd Packets Length Total` > 15 THEN 0.9D ELSE 0.1D END")


def score(spark, paths, output, **options):
    return scoring.score_flow_files(spark, paths, output, NEEDED, SCORER, 0.26, "test_model", **options)


def test_load_and_save(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "a int, b double")
    for kind in ("csv", "parquet"):
        path = str(tmp_path / f"t.{kind}")
        files.save_data(df, path, kind)
        assert sorted(map(tuple, files.load_data(spark, path).collect())) == [(1, 2.5), (2, 3.5)]
        with pytest.raises(FileExistsError, match="Already there"):
            files.save_data(df, path, kind)
    with pytest.raises(FileNotFoundError):
        files.load_data(spark, str(tmp_path / "no.csv"))
    with pytest.raises(ValueError, match="of the kind"):
        files.load_data(spark, write(tmp_path / "t.xlsx", "x"))
    with pytest.raises(ValueError, match="of the kind"):
        files.save_data(df, str(tmp_path / "t.json"), "json")
    broken = write(tmp_path / "broken.parquet", "not parquet")
    with pytest.raises(OSError):
        files.load_data(spark, broken)


def test_failed_save_keeps_the_old_result(spark, tmp_path):
    path = str(tmp_path / "out")
    files.save_data(spark.createDataFrame([(1,)], "a int"), path, "parquet")
    failing = spark.range(3).select(F.raise_error(F.lit("boom")).cast("int").alias("a"))
    with pytest.raises(Exception, match="boom"):
        files.save_data(failing, path, "parquet", overwrite=True)
    assert [r.a for r in spark.read.parquet(path).collect()] == [1]
    assert not [n for n in os.listdir(tmp_path) if "partial" in n]
    files.save_data(spark.createDataFrame([(2,)], "a int"), path, "parquet", overwrite=True)
    assert [r.a for r in spark.read.parquet(path).collect()] == [2]


def test_scores_keep_every_row(spark, tmp_path):
    source = write(tmp_path / "flows.csv", *FLOWS)
    output = str(tmp_path / "scores")
    manifest = score(spark, [source], output)
    assert [manifest[k] for k in ("rows_read", "rows_scored", "rows_invalid_input", "alerts")] == [3, 2, 1, 1]
    rows = sorted(
        spark.read.option("header", True).option("inferSchema", True).csv(output).collect(), key=lambda r: r.source_row
    )
    assert [r.source_row for r in rows] == [0, 1, 2]
    assert [r.score_status for r in rows] == ["scored", "scored", "invalid_input"]
    assert [r.is_alert for r in rows] == [False, True, False]
    assert {r.model_version for r in rows} == {"test_model"} and {r.threshold for r in rows} == {0.26}
    assert rows[2].prediction is None and rows[2].probability is None
    assert json.loads((tmp_path / "scores.manifest.json").read_text())["alerts"] == 1
    with pytest.raises(FileExistsError, match="Already there"):
        score(spark, [source], output)
    score(spark, [source], output, overwrite=True)


def test_failed_scoring_keeps_the_old_output(spark, tmp_path):
    source = write(tmp_path / "flows.csv", *FLOWS)
    output = str(tmp_path / "scores")
    score(spark, [source], output)
    failing = scoring.expression_scorer("CAST(raise_error('model failure') AS DOUBLE)")
    with pytest.raises(Exception, match="model failure"):
        scoring.score_flow_files(spark, [source], output, NEEDED, failing, 0.26, "v2", overwrite=True)
    assert spark.read.option("header", True).csv(output).count() == 3
    assert not [n for n in os.listdir(tmp_path) if "partial" in n]


def test_empty_input_is_an_error(spark, tmp_path):
    source = write(tmp_path / "flows.csv", FLOWS[0])
    with pytest.raises(ValueError, match="no flow records"):
        score(spark, [source], str(tmp_path / "scores"))
    assert not os.path.exists(tmp_path / "scores")


def test_header_problems(spark, tmp_path):
    repeated = write(tmp_path / "a.csv", "Max Packet Length,Packet Length Max", "1,2")
    with pytest.raises(ValueError, match="fall together"):
        flowcsv.read_flows(spark, [repeated], ["Packet Length Max"])
    missing = write(tmp_path / "b.csv", "x", "1")
    with pytest.raises(ValueError, match="does not have"):
        flowcsv.read_flows(spark, [missing], ["Packet Length Max"])


def test_files_with_different_headers_read_together(spark, tmp_path):
    one = write(tmp_path / "one.csv", "Fwd Seg Size Min,Fwd Packets Length Total", "1,100")
    two = write(tmp_path / "two.csv", " Total Length of Fwd Packets, min_seg_size_forward,extra", "200,2,z")
    rows = flowcsv.read_flows(spark, [one, two], NEEDED).collect()
    assert sorted((r[NEEDED[0]], r[NEEDED[1]]) for r in rows) == [("100", "1"), ("200", "2")]


def test_row_numbers_across_splits(spark, tmp_path):
    paths = [write(tmp_path / f"f{i}.csv", "n", *[str(n) for n in range(2000)]) for i in range(2)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = flowcsv.number_rows(flowcsv.read_flows(spark, paths, ["n"]))
        assert rows.count() == 4000
        assert rows.where("CAST(n AS BIGINT) <> source_row").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_preflight(spark, tmp_path):
    write(tmp_path / "good.csv", "Label,Protocol,Max Packet Length", "a,b,c")
    write(tmp_path / "old.csv", " Total Length of Fwd Packets, Label", "10,BENIGN")
    write(tmp_path / "twice.csv", "label,Protocol,Packet Length Max,Max Packet Length", "a,b,c,d")
    report = files.preflight_folder(spark, str(tmp_path), ["Protocol", "Packet Length Max"])
    rows = {files.base_name(r.file): r for r in report.collect()}
    assert rows["good.csv"].schema_compatible
    assert rows["old.csv"].missing_required_features == "Packet Length Max; Protocol"
    assert rows["old.csv"].label_column_present and not rows["old.csv"].schema_compatible
    assert rows["twice.csv"].duplicate_normalized_columns == "Packet Length Max"
    summary = files.preflight_summary(report).first()
    assert summary.files_inspected == 3 and not summary.all_files_schema_compatible
    with pytest.raises(FileNotFoundError):
        files.preflight_folder(spark, str(tmp_path / "none"), ["x"])


def test_external_preparation(spark, tmp_path):
    write(tmp_path / "in" / "flows.csv", " Total Length of Fwd Packets, Label", "1,BENIGN", "Infinity,DDoS")
    output = str(tmp_path / "prepared")
    manifest = flowcsv.prepare_external_folder(spark, str(tmp_path / "in"), NEEDED[:1], output)
    assert manifest["rows_written"] == 1 and manifest["rows_dropped_nonfinite_or_unlabeled"] == 1
    row = spark.read.option("header", True).csv(output).first()
    assert row.asDict() == {NEEDED[0]: "1.0", "label": "0"}
    with pytest.raises(FileExistsError):
        flowcsv.prepare_external_folder(spark, str(tmp_path / "in"), NEEDED[:1], output)
    write(tmp_path / "bad" / "flows.csv", " Total Length of Fwd Packets, Label", "x,DDoS")
    with pytest.raises(ValueError, match="Not one row"):
        flowcsv.prepare_external_folder(spark, str(tmp_path / "bad"), NEEDED[:1], str(tmp_path / "none"))


def put(df, folder, name):
    os.makedirs(folder, exist_ok=True)
    df.toPandas().to_parquet(os.path.join(folder, name), index=False)


def test_union_of_files(spark, tmp_path):
    raw = str(tmp_path / "raw")
    put(spark.createDataFrame([(1, "Benign")], "a int, Label string"), raw, "Bot_1.parquet")
    put(spark.createDataFrame([(2.5, 7)], "a double, b int"), raw, "DDoS_2018.parquet")
    put(spark.createDataFrame([(4.5, 8)], "a double, b int"), raw, "Web.parquet")
    rows = sorted(files.union_files(spark, str(tmp_path), "source").collect(), key=lambda r: r.a)
    assert [(r.a, r.b, r.Label, r.source) for r in rows] == [
        (1.0, None, "Benign", "Bot"), (2.5, 7, "DDoS", "DDoS"), (4.5, 8, "Web", "Web"),
    ]


def test_manifest(spark, tmp_path):
    path = write(tmp_path / "data.csv", "feature,label", "0,0", "0.1,0", "0.9,1", "1,1")
    manifest = governance.dataset_manifest(files.load_data(spark, path), path)
    assert manifest["rows"] == 4 and manifest["label_counts"] == {"0": 2, "1": 2}
    assert manifest["bytes"] == os.path.getsize(path) and len(manifest["schema_sha256"]) == 64


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, class_name string")
    row = explore.profile(df).first()
    assert (row.rows, row.columns, row.missing_cells, row.duplicates) == (3, 2, 2, 1)
    assert explore.label_distribution(df).first().percent == pytest.approx(100 / 3)
    approximate = {r.column: r.unique for r in explore.column_info(df, approximate=True).collect()}
    assert approximate == {"a": 2, "class_name": 1}
    with pytest.raises(ValueError):
        explore.label_distribution(df.select("a"))


def test_histogram_of_a_constant(spark):
    rows = explore.histograms(spark.createDataFrame([(2.0,), (2.0,)], "v double")).collect()
    assert len(rows) == 30 and sum(r.n for r in rows) == 2


def test_preflight_report_files(spark, tmp_path):
    write(tmp_path / "in" / "good.csv", "Label,Protocol", "a,b")
    files.write_preflight(spark, str(tmp_path / "in"), ["Protocol"], str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "schema_preflight.json").read_text())["all_files_schema_compatible"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "schema_preflight")).count() == 1


def test_headers_come_through_the_registered_file_system(spark, tmp_path):
    import gzip

    conf = spark._jsc.hadoopConfiguration()
    # A scheme that only Hadoop knows: a view of this folder.
    conf.set("fs.viewfs.impl", "org.apache.hadoop.fs.viewfs.ViewFileSystem")
    conf.set("fs.viewfs.mounttable.flows.link./exports", f"file://{tmp_path}")
    try:
        (tmp_path / "bom.csv").write_bytes("\ufeffa,\"b,c\",a\r\n1,2,3\r\n".encode())
        (tmp_path / "empty.csv").write_bytes(b"")
        (tmp_path / "no end.csv").write_bytes(b"x,y")
        (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(b"p,q\n1,2\n"))
        root = "viewfs://flows/exports"
        names = ["bom.csv", "empty.csv", "no end.csv", "packed.csv.gz"]
        found = {r.path: list(r["columns"]) for r in files.csv_headers(spark, [f"{root}/{n}" for n in names]).collect()}
        assert found == {
            f"{root}/bom.csv": ["a", "b,c", "a.1"], f"{root}/empty.csv": [],
            f"{root}/no end.csv": ["x", "y"], f"{root}/packed.csv.gz": ["p", "q"],
        }
        put(spark.range(3).coalesce(1), str(tmp_path), "DDoS_1.parquet")
        put(spark.range(2).selectExpr("cast(id as int) as id", "'x' as Label").coalesce(1), str(tmp_path), "Bot_1.parquet")
        made = files.union_files(spark, root, "source").orderBy("Label", "id").collect()
        assert [(r.id, r.Label, r.source) for r in made] == [
            (0, "DDoS", "DDoS"), (1, "DDoS", "DDoS"), (2, "DDoS", "DDoS"), (0, "x", "Bot"), (1, "x", "Bot"),
        ]
    finally:
        conf.unset("fs.viewfs.mounttable.flows.link./exports")
        conf.unset("fs.viewfs.impl")


def test_header_faults_name_the_file(spark, tmp_path, monkeypatch):
    with pytest.raises(OSError, match="gone.csv"):
        files.csv_headers(spark, [str(tmp_path / "gone.csv")])
    (tmp_path / "damaged.parquet").write_bytes(b"no footer here")
    with pytest.raises(OSError, match="damaged.parquet"):
        files.union_files(spark, str(tmp_path))
    monkeypatch.setattr(files, "HEADER_BYTES", 64)
    (tmp_path / "long.csv").write_text("a" * 100)
    with pytest.raises(ValueError, match="does not end"):
        files.csv_headers(spark, [str(tmp_path / "long.csv")])
    assert files.csv_headers(spark, []).count() == 0


def test_workers_find_the_package_from_any_folder(tmp_path):
    (tmp_path / "flows.csv").write_text("flow,label\n1,x\n")
    script = f"""
import sys
sys.path.insert(0, {str(Path(files.__file__).parents[2])!r})
from flowspark.session import build_session
from flowspark.sources.files import csv_headers
spark = build_session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false"}})
print([list(r) for r in csv_headers(spark, [{str(tmp_path / "flows.csv")!r}]).select("columns").collect()])
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "[[['flow', 'label']]]" in done.stdout, done.stderr


def test_places_name_file_and_position(spark, tmp_path):
    put(spark.range(30).coalesce(1), str(tmp_path), "my a+b.parquet")
    placed = files.union_files(spark, str(tmp_path), place_column="row_id").orderBy("row_id").collect()
    assert [(r.id, r.row_id) for r in placed] == [(k, f"my a+b.parquet:{k:019d}") for k in range(30)]


def test_folder_processing(spark, tmp_path):
    from flowspark.plans.training import process_folder, save_reports

    rows = [(float(i), float(i % 7), "Benign" if i % 3 else "DDoS") for i in range(60)]
    put(spark.createDataFrame(rows, "a double, b double, Label string"), str(tmp_path / "raw"), "Mix_1.parquet")
    (single,) = process_folder(spark, str(tmp_path), str(tmp_path / "one"), single_source=True)
    assert {r.label for r in spark.read.parquet(single).collect()} == {0, 1}
    train, test = process_folder(spark, str(tmp_path), str(tmp_path / "two"))
    assert spark.read.parquet(test).count() == 12 and spark.read.parquet(train).count() == 48
    with pytest.raises(FileExistsError):
        process_folder(spark, str(tmp_path), str(tmp_path / "two"))
    reports = save_reports({"metrics": spark.range(2)}, str(tmp_path / "reports"))
    assert spark.read.option("header", True).csv(f"{reports}/metrics").count() == 2


def test_stored_drift_state(spark, tmp_path):
    from flowspark.operators import drift

    df = spark.createDataFrame([(float(i),) for i in range(20)], "a double")
    drift.drift_report(df, drift.drift_baseline(df, ["a"])).write.parquet(str(tmp_path / "drift"))
    assert drift.stored_drift_state(spark, str(tmp_path / "drift")) == "healthy"
    assert drift.stored_drift_state(spark, None) == "unknown"
    assert drift.stored_drift_state(spark, str(tmp_path / "none")) == "error"


def test_repeated_header_spellings_are_numbered(spark, tmp_path):
    assert files.number_repeats(["a", "b", "a", "a.1", "a"]) == ["a", "b", "a.2", "a.1", "a.3"]
    path = write(tmp_path / "in" / "a.csv", " Fwd Header Length,Protocol, Fwd Header Length,Label", "1,2,3,BENIGN")
    (row,) = flowcsv.read_flows(spark, [path], ["Protocol", "Fwd Header Length"]).collect()
    assert (row["Protocol"], row["Fwd Header Length"]) == ("2", "1")
    assert files.preflight_folder(spark, str(tmp_path / "in"), ["Protocol"]).first().schema_compatible


def test_missing_label_texts_are_dropped(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Max Packet Length,Label", "1,NA", "2,BENIGN", "3,nan", "4,  ", "5,Bot")
    flows = flowcsv.read_flows(spark, [path], ["Packet Length Max"], label=True)
    prepared, counts = flowcsv.prepare_external(flows, ["Packet Length Max"])
    assert sorted(tuple(r) for r in prepared.collect()) == [(2.0, 0), (5.0, 1)]
    assert counts.first().rows_dropped == 3


def test_sorted_output_is_cut_into_bounded_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "many.csv")
    with open(path, "w") as f:
        f.write(",".join(NEEDED) + "\n" + "".join(",".join([str(i)] * len(NEEDED)) + "\n" for i in range(1000)))
    monkeypatch.setattr(scoring, "RANGE_ROWS", 100)
    output = str(tmp_path / "out")
    done = scoring.score_flow_files(spark, [path], output, NEEDED, SCORER, 0.26, "v", format="parquet")
    assert done["rows_read"] == 1000
    parts = [spark.read.parquet(p).select("source_row").collect() for p in sorted(str(p) for p in (tmp_path / "out").glob("part-*.parquet"))]
    assert len(parts) >= 8 and max(len(p) for p in parts) <= 250
    assert [r[0] for p in parts for r in p] == list(range(1000))
