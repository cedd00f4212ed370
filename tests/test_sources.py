import json
import struct

import pytest
from pyspark.sql import functions as F

from tandemlake.operators import genotype as gt
from tandemlake.sources import abif, exports, tabular
from tandemlake.streaming import ingest

WIDE = """SAMPLE,ASSAY,MARKER,PANEL,DYE,COUNTRY,ADMINL1,COLLECTION_DATE,ALLELE1,SIZE1,HEIGHT1,ALLELE2,SIZE2,HEIGHT2
S1,a1,pv327,p,R,Indonesia,Papua,2/28/2001,317,316.79,1550,320,319.8,
S1,a1,msp1,p,B,Indonesia,Papua,2/28/2001,0,,,210,209.9,900
S2,a2,pv327,p,R,Peru,,2001,,,,,,
S3,,,,,Peru,Lima,nonsense,,,,,,
"""


@pytest.fixture()
def wide(spark, tmp_path):
    (tmp_path / "x.csv").write_text(WIDE)
    return tabular.read_alleles(spark, str(tmp_path / "x.csv"))


def test_alleles_of_wide_tables(wide):
    got = sorted(tuple(r) for r in tabular.alleles(wide).collect())
    assert got == [("S1", "a1", "pv327", "p", "PET", 0, 317, 316.79, 1550, 0), ("S1", "a1", "pv327", "p", "PET", 1, 320, 319.8, 300, 0)]


def test_samples_of_wide_tables(wide):
    got = {r["code"]: (str(r["collection_date"]), r["country"], r["level1"]) for r in tabular.samples(wide).collect()}
    assert got == {"S1": ("2001-02-28", "indonesia", "papua"), "S2": ("2001-01-01", "peru", ""), "S3": ("1990-01-01", "peru", "lima")}
    assert tabular.repeated_markers(wide).count() == 0 and tabular.repeated_markers(wide.union(wide)).count() == 3


def test_headers():
    tabular.check_headers(["SAMPLE", "ALLELE12", "AREA_1"])
    with pytest.raises(ValueError):
        tabular.check_headers(["SAMPLE", "TOWN"])


def test_documents_round_trip(wide):
    docs = tabular.documents(wide)
    back = sorted(tuple(r) for r in tabular.flatten_documents(docs).collect())
    assert back == sorted(tuple(r) for r in tabular.alleles(wide).collect()) and docs.count() == 3


def test_assay_list_and_panels(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("sample\tfile\tpanel\toptions\n#skip\t\t\t\nS1\tx.fsa\tp1, p2\texclude=M1,zz;\nS2\ty.fsa\tp1\t\n")
    assays = tabular.assay_list(spark, str(tmp_path / "a.tsv"))
    assert sorted((r["sample"], r["panel"], tuple(r["exclude"])) for r in assays.collect()) == [("S1", "p1", ("m1", "zz")), ("S1", "p2", ("m1", "zz")), ("S2", "p1", ())]
    panels = tabular.definitions(spark, '{"p1": {"code": "p1", "data": {"ladder": "LIZ600", "markers": {"M1": {"dye": "VIC"}, "M2": {"dye": "NED"}}}}}', "panel")
    flat = tabular.panel_markers(panels)
    assert flat.count() == 2
    assert [r["marker"] for r in tabular.unknown_exclusions(assays, flat).collect()] == ["zz"]
    markers = tabular.definitions(spark, '[{"code": "M1", "repeats": 3, "min_size": 5, "max_size": 45, "bins": [[5, 5], [10.2, 10]]}]', "marker")
    assert markers.first()["bins"][1]["pos"] == 10.2


def test_relabel(spark):
    names = spark.createDataFrame([("a", "A")], "old string, new string")
    rows = spark.createDataFrame([("a",)], "label string")
    assert tabular.relabel(rows, names).first()["label"] == "A"
    with pytest.raises(Exception, match="no new label"):
        tabular.relabel(spark.createDataFrame([("b",)], "label string"), names).collect()


def test_abif_round_trip(spark, tmp_path):
    trace = [0, 5, -3, 1200, 7]
    data = abif.encode({
        ("DATA", 1): (4, struct.pack(">5h", *trace), 5), ("DATA", 105): (4, struct.pack(">2h", 1, 2), 2), ("DyeN", 1): (18, b"\x056-FAM", 6),
        ("DyeW", 1): (4, struct.pack(">h", 522), 1), ("PCON", 1): (2, b"abc", 3),
    })
    (tmp_path / "one.fsa").write_bytes(data)
    (tmp_path / "readme.txt").write_text("no trace")
    got = {r["dye_no"]: r for r in abif.read_traces(spark, str(tmp_path)).collect()}
    assert got[1]["raw"] == trace and (got[1]["dye"], got[1]["wavelength"]) == ("6-FAM", 522) and got[5]["raw"] == [1, 2]
    points = {r["t"]: (r["1"], r["5"]) for r in abif.trace_points(abif.read_traces(spark, str(tmp_path))).collect()}
    assert points[1] == (5, 2) and points[4] == (7, None)
    with pytest.raises(ValueError):
        abif.entries(b"nothing")


def test_exports(spark):
    wide = spark.createDataFrame([("b", 2, 1.0, None), ("a", 1, 3.0, 4.0), ("a", 5, 3.0, 5.0)], "set_id string, sample_id bigint, m1 double, m2 double")
    assert sorted(r["line"] for r in exports.structure(wide, [1, 2], ["a", "b"]).collect()) == ["1 1 3 4", "2 2 1 -9", "5 1 3 5"]
    whole = gt.complete(wide, [1, 2])
    assert sorted(r["line"] for r in exports.flat(whole, [1, 2]).collect()) == ["1 3 4", "5 3 5"]
    assert sorted(r["line"] for r in exports.arlequin_rows(whole, [1, 2], ["a", "b"], recode=True).collect()) == ["1 1 01003 01004", "2 1 01003 01005"]
    assert "MISSING -9" in exports.structure_params([1, 2], 3, 2) and "NbSamples=2" in exports.arlequin_header(2)
    alleles = spark.createDataFrame([(1, 7, 5.0, 5.1, 90.0), (1, 7, 6.0, 6.1, 99.0)], "sample_id bigint, marker_id bigint, value double, size double, height double")
    assert exports.allele_document(alleles).first()["doc"] == '{"7":[{"value":6.0,"size":6.1,"height":99.0},{"value":5.0,"size":5.1,"height":90.0}]}'
    traces = spark.createDataFrame([(1, [3.0, 4.0])], "channel_id bigint, data array<double>")
    assert exports.plot_points(traces).first()["points"] == "[[0.0,3.0],[1.0,4.0]]"


def test_numbers_are_gapless(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r["k"]: r["number"] for r in exports.numbered(rows.repartition(5), ["k"]).collect()}
    assert got == {k: k + 1 for k in range(1000)}


def test_incremental_ingest(spark, tmp_path):
    source, table, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    source.mkdir()
    columns = WIDE.split("\n")[0].split(",")
    for n, name in ((2, "a.csv"), (4, "b.csv")):
        (source / name).write_text(WIDE)
        ingest.ingest(ingest.stream_alleles(spark, str(source), columns), str(table), str(checkpoint)).awaitTermination()
        assert spark.read.parquet(str(table)).count() == n


def test_types_that_entries_are_known_to_have():
    data = abif.encode({("PCON", 1): (2, bytes([0, 20, 255]), 3), ("GELP", 1): (18, b"gel\0", 4), ("DATA", 1): (4, struct.pack(">2h", 5, -6), 2)})
    got = abif.entries(data)
    assert got["PCON", 1] == (0, 20, -1) and got["GELP", 1] == "gel" and got["DATA", 1] == (5, -6)


def test_documents_of_both_forms(spark, tmp_path):
    doc = {"assays": {"a1": {"panel": "P", "markers": {"M1": {"dye": "VIC", "alleles": [[200, 200.4, 900, 7], [203, 203.1, 400, 0]]}, "M9": {"dye": "NED", "alleles": []}}}}}
    (tmp_path / "plain.json").write_text(json.dumps({"s1": doc, "s2": {"assays": {}}}))
    (tmp_path / "archive.json").write_text(json.dumps({"B1": {"samples": {"s3": doc}}}))
    docs = tabular.read_documents(spark, str(tmp_path))
    assert sorted(r["code"] for r in docs.collect()) == ["s1", "s2", "s3"]
    rows = tabular.stored_alleles(docs).orderBy("sample", "pos").collect()
    assert [(r["sample"], r["marker"], r["value"], r["size"], r["height"], r["area"], r["peak_type"]) for r in rows][:2] == [("s1", "M1", 200, 200.4, 900, 7, "peak-bin"), ("s1", "M1", 203, 203.1, 400, 0, "peak-bin")]
    batches, stored = spark.createDataFrame([("B1",)], "code string"), spark.createDataFrame([("B1", "s1")], "batch string, code string")
    markers = spark.createDataFrame([("m1",)], "code string")
    only = docs.filter("code <> 's2'")
    errors = lambda batch, mode: sorted((tuple(r) for r in tabular.import_errors(only, batch, batches, stored, markers, mode).collect()), key=str)
    assert errors("b2", "new") == [] and errors("b1", "new") == [(None, "batch exists")]
    assert errors("B1", "sample") == [("s1", "sample exists")] and errors("B1", "info") == [("s3", "no such sample")]
    assert (None, "no such batch") in errors("B7", "allele") and len(errors("B7", "allele")) == 3
    bad = spark.createDataFrame([("x", json.dumps({"assays": {"a": {"panel": "P", "markers": {"Q": {"dye": "B", "alleles": [[1, 1, 1, 1]]}}}}}))], "code string, doc string")
    assert [r["error"] for r in tabular.import_errors(bad, "new one", batches, stored, markers).collect()] == ["no such marker: q"]


def test_named_definitions_and_their_checks(spark):
    text = json.dumps({"M1": {"code": "M1", "repeats": 3, "min_size": 10, "max_size": 20, "bins": [[12, 12]]}, "M2": {"code": "M2"}})
    assert [r["code"] for r in tabular.definitions(spark, text, "marker", ["m2"]).collect()] == ["M2"]
    with pytest.raises(ValueError):
        tabular.definitions(spark, json.dumps({"M1": {"code": "M3"}}), "marker")
    markers = tabular.definitions(spark, text, "marker")
    panels = tabular.definitions(spark, json.dumps({"P": {"code": "P", "data": {"ladder": "LIZ500", "markers": {"m1": {"dye": "VIC"}, "M7": {"dye": "NED"}}}}}), "panel")
    assert [tuple(r) for r in tabular.unknown_panel_markers(panels, markers).collect()] == [("P", "M7")]
    docs = {r["code"]: json.loads(r["doc"]) for r in exports.marker_document(markers).collect()}
    again = tabular.definitions(spark, json.dumps(docs), "marker")
    assert sorted(map(str, again.collect())) == sorted(map(str, markers.collect()))
    panel = {r["code"]: json.loads(r["doc"]) for r in exports.panel_document(panels).collect()}
    assert sorted(map(str, tabular.definitions(spark, json.dumps(panel), "panel").collect())) == sorted(map(str, panels.collect()))


def test_export_kinds(spark):
    with pytest.raises(ValueError):
        exports.export("pdf")
