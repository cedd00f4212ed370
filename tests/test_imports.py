"""An import in one call: rules, writes and what is left alone."""

import json

import pytest

from tandemlake.operators import imports as im


def doc(date=None, location=None, comments=None, **markers):
    out = {k: v for k, v in (("collection_date", date), ("location", location), ("comments", comments)) if v is not None}
    alleles = {m: {"dye": "VIC", "alleles": [[v, v + 0.1, 500 - v, 7] for v in values]} for m, values in markers.items()}
    return json.dumps(out | {"assays": {"a1": {"panel": "P", "markers": alleles}} if alleles else {}})


def docs(spark, **samples):
    return spark.createDataFrame(list(samples.items()), "code string, doc string")


@pytest.fixture(scope="module")
def first(spark):
    markers = spark.createDataFrame([("M1",), ("m2",)], "code string")
    given = docs(spark, s1=doc("2001/03/04", ["Asia", "North"], "old", M1=[200, 203], M2=[90]), s2=doc(None, None, M1=[201]), s3=doc())
    after, errors = im.import_documents(given, "B1", im.empty(spark, markers))
    assert errors.count() == 0
    return after


def alleles(stored):
    return sorted((r["sample"], r["marker"], r["value"], r["revision"]) for r in im.latest_alleles(stored).collect())


def test_new_batch(first):
    assert [r["code"] for r in first.batches.collect()] == ["B1"]
    got = {r["code"]: r for r in first.samples.collect()}
    assert set(got) == {"s1", "s2", "s3"} and (got["s1"]["country"], got["s1"]["level1"], got["s1"]["level2"], str(got["s1"]["collection_date"])) == ("asia", "north", None, "2001-03-04")
    assert got["s2"]["collection_date"] is None
    assert alleles(first) == [("s1", "M1", 200, 1), ("s1", "M1", 203, 1), ("s1", "M2", 90, 1), ("s2", "M1", 201, 1)]
    assert {(r["peak_type"], r["method"], r["size"]) for r in first.alleles.filter("value = 90").collect()} == {("peak-bin", "binning-external", 90.1)}


def test_rules_leave_the_tables_alone(spark, first):
    cases = [
        ("new", "b1", docs(spark, s9=doc()), {(None, "batch exists")}), ("sample", "B7", docs(spark, s9=doc()), {(None, "no such batch")}),
        ("sample", "B1", docs(spark, s1=doc(), s9=doc()), {("s1", "sample exists")}), ("allele", "B1", docs(spark, s9=doc(M1=[1])), {("s9", "no such sample")}),
        ("allele", "B1", docs(spark, s1=doc(M5=[1])), {("s1", "no such marker: m5")}), ("info", "B1", docs(spark, s1=doc(M5=[1]), s9=doc()), {("s9", "no such sample")}),
    ]
    for mode, batch, given, want in cases:
        after, errors = im.import_documents(given, batch, first, mode)
        assert {(r["code"], r["error"]) for r in errors.collect()} == want, mode
        assert after is first
    with pytest.raises(ValueError):
        im.import_documents(docs(spark, s1=doc()), "B1", first, "other")


def test_modes_of_change(spark, first):
    added, errors = im.import_documents(docs(spark, s4=doc(location=["Europe"], m2=[95])), "B1", first, "sample")
    assert errors.count() == 0 and {r["code"] for r in added.samples.collect()} == {"s1", "s2", "s3", "s4"}
    newer, _ = im.import_documents(docs(spark, s1=doc(M1=[206])), "b1", added, "allele")
    assert alleles(newer) == [("s1", "M1", 206, 3), ("s1", "M2", 90, 1), ("s2", "M1", 201, 1), ("s4", "m2", 95, 2)]
    assert newer.alleles.count() == first.alleles.count() + 2
    told, _ = im.import_documents(docs(spark, s1=doc("2005/01/02", None, "", M1=[1]), s2=doc(location=["Africa"])), "b1", newer, "info")
    got = {r["code"]: r for r in told.samples.collect()}
    assert (str(got["s1"]["collection_date"]), got["s1"]["country"], got["s1"]["comments"]) == ("2005-01-02", "asia", "old")
    assert got["s2"]["country"] == "africa" and {r["batch"] for r in got.values()} == {"B1"} and len(got) == 4
    assert told.alleles.count() == newer.alleles.count()
    second, errors = im.import_documents(docs(spark, s1=doc(M1=[300])), "B2", told)
    assert errors.count() == 0 and alleles(second).count(("s1", "M1", 300, 1)) == 1 and second.batches.count() == 2


def test_documents_are_parsed_once(spark):
    doc = '{"location": ["Malaysia"], "assays": {"A1": {"panel": "P", "markers": {"m1": {"dye": "FAM", "alleles": [[100, 100.2, 900, 0]]}}}}}'
    docs = spark.createDataFrame([("S1", doc)], "code string, doc string")
    stored, errors = im.import_documents(docs, "B", im.empty(spark, spark.createDataFrame([("m1",)], "code string")))
    assert errors.isEmpty()
    latest = im.latest_alleles(stored)
    assert "from_json" not in latest._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["sample"], r["marker"], r["value"], r["revision"]) for r in latest.collect()] == [("S1", "m1", 100, 1)]
