"""Ground truth documents as other programs write them."""

from __future__ import annotations

import json

import pytest

from tallyspark.sources import truth

COLUMNS = ("image_path", "combo_id", "precinct", "party", "contest", "candidate", "contest_type", "max_votes", "write_in", "counted_as")


def entry(n: int, names=("A", "B")) -> dict:
    marks = [{"contest": "Mayor", "candidate": c, "contestType": "PLURALITY", "maxVotes": 1, "writeIn": c == "B", "counted_as": "VOTED"} for c in names]
    marks.append({"contest": "Mayor", "candidate": "none"})
    return {"combo_id": f"1|{n}", "precinct": f"P{n % 3}", "party": None, "indicators": marks, "copy": 2}


def expected(images: dict) -> list[tuple]:
    rows = []
    for path, e in images.items():
        for m in e.get("indicators", []):
            rows.append((path, e.get("combo_id"), e.get("precinct"), e.get("party"), m["contest"], m["candidate"], m.get("contestType"),
                         m.get("maxVotes"), m.get("writeIn"), m.get("counted_as", "UNMARKED")))
    return sorted(rows, key=repr)


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


AWKWARD = {
    '/scans/"quoted" {x}.png': entry(1, ("A, \"B\"\n    }", "é\\\t}")), "/scans/back\\slash\n    },\n.png": entry(2, ("],", "{")),
    "/empty.png": {}, "/none.png": {"combo_id": "7", "precinct": "P", "party": "2"}, "/no-marks.png": {"combo_id": "8", "indicators": []},
    "/last.png": entry(5),
}
AGGREGATE = {"1|1": {"precinct": "P1", "party": None, "contests": {"Mayor": {"A": 3}}}, "1|2": {"precinct": "P2", "party": "1", "contests": {}}}


@pytest.mark.parametrize("indent", [2, 4])
@pytest.mark.parametrize("document", [
    {"per_image": AWKWARD, "aggregate": AGGREGATE, "total_images": 6},
    {"total_images": 6, "aggregate": AGGREGATE, "per_image": AWKWARD},
    {"per_image": AWKWARD},
    AWKWARD,
    {"/one.png": entry(1)},
], ids=["harness", "per_image last", "alone", "bare", "one image"])
def test_indented_documents(spark, tmp_path, document, indent):
    (tmp_path / "truth.json").write_text(json.dumps(document, indent=indent))
    images = document.get("per_image", document)
    assert truth._form_of(spark, str(tmp_path)) == "indented"
    assert rows_of(truth.read_ground_truth(spark, str(tmp_path))) == expected(images)
    assert rows_of(truth.read_ground_truth(spark, str(tmp_path), form="whole")) == expected(images)


def test_one_document_is_cut_over_many_tasks(spark, tmp_path):
    """A wrapped document of many images: one scan, several tasks, every entry once."""
    images = {f"/scans/b{n}.png": entry(n) for n in range(4000)}
    path = tmp_path / "truth.json"
    path.write_text(json.dumps({"per_image": images, "aggregate": AGGREGATE, "total_images": 4000}, indent=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(path.stat().st_size // 7))
    try:
        frame = truth.read_ground_truth(spark, str(path))
        assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        assert frame.rdd.getNumPartitions() >= 7
        assert frame.select("image_path").distinct().count() == 4000
        assert rows_of(frame) == expected(images)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_compact_documents_and_lines(spark, tmp_path):
    (tmp_path / "compact.json").write_text(json.dumps({"per_image": AWKWARD, "total_images": 6}))
    assert rows_of(truth.read_ground_truth(spark, str(tmp_path / "compact.json"))) == expected(AWKWARD)
    lines = [json.dumps({path: e}) for path, e in AWKWARD.items()]
    (tmp_path / "lines.json").write_text("\n".join([*lines, "", "not json"]))
    assert rows_of(truth.read_ground_truth(spark, str(tmp_path / "lines.json"))) == expected(AWKWARD)
    (tmp_path / "empty.json").write_text("")
    assert rows_of(truth.read_ground_truth(spark, str(tmp_path / "empty.json"))) == []
    with pytest.raises(ValueError, match="form"):
        truth.read_ground_truth(spark, str(tmp_path), form="yaml")


def test_a_torn_indented_document_is_an_error(spark, tmp_path):
    whole = json.dumps({"per_image": {f"/{n}": entry(n) for n in range(5)}}, indent=2)
    (tmp_path / "torn.json").write_text(whole[: len(whole) - 130])
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        truth.read_ground_truth(spark, str(tmp_path / "torn.json")).collect()


def test_documents_written_here_are_json_of_the_harness(spark, tmp_path):
    rows = [("/a\"1", "c1", "P1", None, "Mayor", "A", "VOTED"), ("/a\"1", "c1", "P1", None, "Mayor", "A", "VOTED"),
            ("/a\"1", "c1", "P1", None, "Mayor", "B\n", "UNMARKED"), ("/b", "c2", "P1", "2", "Board", "C", "VOTED"),
            ("/c", "c3", None, "2", "Board", "C", "OVERVOTED")]
    frame = spark.createDataFrame(rows, "image_path string, combo_id string, precinct string, party string, contest string, candidate string, counted_as string")
    truth.write_truth_documents(frame, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*/*.txt"))
    documents = [json.loads(f.read_text()) for f in files if f.read_text()]
    assert len(documents) == 2
    first = next(d for d in documents if "/b" in d["per_image"])
    assert first["total_images"] == 2 and first["aggregate"]["c1"]["contests"] == {"Mayor": {"A": 2}}
    # But for the order of marks, the file is what json.dump would have written.
    assert json.dumps(first, indent=2, ensure_ascii=False) in [f.read_text().rstrip("\n") for f in files]
    back = truth.read_ground_truth(spark, str(tmp_path / "out")).select(*frame.columns)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
