import gzip

import numpy as np
import pytest

from cohortlake.functions import text as S
from cohortlake.sources import text, volumes


def test_volumes_round_trip(spark, tmp_path):
    x = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    (tmp_path / "a.nii").write_bytes(volumes.encode(x, [2, 0, 0, 1, 0, 3, 0, 2, 0, 0, 4, 3]))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(volumes.encode(x.astype("<f8") * 2)))
    rows = volumes.read_volumes(spark, str(tmp_path)).collect()
    got = {(r["volume_id"][-8:].strip("/"), r["i"], r["j"], r["k"]): r["value"] for r in rows}
    assert len(rows) == 46 and all(v == 2 * got[next(k for k in got if k[1:] == key[1:] and "a.nii" in k[0])] for key, v in got.items() if key[0].endswith(".gz"))
    h = {r["volume_id"].rsplit("/", 1)[1]: r for r in volumes.read_headers(spark, str(tmp_path)).collect()}
    assert h["a.nii"]["shape"] == [2, 3, 4] and h["a.nii"]["affine"][3] == 1


def test_subjects(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a/x.nii:1\n/b/y.nii:2\n")
    (tmp_path / "l.txt").write_text("7\n8\n")
    rows = text.read_subjects(spark, str(tmp_path / "s.txt"), "/data/").orderBy("line").collect()
    assert [(r["path"], r["label"]) for r in rows] == [("/data/a/x.nii", "1"), ("/b/y.nii", "2")]
    rows = text.read_subjects(spark, str(tmp_path / "s.txt"), labels=str(tmp_path / "l.txt"))
    assert [r["label"] for r in rows.orderBy("line").collect()] == ["7", "8"]
    text.write_subjects(rows, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["/b/y.nii:8", "a/x.nii:7"]


def test_logs_and_grep(spark, tmp_path):
    (tmp_path / "x.log").write_text("start\nAccuracy: 91.3\nAccuracy: 1.0\nF1: 80\n")
    r = text.read_svmperf_log(spark, str(tmp_path)).first()
    assert (r["Accuracy"], r["F1"], r["Recall"]) == (91.3, 80.0, None)
    assert text.grep_first(spark, str(tmp_path), "cc").first()["value"] == "Accuracy: 91.3"
    s = volumes.file_stats(spark, str(tmp_path)).first()
    assert (s["lines"], s["bytes"]) == (4, 42)


def test_atlas_xml(spark, tmp_path):
    (tmp_path / "demo.xml").write_text('<atlas><header><name>Demo</name><type>Probabilistic</type><units>x</units></header><data><label index="0" x="1" y="2" z="3">Left part</label><label index="1" x="4" y="5" z="6">Right part</label></data></atlas>')
    rows = text.read_atlas_labels(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["atlas"], r["idx"], r["name"], r["z"]) for r in rows] == [("Demo", 0, "Left part", 3), ("Demo", 1, "Right part", 6)]
    h = text.read_atlas_headers(spark, str(tmp_path)).first()
    assert (h["units"], h["upper"]) == ("%", 100)


def test_arff_and_svm_errors(spark, tmp_path):
    rows = spark.createDataFrame([(0, [0.5, 1.0], 1)], "sample_id int, x array<double>, y int")
    text.write_arff(rows, str(tmp_path / "a"), ["p", "q"], "r", [0, 1])
    assert "0.5000,1.0000,1" in [r[0] for r in spark.read.text(str(tmp_path / "a")).collect()]
    with pytest.raises(Exception, match="differ in number"):
        text.arff_lines(rows, ["p"], "r", [0]).collect()
    with pytest.raises(Exception, match="-1 or 1"):
        text.write_svmperf(rows.withColumn("y", rows["y"] + 1), str(tmp_path / "s"))


def test_convert(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    text.convert_table(spark, str(tmp_path / "t.csv"), str(tmp_path / "t.json"))
    assert spark.read.json(str(tmp_path / "t.json")).count() == 2


def test_globs():
    import re

    assert re.match(S.glob_or_regex("*.nii"), "x.nii") and not re.match(S.glob_or_regex("*.nii"), "x.nii.gz")
    assert S.glob_or_regex("ab$") == "^(?:ab$)"


@pytest.mark.parametrize("zeros", [False, True])
def test_large_volumes_are_read_by_ranges(spark, tmp_path, zeros):
    """Ranges that end inside rows, planes and batches give what whole files give; compressed files stay whole."""
    import gzip

    from cohortlake.sources import volumes

    rng = np.random.default_rng(12)
    for name, shape, kind in (("a.nii", (17, 9, 5, 3), "<i2"), ("b.nii", (40, 30), "<f8"), ("c.nii.gz", (20, 20, 8), "<f4"), ("d.nii", (2, 2, 2), "<f8")):
        x = (rng.integers(-2, 3, shape) * 7).astype(kind)
        data = volumes.encode(x)
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = volumes.read_volumes(spark, str(tmp_path), zeros)
    parts = volumes.read_volumes(spark, str(tmp_path), zeros, range_bytes=1000)
    assert parts.rdd.getNumPartitions() >= 5 + 10 + 1  # ranges of the first two, and the other files
    clean = lambda df: [(v.rsplit("/", 1)[1], *r) for v, *r in rows(df)]
    assert sorted(clean(parts)) == sorted(clean(whole)) and len(clean(whole)) > 100
    heads = lambda n: {r["volume_id"].rsplit("/", 1)[1]: r["shape"] for r in volumes.read_headers(spark, str(tmp_path), n).collect()}
    assert heads(1000) == heads(1 << 30) == {"a.nii": [17, 9, 5, 3], "b.nii": [40, 30], "c.nii.gz": [20, 20, 8], "d.nii": [2, 2, 2]}
    if zeros:
        assert len(clean(whole)) == 17 * 9 * 15 + 1200 + 3200 + 8
    (tmp_path / "cut.nii").write_bytes((tmp_path / "b.nii").read_bytes()[:-9])
    with pytest.raises(Exception, match="ends before its last voxel"):
        volumes.read_volumes(spark, str(tmp_path / "cut.nii"), zeros, range_bytes=1000).count()
