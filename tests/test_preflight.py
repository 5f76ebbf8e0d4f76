"""Preflights, strict configurations, foundation checks, JSON documents."""

import json

import pytest
from pyspark.sql import functions as F

from annolith.operators import preflight
from annolith.sources import configs, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_recommendation(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 2), ("b", 1), ("c", 0), ("d", 1), ("d", 0)], "k string, n1 int")
    got = {r.k: (r.positive, r.negative, r.weight, r.recommendation) for r in preflight.recommendation(df, ("k",)).collect()}
    assert got == {"a": (1, 2, 2.0, "CLASS_AWARE_SAMPLING"), "b": (1, 0, 0.0, "DEFER"), "c": (0, 1, None, "DEFER"), "d": (1, 1, 1.0, "DEFER")}
    assert preflight.recommendation(df.limit(0)).first().recommendation == "DEFER"


def test_readiness(spark):
    cases = {
        "fine": ([(["SMALL"], True), ([], True)], (3, 1), (9, 4), "YES", "PASS"),
        "pending": ([(["SMALL"], True), (None, False)], (3, 1), (9, 4), "REVIEW_REQUIRED", "FAIL"),
        "suspicious": ([(["ANNOTATION_SUSPICIOUS"], True)], (3, 1), (9, 4), "REVIEW_REQUIRED", "FAIL"),
        "blurred": ([(["BLUR", "SMALL"], True)], (3, 1), (9, 4), "REVIEW_REQUIRED", "PASS"),
        "unknown": ([(["UNKNOWN"], True)], (3, 1), (9, 4), "REVIEW_REQUIRED", "PASS"),
        "no evidence": ([(["SMALL"], True)], (0, 0), (9, 4), "NO", "FAIL"),
        "one kind": ([(["SMALL"], True)], (0, 2), (9, 4), "YES", "FAIL"),
        "balanced": ([(["SMALL"], True)], (3, 1), (4, 4), "NO", "FAIL"),
    }
    reviews = spark.createDataFrame([(k, c, ok) for k, v in cases.items() for c, ok in v[0]], "k string, categories array<string>, reviewed boolean")
    automatic = spark.createDataFrame([(k, *v[1]) for k, v in cases.items() if sum(v[1])], "k string, low_confidence int, class_confusion int")
    classes = spark.createDataFrame([(k, *v[2]) for k, v in cases.items()], "k string, n0 int, n1 int")
    got = {r.k: (r.decision, r.design) for r in preflight.readiness(reviews, automatic, classes, ("k",)).collect()}
    assert got == {k: v[3:] for k, v in cases.items()}


def test_provenance(spark):
    schema = "k int, image string, label string"
    manifest = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "y"), (4, "d", "z"), (4, "d", "z"), (6, None, "q")], schema)
    actual = spark.createDataFrame([(1, "a", "x"), (2, "b", "new"), (3, "other", "y"), (4, "d", "z"), (5, "e", "w"), (6, None, "q")], schema)
    assert rows(preflight.provenance_violations(manifest, actual, "k", ["image", "label"])) == [(2, "CHANGED label"), (3, "CHANGED image"), (4, "REPEATED"), (5, "FOREIGN")]
    assert rows(preflight.provenance_violations(manifest, actual.limit(0), "k", ["image", "label"])) == sorted([(k, "MISSING") for k in (1, 2, 3, 4, 6)] + [(4, "REPEATED")], key=str)


def test_predictions(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, 0, 0.5, 0.0, 0.0, 1.0, 1.0), (2, 2, 0.5, 0.0, 0.0, 1.0, 1.0), (3, 0, 0.0001, 0.0, 0.0, 1.0, 1.0), (4, 1, nan, 0.0, 0.0, 1.0, 1.0), (5, 1, 0.5, nan, 0.0, 1.0, 1.0), (6, 1, 0.5, 0.0, 0.0, inf, 1.0), (7, None, 0.5, 0.0, None, 1.0, 1.0)] + [(8, 0, 1.0, 0.0, 0.0, 1.0, 1.0)] * 4
    df = spark.createDataFrame(data, "img int, c int, s double, x1 double, y1 double, x2 double, y2 double")
    assert rows(preflight.prediction_violations(df, 2, 0.001, 3)) == [(2, "UNKNOWN_CLASS"), (3, "INVALID_SCORE"), (4, "INVALID_SCORE"), (5, "INVALID_BOX"), (6, "INVALID_BOX"), (7, "INVALID_BOX"), (7, "UNKNOWN_CLASS"), (8, "TOO_MANY")]


def test_run_evidence(spark):
    required = spark.createDataFrame([(r, k, v) for r in (1, 2, 3) for k, v in (("status", "PASS"), ("seed", "42"))], "run int, key string, value string")
    evidence = spark.createDataFrame([(1, "status", "PASS"), (1, "seed", "42"), (1, "more", "x"), (2, "status", "FAIL")], "run int, key string, value string")
    epochs = spark.createDataFrame([(1, 1, 10, True, 5, 10), (1, 2, 10, True, 5, 10), (2, 2, 9, False, 0, 10), (2, 3, 10, None, None, 10)], "run int, epoch int, samples int, used boolean, steps int, expected int")
    assert rows(preflight.run_violations(required, evidence, epochs)) == sorted([(2, "seed", "MISSING"), (2, "status", "WRONG_VALUE"), (3, None, "NOT_RUN"), *[(2, e, p) for e, p in (("2", "OUT_OF_SEQUENCE"), ("2", "WRONG_SAMPLES"), ("2", "SAMPLER_NOT_USED"), ("2", "NO_STEPS"), ("3", "OUT_OF_SEQUENCE"), ("3", "SAMPLER_NOT_USED"), ("3", "NO_STEPS"))]], key=str)


def test_review_sample(spark):
    images = spark.createDataFrame([(k, k % 4, k % 3, k % 2 == 0, k % 5) for k in range(40)], "img int, tier int, n_hard1 int, crowded boolean, n_hard int")
    objects = spark.createDataFrame([(k, "A" if k % 7 == 0 else "B" if k % 11 == 3 else "C") for k in range(40)] + [(0, "A")], "img int, category string")
    got = {r.img: r.reasons for r in preflight.review_sample(images, objects, {3: 2, 1: 1}, ("A", "B")).collect()}
    want = {}
    for t, n in ((3, 2), (1, 1)):
        for k in sorted((k for k in range(40) if k % 4 == t), key=lambda k: (k % 3 == 0, -(k % 3), k))[:n]:
            want.setdefault(k, set()).add(f"tier {t}")
    for k, reason in [(0, "A"), (7, "A"), (3, "B"), (25, "B")]:
        want.setdefault(k, set()).add(reason)
    want = {k: sorted(v) for k, v in want.items()}
    for k in sorted(k for k in range(40) if k % 2 == 0 and k % 5)[:3]:
        want[k] = sorted({*want.get(k, []), "crowded"})
    assert got == want


RUN = {"experiment": "a", "data": "d.yaml", "model": "m", "image_size": 416, "epochs": 3, "patience": 0, "seed": 42, "deterministic": True, "device": "cpu", "workers": 0, "cache": False, "pretrained": True, "batch": 0.5, "smoke_epochs": 1, "smoke_fraction": 0.1}
POLICY = {"schema_version": 1, "split": "valid", "label": "x", "target": "1", "objective": "maximize_recall", "production": False, "tie_break": list(configs.TIE_BREAK), "same_cost": 1, "modes": {m: {"rationale": "r", "constraints": {"min_precision": 0.7, "max_fp_per_image": 1, "max_overall_fp_per_image": 2.5}} for m in configs.MODES}}


def test_run_configurations(tmp_path):
    file = tmp_path / "run.yaml"
    write = lambda **change: file.write_text("﻿" + json.dumps({k: v for k, v in (RUN | change).items() if v != "gone"}), encoding="utf-8")
    write()
    found = configs.RunConfig.load(file, {"device": 0, "workers": None}, {"image_size": 416, "cache": False})
    assert (found.device, found.workers, found.epochs) == ("0", 0, 3)
    for change in ({"seed": "gone"}, {"extra": 1}, {"epochs": 0}, {"epochs": True}, {"epochs": 2.0}, {"smoke_epochs": 3}, {"smoke_fraction": 0}, {"smoke_fraction": 1.5}, {"cache": "no"}, {"patience": -1}, {"model": ""}, {"batch": float("inf")}):
        write(**change)
        with pytest.raises(ValueError):
            configs.RunConfig.load(file)
    write()
    for overrides, constants in (({"seed": 1}, {}), ({}, {"image_size": 640}), ({}, {"cache": 0}), ({"workers": -1}, {})):
        with pytest.raises(ValueError):
            configs.RunConfig.load(file, overrides, constants)
    file.write_text("[]")
    with pytest.raises(ValueError):
        configs.RunConfig.load(file)


def test_policies(spark, tmp_path):
    file = tmp_path / "policy.yaml"
    write = lambda p: file.write_text(json.dumps(p))
    write(POLICY)
    assert rows(configs.Policy.load(file).rows(spark)) == sorted([(m, 0.7, 1.0, 2.5) for m in configs.MODES], key=str)
    bad = lambda **c: POLICY | {"modes": POLICY["modes"] | {"balanced": {"rationale": "r", "constraints": POLICY["modes"]["balanced"]["constraints"] | c}}}
    for p in (POLICY | {"objective": "other"}, POLICY | {"production": 0}, POLICY | {"schema_version": 2}, POLICY | {"tie_break": []}, POLICY | {"same_cost": 1.5}, POLICY | {"more": 1}, POLICY | {"modes": {}}, bad(min_precision=1.1), bad(max_fp_per_image=-1), bad(max_fp_per_image=True), bad(other=1), POLICY | {"modes": POLICY["modes"] | {"balanced": {"rationale": "", "constraints": {}}}}):
        write(p)
        with pytest.raises(ValueError):
            configs.Policy.load(file)
    write(POLICY | {"split": "test"})
    with pytest.raises(PermissionError):
        configs.Policy.load(file)


def test_foundation(spark, tmp_path):
    for split, n in (("train", 2), ("valid", 1)):
        (tmp_path / split / "images").mkdir(parents=True)
        (tmp_path / split / "labels").mkdir()
        for k in range(n):
            (tmp_path / split / "images" / f"{k}.JPG").write_bytes(b"x")
    (tmp_path / "train" / "images" / "note.txt").write_text("no image")
    (tmp_path / "data.yaml").write_text(json.dumps({"path": str(tmp_path), "train": "train/images", "val": "valid/images", "test": "test/images", "nc": 2, "names": {0: "a", 1: "b"}}))
    got = {r.check: r.passed for r in configs.foundation_checks(spark, str(tmp_path / "data.yaml"), str(tmp_path), {"train": 2, "valid": 2, "test": 1}, ("data.yaml", "README")).collect()}
    assert got == {"root": True, "configuration": True, "file data.yaml": True, "file README": False, "classes": True, "train folders": True, "train images": True, "valid folders": True, "valid images": False, "test folders": False, "test images": False}
    assert not {r.check: r.passed for r in configs.foundation_checks(spark, str(tmp_path / "none.yaml"), str(tmp_path), {}).collect()}["classes"]


def test_one_json_document(spark, tmp_path):
    path = f"file://{tmp_path}/report.json"
    tables.write_json_report(spark.createDataFrame([(1, None, 0.5), (2, "é", 1.5)], "a int, b string, c double").orderBy("a"), path)
    assert json.loads((tmp_path / "report.json").read_text()) == [{"a": 1, "b": None, "c": 0.5}, {"a": 2, "b": "é", "c": 1.5}]
    with pytest.raises(FileExistsError):
        tables.write_json_report(spark.range(1), path)
    with pytest.raises(Exception, match="not finite"):
        tables.write_json_report(spark.range(1).select(F.lit(float("nan")).alias("x")), f"file://{tmp_path}/other.json")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["report.json"]
    tables.write_json_report(spark.range(0), f"file://{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == []
