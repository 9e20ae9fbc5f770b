"""From building a benchmark to the tables of a run, by the command lines; the stream."""

import csv
import json

import pytest

from spanlake.__main__ import main
from spanlake.functions import labels as L
from spanlake.operators import metrics
from spanlake.plans import experiment
from spanlake.sources import benchmark
from spanlake.streaming import notes

WEIGHTS = {"DATE": 40, "PATIENT": 30, "EMAIL": 10, "AGE": 20}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("bench")
    (at / "profile.json").write_text(json.dumps({"weights": WEIGHTS, "target_density": 2.0}))
    made = main(["build", "--out", f"{at}/b", "--profile", f"{at}/profile.json", "--demo", "20"], spark)
    assert sum(s["n_docs"] for s in made.values()) == 60 and made["train"]["n_docs"] == 42
    return at


def test_export(spark, built):
    counts = main(["export-opf", "--benchmark", f"{built}/b", "--out", f"{built}/opf"], spark)
    spans = {s: experiment.flat(benchmark.read_split(spark, f"{built}/b", s)) for s in counts}
    for s, c in counts.items():
        kept = [r for r in spans[s].collect() if L.OPF_OF.get(r.label)]
        assert (c["kept"], c["dropped"]) == (len(kept), spans[s].count() - len(kept))


def test_run(spark, built):
    outs = "\n".join(json.dumps({"doc_id": r.doc_id, "output": json.dumps({"spans": [{"text": s.text, "label": s.label} for s in r.spans]})}) for r in benchmark.read_split(spark, f"{built}/b", "test").collect())
    (built / "outs.jsonl").write_text(outs)
    config = {
        "name": "t", "benchmark": {"path": f"{built}/b"}, "detectors": {"tc": {"type": "simulated", "miss_rate": 0.3, "fp_rate": 0.3, "boundary_noise": 0.2, "score": 0.95}, "llm": {"type": "simulated", "miss_rate": 0.2}, "read": {"type": "outputs", "path": f"{built}/outs.jsonl"}},
        "fusion": [{"name": "union"}, {"name": "label_routed"}, {"name": "confidence_gated", "as": "gate"}], "eval": {"levels": ["subtype", "category"], "reference": "tc", "bootstrap": {"n": 50}},
    }
    (built / "config.json").write_text(json.dumps(config))
    out = main(["run", "--config", f"{built}/config.json", "--out", f"{built}/runs"], spark)
    got = json.loads(open(f"{out}/metrics.json").read())
    docs = benchmark.read_split(spark, f"{built}/b", "test")
    gold = experiment.flat(docs)
    assert got["n_docs"] == docs.count() == 12 and got["systems"]["read"]["relaxed/subtype"]["micro"]["recall"] == 1.0
    for system in ("tc", "union", "gate"):
        pred = spark.read.schema(experiment.SPANS).json(f"{out}/predictions/{system}")
        for mode in ("strict", "relaxed"):
            want = metrics.report(metrics.doc_counts(metrics.match(gold, pred, mode)), docs).first()
            entry = got["systems"][system][f"{mode}/subtype"]
            assert [entry["micro"][k] for k in ("tp", "fp", "fn", "f1")] == [want.tp, want.fp, want.fn, want.f1]
            assert (entry["macro_f1"], entry["doc_leak_rate"]) == (pytest.approx(want.macro_f1, abs=1e-5), want.leak_rate)
            buckets = entry["by_bucket"].values()
            assert sum(b["tp"] for b in buckets) == want.tp and sum(b["fp"] for b in buckets) == want.fp
    rules = got["fusion"]["gate"]["rules"]
    assert sum(sum(x.values()) for x in rules.values()) == spark.read.json(f"{out}/decisions/gate").count() and "agree" in rules
    main(["summarize", "--run", out], spark)
    rows = list(csv.DictReader(open(f"{out}/systems.csv")))
    assert len(rows) == 6 * 2 * 3 and sum(r["delta_recall"] != "" for r in rows) == 5 * 2
    pairs = list(csv.DictReader(open(f"{out}/pairs.csv")))
    assert [(p["a"], p["b"]) for p in pairs] == [("tc", "llm"), ("tc", "read"), ("llm", "read")] * 2
    for p in pairs:
        if p["mode"] == "strict":
            assert int(p["fn_a"]) == got["systems"][p["a"]]["strict/subtype"]["micro"]["fn"]
            assert int(p["fn_either"]) == int(p["fn_a"]) + int(p["fn_b"]) - int(p["fn_both"])


def test_limit_and_errors(spark, built):
    config = {"benchmark": {"path": f"{built}/b", "train_split": "nosuch"}, "detectors": {"tc": {"type": "simulated"}}, "eval": {"modes": ["strict"]}}
    out = experiment.run(spark, config, f"{built}/few", 3)
    got = json.loads(open(f"{out}/metrics.json").read())
    assert got["n_docs"] == 3 and got["train_counts"] == {}
    with pytest.raises(FileNotFoundError):
        benchmark.read_split(spark, f"{built}/b", "nosuch")
    with pytest.raises(ValueError):
        experiment.run(spark, config | {"detectors": {"tc": {"type": "torch"}}}, f"{built}/bad")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda i, t: json.dumps({"doc_id": str(i), "text": t}) + "\n"
    s = lambda: notes.detect(notes.unrepeated(notes.documents(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    (tmp_path / "in/a.json").write_text(line(1, "seen 3/4/2019, a@b.example") + "\n" + line(2, None) + line(3, ""))
    s()
    (tmp_path / "in/b.json").write_text(line(4, "seen 3/4/2019, a@b.example") + line(5, "on 1/2/2020"))
    s()
    s()
    assert {r.label: r.n for r in notes.label_counts(spark, f"{tmp_path}/out").collect()} == {"DATE": 2, "EMAIL": 1}
