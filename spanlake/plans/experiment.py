"""Experiments: detectors and fusions over a benchmark's split, scored, compared and summed up in files.

Predictions and the counts of matching are written as tables and read again, so each is computed once and a lost executor
costs one stage; only sums by system, mode, level and label come to the driver."""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import outputs as O
from ..operators import metrics as M
from ..operators import completions, simulate, spans, tokens
from ..sources import files
from ..sources.benchmark import read_split
from ..sources.records import DOC

SPANS = "doc_id string, start int, end int, label string, text string, source string, score double"
# The columns of the two tables.
SYSTEM_COLUMNS = ("run_id", "system", "mode", "level", "view", "n_docs", "support", "tp", "fp", "fn", "precision", "recall", "f1", "macro_f1", "doc_leak_rate", "reference", "delta_recall", "delta_recall_ci_low", "delta_recall_ci_high", "delta_recall_p")
PAIR_COLUMNS = ("run_id", "mode", "n_gold", "oracle_union_recall", "intersection_recall", "a", "b", "recall_a", "recall_b", "fn_a", "fn_b", "fn_both", "fn_either", "jaccard", "p_b_missed_given_a_missed", "p_a_missed_given_b_missed", "mcnemar_p", "kappa")
CELL = ("system", "mode", "level", "view")


def flat(docs: DataFrame) -> DataFrame:
    """Span rows of documents with nested spans."""
    return docs.select("doc_id", F.explode("spans").alias("s")).select("doc_id", *[f"s.{c}" for c in spans.COLUMNS[1:]])


def with_text(found: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    d = found.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id")
    return d.select("doc_id", "start", "end", "label", F.expr("substring(__text, start + 1, end - start)").alias("text"), F.lit(name).alias("source"), "score")


def detected(spark: SparkSession, name: str, spec: dict, docs: DataFrame, gold: DataFrame) -> DataFrame:
    """Spans of one detector: simulated; predictions (documents with spans as JSON lines); tokens (a table of token predictions,
    see tokens.decode); outputs (doc_id, output: what a language model wrote, in the format json, inline or segments).

    Models run outside; what they gave is the input here. Of predictions with a repeated doc_id the last one in the file counts."""
    kind = spec.get("type", name)
    if kind == "simulated":
        known = {k: v for k, v in spec.items() if k in ("miss_rate", "fp_rate", "boundary_noise", "score", "seed")}
        return simulate.detect(docs, gold, name, **known)
    ids = docs.select("doc_id")
    if kind == "predictions":
        rows = spark.read.schema(DOC).json(spec["path"]).withColumn("__row", F.monotonically_increasing_id())
        last = rows.groupBy("doc_id").agg(F.max_by("spans", "__row").alias("spans"))
        return flat(last).join(ids, "doc_id", "left_semi").withColumn("source", F.lit(name))
    if kind == "tokens":
        got = tokens.decode(spark.read.parquet(spec["path"]), spec.get("reduce", "mean"))
        table = spec.get("label_map")
        if table:
            got = got.withColumn("label", L.map_label(F.col("label"), L.TABLES[table])).where("label is not null")
        return with_text(got, docs, name)
    if kind == "outputs":
        raw = spark.read.schema("doc_id string, output string").json(spec["path"])
        form = spec.get("format", "json")
        if form == "json":
            items = raw.select("doc_id", F.posexplode(O.span_items(F.col("output"))).alias("item", "x")).select("doc_id", "item", "x.text", "x.label", "x.before")
            got = O.deduped(O.ground(docs, items, spec.get("occurrences", "all") == "all", spec.get("fuzzy_threshold", O.LEAST_FUZZY)))
        elif form in ("inline", "editor", "segments"):  # an editor corrects another detector's tags
            got = O.tagged(docs, raw) if form != "segments" else O.tagged_segments(docs, raw, spec.get("max_chars", 1500))
        else:
            raise ValueError(f"unknown format {form}")
        got = got.where("start is not null")
        return with_text(got if form == "editor" else got.where(F.col("label").isin(*spec.get("labels", L.SUBTYPES))), docs, name)
    raise ValueError(f"detector {name}: {kind} is none of simulated, predictions, tokens, outputs")


def fused(spec: dict, all_spans: DataFrame, counts: DataFrame, gold: DataFrame, detectors: dict) -> tuple[DataFrame, DataFrame | None]:
    """(spans, decisions of the gate or none). Systems play the parts of "tc" and "llm" as the specification says."""
    kind, tc, llm = spec["name"], spec.get("tc", "tc"), spec.get("llm", "llm")
    parts = all_spans.withColumn("source", F.when(F.col("source") == tc, "tc").when(F.col("source") == llm, "llm"))
    if kind == "union":
        return spans.union(all_spans, tuple(spec.get("priority", (tc, llm))), spec.get("min_score")), None
    if kind == "label_routed":
        return spans.label_routed(parts, counts, int(spec.get("tau", 10)), both=tuple(spec.get("both", ()))), None
    if kind != "confidence_gated":
        raise ValueError(f"unknown fusion {kind}")
    parts = parts.where("source is not null")
    ask = simulate.right(spans.merge(parts), gold)
    hook = lambda x: detectors.get(x, {}).get("type", x) == "simulated"
    answers = detectors.get(llm, {}).get("verdicts")  # JSON lines of what a verifier wrote about each span
    if answers:
        raw = all_spans.sparkSession.read.schema("doc_id string, start int, end int, label string, output string").json(answers)
        ask = completions.verdicts(raw)
    verdicts = ask if spec.get("verify", True) and (answers or hook(llm)) else None
    forced = simulate.forced(simulate.right(spans.merge(parts), gold), float(detectors[tc].get("score", 0.9))) if hook(tc) else None
    decisions = spans.gate(parts, counts, float(spec.get("theta_hi", 0.9)), float(spec.get("theta_lo", 0.3)), int(spec.get("tau", 10)), verdicts=verdicts, forced=forced)
    return spans.resolve(spans.merge(decisions.where("accepted").select(*spans.COLUMNS))), decisions


def share(a, b) -> float:
    return round(a / b, 6) if b else 0.0


def scores(tp: int, fp: int, fn: int) -> dict:
    return {"tp": tp, "fp": fp, "fn": fn, "support": tp + fn, "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)}


def entries(counts: DataFrame, n_docs: int) -> dict:
    """{cell: report} from the table of counts: per label, micro, macro over labels with gold spans, leaks."""
    out: dict[tuple, dict] = {}
    sums = [F.sum(x).alias(x) for x in ("tp", "fp", "fn")]
    for r in counts.groupBy(*CELL, "label").agg(*sums).orderBy(*CELL, "label").collect():
        out.setdefault(tuple(r[c] for c in CELL), {}).setdefault("per_label", {})[r.label] = scores(r.tp, r.fp, r.fn)
    leaks = counts.groupBy(*CELL, "doc_id").agg(F.sum("fn").alias("fn")).groupBy(*CELL).agg(F.sum((F.col("fn") > 0).cast("long")).alias("n"))
    leaked = {tuple(r[c] for c in CELL): r.n for r in leaks.collect()}
    for cell, e in out.items():
        rows = list(e["per_label"].values())
        known = [x for x in rows if x["support"]]
        e["micro"] = scores(*(sum(x[k] for x in rows) for k in ("tp", "fp", "fn")))
        e["macro"] = {k: round(sum(x[k] for x in known) / len(known), 6) if known else 0.0 for k in ("precision", "recall", "f1")}
        e |= {"macro_f1": e["macro"]["f1"], "n_docs": n_docs, "doc_leak_rate": share(leaked.get(cell, 0), n_docs)}
    return out


EMPTY = {"per_label": {}, "micro": scores(0, 0, 0), "macro": {"precision": 0.0, "recall": 0.0, "f1": 0.0}, "macro_f1": 0.0, "doc_leak_rate": 0.0}


def bucketed(per_label: dict, train: dict) -> dict:
    out: dict[str, list[int]] = {}
    for label, x in per_label.items():
        n = train.get(label, 0)
        b = next(b for b, most in zip(L.BUCKETS, (0, 10, 50, 200, float("inf")), strict=True) if n <= most)
        out[b] = [a + x[k] for a, k in zip(out.get(b, [0, 0, 0]), ("tp", "fp", "fn"), strict=True)]
    return {b: scores(*out[b]) for b in L.BUCKETS if b in out}


def compared(gold: DataFrame, systems: dict[str, DataFrame], mode: str) -> dict:
    """What the detectors miss together and alone: one pass for all, one per pair of them."""
    names = list(systems)
    missed = M.misses(gold.select("doc_id", *M.KEY), systems, mode)
    one = M.shared_misses(missed, names).first()
    out = {"n_gold": one.n_gold, "oracle_union_recall": share(one.n_gold - one.n_all, one.n_gold), "intersection_recall": share(one.n_gold - one.n_any, one.n_gold), "pairs": []}
    for a, b in itertools.combinations(names, 2):
        r = M.complementarity(missed, a, b).first()
        out["pairs"].append({
            "a": a, "b": b, "recall_a": share(r.n - r.fn_a, r.n), "recall_b": share(r.n - r.fn_b, r.n), "fn_a": r.fn_a or 0, "fn_b": r.fn_b or 0, "fn_both": r.both or 0, "fn_either": r.either or 0, "jaccard": r.jaccard,
            "p_b_missed_given_a_missed": share(r.both or 0, r.fn_a), "p_a_missed_given_b_missed": share(r.both or 0, r.fn_b), "mcnemar_p": M.mcnemar_p(r.mcnemar or 0.0), "kappa": r.kappa,
        })
    return out


def table(per_label: dict) -> str:
    head = ["| label | support | P | R | F1 |", "|---|---:|---:|---:|---:|"]
    return "\n".join([*head, *(f"| {k} | {v['support']} | {v['precision']:.3f} | {v['recall']:.3f} | {v['f1']:.3f} |" for k, v in per_label.items())])


def run(spark: SparkSession, config: dict, out_dir: str | None = None, limit: int | None = None) -> str:
    """Runs an experiment, returns its folder: config.json, predictions/, counts/, metrics.json, complementarity.json, cost.json, summary.md.

    config: benchmark {path, split, train_split, limit}, detectors {name: specification}, fusion [specification], eval {modes,
    levels, hipaa_view, reference, bootstrap {n, seed}}, calls (a log of model calls), output, name. A limit takes the first
    documents by id. A missing training split means no counts."""
    bench, ev = config["benchmark"], config.get("eval") or {}
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:6]
    name, run_id = config.get("name", "run"), f"{time.strftime('%Y%m%d-%H%M%S')}-{digest}"
    out = f"{out_dir or config.get('output', 'results')}/{name}/{run_id}"
    docs = read_split(spark, bench["path"], bench.get("split", "test"))
    limit = limit if limit is not None else bench.get("limit")
    if limit:
        docs = docs.orderBy("doc_id").limit(int(limit))
    docs.write.parquet(f"{out}/docs")
    docs = spark.read.parquet(f"{out}/docs")
    gold, n_docs = flat(docs), docs.count()
    try:
        train = {r.label: r["count"] for r in flat(read_split(spark, bench["path"], bench.get("train_split", "train"))).groupBy("label").count().orderBy("label").collect()}
    except FileNotFoundError:
        train = {}
    counts = spark.createDataFrame(list(train.items()), "label string, n long")
    files.write_json(spark, f"{out}/config.json", config)

    def kept(found: DataFrame, system: str) -> DataFrame:
        found.select(*spans.COLUMNS).write.json(f"{out}/predictions/{system}")
        return spark.read.schema(SPANS).json(f"{out}/predictions/{system}")

    detectors = config.get("detectors") or {}
    base = {k: kept(detected(spark, k, spec or {}, docs, gold), k) for k, spec in detectors.items()}
    systems, fusion = dict(base), {}
    for spec in config.get("fusion") or []:
        label = spec.get("as") or spec["name"]
        every = None
        for x in base.values():
            every = x if every is None else every.unionByName(x)
        found, decisions = fused(spec, every, counts, gold, detectors)
        systems[label] = kept(found, label)
        if decisions is not None:
            decisions.write.json(f"{out}/decisions/{label}")
            rules: dict[str, dict] = {}
            for r in spark.read.schema("rule string, accepted boolean").json(f"{out}/decisions/{label}").groupBy("rule", "accepted").count().orderBy("rule").collect():
                rules.setdefault(r.rule, {"accepted": 0, "dropped": 0})["accepted" if r.accepted else "dropped"] += r["count"]
            fusion[label] = {"verifier_calls": sum(sum(v.values()) for k, v in rules.items() if k.endswith(":verified")), "rules": rules}

    modes, levels, reference = ev.get("modes", ["strict", "relaxed"]), ev.get("levels", ["subtype"]), ev.get("reference")
    cells = [(s, m, v, view) for s in systems for m in modes for v in levels for view in ("full", "hipaa") if view == "full" or (v == "subtype" and ev.get("hipaa_view", True))]
    for i, (s, m, v, view) in enumerate(cells):
        g, p = (M.prepare(x, v, view == "hipaa") for x in (gold, systems[s]))
        c = M.doc_counts(M.match(g, p, m)).select(*[F.lit(x).alias(k) for k, x in zip(CELL, (s, m, v, view), strict=True)], "doc_id", "label", "tp", "fp", "fn")
        c.write.mode("append").parquet(f"{out}/counts")
    every = spark.read.parquet(f"{out}/counts") if cells else None
    got = entries(every, n_docs) if cells else {}
    side = lambda s, m: every.where((F.col("system") == s) & (F.col("mode") == m) & (F.col("level") == "subtype") & (F.col("view") == "full"))
    result = {"n_docs": n_docs, "train_counts": train, "fusion": fusion, "reference": reference, "systems": {}}
    lines = [f"# {name} {run_id}", "", f"{n_docs} documents.", ""]
    for label, st in fusion.items():
        lines += [f"{label}: {st['verifier_calls']} verifier calls; accepted of candidates by rule: " + "; ".join(f"{r} {c['accepted']}/{c['accepted'] + c['dropped']}" for r, c in st["rules"].items()), ""]
    for s, m, v, view in cells:
        if view != "full":
            continue
        entry = dict(got.get((s, m, v, view), EMPTY | {"n_docs": n_docs}))
        if v == "subtype":
            if train:
                entry["by_bucket"] = bucketed(entry["per_label"], train)
            if ev.get("hipaa_view", True):
                entry["hipaa"] = got.get((s, m, v, "hipaa"), EMPTY | {"n_docs": n_docs})
            if reference in systems and reference != s:
                bs = ev.get("bootstrap") or {}
                entry["vs_reference"] = {x: M.paired_bootstrap(side(s, m), side(reference, m), x, int(bs.get("n", 1000)), int(bs.get("seed", 0))).first().asDict() for x in ("recall", "precision", "f1")}
            lines += [f"## {s} ({m})", "", f"micro P {entry['micro']['precision']:.3f} R {entry['micro']['recall']:.3f} F1 {entry['micro']['f1']:.3f}; macro F1 {entry['macro_f1']:.3f}; leaking documents {entry['doc_leak_rate']:.3f}", "", table(entry["per_label"]), ""]
        result["systems"].setdefault(s, {})[f"{m}/{v}"] = entry
    files.write_json(spark, f"{out}/metrics.json", result)
    if len(base) > 1:
        comp = {m: {"overall": compared(gold, base, m)} for m in modes}
        files.write_json(spark, f"{out}/complementarity.json", comp)
        for m, c in comp.items():
            o = c["overall"]
            lines += [f"## together ({m})", "", f"union recall {o['oracle_union_recall']:.3f}; intersection recall {o['intersection_recall']:.3f}; " + "; ".join(f"{p['a']}/{p['b']} Jaccard {p['jaccard']:.3f}, McNemar p {p['mcnemar_p']:.3g}" for p in o["pairs"]), ""]
    log = "cached boolean, input_tokens long, output_tokens long, cost_usd double, latency_s double"
    cost = O.call_costs(spark.read.schema(log).json(config["calls"])).first().asDict() if config.get("calls") else {}
    files.write_json(spark, f"{out}/cost.json", cost)
    files.write_file(spark, f"{out}/summary.md", "\n".join(lines))
    return out


def _csv(rows: list[dict], columns) -> str:
    out = io.StringIO()
    w = csv.DictWriter(out, columns, extrasaction="ignore", restval="", lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()


def summarize(spark: SparkSession, path: str) -> tuple[list[dict], list[dict]]:
    """Writes systems.csv and pairs.csv from a run's files, nothing computed anew; returns their rows."""
    metrics, run_id = json.loads(files.read_file(spark, f"{path}/metrics.json")), path.rstrip("/").rsplit("/", 1)[-1]
    rows, pairs = [], []
    for system, entries_of in metrics["systems"].items():
        for key, entry in entries_of.items():
            mode, level = key.split("/")
            for view, e in (("full", entry), ("hipaa", entry.get("hipaa"))):
                if not e:
                    continue
                row = {"run_id": run_id, "system": system, "mode": mode, "level": level, "view": view, "n_docs": e["n_docs"], "macro_f1": e["macro_f1"], "doc_leak_rate": e["doc_leak_rate"], **e["micro"]}
                r = e.get("vs_reference", {}).get("recall")
                if r:
                    row |= {"reference": metrics["reference"], "delta_recall": r["delta"], "delta_recall_ci_low": r["lo"], "delta_recall_ci_high": r["hi"], "delta_recall_p": r["p"]}
                rows.append(row)
    files.write_file(spark, f"{path}/systems.csv", _csv(rows, SYSTEM_COLUMNS))
    if files.exists(spark, f"{path}/complementarity.json"):
        for mode, c in json.loads(files.read_file(spark, f"{path}/complementarity.json")).items():
            o = c["overall"]
            pairs += [{"run_id": run_id, "mode": mode, **{k: o[k] for k in ("n_gold", "oracle_union_recall", "intersection_recall")}, **p} for p in o["pairs"]]
        files.write_file(spark, f"{path}/pairs.csv", _csv(pairs, PAIR_COLUMNS))
    return rows, pairs
