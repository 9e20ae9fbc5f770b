"""Matching, fusion and redaction against plain loops over drawn spans."""

import random
from collections import Counter

import pytest

from spanlake.operators import metrics, spans, splits

R = random.Random(11)
DDL = "doc_id long, start int, end int, label string, text string, source string, score double"
TEXT = "aé😀b cd " * 8


def drawn(source, n, docs=range(12)):
    out = []
    for d in docs:
        for _ in range(R.randint(0, n)):
            s = R.randrange(50)
            out.append((d, s, s + R.randint(1, 8), R.choice(["DATE", "PHONE", "AGE"]), "", source, R.choice([None, 0.2, 0.5, 0.95])))
    return out


@pytest.fixture(scope="module")
def drawn_spans():
    return drawn("gold", 5), drawn("tc", 6), drawn("llm", 6)


def per_doc(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def meets(a, b):
    return a[1] < b[2] and b[1] < a[2]


@pytest.mark.parametrize("mode", ["relaxed", "typeless"])
def test_greedy_matches(spark, drawn_spans, mode):
    gold, pred, _ = drawn_spans
    want = Counter()
    for d in range(12):
        g, p = (sorted(per_doc(x).get(d, []), key=lambda r: r[1:4]) for x in (gold, pred))
        free = list(range(len(p)))
        for x in g:
            can = [j for j in free if meets(x, p[j]) and (mode == "typeless" or x[3] == p[j][3])]
            best = max(can, key=lambda j: (p[j][1:3] == x[1:3], min(p[j][2], x[2]) - max(p[j][1], x[1]), -j), default=None)
            want[d, x[3], None if best is None else p[best][3]] += 1
            if best is not None:
                free.remove(best)
        for j in free:
            want[d, None, p[j][3]] += 1
    got = metrics.match(spark.createDataFrame(gold, DDL), spark.createDataFrame(pred, DDL), mode)
    assert Counter(map(tuple, got.collect())) == want


def merged(rows):
    out = []
    for label in sorted({r[3] for r in rows}):
        for r in sorted((r for r in rows if r[3] == label), key=lambda r: r[1:3]):
            if out and out[-1][3] == label and r[1] < out[-1][2]:
                a = out.pop()
                scores = [x for x in (a[6], r[6]) if x is not None]
                r = (r[0], a[1], max(a[2], r[2]), label, "", "+".join(sorted({*a[5].split("+"), *r[5].split("+")})), max(scores, default=None))
            out.append(r)
    return out


def test_union(spark, drawn_spans):
    _, tc, llm = drawn_spans
    want = Counter()
    for rows in per_doc(tc + llm).values():
        kept = []
        for s in sorted(merged(rows), key=lambda r: (0 if "tc" in r[5] else 1, -(r[6] or 0), r[1] - r[2], r[1], r[2], r[3])):
            if not any(meets(s, k) and k[3] != s[3] for k in kept):
                kept.append(s)
        want.update((s[0], s[1], s[2], s[3], s[5], s[6]) for s in kept)
    got = spans.union(spark.createDataFrame(tc + llm, DDL)).select("doc_id", "start", "end", "label", "source", "score")
    assert Counter(map(tuple, got.collect())) == want


def test_redact(spark, drawn_spans):
    tc = drawn_spans[1]
    docs = spark.createDataFrame([(d, TEXT) for d in range(13)] + [(20, None), (21, "")], "doc_id long, text string")
    want = {12: TEXT, 20: None, 21: ""}
    for d in range(12):
        out, at = "", 0
        for s in sorted(per_doc(tc).get(d, []), key=lambda r: (r[1], -r[2], r[3])):
            if s[1] >= at:
                out += TEXT[at : s[1]] + f"[{s[3]}]"
            at = max(at, s[2])
        want[d] = out + TEXT[at:]
    assert dict(map(tuple, spans.redact(docs, spark.createDataFrame(tc, DDL)).collect())) == want


def test_split(spark):
    rows = [(i, R.choice(["a", "b", "c", None])) for i in range(400)] + [(1, "a"), (1, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, kind string")
    got = splits.stratified(docs, "kind").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for kind, n in Counter(k or "" for _, k in rows).items():
        share = Counter(r.split for r in got if r.stratum == kind)
        assert abs(share["train"] - 0.7 * n) <= 1 and abs(share["dev"] - 0.1 * n) <= 1
    assert splits.stratified(docs.where("false"), "kind").count() == 0
    with pytest.raises(ValueError):
        metrics.paired_bootstrap(docs, docs, "recal")


def resolved(rows):
    kept = []
    for s in sorted(merged(rows), key=lambda r: (0 if "tc" in r[5].split("+") else 1, -(r[6] or 0), r[1] - r[2], r[1], r[2], r[3])):
        if not any(meets(s, k) and k[3] != s[3] for k in kept):
            kept.append(s)
    return Counter((s[0], s[1], s[2], s[3], s[5], s[6]) for s in kept)


COUNTS = {"DATE": 50, "PHONE": 10, "AGE": 9}


def test_label_routed(spark, drawn_spans):
    _, tc, llm = drawn_spans
    counts = spark.createDataFrame(list(COUNTS.items()), "label string, n long")
    for unsupported, both in (((), ()), (("DATE",), ("AGE",))):
        known = lambda x: x not in unsupported and COUNTS[x] >= 10  # noqa: B023, E731
        want = Counter()
        for rows in per_doc([r for r in tc + llm if r[3] in both or known(r[3]) == (r[5] == "tc")]).values():
            want += resolved(rows)
        got = spans.label_routed(spark.createDataFrame(tc + llm, DDL), counts, 10, unsupported, both)
        assert Counter(map(tuple, got.select("doc_id", "start", "end", "label", "source", "score").collect())) == want


@pytest.mark.parametrize("asked", [False, True])
def test_gate(spark, drawn_spans, asked):
    _, tc, llm = drawn_spans
    counts = spark.createDataFrame(list(COUNTS.items()), "label string, n long")
    yes = lambda s: (s[1] + s[2]) % 2 == 0
    sure = lambda s: 0.5 if s[1] % 3 == 0 else 0.05
    keys = sorted({r[:4] for d in range(12) for rows in (tc, llm) for r in merged(per_doc(rows).get(d, []))})
    verdicts = spark.createDataFrame([(*k, yes(k)) for k in keys], "doc_id long, start int, end int, label string, is_phi boolean") if asked else None
    forced = spark.createDataFrame([(*k, sure(k)) for k in keys], "doc_id long, start int, end int, label string, p double") if asked else None
    rules, want = Counter(), Counter()
    for d in range(12):
        a, b = (merged(per_doc(x).get(d, [])) for x in (tc, llm))
        taken, kept = set(), []
        for s in a:
            partners = sorted((x for x in b if meets(s, x)), key=lambda x: x[1:4])
            taken.update(partners)
            if partners:
                kept.append((*s[:3], s[3] if s[6] is None or s[6] >= 0.3 else partners[0][3], "", "llm+tc", s[6]))
                rules["agree", True] += 1
                continue
            rule, ok = ("tc-only:high", True) if s[6] is not None and s[6] >= 0.9 else ("tc-only:low:verified", yes(s)) if asked else ("tc-only:low:no-verifier", False)
            rules[rule, ok] += 1
            kept += [s] * ok
        for s in b:
            if s in taken:
                continue
            if s[3] == "PHONE" or COUNTS[s[3]] < 10:
                rule, ok = "llm-only:rare-or-unsupported", True
            elif asked and sure(s) >= 0.3:
                rule, ok = "llm-only:tc-forced", True
            else:
                rule, ok = ("llm-only:frequent:verified", yes(s)) if asked else ("llm-only:frequent:no-verifier", False)
            rules[rule, ok] += 1
            kept += [s] * ok
        want += resolved(kept)
    options = {"unsupported": ("PHONE",), "verdicts": verdicts, "forced": forced}
    every = spark.createDataFrame(tc + llm, DDL)
    assert Counter((r.rule, r.accepted) for r in spans.gate(every, counts, **options).collect()) == rules
    got = spans.confidence_gated(every, counts, **options)
    assert Counter(map(tuple, got.select("doc_id", "start", "end", "label", "source", "score").collect())) == want


def test_bootstrap_of_evaluated_documents(spark):
    ddl = "doc_id long, label string, tp long, fp long, fn long"
    a, b = spark.createDataFrame([(0, "DATE", 1, 0, 1)], ddl), spark.createDataFrame([(1, "DATE", 2, 0, 0)], ddl)
    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    r = metrics.paired_bootstrap(a, b, "leak_rate", 50, docs=docs).first()
    assert (r.n_docs, r.value_a, r.value_b) == (10, 0.1, 0.0)
    assert metrics.paired_bootstrap(a, b, "leak_rate", 50).first().value_a == 0.5
    with pytest.raises(Exception, match="wasn't evaluated: 1"):
        metrics.paired_bootstrap(a, b, "recall", 50, docs=docs.where("doc_id = 0")).collect()


def test_overlapping(spark):
    from spanlake.operators import ranges

    a = [(d, i, s, s + R.choice([0, 1, 3, 700])) for d in (0, 1) for i, s in enumerate(R.sample(range(1500), 40))]
    b = [(d, i, s, s + R.choice([0, 2, 250, 256, 600])) for d in (1, 2) for i, s in enumerate(R.sample(range(1500), 40))]
    want = Counter((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    one, two = spark.createDataFrame(a, "doc_id int, i int, start int, end int"), spark.createDataFrame(b, "doc_id int, j int, s int, e int")
    assert Counter(map(tuple, ranges.overlapping(one, two).select("doc_id", "i", "j").collect())) == want and len(want) > 50


def test_residual_and_cues(spark):
    from spanlake.functions import text as T
    from spanlake.operators import routing

    texts = ["MRN" + ": " * 12 + "1234567, 34-year-old, 1/2/2020 212-555-0188 a.b@c.org 123-45-6789 Jan 3, 2021", "", None, "2020-01-02 " * 40 + "http://x.y fax 10.0.0.1 AB-12345 90210"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import re

    kept, seen = [], Counter()
    for d, t in enumerate(texts):
        mine = []
        for label, pattern in T.RESIDUAL:
            rx = re.compile(pattern)
            for m in rx.finditer(t or ""):
                s, e = m.span(1 if rx.groups else 0)
                if not any(a < e and s < z for _, a, z, *_ in mine):
                    mine.append((d, s, e, label, t[s:e]))
        kept += mine
        seen.update((d, name, *m.span()) for name, p in T.CUES.items() for m in re.finditer(p, t or ""))
    got = spans.residual(docs)
    assert Counter(map(tuple, got.select("doc_id", "start", "end", "label", "text").collect())) == Counter(kept) and ("MEDICALRECORD" in {k[3] for k in kept})
    assert Counter(map(tuple, routing.cues(docs).collect())) == seen
    covering = spark.createDataFrame([(0, 0, 60, "ID", "", "tc", 1.0)], DDL)
    f = {r.doc_id: r for r in routing.scored(routing.features(docs, covering)).collect()}
    for d, t in enumerate(texts):
        n = sum(1 for x, _, s, e in seen.elements() if x == d and not (d == 0 and s < 60 and 0 < e))
        assert (f[d].n_chars, f[d].uncovered_cues, f[d].tc_span_count) == (len(t or ""), n, int(d == 0))
        assert f[d].risk == round(n + 0.5 * f[d].header_lines + 0.2 * f[d].capitalized_oov + 0.0002 * len(t or ""), 6)
    assert spans.residual(docs.where("false")).count() == 0
