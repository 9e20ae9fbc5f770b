"""Finding in texts against plain Python: Unicode spaces, groups, gaps, long texts, nulls."""

import re
from collections import Counter

from spanlake.functions import text as T
from spanlake.operators import metrics, spans

ROWS = [(1, "a\u00a0b\u3000c d_e, é1!?\u0301 😀x\x1cy"), (2, None), (3, ""), (4, " \t\u2003 "), (5, "MRN:::::::::::::: 123456 x MRN# 98765"), (5, "again, again"), (6, "ab " * 300_000), (None, "x-y")]


def plain(pattern, group=0):
    return Counter((d, n, m.start(group), m.end(group), m[group]) for d, t in ROWS if t for n, m in enumerate(re.finditer(pattern, t)))


def test_tokens_and_matches(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = lambda df: Counter((r.doc_id, r.ix, r.start, r.end, r.found) for r in df.collect())
    want = plain(r"\w+|[^\w\s]")
    assert got(T.tokenised(d)) == want == got(T.find_all(d, T.TOKEN))
    assert got(T.find_all(d, r"\bMRN[:# ]*\s*([0-9]{5,})\b")) == plain(r"\bMRN[:# ]*\s*([0-9]{5,})\b", 1)
    assert T.tokenised(d.where("false")).count() == 0 == T.find_all(d.where("false"), T.TOKEN).count()
    one = d.where("doc_id = 1 OR doc_id = 5")
    a, b = (Counter(map(tuple, f.collect())) for f in (T.tokenised(one, ahead=3), T.find_all(one, T.TOKEN, ahead=3)))
    assert a == b
    gaps = T.find_all(one.where("doc_id = 1"), T.TOKEN, gap=True).orderBy("ix").collect()
    assert gaps[0].gap is None and gaps[1].gap == "\u00a0" and gaps[2].gap == "\u3000"


def test_records_beyond_twelve_colons(spark):
    d = spark.createDataFrame([(5, ROWS[4][1])], "doc_id long, text string")
    got = sorted((r.start, r.text, r.label) for r in spans.residual(d).collect())
    assert got == [(ROWS[4][1].index(x), x, "MEDICALRECORD") for x in ("123456", "98765")]


def test_report_is_of_the_evaluated_documents(spark):
    span = "doc_id long, start int, end int, label string, text string, source string, score double"
    gold = spark.createDataFrame([(1, 0, 2, "AGE", "", "gold", None)], span)
    pred = spark.createDataFrame([(1, 0, 2, "AGE", "", "tc", None), (9, 0, 2, "AGE", "", "tc", None)], span)
    counts = metrics.doc_counts(metrics.match(gold, pred))
    r = metrics.report(counts, spark.createDataFrame([(1,), (2,)], "doc_id long")).first()
    assert (r.tp, r.fp, r.fn, r.n_docs) == (1, 0, 0, 2)


def test_bootstrap_of_leaks(spark):
    ddl = "doc_id long, label string, tp long, fp long, fn long"
    a = spark.createDataFrame([(i, "AGE", 1, 0, int(i < 10)) for i in range(40)], ddl)
    b = spark.createDataFrame([(i, "AGE", 1, 0, int(i < 30)) for i in range(40)], ddl)
    r = metrics.paired_bootstrap(a, b, "leak_rate", 200).first()
    assert (r.value_a, r.value_b, r.delta) == (0.25, 0.75, -0.5) and r.lo < -0.5 < r.hi < 0 and r.p < 0.05
