"""Grounding of model outputs against plain brute force."""

import random

import pytest

from spanlake.functions import outputs as O

R = random.Random(5)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def closest_plainly(needle, text, least):
    m, n = len(needle), len(text)
    spots = [(s, s + m) for s in range(n - m + 1)] + [x for k in range(1, m) for x in ((0, k), (n - k, n))]
    scored = [(200.0 * lcs(needle, text[s:e]) / (m + e - s), -s, -e) for s, e in spots]
    best = max(scored)
    return (best[0], -best[1], -best[2]) if best[0] >= least else None


@pytest.mark.parametrize("m", [1, 3, 9, 63, 64, 65, 130])
def test_closest(m):
    for _ in range(6):
        text = "".join(R.choice("abcdé😀 ") for _ in range(m + R.randint(0, 40)))
        at = R.randrange(len(text) - m + 1)
        needle = "".join(R.choice("xyb") if R.random() < 0.07 else c for c in text[at : at + m])
        for least in (50.0, 90.0):
            assert O.closest(needle, text, least) == closest_plainly(needle, text, least)
    assert O.closest("", "a") is None and O.closest("a", "") is None and O.closest("abcd", "abc", 80.0)[1:] == (0, 3)


TEXT = "Ann Lee saw Dr. Ann  Lee in Gothenburg.\n\nAnn called aaaa."


def test_ground(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    rows = [(1, 0, "Ann", "PATIENT", None), (1, 1, "Ann", "PATIENT", "DR. "), (1, 2, "Dr. Ann Lee", "DOCTOR", None), (1, 3, "Gothenborg", "CITY", None), (1, 4, "nowhere", "CITY", None), (1, 5, "aa", "X", "not this"), (1, 6, "Ann", "DOCTOR", None), (2, 0, "Ann", "PATIENT", None), (3, 0, " ", "X", ""), (9, 0, "a", "X", None)]
    items = spark.createDataFrame(rows, "doc_id long, item int, text string, label string, before string")
    got = O.ground(docs, items)
    assert sorted(((r.doc_id, r.item, r.start, r.end, r.method) for r in got.collect()), key=repr) == sorted([
        (1, 0, 0, 3, "exact"), (1, 0, 16, 19, "exact"), (1, 0, 41, 44, "exact"), (1, 1, 16, 19, "anchored"), (1, 2, 12, 24, "whitespace"), (1, 3, 28, 38, "fuzzy"), (1, 4, None, None, "failed"),
        (1, 5, 52, 54, "exact"), (1, 5, 53, 55, "exact"), (1, 5, 54, 56, "exact"), (1, 6, 0, 3, "exact"), (1, 6, 16, 19, "exact"), (1, 6, 41, 44, "exact"), (2, 0, None, None, "failed"), (3, 0, None, None, "failed"),
    ], key=repr)
    kept = [(r.start, r.end, r.label) for r in O.deduped(got).orderBy("start", "end").collect()]
    assert kept[0] == (0, 3, "PATIENT") and len(kept) == len(set(kept)) == 8
    stats = {r.method: (r.n_items, r.n_spans) for r in O.ground_stats(got).collect()}
    assert stats == {"exact": (3, 9), "anchored": (1, 1), "whitespace": (1, 1), "fuzzy": (1, 1), "failed": (3, 0)}
    assert O.ground(docs, items.drop("before"), every=False).where("doc_id = 1 and method = 'exact'").count() == 4
    assert O.ground(docs.where("false"), items).count() == 0


def test_tagged(spark):
    docs = spark.createDataFrame([(i, TEXT) for i in range(4)] + [(5, None)], "doc_id long, text string")
    good = TEXT.replace("Ann", '<PHI type="PATIENT">Ann</PHI>', 1)
    outs = spark.createDataFrame([(0, good), (1, good.replace("\n\n", "\n").replace("  ", " ")), (2, good[:-2]), (3, None), (5, "")], "doc_id long, output string")
    got = sorted(((r.doc_id, r.start, r.end, r.label, r.method) for r in O.tagged(docs, outs).collect()), key=repr)
    assert got == [(0, 0, 3, "PATIENT", "exact"), (1, 0, 3, "PATIENT", "whitespace"), (2, None, None, None, "rejected"), (3, None, None, None, "rejected")]


@pytest.mark.parametrize("longest", [7, 20, 1500])
def test_segments(spark, longest):
    texts = ["", None, TEXT, "x" * 40, "a b\nc d " * 9, "\n\n\n", "one\n \ntwo\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    segs = O.segments(docs, longest)
    by_doc = {}
    for r in segs.orderBy("doc_id", "segment").collect():
        assert r.end - r.start <= longest and texts[r.doc_id][r.start : r.end] == r.text
        by_doc.setdefault(r.doc_id, []).append(r)
    assert {d: "".join(r.text for r in rs) for d, rs in by_doc.items()} == {i: t for i, t in enumerate(texts) if t}
    lines = {r.doc_id: r.text for r in O.render_segments(segs).collect()}
    assert all(lines[d] == "\n".join(f"[{r.segment}] " + r.text.replace("\n", " ") for r in rs) for d, rs in by_doc.items())
    echo = spark.createDataFrame([(d, t.replace("Ann", '<PHI type="PATIENT">Ann</PHI>')) for d, t in lines.items()], "doc_id long, output string")
    back = O.tagged_segments(docs, echo, longest).where("start is not null").collect()
    assert sorted((r.doc_id, r.start, r.end) for r in back) == [(2, p, p + 3) for p in O.occurrences(TEXT, "Ann")]


def test_parse_segments():
    assert O.parse_segments("```\n[1] a\nmore\n\n[2] b\n[1]  c\n```") == {1: " c", 2: "b"}
    assert O.untag('x<PHI type="A"></PHI>y<PHI type="B">z\n</PHI>') == ("xyz\n", [(2, 4, "B")])


def test_costs(spark):
    ddl = "cached boolean, input_tokens long, output_tokens long, cost_usd double, latency_s double"
    log = spark.createDataFrame([(True, 1, 2, 0.5, None), (False, 3, 4, 0.25, 1.0)], ddl)
    assert tuple(O.call_costs(log).first()) == (2, 1, 4, 6, 0.75, 1.0)
    assert tuple(O.call_costs(log.where("false")).first()) == (0, 0, 0, 0, 0.0, 0.0)
