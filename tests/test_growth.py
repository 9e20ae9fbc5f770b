"""What a query holds, shuffles and draws follows its input; the passes over texts give what the joins of rows give."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlake.functions import outputs as O
from spanlake.functions import text as T
from spanlake.operators import metrics, prompts, routing, tokens, training
from spanlake.plans import queries as Q
from spanlake.sources import records

SF = "/root/testdata/sf0.001"
R = random.Random(3)
DDL = "doc_id long, start int, end int, label string, text string, source string, score double"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, " ".join(R.choice(["ab", "é😀", "Carla", "x.", "a-b", "MRN", "12"]) for _ in range(R.randint(0, 90)))) for i in range(14)] + [(20, None), (21, ""), (22, "  ")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def some_spans(spark, source, labels=("DATE", "PHONE", "AGE")):
    rows = [(d, s, s + R.choice([0, 1, 2, 6, 40, 500]), R.choice(labels), "", source, None) for d in (*range(12), 20, 30) for s in (R.randrange(-2, 320) for _ in range(R.randint(0, 9)))]
    rows += [(3, 4, 9, labels[0], "", source, None)] * 3
    return spark.createDataFrame(rows, DDL)


def counted(df):
    return Counter(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("scheme", ["bioes", "bio"])
def test_encode_texts(spark, texts, scheme):
    gold = some_spans(spark, "gold")
    want = counted(tokens.encode(T.tokenised(texts), gold, scheme))
    got = tokens.encode_texts(texts, gold, scheme)
    assert counted(got.select("doc_id", "ix", "tag")) == want and len({t for _, _, t in want}) > 6
    assert counted(tokens.encode_texts(texts, gold, scheme, outside=False)) == counted(got.where("tag <> 'O'"))
    probs = got.withColumn("prob", (F.col("ix") % 7) / 7.0)
    norm = lambda df: Counter((*r[:4], round(r[4], 9)) for r in df.collect())
    assert norm(tokens.decode(probs.where("tag <> 'O'"), sparse=True)) == norm(tokens.decode(probs))
    with pytest.raises(ValueError):
        tokens.encode_texts(texts, gold, "x")


def test_tokens_under_spans(spark, texts):
    gold, pred = some_spans(spark, "gold"), some_spans(spark, "tc")
    t = T.tokenised(texts)
    assert counted(metrics.token_prf_of_texts(texts, gold, pred)) == counted(metrics.token_prf(t, gold, pred))
    want = counted(t.join(gold.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e")), "doc_id").where("start < e AND s < end").select("doc_id", "ix", "start", "end").distinct())
    assert counted(tokens.under_spans(texts, gold)) == want and want


@pytest.mark.parametrize("longest,stride", [(9, 3), (130, 32), (4, 0)])
def test_examples_of_texts(spark, texts, longest, stride):
    gold = some_spans(spark, "gold", ("DATE", "DOCTOR", "PHONE", "AGE"))
    size = T.tokenised(texts).withColumn("id", F.length("found"))
    want = counted(training.examples(size, gold, "opf8", longest, stride, before=(7, 8), after=(9,)).select("doc_id", "window", *[F.col(c).cast("string") for c in ("input_ids", "attention_mask", "labels")]))
    got = training.examples_of_texts(texts, gold, lambda found: [len(x) for x in found.to_pylist()], "opf8", longest, stride, before=(7, 8), after=(9,))
    assert counted(got.select("doc_id", "window", *[F.col(c).cast("string") for c in ("input_ids", "attention_mask", "labels")])) == want and want


@pytest.mark.parametrize("name", ["training_examples", "bioes_encode", "decode_tags", "token_prf", "span_label_probability"])
def test_tokens_are_not_shuffled(spark, name):
    """an exchange above the pass that makes tokens has at most those under spans."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = T.tokenised(docs.select("doc_id", "text"), found=False).count()
    df = Q.QUERIES[name](spark, SF)
    df.collect()
    rows, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            rows.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert rows and max(rows) < n / 3


@pytest.mark.parametrize("name", ["by_bucket", "gate_decisions", "fuse_confidence_gated", "fuse_label_routed"])
def test_spans_are_drawn_once(spark, name):
    """counts for training read the same draw."""
    docs = Q.QUERIES[name](spark, SF)
    assert final_plan(docs).count("MapInArrow") == 1


def test_merge_nested_windows(spark):
    rows = []
    for d in range(5):
        for w, first in enumerate(sorted(R.sample(range(60), 6))):
            rows.append((d, w, first + 10**6 * (d == 4 and w > 2), [R.choice("abc") for _ in range(R.randint(0, 20))]))
    flat = [(d, w, k, len(tags), first + k, t, k / 8) for d, w, first, tags in rows for k, t in enumerate(tags)]
    want = counted(tokens.merge_windows(spark.createDataFrame(flat, "doc_id long, window int, k int, size int, ix int, tag string, prob double")))
    nested = [(d, [(first, tags, [k / 8 for k in range(len(tags))]) for x, _, first, tags in rows if x == d]) for d in range(5)] + [(8, []), (9, None)]
    docs = spark.createDataFrame(nested, "doc_id long, windows array<struct<first: int, tags: array<string>, probs: array<double>>>")
    got = tokens.merge_nested_windows(docs)
    assert counted(got) == want
    assert "Exchange" not in plan(got) and "Sort" not in plan(got)  # F16


def test_to_opf_looks_at_each_span_once(spark):
    """6000 spans of one document; the square of their number took minutes."""
    text = "".join(f"{i:05d} " for i in range(6000))
    spans = [(6 * i, 6 * i + 5, "DATE" if i % 2 else "PHONE") for i in range(6000)] + [(0, 5, "PHONE"), (3, 4, "PROFESSION"), (0, 2, None)]
    docs = spark.createDataFrame([(1, text, spans), (2, None, spans[:2]), (3, "", None)], "doc_id long, text string, spans array<struct<start: int, end: int, label: string>>")
    got = {r.doc_id: r.spans for r in records.to_opf(docs).collect()}
    assert len(got[1]) == 6000 and got[1]["private_phone: 00000"] == [[0, 5], [0, 5]] and got[2] == got[3] == {}
    assert "MapInArrow" in plan(records.to_opf(docs))


def test_rows_of_one_text_leave_in_pieces(spark):
    """what is made of a batch, or of one text, isn't held at once."""
    seen = []

    class Frame:
        schema = spark.createDataFrame([], "doc_id long, text string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a" * 100_000, None, "b"]})
            seen.extend(b.num_rows for b in run(iter([rows])))

    O.per_row(Frame(), ["text"], "at int, what string", lambda t: ((i, c) for i, c in enumerate(t or "")))
    assert sum(seen) == 100_001 and max(seen) <= O.BATCH


def test_cuts():
    """rows of a batch are taken a few at a time, by their texts' sizes."""
    sizes = [0, T.STEP // 2, T.STEP // 2, 1, None, 3 * T.STEP, 5, 0]
    got = list(T.cuts(pa.array([None if n is None else "x" * n for n in sizes])))
    assert got[0][0] == 0 and got[-1][1] == len(sizes) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert all(j - i == 1 or sum(n or 0 for n in sizes[i:j]) <= T.STEP for i, j in got) and len(got) == 4
    assert list(T.cuts(pa.array([], pa.string()))) == []


def test_grounded_once(spark):
    """a name under many labels has one row a place from the start."""
    docs = spark.createDataFrame([(1, "ab ab abc"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, 3, "ab", "DATE"), (1, 1, "ab", "AGE"), (1, 2, "abc", "CITY"), (1, 5, "zz", "ZIP"), (2, 1, "q", "ZIP")], "doc_id long, item int, text string, label string")
    plain, once = O.ground(docs, items), O.ground(docs, items, once=True)
    assert counted(O.deduped(once)) == counted(O.deduped(plain))
    assert counted(once.where("start IS NOT NULL")) == counted(O.deduped(plain)) and counted(once.where("start IS NULL")) == counted(plain.where("start IS NULL"))


@pytest.mark.parametrize("ids", ["long", "string"])
def test_weights_of_resamples(spark, ids):
    """F8: the same draws as an explode of resamples and MD5 in the engine, without its rows."""
    rows = [(str(i * 997 % 40_000) if ids == "string" else i * 997 % 40_000, i % 3, i % 2) for i in range(60)] + [(None, 1, 1)]
    counts = spark.createDataFrame(rows, f"doc_id {ids}, a long, b long")
    h = T.hashed(F.concat_ws(":", F.lit("5"), "r", "doc_id"))
    draws = counts.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("w", sum((h >= e).cast("long") for e in metrics.POISSON_EDGES)).where("w > 0")
    want = counted(draws.groupBy(F.col("r").cast("long")).agg(F.sum(F.col("a") * F.col("w")), F.sum(F.col("b") * F.col("w"))))
    made = metrics.weighted_sums(counts, ["a", "b"], 20, 5)
    assert counted(made.groupBy("r").agg(F.sum("a"), F.sum("b"))) == want
    assert "Generate" not in plan(made)


def test_uncovered_counts(spark, texts):
    """one search a word instead of a join with all spans of its document."""
    spans = some_spans(spark, "tc").where("doc_id < 20")
    docs = texts.unionByName(spark.createDataFrame([(23, "Call Ada at 212-555-0188. Bob, fax 12345 Eve\nSue or ZIP")], "doc_id long, text string"))
    for name, found in (("uncovered_cues", routing.uncovered(routing.cues(docs), spans)), ("capitalized_oov", routing.capitalised(docs, spans))):
        want = {r[0]: r[1] for r in found.groupBy("doc_id").count().collect()}
        got = {r[0]: r[1] for r in routing.uncovered_counts(docs, spans).select("doc_id", name).collect()}
        assert {k: v for k, v in got.items() if v} == want and len(got) == docs.count() and want
    assert "SortMergeJoin" not in plan(routing.uncovered_counts(docs, spans)) or "start" not in plan(routing.uncovered_counts(docs, spans)).split("SortMergeJoin")[1].split("\n")[0]


def test_hash_of(spark):
    """the system's part is written once."""
    users = spark.createDataFrame([('say "x"\n\t\\ \x01é',), ("",), (None,)], "u string")
    system = prompts.verifier_text('a "guide"\\\n\x02é')
    got = users.select(prompts.hash_of(system, F.col("u")), prompts.prompt_hash(prompts.messages(system, F.col("u")))).collect()
    assert all(a == b for a, b in got)
