"""Prompts, the cache of completions, verdicts and training windows against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from spanlake.functions import outputs as O
from spanlake.operators import completions as C
from spanlake.operators import prompts as P
from spanlake.operators import training as T

TEXTS = ["Pt John Smith, \"seen\" 3/4/2019.\n\nDr. Lee \\ agreed.", "", None, "tab\there é 😀 \x0b\x1f\x7f\b\f\r", "u001F \\u001f / </PHI>", "a " * 2000]
SPAN_DDL = "doc_id long, start int, end int, label string, text string, source string, score double"


def hashed(system, user):
    m = [{"role": "system", "content": system}, {"role": "user", "content": user}]
    return hashlib.sha256(json.dumps(m, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.mark.parametrize("form", P.FORMATS)
def test_extraction(docs, form):
    got = {r.doc_id: (r.messages, r.h) for r in P.extraction(docs, form, ["AGE"], "G").withColumn("h", P.prompt_hash(F.col("messages"))).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        t = t or ""
        if form == "segments":
            t = "\n".join(f"[{k}] {t[s:e]}".replace("\n", " ") for k, (s, e) in enumerate(O.cut_segments(t), 1))
        system = P.system_text(form, ["AGE"], "G")
        assert system.startswith("G\n") and "AGE" in system and [m.content for m in got[i][0]] == [system, t] and got[i][1] == hashed(system, t)
    with pytest.raises(ValueError):
        P.system_text("xml")


def test_editor_and_verifier(spark, docs, tmp_path):
    spans = spark.createDataFrame([(0, 3, 13, "PATIENT", "", "tc", 1.0), (0, 5, 8, "DATE", "", "tc", 1.0)], SPAN_DDL)
    got = {r.doc_id: r.messages for r in P.editor(docs, spans, focus=["AGE", "PROFESSION"]).collect()}
    assert got[0][1].content.startswith('Pt <PHI type="PATIENT">John Smith</PHI>, ') and got[2][1].content == "" and len(got) == len(TEXTS)
    assert "pre-tagged" in got[0][0].content and "AGE, PROFESSION" in got[0][0].content
    v = {r.start: r.messages[1].content for r in P.verifier(docs, spans, context=4).collect()}
    assert v[3] == 'Text around it: ...Pt [[John Smith]], "s...\nCandidate: "John Smith", label PATIENT'
    assert v[5].startswith("Text around it: ...t Jo[[hn ]]Smit...")
    (tmp_path / "g").write_text("mine é", encoding="utf-8")
    assert P.load_guideline(str(tmp_path / "g")) == "mine é" and P.load_guideline("x", "t") == "t" and "ZIP" in P.load_guideline()


CONFIG = {"model_list": [{"model_name": "big", "litellm_params": {"model": "a/b", "api_key": "k1"}}]}


def test_resolve(docs):
    assert C.resolve(CONFIG, "big")["model"] == "a/b" and C.resolve({}, "x/y") == {"model": "x/y"}
    with pytest.raises(KeyError):
        C.resolve(CONFIG, "nope")
    p = P.extraction(docs.where("doc_id = 0"), "json_strings")
    key = lambda **k: C.requests(p, k.pop("config", CONFIG), "big", **k).first().key
    other = {"model_list": [{"model_name": "big", "litellm_params": {"model": "a/b", "api_key": "k2"}}]}
    assert key() == key(config=other) == key(temperature=None) != key(temperature=0)


def test_cache(spark, tmp_path):
    texts = ["a", "b", "a", "a", "c", None, "b", ""]
    p = P.extraction(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "json_strings")
    asked = C.requests(p, CONFIG, "big")
    cache = asked.where("doc_id = 1").select("key", F.lit("old").alias("output"), F.lit(7).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    wanted = C.pending(asked, cache)
    assert wanted.count() == 3
    said = lambda keys: keys.select("key", F.lit("new").alias("output"), F.lit(5).cast("long").alias("input_tokens"), F.lit(2).cast("long").alias("output_tokens"), F.lit(0.5).alias("cost_usd"), F.lit(1.5).alias("latency_s"))
    answers = said(asked.where("doc_id in (0, 1, 5)").select("key"))
    done = C.completed(asked, cache, answers, "doc_id")
    got = {r.doc_id: (r.output, r.cached, r.cost_usd) for r in done.collect()}
    want = {0: ("new", False, 0.5), 1: ("old", True, 0.0), 2: ("new", True, 0.0), 3: ("new", True, 0.0), 4: (None, None, None), 5: ("new", False, 0.5), 6: ("old", True, 0.0), 7: ("new", True, 0.0)}
    assert got == want
    C.call_log(done).write.json(str(tmp_path / "log"))
    cost = O.call_costs(spark.read.json(str(tmp_path / "log"))).first()
    assert (cost.calls, cost.cached_calls, cost.input_tokens, cost.cost_usd, cost.latency_s) == (7, 5, 5 * 5 + 2 * 7, 1.0, 3.0)
    full = C.grown(cache, answers.unionByName(answers))
    assert full.count() == 3 and C.completed(asked, full, said(asked.where("false").select("key")), "doc_id").where("cached").count() == 7
    assert C.pending(asked.where("false"), cache).count() == 0


def test_is_phi(spark):
    said = ["true", "false", "null", "0", "0.0", "1", '"false"', '""', "[]", "{}", "[0]", "-0.0", "1e3", "0e5"]
    raw = [f'Sure: ```json\n{{"label": null, "is_phi": {x}}}\n```' for x in said] + ["no idea", '{"label": "X"}', "{broken", None, ""]
    d = spark.createDataFrame(list(enumerate(raw)), "i int, output string")
    got = {r.i: r.v for r in d.select("i", C.is_phi(F.col("output")).alias("v")).collect()}
    assert [got[i] for i in range(len(raw))] == [bool(json.loads(x)) for x in said] + [False] * 5
    rows = [(0, 1, 2, "AGE", '{"is_phi": true}'), (0, 1, 2, "AGE", None), (1, 1, 2, "AGE", "?")]
    assert sorted(map(tuple, C.verdicts(spark.createDataFrame(rows, "doc_id long, start int, end int, label string, output string")).collect())) == [(0, 1, 2, "AGE", True), (1, 1, 2, "AGE", False)]


def test_label_spaces(spark):
    assert [len(T.label_space(x)[0]) for x in ("i2b2_28", "i2b2_categories", "opf8", "binary")] == [28, 7, 8, 1]
    assert T.tag_list(["A", "B"], "bio") == ["O", "B-A", "I-A", "B-B", "I-B"] and T.tag_list(["A"])[:3] == ["O", "B-A", "I-A"]
    for bad in (lambda: T.label_space("x"), lambda: T.tag_list([], "x")):
        with pytest.raises(ValueError):
            bad()
    s = spark.createDataFrame([(0, 0, 1, x, "", "g", None) for x in ("PATIENT", "AGE", "odd")], SPAN_DDL)
    labels = lambda name: [r.label for r in T.map_gold(s, T.label_space(name)[1]).collect()]
    assert labels("opf8") == ["private_person", "odd"] and labels("i2b2_28") == ["PATIENT", "AGE", "odd"] and labels("binary") == ["PHI", "PHI", "odd"]
    t = spark.createDataFrame([(0, 0, "O"), (0, 2, "S-DATE"), (3, 5, "O"), (9, 9, "O")], "start int, end int, tag string")
    assert [r.tag_id for r in T.tag_ids(t, ["O", "S-DATE"]).collect()] == [-100, 1, 0, -100]
    with pytest.raises(Exception, match="unknown tag S-DATE"):
        T.tag_ids(t, ["O"]).collect()


@pytest.mark.parametrize("longest, stride, before, after", [(7, 2, (1,), (2,)), (4, 3, (), ()), (50, 10, (), (9, 9))])
def test_examples(spark, longest, stride, before, after):
    rng = random.Random(longest)
    sizes = {0: 1, 1: 5, 2: 6, 3: 37, 4: 48}
    toks = [(d, i, 3 * i, 3 * i + (0 if i == 4 else 2), 100 * d + i) for d, n in sizes.items() for i in range(n)]
    gold = [(d, a, a + rng.randint(1, 20), rng.choice(["DATE", "AGE"]), "", "g", None) for d in sizes for a in rng.sample(range(100), 4)]
    made = T.examples(spark.createDataFrame(toks, "doc_id long, ix int, start int, end int, id int"), spark.createDataFrame(gold, SPAN_DDL), "i2b2_28", longest, stride, before=before, after=after)
    got = {(r.doc_id, r.window): (r.input_ids, r.attention_mask, r.labels) for r in made.collect()}
    tags, want, body = T.tag_list(T.label_space("i2b2_28")[0]), {}, longest - len(before) - len(after)
    for d, n in sizes.items():
        mine, owner = [t for t in toks if t[0] == d], {}
        for k, g in enumerate(sorted((g for g in gold if g[0] == d), key=lambda g: (g[1], g[2], g[3]))):
            for t in mine:
                if t[2] < t[3] and t[2] < g[2] and g[1] < t[3]:
                    owner.setdefault(t[1], (k, g[3]))
        ids = []
        for t in mine:
            o = owner.get(t[1])
            same = [i for i in owner if owner[i] == o]
            p = None if o is None else "S" if len(same) == 1 else "B" if t[1] == same[0] else "E" if t[1] == same[-1] else "I"
            ids.append(-100 if t[2] == t[3] else tags.index("O" if o is None else f"{p}-{o[1]}"))
        a, w = 0, 0
        while True:
            z = min(n, a + body)
            inner = [100 * d + i for i in range(a, z)]
            want[d, w] = ([*before, *inner, *after], [1] * (z - a + len(before) + len(after)), [-100] * len(before) + ids[a:z] + [-100] * len(after))
            if z == n:
                break
            a, w = z - stride, w + 1
    assert got == want
