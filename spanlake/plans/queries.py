"""Queries over the test tables, and the same in SQL.

The tables hold no annotated spans, so gold spans and two detectors' outputs are drawn from `documents` by MD5: every 50th
token or so begins a gold span of one to five tokens (some overlap), the detectors miss, widen, relabel and invent some. A
drawn span's text is its first token."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import outputs as O
from ..functions import text as T
from ..functions.digests import md5_heads
from ..operators import completions, injection, prompts, routing, simulate, spans, splits, tokens, training
from ..operators import metrics as M
from ..sources import records


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return T.spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def labelled(tokens_: DataFrame) -> DataFrame:
    """Tokens with a drawn label and the key of their draws."""
    k, names = F.concat_ws(":", "doc_id", "ix"), F.array(*map(F.lit, L.SUBTYPES))
    return tokens_.withColumn("label", names[(F.floor(T.hashed(F.concat(F.lit("g"), k)) / 50) % 28).cast("int")]).withColumn("k", k)


SPAN = "doc_id bigint, start int, end int, label string, text string, source string, score double"


def drawn(tokens_: pa.RecordBatch) -> pa.RecordBatch:
    """The gold, tc and llm spans that begin at some tokens (of tokenised() with `ahead` 4)."""
    t = {c: tokens_.column(c) for c in tokens_.schema.names}
    ix = t["ix"].to_numpy()
    heads = np.flatnonzero(ix == 0)  # documents are whole, their tokens in order
    ids = t["doc_id"].take(pa.array(heads)).to_pylist()
    whose = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(ix))))

    def h(prefix: str, rows=slice(None)) -> np.ndarray:
        return md5_heads([f"{prefix}{i}:".encode() for i in ids], whose[rows], ix[rows])

    names = np.array(L.SUBTYPES, object)
    g = h("g")
    gold = np.flatnonzero(g % 50 == 0)
    other = np.ones(len(ix), bool)
    other[gold] = False
    stop = t["end"].to_numpy().copy()
    stop[gold] = np.stack([t[c].to_numpy()[gold] for c in ("end", "end1", "end2", "end3", "end4")])[g[gold] // 1400 % 5, np.arange(len(gold))]
    label = g // 50 % 28
    at, end, kind, source, score = [gold], [stop[gold]], [label[gold]], ["gold"], [np.full(len(gold), np.nan)]
    for p, name, miss, wide in (("t", "tc", 15, 2), ("l", "llm", 25, 3)):
        hit, stray = gold[h(p + "m", gold) % 100 >= miss], np.flatnonzero(other & (h(p + "f") % 400 == 0))
        some = np.sort(np.append(hit, stray))
        at.append(some)
        end.append(stop[some] + np.where(h(p + "w", some) % 10 == 0, wide, 0))
        kind.append(np.where(~other[some] & (h(p + "r", some) % 10 > 0), label[some], h(p + "n", some) % 28))
        source.append(name)
        score.append(h(p + "s", some) % 100 / 100.0 if p == "t" else np.full(len(some), np.nan))
    rows, score = pa.array(np.concatenate(at)), np.concatenate(score)
    cols = [t["doc_id"].take(rows), t["start"].take(rows), pa.array(np.concatenate(end).astype(np.int32)), pa.array(names[np.concatenate(kind)], pa.string()), t["found"].take(rows)]
    cols += [pa.array(np.repeat(source, [len(x) for x in at]).tolist(), pa.string()), pa.array(score, mask=np.isnan(score))]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "end", "label", "text", "source", "score"])


def all_spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold, tc and llm spans. They are drawn once and meet by document, so all that a query takes of them reads one exchange.
    Ids aren't null on either side of the draw, so that joins, which ask for that, leave the plan below the exchange as it is."""
    s = T.tokenised(documents(spark, sf).where("doc_id IS NOT NULL"), ahead=4, then=(drawn, SPAN)).where("doc_id IS NOT NULL")
    met = s.groupBy("doc_id").agg(F.collect_list(F.struct(*s.columns[1:])).alias("x")).select("doc_id", F.explode("x").alias("x"))
    each = met.select("doc_id", *[f"x.{c}" for c in s.columns[1:]])
    return tuple(each.where(F.col("source") == x) for x in ("gold", "tc", "llm"))


def train_counts(gold: DataFrame) -> DataFrame:
    """Counted, not filtered: a filter on documents would go below the draw's exchange, and gold spans would be drawn a second time."""
    return gold.groupBy("label").agg(F.sum((F.col("doc_id") % 10 == 0).cast("long")).alias("n")).where("n > 0")


_NAMES = "[" + ", ".join(f"'{x}'" for x in L.SUBTYPES) + "]"
_CATS = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.CATEGORY_OF.items()) + " END"
_H = lambda x: f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


def _drawn(p: str) -> str:
    miss, wide, name = (15, 2, "tc") if p == "t" else (25, 3, "llm")
    h = lambda q: _H(f"'{p}{q}' || k")
    score = f"({h('s')} % 100) / 100.0" if p == "t" else "NULL"
    return f"""SELECT doc_id, s, CASE WHEN h % 50 = 0 THEN stop ELSE e END + CASE WHEN {h('w')} % 10 = 0 THEN {wide} ELSE 0 END AS e, CASE WHEN h % 50 = 0 AND {h('r')} % 10 > 0 THEN label ELSE {_NAMES}[{h('n')} % 28 + 1] END AS label,
    tok AS text, '{name}' AS source, CAST({score} AS DOUBLE) AS score FROM token WHERE CASE WHEN h % 50 = 0 THEN {h('m')} % 100 >= {miss} ELSE {h('f')} % 400 = 0 END"""


# T.TOKEN in words that don't depend on an engine's idea of a space
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
TOKEN_SQL = r"""WITH cut AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, 'PATTERN') AS hit, regexp_split_to_array(text, 'PATTERN') AS gap FROM documents WHERE text IS NOT NULL),
flat AS (SELECT r, doc_id, unnest(hit) AS tok, unnest(gap[1:len(hit)]) AS g, unnest(range(0, len(hit))) AS ix FROM cut WHERE len(hit) > 0),
place AS (SELECT r, doc_id, ix, tok, CAST(sum(length(g) + length(tok)) OVER (PARTITION BY r ORDER BY ix) AS INT) AS e FROM flat),
drawn AS (SELECT *, e - length(tok) AS s, doc_id || ':' || ix AS k, HASH AS h, lead(e, 1) OVER w AS e1, lead(e, 2) OVER w AS e2, lead(e, 3) OVER w AS e3, lead(e, 4) OVER w AS e4 FROM place WINDOW w AS (PARTITION BY r ORDER BY ix)),
token AS (SELECT doc_id, ix, tok, s, e, k, h, NAMES[(h // 50) % 28 + 1] AS label, CASE (h // 1400) % 5 WHEN 0 THEN e WHEN 1 THEN coalesce(e1, e) WHEN 2 THEN coalesce(e2, e1, e) WHEN 3 THEN coalesce(e3, e2, e1, e) ELSE coalesce(e4, e3, e2, e1, e) END AS stop FROM drawn)""".replace("NAMES", _NAMES).replace("HASH", _H("'g' || doc_id || ':' || ix")).replace("PATTERN", TOKEN_RE)
SPAN_SQL = TOKEN_SQL + f""",
gold AS (SELECT doc_id, s, stop AS e, label, tok AS text FROM token WHERE h % 50 = 0), tc AS ({_drawn('t')}), llm AS ({_drawn('l')}),
num AS (SELECT doc_id, s, e, label, row_number() OVER (PARTITION BY doc_id, s, e, label) AS n FROM gold), pnum AS (SELECT doc_id, s, e, label, row_number() OVER (PARTITION BY doc_id, s, e, label) AS n FROM tc),
pair AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, coalesce(g.label, p.label) AS label, CAST(g.s IS NOT NULL AND p.s IS NOT NULL AS BIGINT) AS tp, CAST(g.s IS NULL AS BIGINT) AS fp, CAST(p.s IS NULL AS BIGINT) AS fn
  FROM num g FULL JOIN pnum p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.label = p.label AND g.n = p.n),
sums AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM pair GROUP BY label),
train AS (SELECT label, count(*) AS n FROM gold WHERE doc_id % 10 = 0 GROUP BY label)"""
_R = lambda a, b: f"round(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0 END, 6)"
PRF_SQL = f"{_R('tp', 'tp + fp')} AS precision, {_R('tp', 'tp + fn')} AS recall, {_R('2 * tp', '2 * tp + fp + fn')} AS f1"
_BUCKET = "CASE WHEN n = 0 THEN '0' WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50' WHEN n <= 200 THEN '51-200' ELSE '>200' END"
_MISS = """, miss AS (SELECT g.label, CAST(NOT EXISTS (FROM tc p WHERE p.doc_id = g.doc_id AND p.s = g.s AND p.e = g.e AND p.label = g.label) AS BIGINT) AS a, CAST(NOT EXISTS (FROM llm p WHERE p.doc_id = g.doc_id AND p.s = g.s AND p.e = g.e AND p.label = g.label) AS BIGINT) AS b FROM gold g),
c AS (SELECT {by} count(*) AS n, CAST(sum(a) AS BIGINT) AS fn_a, CAST(sum(b) AS BIGINT) AS fn_b, CAST(sum(a * b) AS BIGINT) AS "both" FROM miss {group}),
q AS (SELECT *, fn_a + fn_b - "both" AS either, CAST((n - fn_a - fn_b + 2 * "both") AS DOUBLE) / n AS agree, (CAST(fn_a AS DOUBLE) * fn_b + CAST(n - fn_a AS DOUBLE) * (n - fn_b)) / (CAST(n AS DOUBLE) * n) AS chance FROM c)
SELECT {by} n, fn_a, fn_b, "both", either, round(CASE WHEN either > 0 THEN CAST("both" AS DOUBLE) / either ELSE 0 END, 6) AS jaccard, round(1 - CAST("both" AS DOUBLE) / n, 6) AS oracle_union_recall, round(1 - CAST(either AS DOUBLE) / n, 6) AS intersection_recall,
round(CASE WHEN fn_a + fn_b - 2 * "both" > 0 THEN pow(greatest(0, abs(fn_a - fn_b) - 1), 2) / CAST(fn_a + fn_b - 2 * "both" AS DOUBLE) ELSE 0 END, 6) AS mcnemar, round(CASE WHEN chance = 1 THEN 1 ELSE (agree - chance) / (1 - chance) END, 6) AS kappa FROM q"""

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(TOKEN_SQL + " SELECT doc_id, count(*) AS n_tokens, max(e) AS last FROM token GROUP BY doc_id")
def tokenize_counts(spark, sf):
    return T.tokenised(documents(spark, sf), found=False).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.max("end").alias("last"))


@query(SPAN_SQL + f" SELECT label, {_CATS} AS category, count(*) AS n, {_BUCKET.replace('n ', 'count(*) ')} AS bucket FROM gold GROUP BY label")
def category_rollup(spark, sf):
    g = all_spans(spark, sf)[0].groupBy("label").agg(F.count("*").alias("n"))
    return g.select("label", L.relabel(F.col("label"), "category").alias("category"), "n", L.frequency_bucket(F.col("n")).alias("bucket"))


@query(SPAN_SQL + " SELECT opf, count(*) AS n FROM (SELECT CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.OPF_OF.items() if v) + " END AS opf FROM gold) GROUP BY opf")
def opf_export_counts(spark, sf):
    return all_spans(spark, sf)[0].groupBy(L.map_label(F.col("label"), L.OPF_OF).alias("opf")).agg(F.count("*").alias("n"))


@query(SPAN_SQL + """, u AS (SELECT doc_id, s, e, label, source, score FROM tc UNION ALL SELECT doc_id, s, e, label, source, score FROM llm),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM u), i AS (SELECT *, sum(CASE WHEN b IS NULL OR s >= b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM m)
SELECT doc_id, label, min(s) AS start, max(e) AS "end", array_to_string(list_sort(list_distinct(list(source))), '+') AS source, max(score) AS score FROM i GROUP BY doc_id, label, isle""")
def merge_islands(spark, sf):
    _, tc, llm = all_spans(spark, sf)
    return spans.merge(tc.unionByName(llm)).select("doc_id", "label", "start", "end", "source", "score")


@query(SPAN_SQL + f" SELECT label, tp, fp, fn, tp + fn AS support, {PRF_SQL} FROM sums")
def match_strict(spark, sf):
    g, tc, _ = all_spans(spark, sf)
    return M.per_label(M.doc_counts(M.match(g, tc)))


@query(SPAN_SQL + f""", t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
round(avg(CAST(tp AS DOUBLE) / greatest(1, tp + fp)) FILTER (tp + fn > 0), 6) AS macro_precision, round(avg(CAST(tp AS DOUBLE) / (tp + fn)) FILTER (tp + fn > 0), 6) AS macro_recall, round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)) FILTER (tp + fn > 0), 6) AS macro_f1 FROM sums),
d AS (SELECT doc_id, sum(fn) AS fn, sum(tp + fn) AS gold FROM pair GROUP BY doc_id), k AS (SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) FILTER (fn > 0) AS n_leaked, count(*) FILTER (gold > 0) AS n_gold_docs FROM d)
SELECT *, {PRF_SQL}, {_R('n_leaked', 'n_docs')} AS leak_rate, {_R('n_leaked', 'n_gold_docs')} AS leak_rate_gold FROM t, k""")
def report_micro_macro(spark, sf):
    g, tc, _ = all_spans(spark, sf)
    return M.report(M.doc_counts(M.match(g, tc)), documents(spark, sf))


@query(SPAN_SQL + f", b AS (SELECT {_BUCKET} AS bucket, tp, fp, fn FROM (SELECT s.*, coalesce(n, 0) AS n FROM sums s LEFT JOIN train USING (label))), z AS (SELECT bucket, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM b GROUP BY bucket) SELECT bucket, tp, fp, fn, {PRF_SQL} FROM z")
def by_bucket(spark, sf):
    g, tc, _ = all_spans(spark, sf)
    return M.by_bucket(M.doc_counts(M.match(g, tc)), train_counts(g))


@query(SPAN_SQL + f""", x AS (SELECT t.doc_id, t.ix, EXISTS (FROM gold g WHERE g.doc_id = t.doc_id AND t.s < g.e AND g.s < t.e) AS g, EXISTS (FROM tc p WHERE p.doc_id = t.doc_id AND t.s < p.e AND p.s < t.e) AS p FROM token t),
z AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM x) SELECT tp, fp, fn, {PRF_SQL} FROM z""")
def token_prf(spark, sf):
    return M.token_prf_of_texts(documents(spark, sf), *all_spans(spark, sf)[:2])


@query(SPAN_SQL + _MISS.format(by="", group=""))
def complementarity_overall(spark, sf):
    g, tc, llm = all_spans(spark, sf)
    return M.complementarity(M.misses(g, {"tc": tc, "llm": llm}), "tc", "llm")


@query(SPAN_SQL + _MISS.format(by="label,", group="GROUP BY label"))
def complementarity_by_label(spark, sf):
    g, tc, llm = all_spans(spark, sf)
    return M.complementarity(M.misses(g, {"tc": tc, "llm": llm}), "tc", "llm", "label")


@query("SELECT min(doc_id) AS doc_id, substr(sha1(text), 1, 12) AS sha FROM documents WHERE text IS NOT NULL GROUP BY sha")
def dedup_documents_sha1(spark, sf):
    return records.dedup_sha1(documents(spark, sf))


@query(TOKEN_SQL + ", n AS (SELECT doc_id, count(*) AS n FROM token GROUP BY doc_id), w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 128 THEN 0 ELSE CAST(ceil((n - 128) / 96.0) AS BIGINT) END + 1)) AS i FROM n) SELECT doc_id, CAST(i * 96 AS INT) AS first, CAST(least(n, i * 96 + 128) AS INT) AS last FROM w")
def chunk_windows(spark, sf):
    n = T.tokenised(documents(spark, sf), found=False).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.select("doc_id", F.explode(tokens.windows(F.col("n"), 128, 32)).alias("w")).select("doc_id", "w.first", "w.last")


ENCODED = """, o AS (SELECT t.doc_id, t.ix, min({'s': g.s, 'e': g.e, 'label': g.label}) AS p FROM token t JOIN gold g ON t.doc_id = g.doc_id AND t.s < g.e AND g.s < t.e GROUP BY t.doc_id, t.ix),
tagged AS (SELECT doc_id, ix, CASE WHEN n = 1 THEN 'S-' WHEN i = 1 THEN 'B-' WHEN i = n THEN 'E-' ELSE 'I-' END || p.label AS tag FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, p) AS n, row_number() OVER (PARTITION BY doc_id, p ORDER BY ix) AS i FROM o))"""


@query(SPAN_SQL + ENCODED + " SELECT doc_id, ix, tag FROM tagged")
def bioes_encode(spark, sf):
    return tokens.encode_texts(documents(spark, sf), all_spans(spark, sf)[0], outside=False).where("tag <> 'O'").select("doc_id", "ix", "tag")


# the algebra of spans: merging per label, then a fold over each document's spans in order of rank, score and length
MERGE = """, {out}_m AS (SELECT *, max(e) OVER (PARTITION BY doc_id, label ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({src})),
{out}_i AS (SELECT *, sum(CASE WHEN b IS NULL OR s >= b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, label ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isle FROM {out}_m),
{out} AS (SELECT doc_id, label, min(s) AS s, max(e) AS e, CASE WHEN count(*) = 1 THEN any_value(text) ELSE '' END AS text, array_to_string(list_sort(list_distinct(flatten(list(string_split(source, '+'))))), '+') AS source, max(score) AS score FROM {out}_i GROUP BY doc_id, label, isle)"""
RESOLVE = """, {out}_l AS (SELECT doc_id, list({{'s': s, 'e': e, 'label': label, 'text': text, 'source': source, 'score': score}} ORDER BY CASE WHEN list_contains(string_split(source, '+'), 'tc') THEN 0 WHEN list_contains(string_split(source, '+'), 'llm') THEN 1 ELSE 2 END, -coalesce(score, 0), s - e, s, e, label, text, source, score NULLS FIRST) AS xs FROM {src} GROUP BY doc_id),
{out}_k AS (SELECT doc_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.label <> x[1].label AND k.s < x[1].e AND x[1].s < k.e)) = 0 THEN list_concat(a, x) ELSE a END)) AS x FROM {out}_l),
{out} AS (SELECT doc_id, x.s AS s, x.e AS e, x.label AS label, x.text AS text, x.source AS source, x.score AS score FROM {out}_k)"""
SPAN_COLUMNS = 'doc_id, s AS start, e AS "end", label, text, source, score'
BOTH = "SELECT doc_id, s, e, label, text, source, score FROM tc UNION ALL SELECT doc_id, s, e, label, text, source, score FROM llm"
_RARE = "(u.label IN (" + ", ".join(f"'{x}'" for x in L.UNSUPPORTED) + ") OR coalesce(n, 0) < 10)"
ROUTED = f"SELECT doc_id, s, e, u.label, text, source, score FROM ({BOTH}) u LEFT JOIN train ON train.label = u.label WHERE CASE WHEN source = 'tc' THEN NOT {_RARE} ELSE {_RARE} END"
UNION_SQL = SPAN_SQL + MERGE.format(out="mu", src=BOTH) + RESOLVE.format(out="un", src="mu")
GATE_SQL = SPAN_SQL + MERGE.format(out="gt", src="FROM tc") + MERGE.format(out="gl", src="FROM llm") + f""",
pairs AS (SELECT t.*, (SELECT min({{'s': l.s, 'e': l.e, 'label': l.label}}) FROM gl l WHERE l.doc_id = t.doc_id AND t.s < l.e AND l.s < t.e) AS one FROM gt t),
decided AS (SELECT doc_id, s, e, CASE WHEN score IS NULL OR score >= 0.3 THEN label ELSE one.label END AS label, text, 'llm+tc' AS source, score, 'agree' AS rule FROM pairs WHERE one IS NOT NULL
UNION ALL SELECT doc_id, s, e, label, text, source, score, CASE WHEN score >= 0.9 THEN 'tc-only:high' ELSE 'tc-only:low:no-verifier' END FROM pairs WHERE one IS NULL
UNION ALL SELECT doc_id, s, e, u.label, text, source, score, CASE WHEN {_RARE} THEN 'llm-only:rare-or-unsupported' ELSE 'llm-only:frequent:no-verifier' END FROM gl u LEFT JOIN train ON train.label = u.label WHERE NOT EXISTS (FROM gt t WHERE t.doc_id = u.doc_id AND t.s < u.e AND u.s < t.e))"""
ACCEPTED = "SELECT doc_id, s, e, label, text, source, score FROM decided WHERE NOT ends_with(rule, 'no-verifier')"


@query(UNION_SQL + f" SELECT {SPAN_COLUMNS} FROM un")
def fuse_union(spark, sf):
    _, tc, llm = all_spans(spark, sf)
    return spans.union(tc.unionByName(llm))


@query(SPAN_SQL + MERGE.format(out="mr", src=ROUTED) + RESOLVE.format(out="ro", src="mr") + f" SELECT {SPAN_COLUMNS} FROM ro")
def fuse_label_routed(spark, sf):
    g, tc, llm = all_spans(spark, sf)
    return spans.label_routed(tc.unionByName(llm), train_counts(g))


@query(GATE_SQL + " SELECT rule, NOT ends_with(rule, 'no-verifier') AS accepted, count(*) AS n FROM decided GROUP BY ALL")
def gate_decisions(spark, sf):
    g, tc, llm = all_spans(spark, sf)
    return spans.gate(tc.unionByName(llm), train_counts(g)).groupBy("rule", "accepted").agg(F.count("*").alias("n"))


@query(GATE_SQL + MERGE.format(out="mg", src=ACCEPTED) + RESOLVE.format(out="co", src="mg") + f" SELECT {SPAN_COLUMNS} FROM co")
def fuse_confidence_gated(spark, sf):
    g, tc, llm = all_spans(spark, sf)
    return spans.confidence_gated(tc.unionByName(llm), train_counts(g))


# gold spans in order take the best free prediction: one step a gold span, all documents at once
_GREEDY = """WITH RECURSIVE """ + SPAN_SQL[5:] + """, sides AS (SELECT doc_id, coalesce(gs, []) AS gs, coalesce(ps, []) AS ps FROM (SELECT doc_id, list({'s': s, 'e': e, 'label': label} ORDER BY s, e, label) AS gs FROM gold GROUP BY doc_id) FULL JOIN
  (SELECT doc_id, list({'s': s, 'e': e, 'label': label} ORDER BY s, e, label) AS ps FROM tc GROUP BY doc_id) USING (doc_id)),
steps AS (SELECT doc_id, 0 AS i, CAST([] AS BIGINT[]) AS used FROM sides UNION ALL
  SELECT t.doc_id, i + 1, list_append(used, coalesce(-list_max(list_transform(list_filter(range(1, len(ps) + 1), lambda j: NOT list_contains(used, j) AND ps[j].s < gs[i + 1].e AND gs[i + 1].s < ps[j].eEQUAL),
    lambda j: {'exact': (ps[j].s = gs[i + 1].s AND ps[j].e = gs[i + 1].e)::INT, 'shared': least(ps[j].e, gs[i + 1].e) - greatest(ps[j].s, gs[i + 1].s), 'j': -j})).j, 0)) FROM steps t JOIN sides USING (doc_id) WHERE i < len(gs)),
ends AS (SELECT gs, ps, used FROM steps t JOIN sides USING (doc_id) WHERE i = len(gs)),
found AS (SELECT gs[k].label AS label, (used[k] > 0)::BIGINT AS tp, 0::BIGINT AS fp, (used[k] = 0)::BIGINT AS fn FROM (SELECT *, unnest(range(1, len(gs) + 1)) AS k FROM ends) UNION ALL
  SELECT ps[k].label, 0, 1, 0 FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM ends) WHERE NOT list_contains(used, k)),
greedy AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM found GROUP BY label)
SELECT label, tp, fp, fn, tp + fn AS support, """ + PRF_SQL + " FROM greedy"


@query(_GREEDY.replace("EQUAL", " AND ps[j].label = gs[i + 1].label"))
def match_relaxed(spark, sf):
    g, tc, _ = all_spans(spark, sf)
    return M.per_label(M.doc_counts(M.match(g, tc, "relaxed")))


@query(_GREEDY.replace("EQUAL", ""))
def match_typeless(spark, sf):
    g, tc, _ = all_spans(spark, sf)
    return M.per_label(M.doc_counts(M.match(g, tc, "typeless")))


_NOT_HIPAA = ", ".join(f"'{x}'" for x in L.NOT_HIPAA)
_HIPAA = lambda t: f"""(SELECT doc_id, s, e, {_CATS} AS label FROM {t} WHERE CASE label WHEN 'AGE' THEN coalesce(TRY_CAST(regexp_extract(text, '[0-9]{{1,3}}') AS INT), 0) >= 90
    WHEN 'DATE' THEN NOT regexp_matches(text, '^[^\\p{{L}}\\p{{N}}_]*(1[89]|20)[0-9]{{2}}[^\\p{{L}}\\p{{N}}_]*$') ELSE label NOT IN ({_NOT_HIPAA}) END)"""  # noqa: E731
_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY doc_id, s, e, label) AS n FROM {0})"


@query(SPAN_SQL + ", hg AS " + _NUMBERED.format(_HIPAA("gold")) + ", hp AS " + _NUMBERED.format(_HIPAA("tc")) + f""",
hz AS (SELECT coalesce(g.label, p.label) AS label, count(*) FILTER (g.s IS NOT NULL AND p.s IS NOT NULL) AS tp, count(*) FILTER (g.s IS NULL) AS fp, count(*) FILTER (p.s IS NULL) AS fn
  FROM hg g FULL JOIN hp p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.label = p.label AND g.n = p.n GROUP BY 1) SELECT label, tp, fp, fn, tp + fn AS support, {PRF_SQL} FROM hz""")
def hipaa_view(spark, sf):
    g, tc, _ = all_spans(spark, sf)
    return M.per_label(M.doc_counts(M.match(M.prepare(g, "category", True), M.prepare(tc, "category", True))))


@query(UNION_SQL + """, ra AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, -e, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM un),
rb AS (SELECT *, sum(CASE WHEN b IS NULL OR s >= b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, -e, label ROWS UNBOUNDED PRECEDING) AS isle FROM ra),
rc AS (SELECT doc_id, isle, min(s) AS s, max(e) AS e, arg_min(label, (s, -e, label)) AS label FROM rb GROUP BY doc_id, isle),
rd AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY isle) AS since FROM rc),
re AS (SELECT doc_id, string_agg(substring(text, since + 1, s - since) || '[' || label || ']', '' ORDER BY isle) AS head, max(e) AS last FROM rd JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE WHEN head IS NULL THEN text ELSE head || substring(text, last + 1) END AS text FROM documents LEFT JOIN re USING (doc_id)""")
def redact_text(spark, sf):
    _, tc, llm = all_spans(spark, sf)
    return spans.redact(documents(spark, sf), spans.union(tc.unionByName(llm)))


# the same rules without looking ahead: a group says what of a match is the span
_RULES = tuple((i, label, p.replace(r"(?=[- ]?(?:year|yr)s?[- ]old\b)", r"[- ]?(?:year|yr)s?[- ]old\b").replace(r"[\w.+-]", r"[\p{L}\p{N}_.+-]").replace(r"[\w-]", r"[\p{L}\p{N}_-]"), {"AGE": "head", "MEDICALRECORD": "tail"}.get(label)) for i, (label, p) in enumerate(T.RESIDUAL))


def _rule(i: int, label: str, pattern: str, part: str | None) -> str:
    number = "regexp_extract(m, '[0-9]+$')" if part == "tail" else "regexp_extract(m, '^[0-9]+')" if part else "m"
    begin = f"till - length({number})" if part == "tail" else "till - length(m)"
    return f"""SELECT doc_id, {i} AS rule, {begin} AS s, {begin} + length({number}) AS e, '{label}' AS label, {number} AS text FROM (SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY ix) AS till FROM (
  SELECT doc_id, unnest(hit) AS m, unnest(gap[1:len(hit)]) AS g, unnest(range(0, len(hit))) AS ix FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hit, regexp_split_to_array(text, '{pattern}') AS gap FROM documents) WHERE len(hit) > 0))"""


@query("WITH rules AS (" + " UNION ALL ".join(_rule(*r) for r in _RULES) + """), ruled AS (SELECT doc_id, list({'s': s, 'e': e, 'label': label, 'text': text} ORDER BY rule, s, e) AS xs FROM rules GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.s < x[1].e AND x[1].s < k.e)) = 0 THEN list_concat(a, x) ELSE a END)) AS x FROM ruled)
SELECT doc_id, CAST(x.s AS INT) AS start, CAST(x.e AS INT) AS "end", x.label AS label, x.text AS text, 'rule' AS source, CAST(NULL AS DOUBLE) AS score FROM kept""")
def residual_spans(spark, sf):
    return spans.residual(documents(spark, sf))


@query()
def risk_score(spark, sf):
    return routing.scored(routing.features(documents(spark, sf), all_spans(spark, sf)[1]))


def _stripped() -> tuple[str, str]:
    text, n = "text", "0"
    for pattern, instead in T.PLACEHOLDERS:
        n += f" + len(regexp_extract_all({text}, '{pattern}'))"
        text = f"regexp_replace({text}, '{pattern}', '{instead}', 'g')"
    return f"regexp_replace({text}, '[ \\t]{{2,}}', ' ', 'g')", n


@query("SELECT doc_id, CAST(length({}) AS INT) AS n_chars, CAST({} AS BIGINT) AS n_removed FROM documents".format(*_stripped()))
def strip_placeholders(spark, sf):
    text, n = T.strip_placeholders(F.col("text"))
    return documents(spark, sf).select("doc_id", F.length(text).alias("n_chars"), n.alias("n_removed"))


_COUNTS = """, {0}n AS (SELECT doc_id, s, e, label, row_number() OVER (PARTITION BY doc_id, s, e, label) AS n FROM {0}),
{0}c AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, CAST(count(*) FILTER (g.s IS NOT NULL AND p.s IS NOT NULL) AS BIGINT) AS tp, CAST(count(*) FILTER (p.s IS NULL) AS BIGINT) AS fn
  FROM num g FULL JOIN {0}n p ON g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.label = p.label AND g.n = p.n GROUP BY 1)"""
_WEIGHT = " + ".join(f"(h >= {e})::BIGINT" for e in M.POISSON_EDGES)
_RESAMPLES = 200


@query(SPAN_SQL + _COUNTS.format("tc") + _COUNTS.format("llm") + f""", b AS (SELECT doc_id, coalesce(x.tp, 0) AS ta, coalesce(x.fn, 0) AS fa, coalesce(y.tp, 0) AS tb, coalesce(y.fn, 0) AS fb FROM tcc x FULL JOIN llmc y USING (doc_id)),
v AS (SELECT count(*) AS n_docs, sum(ta) / sum(ta + fa)::DOUBLE AS va, sum(tb) / sum(tb + fb)::DOUBLE AS vb FROM b),
z AS (SELECT *, {_WEIGHT} AS w FROM (SELECT b.*, r, {_H("'0:' || r || ':' || doc_id")} AS h FROM b, range({_RESAMPLES}) t(r))),
d AS (SELECT r, CASE WHEN sum(w * (ta + fa)) > 0 THEN sum(w * ta) / sum(w * (ta + fa))::DOUBLE ELSE 0 END - CASE WHEN sum(w * (tb + fb)) > 0 THEN sum(w * tb) / sum(w * (tb + fb))::DOUBLE ELSE 0 END AS d FROM z WHERE w > 0 GROUP BY r),
q AS (SELECT list_sort(list(d)) AS ds, count(*) FILTER (d <= 0) AS le, count(*) FILTER (d >= 0) AS ge, count(*) AS k FROM d)
SELECT n_docs, round(va, 6) AS value_a, round(vb, 6) AS value_b, round(va - vb, 6) AS delta, round(ds[CAST(floor(0.025::DOUBLE * (k - 1)) AS BIGINT) + 1], 6) AS lo, round(ds[CAST(floor(0.975::DOUBLE * (k - 1)) AS BIGINT) + 1], 6) AS hi, round(least(1.0::DOUBLE, 2 * least(le, ge) / k::DOUBLE), 6) AS p FROM v, q""")
def bootstrap_recall(spark, sf):
    g, tc, llm = all_spans(spark, sf)
    return M.paired_bootstrap(M.doc_counts(M.match(g, tc)), M.doc_counts(M.match(g, llm)), "recall", _RESAMPLES)


_AGREED = "(SELECT '{0}' AS system, count(*) AS agreed, count(*) FILTER (EXISTS (FROM gold g WHERE g.doc_id = p.doc_id AND g.s = p.s AND g.e = p.e AND g.label = p.label)) AS tp FROM {0} p WHERE EXISTS (FROM {1} o WHERE o.doc_id = p.doc_id AND o.s = p.s AND o.e = p.e AND o.label = p.label))"


@query(SPAN_SQL + " " + _AGREED.format("tc", "llm") + " UNION ALL " + _AGREED.format("llm", "tc"))
def agreement_precision(spark, sf):
    g, tc, llm = all_spans(spark, sf)
    return M.agreement(g, {"tc": tc, "llm": llm})


@query("""WITH RECURSIVE s AS (SELECT coalesce(lang, '') AS stratum, count(*) AS n, row_number() OVER (ORDER BY coalesce(lang, '')) AS i FROM documents GROUP BY 1),
f AS (SELECT CAST(0 AS BIGINT) AS i, '' AS stratum, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS d, 0::DOUBLE AS ct, 0::DOUBLE AS cd UNION ALL
 SELECT i, stratum, t, d, wt - t, wd - d FROM (SELECT *, least(n - t, greatest(0, CAST(round_even(wd, 0) AS BIGINT))) AS d FROM (SELECT *, least(n, greatest(0, CAST(round_even(wt, 0) AS BIGINT))) AS t
  FROM (SELECT s.i, s.stratum, s.n, 0.7::DOUBLE * s.n + f.ct AS wt, 0.1::DOUBLE * s.n + f.cd AS wd FROM f JOIN s ON s.i = f.i + 1)))),
r AS (SELECT doc_id, coalesce(lang, '') AS stratum, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY md5('0:' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, stratum, CASE WHEN r <= t THEN 'train' WHEN r <= t + d THEN 'dev' ELSE 'test' END AS split FROM r JOIN (SELECT * FROM f WHERE i > 0) USING (stratum)""")
def stratified_split(spark, sf):
    return splits.stratified(spark.read.parquet(f"{sf}/documents.parquet"), "lang")


_DRAW = lambda what: f"({_H(chr(39) + '3:sim:' + what + ':' + chr(39) + ' || key')} / 4294967296.0::DOUBLE)"


@query(SPAN_SQL + f""", sk AS (SELECT *, doc_id || ':' || s || ':' || e || ':' || label AS key FROM gold),
sf AS (SELECT *, CASE WHEN {_DRAW('noise')} < 0.2::DOUBLE AND e - s > 2 THEN 1 ELSE 0 END AS cut FROM sk WHERE {_DRAW('miss')} >= CASE label WHEN 'DATE' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END),
si AS (SELECT doc_id, label, spot AS s, CAST(least(n, spot + 5) AS INT) AS e FROM (SELECT sf.doc_id, label, n, CAST({_H("'3:sim:spot:' || key")} % greatest(1, n - 6) AS INT) AS spot FROM sf JOIN (SELECT doc_id, length(text) AS n FROM documents) d USING (doc_id) WHERE {_DRAW('invent')} < 0.1::DOUBLE AND n > 0)),
sa AS (SELECT doc_id, s, CAST(e - cut AS INT) AS e, label, 0.8::DOUBLE AS score FROM sf UNION ALL SELECT doc_id, s, e, label, 0.4::DOUBLE FROM si WHERE NOT EXISTS (FROM gold g WHERE g.doc_id = si.doc_id AND g.s < si.e AND si.s < g.e))
SELECT sa.doc_id, s AS start, e AS "end", label, substring(text, s + 1, e - s) AS text, 'sim' AS source, score FROM sa JOIN documents USING (doc_id)""")
def simulated_detector(spark, sf):
    docs, gold = documents(spark, sf), all_spans(spark, sf)[0]
    return simulate.detect(docs, gold, "sim", {"DATE": 0.5, "default": 0.1}, 0.1, 0.2, 0.8, 3)


@query(SPAN_SQL + """, v AS (SELECT DISTINCT doc_id, s, e, label FROM tc) SELECT doc_id, s AS start, e AS "end", label, EXISTS (FROM gold g WHERE g.doc_id = v.doc_id AND g.label = v.label AND g.s < v.e AND v.s < g.e) AS is_phi FROM v""")
def verdicts(spark, sf):
    g, tc, _ = all_spans(spark, sf)
    return simulate.right(tc, g)


@query(SPAN_SQL + ENCODED + f""", spoilt AS (SELECT t.doc_id, t.ix, t.s, t.e, coalesce(CASE WHEN {_H("'b' || t.k")} % 5 = 0 THEN 'I-' || substr(tag, 3) ELSE tag END, 'O') AS tag, ({_H("'p' || t.k")} % 100) / 100.0::DOUBLE AS prob FROM token t LEFT JOIN tagged USING (doc_id, ix)),
seen AS (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY ix) AS before FROM spoilt),
cuts AS (SELECT *, sum(CASE WHEN tag <> 'O' AND (tag[1] IN ('B', 'S') OR before IS NULL OR before = 'O' OR before[1] IN ('E', 'S') OR substr(before, 3) <> substr(tag, 3)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS isle FROM seen)
SELECT doc_id, min(s) AS start, max(e) AS "end", any_value(substr(tag, 3)) AS label, round(avg(prob), 6) AS score FROM cuts WHERE tag <> 'O' GROUP BY doc_id, isle""")
def decode_tags(spark, sf):
    """Tags of which every fifth is spoilt, decoded."""
    tags = tokens.encode_texts(documents(spark, sf), all_spans(spark, sf)[0], outside=False)
    of = lambda p: T.hashed(F.concat(F.lit(p), F.concat_ws(":", "doc_id", "ix")))
    spoilt = F.when((F.col("tag") != "O") & (of("b") % 5 == 0), F.concat(F.lit("I-"), F.substring("tag", 3, 100))).otherwise(F.col("tag"))
    got = tokens.decode(tags.withColumn("tag", spoilt).withColumn("prob", (of("p") % 100) / 100.0), sparse=True)
    return got.withColumn("score", F.round("score", 6))


@query(TOKEN_SQL + """, n AS (SELECT doc_id, count(*) AS n FROM token GROUP BY doc_id), w AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 128 THEN 0 ELSE CAST(ceil((n - 128) / 96.0) AS BIGINT) END + 1)) AS i FROM n),
p AS (SELECT doc_id, i, unnest(range(i * 96, least(n, i * 96 + 128))) AS ix, i * 96 AS a, least(n, i * 96 + 128) AS z FROM w)
SELECT doc_id, CAST(ix AS INT) AS ix, CAST(i AS VARCHAR) AS tag FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ix ORDER BY least(ix - a, z - 1 - ix) DESC, i) AS r FROM p) WHERE r = 1""")
def merge_window_predictions(spark, sf):
    n = T.tokenised(documents(spark, sf), found=False).groupBy("doc_id").agg(F.count("*").alias("n"))
    n = n.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # counts are few bytes, so Spark would put them into few tasks
    said = lambda w, i: F.struct(w["first"].cast("int").alias("first"), F.array_repeat(i.cast("string"), (w["last"] - w["first"]).cast("int")).alias("tags"), F.array_repeat(F.lit(1.0), (w["last"] - w["first"]).cast("int")).alias("probs"))
    return tokens.merge_nested_windows(n.select("doc_id", F.transform(tokens.windows(F.col("n"), 128, 32), said).alias("windows"))).select("doc_id", "ix", "tag")


@query(SPAN_SQL + f""", q AS (SELECT DISTINCT doc_id, s, e, label FROM tc), m AS (SELECT q.doc_id, q.s, q.e, q.label, avg(CASE WHEN t.label = q.label THEN ({_H("'p' || t.k")} % 100) / 100.0::DOUBLE ELSE 0 END) AS p FROM q JOIN token t ON t.doc_id = q.doc_id AND t.s < q.e AND q.s < t.e GROUP BY ALL)
SELECT doc_id, s AS start, e AS "end", label, round(p, 6) AS p FROM m""")
def span_label_probability(spark, sf):
    tc = all_spans(spark, sf)[1]
    t = labelled(tokens.under_spans(documents(spark, sf), tc))
    p = (T.hashed(F.concat(F.lit("p"), "k")) % 100) / 100.0
    dist = t.select("doc_id", "ix", F.col("start").alias("ts"), F.col("end").alias("te"), F.explode(F.array(F.struct(F.concat(F.lit("B-"), "label").alias("tag"), p.alias("p")), F.struct(F.lit("O").alias("tag"), (1 - p).alias("p")))).alias("x")).select("doc_id", "ix", "ts", "te", "x.tag", "x.p")
    got = tokens.label_probability(dist, tc.select("doc_id", "start", "end", "label").distinct())
    return got.withColumn("p", F.round("p", 6))


@query(SPAN_SQL + _MISS.format(by="label,", group="GROUP BY label").replace("SELECT label, n, fn_a", ", tests AS (SELECT label, n, fn_a") + """),
ranked AS (SELECT label AS name, 1 / (1 + mcnemar) AS p, row_number() OVER (ORDER BY 1 / (1 + mcnemar), label) AS i, count(*) OVER () AS m FROM tests)
SELECT name, round(p, 6) AS p, round(max(least(1.0::DOUBLE, (m - i + 1) * p)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM ranked""")
def holm_adjusted(spark, sf):
    """Holm's correction of numbers that SQL can give: 1 / (1 + statistic) in place of p, as SQL has no error function."""
    g, tc, llm = all_spans(spark, sf)
    tests = M.complementarity(M.misses(g, {"tc": tc, "llm": llm}), "tc", "llm", "label")
    got = M.holm(tests.select(F.col("label").alias("name"), (1 / (1 + F.col("mcnemar"))).alias("p")))
    return got.select("name", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


@query()
def mcnemar_holm(spark, sf):
    g, tc, llm = all_spans(spark, sf)
    tests = M.with_p(M.complementarity(M.misses(g, {"tc": tc, "llm": llm}), "tc", "llm", "label"))
    return M.holm(tests.select(F.col("label").alias("name"), F.round("p", 6).alias("p")))


@query(SPAN_SQL + ", z AS (SELECT doc_id, CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.OPF_OF.items() if v) + """ END || ': ' || substring(d.text, s + 1, e - s) AS key, s, e FROM gold JOIN documents d USING (doc_id))
SELECT doc_id, md5(key) AS key, string_agg(s || '-' || e, ',' ORDER BY s, e) AS places FROM z WHERE key IS NOT NULL GROUP BY doc_id, z.key""")
def opf_records(spark, sf):
    g = all_spans(spark, sf)[0]
    nested = g.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label")).alias("spans"))
    made = records.to_opf(documents(spark, sf).join(nested, "doc_id"))
    return made.select("doc_id", F.explode("spans").alias("key", "at")).select("doc_id", F.md5("key").alias("key"), F.array_join(F.transform("at", lambda x: F.concat_ws("-", x[0], x[1])), ",").alias("places"))


_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"


@query(f"""WITH RECURSIVE found AS (SELECT doc_id, text, regexp_extract_all(text, '\n{_WHITE}*\n') AS hit, regexp_split_to_array(text, '\n{_WHITE}*\n') AS gap FROM documents WHERE text <> ''),
paras AS (SELECT doc_id, unnest(gap) AS g, unnest(list_append(hit, '')) AS m, unnest(range(0, len(gap))) AS k FROM found),
blocks AS (SELECT doc_id, k, g || m AS body, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(g) - length(m) AS BIGINT) AS base FROM paras),
cuts AS (SELECT doc_id, k, body, base, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS z FROM blocks UNION ALL
  SELECT doc_id, k, body, base, z, CASE WHEN length(body) - z <= 1500 THEN length(body) ELSE z + coalesce(nullif(length(regexp_extract(substring(body, z + 1, 1500), '(?s)^(.+)\n', 1)), 0), nullif(length(regexp_extract(substring(body, z + 1, 1500), '(?s)^(.+) ', 1)), 0), 1500) END FROM cuts WHERE z < length(body))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, a) AS INT) AS segment, CAST(base + a AS INT) AS start, CAST(base + z AS INT) AS "end" FROM cuts WHERE z > 0""")
def segment_documents(spark, sf):
    return O.segments(documents(spark, sf)).select("doc_id", "segment", "start", "end")


@query()
def ground_items(spark, sf):
    """The surfaces that the second detector names, one item each, grounded anew."""
    llm = all_spans(spark, sf)[2]
    items = llm.groupBy("doc_id", "text", "label").agg(F.min("start").alias("item"))
    return O.deduped(O.ground(documents(spark, sf), items, once=True)).select("doc_id", "start", "end", "label", "method", "score")


# a detector's spans in order, without those that begin inside one
WRITTEN = """, row_of AS (SELECT doc_id, list({'s': s, 'e': e, 'label': label} ORDER BY s, e, label) AS xs FROM tc GROUP BY doc_id),
apart AS (SELECT doc_id, x.s AS s, x.e AS e, x.label AS label FROM (SELECT doc_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN x[1].s >= a[-1].e THEN list_concat(a, x) ELSE a END)) AS x FROM row_of))"""


@query(SPAN_SQL + WRITTEN + """ SELECT doc_id, s AS start, CAST(least(e, length(text)) AS INT) AS "end", label, 'exact' AS method, 1.0::DOUBLE AS score FROM apart JOIN documents USING (doc_id)""")
def tagged_outputs(spark, sf):
    """A detector's spans written as tags, read back."""
    docs = documents(spark, sf)
    return O.tagged(docs, spans.render_tagged(docs, all_spans(spark, sf)[1]).withColumnRenamed("text", "output"))


@query()
def inject_identifiers(spark, sf):
    profile = injection.Profile.of({"weights": {"DATE": 40, "DOCTOR": 15, "HOSPITAL": 8, "PATIENT": 7, "AGE": 6, "PHONE": 1.5}})
    docs = T.spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source"))
    made = injection.inject(docs, profile, 0, "source")
    return made.select("doc_id", F.length("text").alias("n_chars"), F.size("spans").alias("n_spans"), F.sha1("text").alias("sha"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _escaped(x: str) -> str:
    for char, escape in (prompts.ESCAPES | prompts.RARE).items():
        x = f"replace({x}, {f'chr({ord(char)})' if ord(char) < 32 else _quoted(char)}, {_quoted(escape)})" if char != "\0" else x
    return x


def _hash(system: str, user: str) -> str:
    head = '[{"content": ' + json.dumps(system, ensure_ascii=False) + ', "role": "system"}, {"content": "'
    return f"substr(sha256({_quoted(head)} || {_escaped(user)} || '\", \"role\": \"user\"}}]'), 1, 16)"


_FORMS = prompts.FORMATS[:3]


@query(" UNION ALL ".join(f"SELECT doc_id, '{f}' AS form, " + _hash(prompts.system_text(f), "coalesce(text, '')") + " AS prompt_hash FROM documents" for f in _FORMS))
def extraction_prompts(spark, sf):
    docs, out = documents(spark, sf), None
    for f in _FORMS:
        one = prompts.extraction(docs, f).select("doc_id", F.lit(f).alias("form"), prompts.prompt_hash(F.col("messages")).alias("prompt_hash"))
        out = one if out is None else out.unionByName(one)
    return out


@query(SPAN_SQL + WRITTEN + """, gaps AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS since FROM apart),
heads AS (SELECT doc_id, string_agg(substring(text, since + 1, s - since) || '<PHI type="' || label || '">' || substring(text, s + 1, e - s) || '</PHI>', '' ORDER BY s) AS head, max(e) AS last FROM gaps JOIN documents USING (doc_id) GROUP BY doc_id),
told AS (SELECT doc_id, CASE WHEN head IS NULL THEN coalesce(text, '') ELSE head || substring(text, last + 1) END AS t FROM documents LEFT JOIN heads USING (doc_id))
SELECT doc_id, """ + _hash(prompts.editor_text(focus=L.UNSUPPORTED), "t") + " AS prompt_hash FROM told")
def editor_prompts(spark, sf):
    made = prompts.editor(documents(spark, sf), all_spans(spark, sf)[1], focus=L.UNSUPPORTED)
    return made.select("doc_id", prompts.prompt_hash(F.col("messages")).alias("prompt_hash"))


@query(SPAN_SQL + """, asked AS (SELECT doc_id, s, e, label, 'Text around it: ...' || substring(d.text, greatest(0, s - 200) + 1, s - greatest(0, s - 200)) || '[[' || substring(d.text, s + 1, e - s) || ']]' || substring(d.text, e + 1, 200) || '...' || chr(10) || 'Candidate: "' || substring(d.text, s + 1, e - s) || '", label ' || label AS t FROM tc JOIN documents d USING (doc_id))
SELECT doc_id, s AS start, e AS "end", label, """ + _hash(prompts.verifier_text(), "t") + " AS prompt_hash FROM asked")
def verifier_prompts(spark, sf):
    made = prompts.verifier_asked(documents(spark, sf), all_spans(spark, sf)[1])
    return made.select("doc_id", "start", "end", "label", prompts.hash_of(prompts.verifier_text(), F.col("user")).alias("prompt_hash"))


@query("""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents), c AS (SELECT DISTINCT t FROM d WHERE lang = 'en'), f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t)
SELECT doc_id, c.t IS NOT NULL OR doc_id <> first AS cached, CAST(length(d.t) AS BIGINT) AS input_tokens, CASE WHEN c.t IS NOT NULL OR doc_id <> first THEN 0 ELSE length(d.t) / 1024.0::DOUBLE END AS cost_usd FROM d JOIN f USING (t) LEFT JOIN c ON c.t = d.t""")
def completion_calls(spark, sf):
    """All documents are asked about, those in English were before; a made-up answer counts a token a character."""
    docs = T.spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"))
    ask = lambda d: completions.requests(prompts.extraction(d, "json_strings"), {}, "made/up", temperature=0)
    n = F.length(F.expr("messages[1].content")).cast("long")
    answer = lambda d: d.select("key", F.lit('{"spans": []}').alias("output"), n.alias("input_tokens"), F.lit(5).cast("long").alias("output_tokens"), (n / 1024.0).alias("cost_usd"), F.lit(0.1).alias("latency_s"))
    held = answer(ask(docs.where("lang = 'en'")))
    cache = completions.grown(held.where("false"), held)
    asked = ask(docs)
    return completions.completed(asked, cache, answer(completions.pending(asked, cache)), "doc_id").select("doc_id", "cached", "input_tokens", "cost_usd")


@query(SQL["verdicts"])
def verifier_answers(spark, sf):
    """Verdicts written as a verifier does, and read."""
    g, tc, _ = all_spans(spark, sf)
    said = F.concat(F.lit('```json\n{"label": null, "is_phi": '), F.col("is_phi").cast("string"), F.lit("}\n```"))
    return completions.verdicts(simulate.right(tc, g).withColumn("output", said))


_OPF_TAGS = training.tag_list(training.label_space("opf8")[0])


@query(SPAN_SQL + ", og AS (SELECT * FROM (SELECT doc_id, s, e, CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.OPF_OF.items() if v) + " END AS label FROM gold) WHERE label IS NOT NULL)" + ENCODED.replace("gold g", "og g") + f""",
cn AS (SELECT doc_id, count(*) AS n FROM token GROUP BY doc_id), cw AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 128 THEN 0 ELSE CAST(ceil((n - 128) / 96.0) AS BIGINT) END + 1)) AS i FROM cn),
cp AS (SELECT doc_id, i, unnest(range(i * 96, least(n, i * 96 + 128))) AS ix FROM cw),
ci AS (SELECT doc_id, i, ix, {_H("'v' || tok")} % 50000 AS id, list_position([{', '.join(f"'{x}'" for x in _OPF_TAGS)}], coalesce(tag, 'O')) - 1 AS tag_id FROM cp JOIN token USING (doc_id, ix) LEFT JOIN tagged USING (doc_id, ix))
SELECT doc_id, CAST(i AS INT) AS "window", CAST(count(*) + 2 AS INT) AS n, md5('1,' || string_agg(id, ',' ORDER BY ix) || ',2') AS ids, md5('-100,' || string_agg(tag_id, ',' ORDER BY ix) || ',-100') AS labels FROM ci GROUP BY doc_id, i""")
def training_examples(spark, sf):
    """Windows to train on in the privacy filter's labels; a token's id is drawn from its text."""

    def ids_of(found):
        d = found.dictionary_encode()
        return np.array([int(hashlib.md5(b"v" + x.encode()).hexdigest()[:8], 16) % 50000 for x in d.dictionary.to_pylist()], np.int32)[d.indices.to_numpy()]

    made = training.examples_of_texts(documents(spark, sf), all_spans(spark, sf)[0], ids_of, "opf8", 130, 32, before=(1,), after=(2,))
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))
    return made.select("doc_id", "window", F.size("input_ids").alias("n"), digest("input_ids").alias("ids"), digest("labels").alias("labels"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Strict scores by label of the union of two detectors."""
    g, tc, llm = all_spans(spark, sf)
    return M.per_label(M.doc_counts(M.match(g, spans.union(tc.unionByName(llm)))))
