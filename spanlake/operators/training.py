"""Tables to train token classifiers from: label spaces, gold labels in them, windows of token ids with tag ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CATEGORIES, CATEGORY_OF, OPF_CATEGORY, OPF_OF, SUBTYPES, bioes_tags, literal_map
from ..functions.text import tokenised
from .tokens import beside_texts, encode, owned, prefixes, windows

# Fixed value: the tag id that a loss leaves out.
IGNORED = -100


def label_space(name: str) -> tuple[list[str], dict | None]:
    """(labels, what each gold label becomes; None: itself)."""
    spaces = {"i2b2_28": (SUBTYPES, None), "i2b2_categories": (tuple(CATEGORIES), CATEGORY_OF), "opf8": (tuple(OPF_CATEGORY), OPF_OF), "binary": (("PHI",), {s: "PHI" for s in SUBTYPES})}
    if name not in spaces:
        raise ValueError(f"unknown label space {name}; there are {', '.join(spaces)}")
    labels, table = spaces[name]
    return list(labels), table


def tag_list(labels, scheme: str = "bioes") -> list[str]:
    """Tags by id."""
    if scheme == "bioes":
        return bioes_tags(labels)
    if scheme == "bio":
        return ["O", *(f"{p}-{x}" for x in labels for p in "BI")]
    raise ValueError(f"unknown scheme {scheme}")


def map_gold(spans: DataFrame, table: dict | None) -> DataFrame:
    """Spans with the table's labels; those it maps to nothing go, labels it doesn't know stay."""
    if table is None:
        return spans
    m = literal_map(table)
    return spans.withColumn("label", F.when(F.map_contains_key(m, F.col("label")), m[F.col("label")]).otherwise(F.col("label"))).where("label is not null")


def tag_ids(tagged: DataFrame, tags) -> DataFrame:
    """tagged (start, end, tag, ...) with tag_id: the place in `tags`, IGNORED for tokens without extent; an unknown tag is an error."""
    ids = F.create_map(*[x for i, t in enumerate(tags) for x in (F.lit(t), F.lit(i))])
    known = F.when(F.map_contains_key(ids, F.col("tag")), ids[F.col("tag")]).otherwise(F.raise_error(F.concat(F.lit("unknown tag "), F.col("tag"))).cast("int"))
    return tagged.withColumn("tag_id", F.when(F.col("start") == F.col("end"), F.lit(IGNORED)).otherwise(known))


def examples(tokens: DataFrame, gold: DataFrame, space: str = "i2b2_28", longest: int = 512, stride: int = 64, scheme: str = "bioes", before=(), after=()) -> DataFrame:
    """(doc_id, window, input_ids, attention_mask, labels): overlapping windows of at most `longest` ids, `before` and `after` (a tokenizer's special ids) included.

    tokens: (doc_id, ix, start, end, id), ix from 0 without gaps. A document without tokens has no window. Rows are
    grouped by document and window, so a very long document is many small groups."""
    before, after = list(before), list(after)
    body = longest - len(before) - len(after)
    labels, table = label_space(space)
    tags = encode(tokens, map_gold(gold, table), scheme)
    t = tag_ids(tokens.join(tags, ["doc_id", "ix"]), tag_list(labels, scheme))
    n = tokens.groupBy("doc_id").agg(F.count("*").cast("int").alias("__n"))
    w = n.select("doc_id", F.posexplode(windows(F.col("__n"), body, stride)).alias("window", "__w")).select("doc_id", "window", F.col("__w.first").alias("__a"), F.col("__w.last").alias("__z"))
    # a token finds its windows by the step they begin in, not by trying all of its document's
    step = body - stride
    back = (body - 1) // step
    placed = t.select("doc_id", "ix", "id", "tag_id", F.explode(F.expr(f"sequence(greatest(0, CAST(floor(ix / {step}) AS INT) - {back}), CAST(floor(ix / {step}) AS INT))")).alias("window"))
    inside = placed.join(w, ["doc_id", "window"]).where("__a <= ix AND ix < __z")
    rows = inside.groupBy("doc_id", "window").agg(F.array_sort(F.collect_list(F.struct("ix", "id", "tag_id"))).alias("t"))
    ids = lambda xs: F.array(*[F.lit(int(x)) for x in xs]).cast("array<int>")
    ignored = lambda xs: ids([IGNORED] * len(xs))
    whole = F.concat(ids(before), F.transform("t", lambda x: x["id"].cast("int")), ids(after))
    return rows.select("doc_id", "window", whole.alias("input_ids"), F.array_repeat(F.lit(1), F.size(whole)).alias("attention_mask"), F.concat(ignored(before), F.transform("t", lambda x: x["tag_id"]), ignored(after)).alias("labels"))


def examples_of_texts(docs: DataFrame, gold: DataFrame, ids_of, space: str = "i2b2_28", longest: int = 512, stride: int = 64, scheme: str = "bioes", before=(), after=()) -> DataFrame:
    """examples() for the tokens of texts, made in the pass that makes the tokens: texts and spans are shuffled, tokens aren't.

    ids_of: the ids of a string array of tokens, as an array. docs: (doc_id, text), one row an id."""
    before, after = np.array(before, np.int32), np.array(after, np.int32)
    body = longest - len(before) - len(after)
    if body <= 0 or stride >= body:
        raise ValueError("windows don't advance")
    labels, table = label_space(space)
    tags = {t: i for i, t in enumerate(tag_list(labels, scheme))}

    def made(tokens, doc, rows):
        mine, at, size, names = owned(tokens, doc, rows.column(0))
        known = names.dictionary_encode()
        ids = np.array([[tags[f"{p}-{x}"] if f"{p}-{x}" in tags else -1 for p in "BIES"] for x in known.dictionary.to_pylist()], np.int32).reshape(-1, 4)
        tag = np.full(len(doc), tags["O"], np.int32)
        tag[mine] = ids[known.indices.to_numpy(), prefixes(at, size, scheme)]
        if (tag < 0).any():
            raise ValueError(f"unknown tag of {names[int(np.flatnonzero(tag[mine] < 0)[0])]}")
        heads = np.flatnonzero(tokens.column("ix").to_numpy() == 0)
        n = np.diff(np.append(heads, len(doc)))
        count = 1 + np.maximum(0, -((body - n) // (body - stride)))
        which = np.repeat(np.arange(len(heads)), count)
        window = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        first = window * (body - stride)
        length = np.minimum(n[which] - first, body)
        whole = length + len(before) + len(after)
        ends = np.append(0, np.cumsum(whole)).astype(np.int32)
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        to, source = np.repeat(ends[:-1] + len(before), length) + inner, np.repeat(heads[which] + first, length) + inner
        columns = []
        for values, fill in ((np.asarray(ids_of(tokens.column("found")), np.int32), None), (tag, IGNORED)):
            x = np.full(ends[-1], IGNORED, np.int32)
            x[to] = values[source]
            for k, v in enumerate(before):
                x[ends[:-1] + k] = v if fill is None else fill
            for k, v in enumerate(after):
                x[ends[1:] - len(after) + k] = v if fill is None else fill
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)))
        ones = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ones(ends[-1], np.int32)))
        ids_col = tokens.column("doc_id").take(pa.array(heads[which]))
        return pa.RecordBatch.from_arrays([ids_col, pa.array(window.astype(np.int32)), columns[0], ones, columns[1]], names=["doc_id", "window", "input_ids", "attention_mask", "labels"])

    d = beside_texts(docs, spans=map_gold(gold, table))
    return tokenised(d, then=(made, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, window int, input_ids array<int>, attention_mask array<int>, labels array<int>"), beside=["spans"])
