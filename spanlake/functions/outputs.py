"""Reading what a language model wrote (items, tagged text, tagged segments) and finding it in the documents.

Grounding works on one document and its outputs at a time, in Arrow batches: the texts pass by once and aren't copied per
item. Every function returns rows (doc_id, ..., start, end, label, method, score); what can't be found is a row without
offsets, so nothing gets lost on the way to the counts of ground_stats()."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import cuts

ITEM = "array<struct<text: string, label: string, before: string, score: double>>"
# The tags around a mention, the head of a segment's line, the fence around an output.
TAG = re.compile(r'<PHI type="([^"]+)">(.*?)</PHI>', re.DOTALL)
SEGMENT = re.compile(r"^\s*\[(\d+)\]\s?(.*)$")
FENCE = re.compile(r"^```[a-zA-Z]*\s*|\s*```$", re.MULTILINE)
BLANK = re.compile(r"\n\s*\n")
# Scores of the rungs below an exact match.
SPACED_SCORE, LEAST_FUZZY = 0.95, 90.0
SLICE = 1 << 16
Found = tuple[int, int, str, str, float]


def json_object(raw: Column) -> Column:
    """The object in an output: code fences off, from the first brace to the last; null if there's none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(raw, r"```[a-zA-Z]*", ""), r"(?s)\{.*\}", 0), F.lit(""))


def span_items(raw: Column) -> Column:
    """The items under "spans" (else "entities") that have a text and a label; null if the output can't be read."""
    got = F.from_json(json_object(raw), f"struct<spans: {ITEM}, entities: {ITEM}>")
    return F.filter(F.coalesce(got["spans"], got["entities"]), lambda x: (F.coalesce(x["text"], F.lit("")) != "") & (F.coalesce(x["label"], F.lit("")) != ""))


def occurrences(text: str, needle: str) -> list[int]:
    """Where a needle begins, overlapping occurrences too; an empty one is nowhere."""
    out, at = [], text.find(needle) if needle else -1
    while at >= 0:
        out.append(at)
        at = text.find(needle, at + 1)
    return out


def folded(s: str) -> str:
    return " ".join(s.split()).lower()


def common_lengths(needle: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of the needle and each window of its length: the bit-parallel recurrence, 64 characters of the needle a word, all windows at once."""
    m = len(needle)
    n_words, out = (m + 63) // 64, np.zeros(len(starts), np.int64)
    chars, which = np.unique(needle, return_inverse=True)
    masks = np.zeros((len(chars) + 1, n_words), np.uint64)
    for i, c in enumerate(which):
        masks[c, i // 64] |= np.uint64(1 << (i % 64))
    at = np.searchsorted(chars, codes)
    own = np.where(chars[np.minimum(at, len(chars) - 1)] == codes, at, len(chars))
    full = np.uint64(2**64 - 1)
    for lo in range(0, len(starts), SLICE):
        begin = starts[lo : lo + SLICE]
        v = np.full((n_words, len(begin)), full, np.uint64)
        for k in range(m):
            mask, carry = masks[own[begin + k]], np.zeros(len(begin), np.uint64)
            for w in range(n_words):
                u = v[w] & mask[:, w]
                x = v[w] + u
                y = x + carry
                carry = ((x < u) | (y < x)).astype(np.uint64)
                v[w] = y | (v[w] & ~mask[:, w])
        if m % 64:
            v[-1] |= full << np.uint64(m % 64)
        out[lo : lo + SLICE] = np.bitwise_count(~v).sum(axis=0)
    return out


def closest(needle: str, text: str, least: float = LEAST_FUZZY) -> tuple[float, int, int] | None:
    """(score, start, end) of the window of the text closest to the needle, the first of the best; null below `least`.

    score = 200 * longest common subsequence / both lengths. Windows have the needle's length, those at the text's ends may
    be shorter; a needle longer than the text is compared with the whole of it, by the needle's own windows. Windows whose
    letters alone rule the score out are passed over, which changes nothing."""
    if not needle or not text:
        return None
    if len(needle) > len(text):
        got = closest(text, needle, least)
        return got and (got[0], 0, len(text))
    b, a = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (needle, text))
    m, n = len(b), len(a)

    def best(starts: np.ndarray, size: int, part: np.ndarray) -> list[tuple[float, int, int]]:
        """Best of the windows of one size; LCS is symmetric, so the shorter windows take the needle as text."""
        room = np.zeros(len(starts), np.int64)
        for c, need in zip(*np.unique(b, return_counts=True), strict=True):
            seen = np.concatenate([[0], np.cumsum(part == c)])
            room += np.minimum(seen[starts + size] - seen[starts], need)
        starts = starts[200.0 * room >= least * (m + size)]
        if not len(starts):
            return []
        if size == m:
            scores = 200.0 * common_lengths(b, part, starts) / (m + size)
        else:
            pad = np.concatenate([part[starts[0] : starts[0] + size], np.full(m - size, 0xFFFFFFFF, np.uint32)])
            scores = 200.0 * common_lengths(b, pad, np.zeros(1, np.int64)) / (m + size)
        i = int(np.argmax(scores))
        return [(float(scores[i]), int(starts[i]), int(starts[i]) + size)] if scores[i] >= least else []

    found = best(np.arange(n - m + 1), m, a)
    for size in range(m - 1, 0, -1):
        if 200.0 * size < least * (m + size):
            break
        for start in (0, n - size):
            found += best(np.array([start]), size, a)
    return max(found, key=lambda x: (x[0], -x[1], -x[2]), default=None)


def ground_item(text: str, needle: str, label: str, before: str | None, every: bool, least: float) -> list[Found]:
    """One item's places, by the first rung that holds: after `before` (the first such), exact, white space as it comes, closest window widened to whole words."""
    at = occurrences(text, needle)
    if at and (before or "").strip():
        left = folded(before)
        fits = next((p for p in at if folded(text[max(0, p - len(before) - 5) : p]).endswith(left)), None)
        if fits is not None:
            return [(fits, fits + len(needle), label, "anchored", 1.0)]
    if at:
        return [(p, p + len(needle), label, "exact", 1.0) for p in (at if every else at[:1])]
    words = needle.split()
    loose = [m.span() for m in re.finditer(r"\s+".join(map(re.escape, words)), text)] if words else []
    if loose:
        return [(s, e, label, "whitespace", SPACED_SCORE) for s, e in (loose if every else loose[:1])]
    got = closest(needle, text, least) if words else None
    if got is None:
        return []
    score, s, e = got
    while 0 < s and text[s - 1 : s + 1].isalnum():
        s -= 1
    while e < len(text) and text[e - 1 : e + 1].isalnum():
        e += 1
    return [(s, e, label, "fuzzy", score / 100.0)]


def untag(tagged: str) -> tuple[str, list[tuple[int, int, str]]]:
    """(text without tags, mentions in it); an empty mention is none."""
    plain, spans, at = [], [], 0
    pieces = TAG.split(tagged)
    for i in range(0, len(pieces), 3):
        plain.append(pieces[i])
        at += len(pieces[i])
        if i + 2 < len(pieces):
            mention = pieces[i + 2]
            if mention:
                spans.append((at, at + len(mention), pieces[i + 1]))
            plain.append(mention)
            at += len(mention)
    return "".join(plain), spans


def fit_tagged(text: str, output: str) -> list[Found] | None:
    """Mentions of a tagged rewrite as places in the text; null unless it is the text, or the text but for white space."""
    plain, raw = untag(output.strip())
    if plain == text:
        return [(s, e, label, "exact", 1.0) for s, e, label in raw]
    mine, theirs = ([i for i, c in enumerate(x) if not c.isspace()] for x in (text, plain))
    if [text[i] for i in mine] != [plain[i] for i in theirs]:
        return None
    place = [*mine, len(text)]
    out = []
    for s, e, label in raw:
        a, z = place[bisect_left(theirs, s)], min(len(text), place[bisect_left(theirs, e - 1)] + 1)
        inner = text[a:z]
        a, z = a + len(inner) - len(inner.lstrip()), z - len(inner) + len(inner.rstrip())
        if a < z:
            out.append((a, z, label, "whitespace", SPACED_SCORE))
    return out


def cut_segments(text: str, longest: int = 1500) -> Iterator[tuple[int, int]]:
    """Paragraphs, each with the blank lines after it; a longer one is cut before its last line break, else space, that fits, else at the limit."""
    if longest < 1:
        raise ValueError("segments need a length")
    at = 0
    for stop in (*(m.end() for m in BLANK.finditer(text)), len(text)):
        while stop - at > longest:
            cut = next((c for c in (text.rfind(x, at + 1, at + longest) for x in "\n ") if c >= 0), at + longest)
            yield at, cut
            at = cut
        if stop > at:
            yield at, stop
        at = stop


def parse_segments(output: str) -> dict[int, str]:
    """Tagged segments by number: a line without one continues the segment before, blank lines go, of a repeated number the last stays."""
    parts: dict[int, list[str]] = {}
    now: list[str] | None = None
    for line in FENCE.sub("", output).splitlines():
        head = SEGMENT.match(line)
        if head:
            now = parts[int(head[1])] = [head[2]]
        elif now is not None and line.strip():
            now.append(line)
    return {k: "\n".join(v) for k, v in parts.items()}


ROW = "start int, end int, label string, method string, score double"


#: Rows that leave a task in one batch.
BATCH = 1 << 15


def per_row(d: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """work(row of `columns`) -> rows of the schema after doc_id, in Arrow batches; doc_id keeps its type. The first column is a text: a batch is
    read in pieces of it, and what is made of a piece or even of one row leaves in several batches, so neither has to fit the memory."""
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        fields = [x.strip().split()[0] for x in schema.split(",")]
        types = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
        kinds = [types[x.strip().split()[1]] for x in schema.split(",")]

        def out(ids, at, rows):
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *cols], names=["doc_id", *fields])

        for b in batches:
            for first, behind in cuts(b.column(columns[0])):
                part = b.slice(first, behind - first)
                ids, at, rows = part.column("doc_id"), [], []
                for i, v in enumerate(zip(*(part.column(c).to_pylist() for c in columns), strict=True)):
                    for r in work(*v):
                        at.append(i)
                        rows.append(r)
                        if len(rows) >= BATCH:
                            yield out(ids, at, rows)
                            at, rows = [], []
                if rows:
                    yield out(ids, at, rows)

    return d.select("doc_id", *columns).mapInArrow(run, f"doc_id {id_type}, {schema}")


def ground(docs: DataFrame, items: DataFrame, every: bool = True, least: float = LEAST_FUZZY, once: bool = False) -> DataFrame:
    """(doc_id, item, start, end, label, method, score): each item's places in its document, `every` exact one or the first.

    items: (doc_id, item, text, label) and perhaps before. An item that isn't found, or whose document has no text, is one
    row "failed" without offsets; items of unknown documents are left out, those of repeated ids meet each repeat. With `once`,
    rows that deduped() would drop anyway stay where they are made: a name under many labels has as many rows a place."""
    before = F.col("before") if "before" in items.columns else F.lit(None)
    one = F.struct(F.col("item").cast("int").alias("item"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("label", F.lit("")).alias("label"), before.cast("string").alias("before"))
    per_doc = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("items"))

    def every_row(text, wanted):
        for x in wanted:
            got = ground_item(text or "", x["text"], x["label"], x["before"], every, least)
            for r in got or [(None, None, x["label"], "failed", 0.0)]:
                yield (x["item"], *r)

    def best(text, wanted):
        kept: dict[tuple, tuple] = {}  # by item, so that of equal scores the first item's stays
        for r in every_row(text, sorted(wanted, key=lambda x: -math.inf if x["item"] is None else x["item"])):
            if r[1] is None:
                yield r
            elif (r[1], r[2]) not in kept or kept[r[1], r[2]][-1] < r[-1]:
                kept[r[1], r[2]] = r
        yield from kept.values()

    work = best if once else every_row

    return per_row(docs.select("doc_id", "text").join(per_doc, "doc_id"), ["text", "items"], f"item int, {ROW}", work)


def deduped(grounded: DataFrame) -> DataFrame:
    """Grounded spans without failures, of equal extents the best scored, then the first item's."""
    w = W.partitionBy("doc_id", "start", "end").orderBy(F.col("score").desc(), "item")
    return grounded.where("start is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def ground_stats(grounded: DataFrame) -> DataFrame:
    """(method, n_items, n_spans) over all documents."""
    per = grounded.groupBy("doc_id", "item", "method").agg(F.count("start").alias("n"))
    return per.groupBy("method").agg(F.count("*").alias("n_items"), F.sum("n").alias("n_spans"))


def tagged(docs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, method, score) from whole tagged texts. outputs: (doc_id, output); one that isn't its document's text (or is null) is a row "rejected"."""

    def work(text, output):
        got = None if output is None else fit_tagged(text or "", output)
        return [(None, None, None, "rejected", 0.0)] if got is None else got

    return per_row(docs.select("doc_id", "text").join(outputs.select("doc_id", "output"), "doc_id"), ["text", "output"], ROW, work)


def segments(docs: DataFrame, longest: int = 1500) -> DataFrame:
    """(doc_id, segment, start, end, text): documents cut at paragraphs, numbered from 1; no rows for empty texts."""

    def work(text):
        return [(i, s, e, text[s:e]) for i, (s, e) in enumerate(cut_segments(text or "", longest), 1)]

    return per_row(docs, ["text"], "segment int, start int, end int, text string", work)


def render_segments(segs: DataFrame) -> DataFrame:
    """(doc_id, text): numbered segments, one a line."""
    rows = segs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("segment", "text"))).alias("all"))
    return rows.select("doc_id", F.array_join(F.transform("all", lambda s: F.format_string("[%d] %s", s["segment"], F.translate(s["text"], "\n", " "))), "\n").alias("text"))


def tagged_segments(docs: DataFrame, outputs: DataFrame, longest: int = 1500) -> DataFrame:
    """As tagged(), from outputs of numbered tagged segments: a missing or unlike segment is a row "rejected"."""

    def work(text, output):
        text, got = text or "", parse_segments(output or "")
        for i, (s, e) in enumerate(cut_segments(text, longest), 1):
            fit = fit_tagged(text[s:e].replace("\n", " "), got[i]) if i in got else None
            if fit is None:
                yield None, None, None, "rejected", 0.0
            else:
                yield from ((s + a, s + z, label, method, score) for a, z, label, method, score in fit)

    return per_row(docs.select("doc_id", "text").join(outputs.select("doc_id", "output"), "doc_id"), ["text", "output"], ROW, work)


def call_costs(log: DataFrame) -> DataFrame:
    """One row from a log of calls (cached, input_tokens, output_tokens, cost_usd, latency_s)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return log.agg(F.count("*").alias("calls"), total(F.col("cached").cast("long")).alias("cached_calls"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), F.round(total("cost_usd"), 6).alias("cost_usd"), F.round(total("latency_s"), 3).alias("latency_s"))
