"""Finding things in text, with code-point offsets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"\w+|[^\w\s]"

# Placeholders of transcription and what stands for them, in order.
PLACEHOLDERS = (
    (r"\bDr\.?\s+[A-Z]{1,3}\b\.?", "the physician"),
    (r"\b(?:XYZ|ABC|ABCD|XX+)\s+(?:Hospital|Medical Center|Clinic|University)\b", "the hospital"),
    (r"(?i)\((?:Patient|Doctor|Physician) name\)", "the patient"),
    (r"\b(?:XYZ|ABCD?|XX+|YYYY|MM/DD/YYYY|DD/MM/YYYY)\b", ""),
    (r"(?i)\[(?:DATE|NAME|AGE|PLACE|REDACTED)\]", ""),
)
# Patterns of identifiers left in a text, in order of precedence.
RESIDUAL = (
    ("AGE", r"(?i)\b[0-9]{1,3}(?=[- ]?(?:year|yr)s?[- ]old\b)"),
    ("DATE", r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"),
    ("DATE", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\.? [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}\b"),
    ("PHONE", r"\(?\b[0-9]{3}\)?[\s.-][0-9]{3}[\s.-][0-9]{4}\b"),
    ("EMAIL", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("MEDICALRECORD", r"\bMRN[:# ]*\s*([0-9]{5,})\b"),
)
# Cues of rare identifiers, and words that head a header line.
CUES = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "url": r"(?i)https?://\S+|www\.\S+",
    "phone": r"\(?\b[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}\b",
    "fax_word": r"(?i)\bfax\b",
    "ip": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "id_like": r"\b(?=[A-Z0-9-]{6,}\b)(?=[A-Z-]*[0-9])[A-Z0-9-]+\b",
    "zip": r"\b[0-9]{5}(?:-[0-9]{4})?\b",
}
HEADER = r"(?im)^\s*(?:patient|name|mrn|dob|date of birth|attending|dictated by|cc:|signed|electronically signed|address|phone|tel|fax|email|account|insurance)\b"


#: Matches that leave a task in one batch.
BATCH = 100_000
#: Bytes of text that are worked on at once.
STEP = 1 << 19


def cuts(column):
    """(first, behind the last) of rows of an Arrow column of strings that hold at most STEP bytes together; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = done = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, done + STEP, side="right")))
        yield i, j
        i, done = j, ends[j - 1]


def find_all(docs: DataFrame, pattern: str, *keys: str, text: str = "text", gap: bool = False, ahead: int = 0) -> DataFrame:
    """(keys, ix, start, end, found): every match of a Python pattern, in order, per row of docs; of its first group if it has one.

    With `gap`, the text since the match before (null for the first). With `ahead`, columns end1, end2, ...: where the match
    so many places on ends (the last one's end, if there are fewer). One narrow pass in Arrow batches, linear in the text; nothing
    is shuffled, and a long text's matches leave in several batches."""
    keys = keys or ("doc_id",)
    rx = re.compile(pattern)
    group = 1 if rx.groups else 0
    extra = [f"end{k}" for k in range(1, ahead + 1)]
    types = dict(zip(docs.select(*keys).columns, (f.dataType.simpleString() for f in docs.select(*keys).schema), strict=True))
    schema = ", ".join([f"`{k}` {t}" for k, t in types.items()] + ["ix int", "start int", "end int", "found string"] + (["gap string"] if gap else []) + [f"{c} int" for c in extra])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            row, ix, places, found, gaps = [], [], [], [], []

            def out(b=b):
                p = np.array(places, np.int32).reshape(-1, 2 + ahead)
                cols = [b.column(i).take(pa.array(row, pa.int64())) for i in range(len(keys))]
                cols += [pa.array(ix, pa.int32()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(found, pa.string())]
                cols += [pa.array(gaps, pa.string())] if gap else []
                cols += [pa.array(np.ascontiguousarray(p[:, 2 + k])) for k in range(ahead)]
                return pa.RecordBatch.from_arrays(cols, names=[*types, "ix", "start", "end", "found", *(["gap"] if gap else []), *extra])

            for first, behind in cuts(b.column(len(keys))):
                for i, t in enumerate(b.column(len(keys)).slice(first, behind - first).to_pylist(), first):
                    if not t:
                        continue
                    spots = [m.span(group) for m in rx.finditer(t)]
                    ends = [e for _, e in spots]
                    for k in range(0, len(spots), BATCH):
                        part = spots[k : k + BATCH]
                        row += [i] * len(part)
                        ix += range(k, k + len(part))
                        found += [t[a:e] for a, e in part]
                        if gap:
                            gaps += [None if j == 0 else t[ends[j - 1] : spots[j][0]] for j in range(k, k + len(part))]
                        if ahead:
                            places += [(a, e, *(ends[min(j, len(ends) - 1)] for j in range(n + 1, n + 1 + ahead))) for n, (a, e) in enumerate(part, k)]
                        else:
                            places += part
                        if len(row) >= BATCH:
                            yield out()
                            row, ix, places, found, gaps = [], [], [], [], []
            if row:
                yield out()

    return docs.select(*keys, F.col(text).cast("string")).mapInArrow(run, schema)


def kinds():
    """What each code point is to TOKEN: 0 a space, 1 part of a word, 2 a token of its own."""
    import numpy as np

    points, kind = "".join(map(chr, range(0x110000))), np.full(0x110000, 2, np.uint8)
    for k, pattern in ((1, r"\w+"), (0, r"\s+")):
        for m in re.finditer(pattern, points):
            kind[m.start() : m.end()] = k
    return kind


_KINDS: list = []


def tokenised(docs: DataFrame, *keys: str, text: str = "text", ahead: int = 0, found: bool = True, then=None, beside=()) -> DataFrame:
    """find_all() for TOKEN, in numpy over the code points of many texts at once: (keys, ix, start, end, found), with `ahead` end1, end2, ...

    Without `found` only places leave the workers. `then` is (a function of a RecordBatch of tokens, the DDL of what it gives):
    it runs where the tokens are made, so that tokens it doesn't want never leave. With columns `beside` the text it gets as well
    which row each token belongs to, and a RecordBatch of those columns' rows."""
    keys = keys or ("doc_id",)
    head = docs.select(*keys)
    extra = [f"end{k}" for k in range(1, ahead + 1)]
    columns = ["ix int", "start int", "end int", *(["found string"] if found else []), *(f"{c} int" for c in extra)]
    schema = then[1] if then else ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema] + columns)
    names = [*head.columns, *(c.split()[0] for c in columns)]

    def some(b, first, texts):
        import numpy as np
        import pyarrow as pa

        length = np.array([len(t) for t in texts])
        begin = np.cumsum(length) - length
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        kind = _KINDS[0][points]
        edge = np.zeros(len(points) + 1, bool)
        edge[begin] = edge[-1] = True
        word = kind == 1
        start = np.flatnonzero((kind == 2) | word & (edge[:-1] | ~np.append(False, word[:-1])))
        end = np.flatnonzero((kind == 2) | word & (edge[1:] | ~np.append(word[1:], False))) + 1
        doc = np.searchsorted(begin, start, side="right") - 1
        count = np.bincount(doc, minlength=len(texts))
        last = np.cumsum(count)
        at = np.arange(len(start))
        cols = [b.column(i).take(pa.array(first + doc)) for i in range(len(keys))]
        cols += [pa.array((at - (last - count)[doc]).astype(np.int32)), pa.array((start - begin[doc]).astype(np.int32)), pa.array((end - begin[doc]).astype(np.int32))]
        if found:
            # the tokens' characters in a row are the data of the string array
            size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4))) * (kind != 0)
            bytes_to = np.append(0, np.cumsum(size))
            offsets = np.append(bytes_to[start], bytes_to[-1]).astype(np.int32)
            data = points[kind != 0].tobytes().decode("utf-32-le").encode()
            cols.append(pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)))
        cols += [pa.array((end[np.minimum(at + k, last[doc] - 1)] - begin[doc]).astype(np.int32)) for k in range(1, ahead + 1)]
        return pa.RecordBatch.from_arrays(cols, names=names), doc

    def run(batches):
        if not _KINDS:
            _KINDS.append(kinds())
        for b in batches:
            for i, j in cuts(b.column(len(keys))):
                part = b.slice(i, j - i)
                texts = part.column(len(keys)).to_pylist()
                whole = [k for k, t in enumerate(texts) if t]
                if whole:
                    part = part.take(_indices(whole))
                    made, doc = some(part, 0, [texts[k] for k in whole])
                    yield then[0](made, *([doc, part.select(list(beside))] if beside else [])) if then else made

    return docs.select(*keys, F.col(text).cast("string"), *beside).mapInArrow(run, schema)


def _indices(rows):
    import pyarrow as pa

    return pa.array(rows, pa.int64())


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores: a table of fewer partitions than two a core (a small file is one) is dealt out once; a larger one stays as it is read."""
    least = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(least) if docs._jdf.rdd().getNumPartitions() < least else docs


def strip_placeholders(text: Column) -> tuple[Column, Column]:
    """(text without placeholders, how many there were)."""
    n = F.lit(0)
    for pattern, instead in PLACEHOLDERS:
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, instead)
    return F.regexp_replace(text, r"[ \t]{2,}", " "), n.cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) that a string fixes, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hashed(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
