"""Exact substring dedup by a distributed merge sort of suffixes that knows common prefixes.

Every byte goes that lies under a string of SIZE bytes which also starts elsewhere. Bytes under a string of SHORT bytes that
starts elsewhere are counted beside that (n_repeated), but stay: a passage of 50 words may be shorter than SIZE. Which
suffixes to sort: of the GRAM-byte grams in a string of SHORT bytes, the leftmost one with the smallest hash is its anchor.
Equal strings have equal anchors at equal offsets (a string of SIZE bytes goes by the SHORT bytes it begins with), and
neighbouring strings share theirs, so only suffixes at anchors are needed (about one byte in 75), and of those only where
the anchor's gram stands twice.

Steps: (1) each chunk of documents ships the hashes of its anchors' grams, deduplicated; (2) it gets back those that stand
twice; (3) it sorts the suffixes at these anchors and ships sorted runs, front coded: an entry holds how many bytes it
shares with the entry before, and the rest; equal suffixes with equal left context are one entry; (4) runs meet per bucket
of the gram's hash in a loser tree that keeps each head's common prefix with the last winner, so bytes known to be equal are
never compared again; the merge yields the suffixes in order with their longest common prefixes, and neighbours that share
GRAM bytes or more form a group; (5) strings of SIZE and of SHORT bytes around the anchor are counted within their group;
those found twice go back to their chunks, where documents are rebuilt.

Text moves in one exchange, which the three passes share. A passage in a third of all documents is one entry per chunk
and neighbourhood. A group holds the distinct neighbourhoods of one gram and meets in one task, so it has to be bounded: a
gram that stands more than HOT times (a line of a third of all documents, each time among other words) is split by what
stands around it. Each of its strings goes to the task of its own hash, once per chunk, as 128 bits of two independent
hashes; the sorted lists of the chunks are merged there, and what is found twice comes back. So the result is the same on
either side of HOT, but for two unlike strings that agree in 128 bits.

Cases: null and empty texts are no bytes; a text under SIZE bytes is kept whole; repeated rows are copies of each other,
so both lose what repeats; a string that overlaps its own copy counts; what is left may be cut within a code point, so
`kept` is binary; doc_id may be null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import _BYTE_VALUES, answer, buckets_for, by_group, chunked, documents, empty, leftmost_minima, mix, prefix_hash, range_hash, split_sorted, table, text_bytes, text_steps

SIZE = 400
SHORT = 250
GRAM = 100
#: A gram that stands more often isn't merged in one task; its strings are dealt to tasks one by one.
HOT = 1 << 14
SECOND_BASE = 0x2545F4914F6CDD1D
#: Bytes of neighbourhoods that are hashed at once in a merge.
SLICE_BYTES = 1 << 19

GRAMS = "bucket int,chunk int,hashes binary,counts binary"
SHARED = "chunk int,hashes binary,hot binary"
RUN = "bucket int,chunk int,run binary,strings binary,checks binary,many binary,hot binary"
HITS = "chunk int,classes binary,spans binary,strings binary,checks binary,hot binary"
OUT = "doc_id bigint,n_bytes bigint,n_removed bigint,n_spans bigint,kept_sha256 string,n_repeated bigint"


class Anchors:
    """The anchors of some documents: at (place), low and high (first and last string of `short` bytes that has it), stop (end of the neighbourhood: that of the last string of `size` bytes, or of the document), gram (hash)."""

    def __init__(self, t, size: int, short: int, gram: int):
        n = len(t.buf)
        self.values, self.second = _BYTE_VALUES[t.buf], None
        self.prefix = prefix_hash(self.values)
        valid = np.zeros(n + 1, np.int32)
        long = t.end - t.begin >= short
        np.add.at(valid, t.begin[long], 1)
        np.add.at(valid, t.end[long] - short + 1, -1)
        start = self.start = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
        if not len(start):
            self.at = self.low = self.high = self.stop = np.zeros(0, np.int64)
            self.gram = self.classes = np.zeros(0, np.uint64)
            return
        at = np.arange(n - gram + 1)
        g = range_hash(self.prefix, at, at + gram)
        best = leftmost_minima(g, short - gram + 1)[start]
        edge = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)))
        self.at, self.low = best[edge], start[edge]
        self.high = start[np.append(edge[1:], len(start)) - 1]
        self.stop = np.minimum(self.high + size, t.end[np.searchsorted(t.begin, self.low, side="right") - 1])
        self.gram = mix(g[self.at])  # smallest hashes are all small: mixed again, they fall evenly into buckets
        # the whole neighbourhood, with the anchor's place and the number of strings in it
        self.classes = mix(range_hash(self.prefix, self.low, self.stop) ^ mix(((self.at - self.low) << 20 | (self.high - self.low)).astype(np.uint64)))

    def starts(self, some: np.ndarray, length: int, short: int) -> np.ndarray:
        """Where the strings of `length` bytes begin at the chosen anchors."""
        last = np.minimum(self.high[some], self.stop[some] - length)
        count = np.maximum(0, last - self.low[some] + 1)
        return np.arange(count.sum()) + np.repeat(self.low[some] - (np.cumsum(count) - count), count)

    def strings(self, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the strings of `length` bytes that begin at `start`."""
        if self.second is None:
            self.second = prefix_hash(self.values, SECOND_BASE)
        return tuple(mix(range_hash(p, start, start + length) ^ np.uint64(length)) for p in (self.prefix, self.second))


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix of a and b, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if a[low] != b[low] else high


_HEAD = struct.Struct("<HHHBHQ")


def encode(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A front-coded run of (suffix, left, class, many, strings) in order of the suffixes."""
    out, before = [], b""
    for suffix, left, cls, many, n in entries:
        k = common(before, suffix)
        out += (_HEAD.pack(k, len(suffix) - k, len(left), many, n, cls), suffix[k:], left)
        before = suffix
    return b"".join(out)


def decode(run: bytes):
    """(common prefix with the suffix before, suffix, left, class, many, strings) for each entry of a run."""
    at, before, end = 0, b"", len(run)
    while at < end:
        k, rest, n_left, many, n, cls = _HEAD.unpack_from(run, at)
        at += _HEAD.size
        before = before[:k] + run[at : at + rest]
        at += rest
        yield k, before, run[at : at + n_left], cls, many, n
        at += n_left


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, string, ...) into (common prefix with the last, run, item).

    Each loser keeps the length of the prefix that it shares with the winner it lost to. A head that shares more with the
    last output is smaller; only heads that share equally much are compared, from there on."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        n = 1
        while n < len(self.runs):
            n *= 2
        self.n = n
        self.item = [next(r, None) for r in self.runs] + [None] * (n - len(self.runs))
        self.same = [0 if x is not None else -1 for x in self.item]
        self.loser = [0] * n
        self.winner = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' heads."""
        x, y = self.same[a], self.same[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = self.item[a][1], self.item[b][1]
        k = common(s, t, x)
        if k == len(s) or (k < len(t) and s[k] < t[k]):
            self.same[b] = k
            return a, b
        self.same[a] = k
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        winner, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self):
        while self.same[self.winner] >= 0:
            w = self.winner
            yield self.same[w], w, self.item[w]
            item = next(self.runs[w], None)
            self.item[w], self.same[w] = item, -1 if item is None else item[0]
            node = (w + self.n) // 2
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node //= 2
            self.winner = w


def grams(docs: DataFrame, n_buckets: int, size: int = SIZE, short: int = SHORT, gram: int = GRAM) -> DataFrame:
    """GRAMS rows: for each chunk and bucket the distinct hashes of its anchors' grams, and how often they stand there (65,535 for more)."""

    def run(t: pa.Table) -> pa.Table:
        found = [Anchors(part, size, short, gram).gram for _, part in text_steps(t["text"])]
        key, count = np.unique(np.concatenate(found), return_counts=True)
        edges = split_sorted(key, n_buckets)
        some = [i for i in range(n_buckets) if edges[i] < edges[i + 1]]
        count = np.minimum(count, 65535).astype(np.uint16)
        return table(GRAMS, some, [t["chunk"][0].as_py()] * len(some), [key[edges[i] : edges[i + 1]].tobytes() for i in some], [count[edges[i] : edges[i + 1]].tobytes() for i in some])

    return by_group(docs, "chunk", run, GRAMS)


def found_twice(per: list[np.ndarray], counts: list[np.ndarray], most: int | None = None, checks: list[np.ndarray] | None = None):
    """(which list, the places of those of its hashes that stand more than once in all, which of these stand more than `most` times) for each sorted list of hashes that has any. With `checks`, second hashes have to agree as well."""
    key, owner = np.concatenate(per), np.repeat(np.arange(len(per)), [len(x) for x in per])
    check = np.concatenate(checks) if checks else None
    order = np.argsort(key, kind="stable") if check is None else np.lexsort((check, key))
    k = key[order]
    fresh = np.append(True, k[1:] != k[:-1])
    if check is not None:
        fresh[1:] |= check[order][1:] != check[order][:-1]
    edge = np.flatnonzero(fresh)
    total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), edge)
    each = np.empty(len(key), np.int64)
    each[order] = np.repeat(total, np.diff(np.append(edge, len(k))))
    cut = np.searchsorted(owner, np.arange(len(per) + 1))
    for i in range(len(per)):
        mine = each[cut[i] : cut[i + 1]]
        at = np.flatnonzero(mine > 1)
        if len(at):
            yield i, at, mine[at] > (most or 0)


def twice(found: DataFrame, hot: int = HOT) -> DataFrame:
    """SHARED rows: for each chunk the hashes that stand more than once in the corpus, and which more than `hot` times."""

    def run(t: pa.Table) -> pa.Table:
        per, counts = ([np.frombuffer(x.as_py(), kind) for x in t[c]] for c, kind in (("hashes", np.uint64), ("counts", np.uint16)))
        rows = [(t["chunk"][i].as_py(), per[i][at].tobytes(), np.packbits(many).tobytes()) for i, at, many in found_twice(per, counts, hot)]
        return table(SHARED, *(zip(*rows, strict=True) if rows else ([], [], [])))

    return by_group(found, "bucket", run, SHARED)


def _all(column, kind) -> np.ndarray:
    parts = [np.frombuffer(x, kind) for x in column.to_pylist() if x is not None]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def runs(docs: DataFrame, shared: DataFrame, n_buckets: int, size: int = SIZE, short: int = SHORT, gram: int = GRAM) -> DataFrame:
    """RUN rows: for each chunk and bucket its suffixes at shared anchors, sorted and front coded; and the hashes of the strings at hot ones."""
    width = -(-(1 << 64) // n_buckets)

    def run(t: pa.Table, other: pa.Table) -> pa.Table:
        wanted = _all(other["hashes"], np.uint64)
        if not len(wanted):
            return empty(RUN)
        bits = [np.unpackbits(np.frombuffer(h.as_py(), np.uint8), count=len(x.as_py()) // 8) for h, x in zip(other["hot"], other["hashes"], strict=True)]
        order = np.argsort(wanted)
        wanted, hot = wanted[order], np.concatenate(bits)[order].astype(bool)
        held: dict[int, list] = {}
        strings = []
        for _, part in text_steps(t["text"]):
            a = Anchors(part, size, short, gram)
            if not len(a.at):
                continue
            near = np.minimum(np.searchsorted(wanted, a.gram), len(wanted) - 1)
            raw = part.buf.tobytes()
            some = wanted[near] == a.gram
            apart = some & hot[near]
            if apart.any():
                strings += [a.strings(a.starts(apart, n, short), n) for n in {size, short}]
                some &= ~apart
            for at, low, high, stop, g, cls in zip(*(x[some].tolist() for x in (a.at, a.low, a.high, a.stop, a.gram, a.classes)), strict=True):
                if cls in held:
                    held[cls][4] = 1
                else:
                    held[cls] = [g // width, raw[at:stop], raw[low:at], cls, 0, high - low + 1]
        entries = sorted(held.values())
        chunk, out, i = t["chunk"][0].as_py(), ([], [], [], [], [], [], []), 0
        while i < len(entries):
            j = i
            while j < len(entries) and entries[j][0] == entries[i][0]:
                j += 1
            for column, v in zip(out, (entries[i][0], chunk, encode([tuple(e[1:]) for e in entries[i:j]]), None, None, None, None), strict=True):
                column.append(v)
            i = j
        if strings:
            for column, v in zip(out, (chunk % n_buckets, chunk, None, None, None, None, wanted[hot].tobytes()), strict=True):  # the chunk will ask for these grams' strings
                column.append(v)
            key, check = (np.concatenate(x) for x in zip(*strings, strict=True))
            order = np.lexsort((check, key))
            key, check = key[order], check[order]
            edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])))
            count = np.diff(np.append(edge, len(key)))
            key, check = key[edge], check[edge]
            edges = split_sorted(key, n_buckets)
            for i in range(n_buckets):
                part = slice(edges[i], edges[i + 1])
                if edges[i] < edges[i + 1]:
                    for column, v in zip(out, (i, chunk, None, key[part].tobytes(), check[part].tobytes(), np.packbits(count[part] > 1).tobytes(), None), strict=True):
                        column.append(v)
        return table(RUN, *out)

    return answer(docs, shared, run, RUN)


def _repeated(group: list[tuple], lengths: tuple[int, ...]):
    """For the members (number of the group, left, suffix, many, class, chunks, strings) of groups and each length: which strings of so many bytes are found twice in their group, as (which length, member, first, last) in strings from the neighbourhood's begin."""
    keys, counts, i = [[] for _ in lengths], [[] for _ in lengths], 0
    while i < len(group):  # a slice of the members at a time: of a large group only keys are held together
        j, held = i, 0
        while j < len(group) and (j == i or held < SLICE_BYTES):
            held += len(group[j][1]) + len(group[j][2])
            j += 1
        texts = [m[1] + m[2] for m in group[i:j]]
        length = np.array([len(x) for x in texts])
        begin = np.cumsum(length) - length
        prefix = prefix_hash(_BYTE_VALUES[np.frombuffer(b"".join(texts), np.uint8)])
        number, left, most = (np.array([f(m) for m in group[i:j]], np.int64) for f in (lambda m: m[0], lambda m: len(m[1]), lambda m: m[6]))
        for which, size in enumerate(lengths):
            count = np.clip(length - size + 1, 0, most)
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(begin, count) + inside
            place = np.repeat(number << 20, count) | (np.repeat(left, count) - inside + size)
            keys[which].append(mix(range_hash(prefix, start, start + size) ^ mix(place.astype(np.uint64))))
            counts[which].append(count)
        i = j
    for which in range(len(lengths)):
        key, count = np.concatenate(keys[which]), np.concatenate(counts[which])
        if not len(key):
            continue
        member = np.repeat(np.arange(len(group), dtype=np.int32), count)
        index = (np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        many = np.array([m[3] for m in group], np.int8)[member]
        order = np.argsort(key, kind="stable")
        k = key[order]
        edge = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        total = np.add.reduceat(1 + many[order], edge, dtype=np.int64)
        dup = np.zeros(len(key), bool)
        dup[order] = np.repeat(total > 1, np.diff(np.append(edge, len(k))))
        rise = np.flatnonzero(dup & np.append(True, ~dup[:-1] | (member[1:] != member[:-1])))
        fall = np.flatnonzero(dup & np.append(~dup[1:] | (member[1:] != member[:-1]), True))
        yield from zip(itertools.repeat(which), member[rise].tolist(), index[rise].tolist(), index[fall].tolist())


def merged(run_rows: DataFrame, size: int = SIZE, short: int = SHORT, gram: int = GRAM) -> DataFrame:
    """HITS rows: for each chunk its neighbourhoods (by class) in which strings of `size` bytes are found twice, and which; and those hashes of hot grams' strings that are found twice."""

    def run(t: pa.Table) -> pa.Table:
        out = ([], [], [], [], [], [])
        asked = t.filter(pc.is_valid(t["hot"]))
        for column, v in zip(out, (asked["chunk"].to_pylist(), *[[None] * asked.num_rows] * 4, asked["hot"].to_pylist()), strict=True):
            column.extend(v)
        apart = t.filter(pc.is_valid(t["strings"]))
        if apart.num_rows:
            per, checks = ([np.frombuffer(x.as_py(), np.uint64) for x in apart[c]] for c in ("strings", "checks"))
            counts = [1 + np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(h)) for m, h in zip(apart["many"], per, strict=True)]
            for i, at, _ in found_twice(per, counts, None, checks):
                for column, v in zip(out, (apart["chunk"][i].as_py(), None, None, per[i][at].tobytes(), checks[i][at].tobytes(), None), strict=True):
                    column.append(v)
        t = t.filter(pc.is_valid(t["run"]))
        if not t.num_rows:
            return table(HITS, *out)
        chunks = t["chunk"].to_pylist()
        got: dict[int, list] = {}

        def flush(batch):
            for which, i, x, y in _repeated(batch, (size, short)):
                for chunk in batch[i][5]:
                    got.setdefault(chunk, []).append((batch[i][4], which, x, y))

        batch, group, held, number = [], [], 0, 0
        tree = LoserTree([decode(x.as_py()) for x in t["run"]])

        def close():
            nonlocal held
            if len(group) > 1 or group and group[0][3]:
                batch.extend(group)
                held += sum(len(m[1]) + len(m[2]) for m in group)
            group.clear()

        for same, source, (_, suffix, left, cls, many, n) in tree:
            if same < gram:
                close()
                number += 1
                if held > SLICE_BYTES:
                    flush(batch)
                    batch, held = [], 0
                seen: dict[int, int] = {}
            if cls in seen:  # the same neighbourhood from another chunk
                one = group[seen[cls]]
                one[3] = 1
                one[5].append(chunks[source])
            else:
                seen[cls] = len(group)
                group.append([number, left, suffix, many, cls, [chunks[source]], n])
        close()
        if batch:
            flush(batch)
        for chunk, rows in got.items():
            out[0].append(chunk)
            out[1].append(np.array([r[0] for r in rows], np.uint64).tobytes())
            out[2].append(np.array([r[1:] for r in rows], np.uint16).tobytes())
            out[3].append(None)
            out[4].append(None)
            out[5].append(None)
        return table(HITS, *out)

    return by_group(run_rows, "bucket", run, HITS)


def rebuilt(docs: DataFrame, hits: DataFrame, size: int = SIZE, short: int = SHORT, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """Per document n_bytes, n_removed, n_spans, the digest of the kept bytes, n_repeated, and (with_text) the kept bytes."""
    ddl = OUT + (",kept binary" if with_text else "")

    def run(t: pa.Table, other: pa.Table) -> pa.Table:
        cls, spans = _all(other["classes"], np.uint64), _all(other["spans"], np.uint16).reshape(-1, 3).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        cls, spans = cls[order], spans[order]
        strings, checks = _all(other["strings"], np.uint64), _all(other["checks"], np.uint64)
        order = np.lexsort((checks, strings))
        strings, checks = strings[order], checks[order]
        hot = np.sort(_all(other["hot"], np.uint64))
        deep = int((np.arange(len(strings)) - np.searchsorted(strings, strings)).max(initial=0)) + 1  # 1, but where first hashes collide
        rows = ([], [], [], [], [])
        texts = []
        for _, part in text_steps(t["text"]):
            gone, twin = np.zeros(len(part.buf), bool), np.zeros(len(part.buf), bool)
            if len(cls) or len(strings):
                a = Anchors(part, size, short, gram)
                first, last = np.searchsorted(cls, a.classes, "left"), np.searchsorted(cls, a.classes, "right")
                n = last - first
                which = np.repeat(np.arange(len(n)), n)
                hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                apart = np.isin(a.gram, hot) if len(strings) else np.zeros(len(a.at), bool)
                for kind, length, flags in ((0, size, gone), (1, short, twin)):
                    diff = np.zeros(len(part.buf) + 1, np.int32)
                    if apart.any():
                        start = a.starts(apart, length, short)
                        key, check = a.strings(start, length)
                        at, found = np.searchsorted(strings, key), np.zeros(len(key), bool)
                        for k in range(deep):
                            p = np.minimum(at + k, len(strings) - 1)
                            found |= (strings[p] == key) & (checks[p] == check)
                        np.add.at(diff, start[found], 1)
                        np.add.at(diff, start[found] + length, -1)
                    mine = spans[hit, 0] == kind
                    np.add.at(diff, a.low[which[mine]] + spans[hit[mine], 1], 1)
                    np.add.at(diff, a.low[which[mine]] + spans[hit[mine], 2] + length, -1)
                    flags |= np.cumsum(diff[:-1]) > 0
            for i, j in zip(part.begin.tolist(), part.end.tolist(), strict=True):
                kept, n_spans, g = part.buf[i:j], 0, gone[i:j]
                if g.any():
                    n_spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                    kept = kept[~g]
                raw = kept.tobytes()
                for column, v in zip(rows, (j - i, j - i - len(raw), n_spans, hashlib.sha256(raw).hexdigest(), int(twin[i:j].sum())), strict=True):
                    column.append(v)
                if with_text:
                    texts.append(raw)
        return table(ddl, t["doc_id"], *rows, *([texts] if with_text else []))

    return answer(docs, hits, run, ddl)


def dedup(docs: DataFrame, size: int = SIZE, gram: int = GRAM, with_text: bool = False, hot: int = HOT, short: int | None = None) -> DataFrame:
    """Per document what goes by strings of `size` bytes, and how many bytes strings of `short` (SHORT, or `size` where that is less) bytes repeat."""
    short = min(size, SHORT) if short is None else short
    if not 8 <= gram < short <= size:
        raise ValueError("a gram is shorter than a short string, which isn't longer than a string")
    total = text_bytes(docs)
    n_buckets = buckets_for(docs.sparkSession, total, 6 << 20)
    dealt = chunked(docs, total=total)
    shared = twice(grams(dealt, n_buckets, size, short, gram), hot)
    return rebuilt(dealt, merged(runs(dealt, shared, n_buckets, size, short, gram), size, short, gram), size, short, gram, with_text)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
