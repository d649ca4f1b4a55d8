"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

A byte goes if a window of WINDOW bytes covers it that also starts earlier (in a document of smaller
id, or earlier in the same one). Not every suffix is moved between machines: every window names one
anchor, the leftmost of its GRAM-byte strings with the least hash. Equal windows have their anchors
at the same offset, so windows are compared through their anchors' suffixes.

1. Texts are reduced to distinct ones (later copies are repeated as a whole) and dealt to parts of
   about PART_BYTES, a bucketed table in the shared folder.
2. First digit: the anchors' GRAM-byte strings are counted over all parts; each part sends each of its
   values once. Suffixes whose first digit occurs once hold no repeated window and are done.
3. Each part sorts the suffixes that are left, through the window's depth only, by most-significant-digit
   passes of 8 bytes (digits after the anchor, and the mirrored ones before it). At each offset the groups that are
   equal on both sides are exactly the repeated windows; all but the earliest are marked. Windows that
   are first within their part go on, with the bytes around their anchor.
4. What parts send is sorted again in the same way, grouped by first digit. A first digit with more than
   HOT occurrences is not gathered: its windows go one by one with their bytes, dealt by a hash of them, in order of documents
   and places, and compared byte by byte with the first as they pass. Equal windows have one row for each part at most, and none is held.
5. The marked ranges return to their part, where they are merged and cut.

In text of a period of PERIOD bytes or less (a long line of dashes) windows that repeat the one just before them are marked before
anything is sorted, so such text takes no more memory than other text. A part holds one text at least, and some 30 bytes of anchors'
rows for each of its bytes.

Cases: null texts count as empty; texts shorter than the window lose nothing; null ids come after all
others; of different texts under one id the one with the smaller digest comes first; rows equal in id and text
are one document, whose result each gets (without_repeats() returns one of them); an empty table gives no rows; columns
of any name travel inside a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_table, quoted, ship

WINDOW, GRAM = 100, 32
#: Bytes of text in one part, parts in one bucket of the table, occurrences from which a first digit is hot.
PART_BYTES, PER_BUCKET, HOT = 1 << 20, 8, 20_000
#: Buckets of the table at most (Spark takes no more than 100,000); of more text each holds more parts, which are still taken one by one.
MOST_BUCKETS = 1 << 16
#: Parts at most, as their numbers have 32 bits; beyond (2 PB) parts grow.
MOST_PARTS = (1 << 31) - 1
#: Positions that are hashed at once; periods up to which repeats of the text just before are told without sorting.
CHUNK, PERIOD = 1 << 19, 16
NO_ID = (1 << 63) - 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_C = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x27BB2EE687B0B0FD)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _C[0]
    x ^= x >> np.uint64(29)
    x *= _C[1]
    x ^= x >> np.uint64(32)
    return x


def _hash(data: np.ndarray, length: int, salt: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` bytes, put together from runs of powers of two, each level with a constant of its own."""
    runs = {1: _mix(data.astype(np.uint64) + np.uint64(salt))}
    n = 1
    while 2 * n <= length:
        h = runs[n]
        runs[2 * n] = h[:-n] * _C[(n.bit_length() + salt) % len(_C)] + h[n:]
        n *= 2
    out, done = runs[n], n
    if done < length:  # the last run overlaps
        shift = length - done
        out = out[: len(out) - shift] * _C[salt % len(_C)] + out[shift:]
    return _mix(out)


def periodic(data: np.ndarray, valid: np.ndarray, begin: int, end: int, window: int) -> np.ndarray:
    """Starts in [begin, end) of windows that repeat the one that starts PERIOD bytes or less before them in the same document."""
    a = max(0, begin - PERIOD)
    piece, out = data[a : end + window - 1], np.zeros(end - begin, bool)
    for p in range(1, min(PERIOD, window - 1) + 1):
        equal = np.concatenate([[0], np.cumsum(piece[p:] == piece[:-p], dtype=np.int32)])
        s = a + p + np.flatnonzero(equal[window:] - equal[:-window] == window)
        s = s[(s >= begin) & (s < end)]
        # documents lie window - 1 starts apart, so two valid starts this near are of one document
        out[s[valid[s] & valid[s - p]] - begin] = True
    return begin + np.flatnonzero(out)


def anchors(data: np.ndarray, valid: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share their anchor: (anchor, first start, last start, first digit). valid: where windows may start.

    In text of a short period nearly every window has an anchor of its own. There, windows that repeat one just before them are left out;
    they are told last. The earliest of equal windows is never among them, so they can be marked at once and all others judged without them.
    """
    span = window - gram + 1
    parts, told = [], [np.empty(0, np.int64)]
    for c in range(0, len(data), CHUNK):
        on = np.flatnonzero(valid[c : c + CHUNK])
        if not len(on):
            continue
        piece = data[c : c + CHUNK + window - 1]
        if len(piece) < window:
            continue
        h = _hash(piece, gram, 0)
        least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= span:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < span:
            least = np.minimum(least[: len(least) - (span - n)], least[span - n :])
        at = (least[on] & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (on[1:] != on[:-1] + 1)])
        if np.count_nonzero(new) * PERIOD > len(on):
            told.append(periodic(data, valid, c, min(c + CHUNK, len(data)), window))
            left = ~np.isin(on, told[-1] - c)
            on, at = on[left], at[left]
            if not len(on):
                continue
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (on[1:] != on[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(on)]]) - 1
        parts.append((at[first] + c, on[first] + c, on[last] + c, h[at[first]]))
    if not parts:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.concatenate(told))
    return (*(np.concatenate(x) for x in zip(*parts, strict=True)), np.concatenate(told))


def radix(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes of 8 bytes over rows (n, width): their order, and how many bytes each shares with the one before."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    digits = padded.view(">u8").astype(np.uint64)
    rank = np.zeros(n, np.int64)  # place of the first row of each group
    active = np.arange(n)
    for d in range(digits.shape[1]):
        if not len(active):
            break
        order = np.lexsort((digits[active, d], rank[active]))
        active = active[order]
        r, x = rank[active], digits[active, d]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        new = new_group | np.concatenate([[True], x[1:] != x[:-1]])
        begin = np.maximum.accumulate(np.where(new_group, np.arange(len(active)), 0))
        place = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
        rank[active] = r + place - begin
        sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(active)]]))
        active = active[np.repeat(sizes > 1, sizes)]
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    if n > 1:
        for a in range(1, n, 65536):
            differ = rows[order[a : a + 65536]] != rows[order[a - 1 : min(n, a + 65536) - 1]]
            shared[a : a + 65536] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, shared


def repeated(context: np.ndarray, mask: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Which windows repeat an earlier one. Rows stand in order of their occurrence.

    context: (n, before + after) bytes around each anchor, `before` bytes before it; mask (n, before + 1): column i
    is the window that starts i bytes before the anchor, if it is to be judged.
    """
    n, offsets = mask.shape
    before = offsets - 1
    out = np.zeros_like(mask)
    if n < 2:
        return out
    order_r, shared_r = radix(context[:, before:])
    order_l, shared_l = radix(np.ascontiguousarray(context[:, before - 1 :: -1]) if before else np.zeros((n, 1), np.uint8))
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(offsets):
        on = np.flatnonzero(mask[:, i])
        if len(on) < 2:
            continue
        right[order_r] = np.cumsum(shared_r < gram + before - i)
        left[order_l] = np.cumsum(shared_l < i) if i else 0
        key = right[on] * (n + 1) + left[on]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        out[on, i] = first[inverse] != np.arange(len(on))
    return out


def spans_of(dup: np.ndarray, anchor: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that a row's marked windows cover; they all hold its anchor, so they touch."""
    row = np.flatnonzero(dup.any(axis=1))
    lo = dup[row].argmax(axis=1)
    hi = dup.shape[1] - 1 - dup[row][:, ::-1].argmax(axis=1)
    return row, anchor[row] - hi, anchor[row] - lo + window


class Part:
    """The distinct texts of one part, in one buffer, in order of (id, hash)."""

    def __init__(self, table: pa.Table, window: int = WINDOW):
        least: dict[bytes, int] = {}
        place: dict[bytes, int] = {}
        texts: dict[bytes, bytes] = {}
        for at, (sha, i, x) in enumerate(zip(table["sha"].to_pylist(), table["id"].to_pylist(), table["text"].to_pylist(), strict=True)):
            rank = NO_ID if i is None else i
            if sha not in least or rank < least[sha]:
                least[sha], place[sha] = rank, at
            if x is not None:
                texts[sha] = x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x
        self.shas = sorted(texts, key=lambda s: (least[s], s))
        self.ids = np.array([least[s] for s in self.shas], np.int64)
        self.places = [place[s] for s in self.shas]
        self.ties = np.array([int.from_bytes(s[:8], "big") >> 1 for s in self.shas], np.int64)
        sizes = np.array([len(texts[s]) for s in self.shas], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"".join(texts[s] for s in self.shas), np.uint8)
        self.window = window

    def valid(self) -> np.ndarray:
        ok = np.ones(len(self.data), bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            ok[max(a, b - self.window + 1) : b] = False
        return ok

    def of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")


def _batch(columns: dict, schema: pa.Schema) -> pa.Table:
    n = max(len(v) for v in columns.values())
    return pa.table({f.name: pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema}, schema=schema)


FIRST = "part int, h long, n long"
MOVED = "g long, part int, doc int, start long, stop long, id long, tie long, window binary, mask binary, context binary"
_MOVED = pa.schema([("g", pa.int64()), ("part", pa.int32()), ("doc", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("window", pa.binary()), ("mask", pa.binary()), ("context", pa.binary())])
SPANS = "part int, doc int, start long, stop long"


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes (n, width) as a binary array, without a Python object for each."""
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if n else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _first_digits(window: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        p = Part(table, window)
        h = anchors(p.data, p.valid(), window, gram)[3]
        values, n = np.unique(h, return_counts=True)
        return pa.table({"part": pa.array(np.full(len(values), table["part"][0].as_py(), np.int32)), "h": pa.array(values.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def _sort_part(window: int, gram: int):
    before = window - gram

    def run(texts: pa.Table, counted: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _MOVED.empty_table()
        part, p = texts["part"][0].as_py(), Part(texts, window)
        a, lo, hi, h, near = anchors(p.data, p.valid(), window, gram)
        out = []
        if len(near):
            cuts = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1] + 1, [True]]))
            start, stop = near[cuts[:-1]], near[cuts[1:] - 1] + window
            d = p.of(start)
            out.append(_batch({"g": start * 1_000_003, "part": np.full(len(d), part), "doc": d, "start": start - p.starts[d], "stop": stop - p.starts[d]}, _MOVED))
        if not counted.num_rows:
            return pa.concat_tables([_MOVED.empty_table(), *out])
        known = counted["h"].to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, hot, elsewhere = known[order], counted["hot"].to_numpy()[order], counted["elsewhere"].to_numpy()[order]
        k = np.minimum(np.searchsorted(known, h), len(known) - 1)
        keep = known[k] == h
        a, lo, hi, h, k = a[keep], lo[keep], hi[keep], h[keep], k[keep]
        data = np.concatenate([np.zeros(before, np.uint8), p.data, np.zeros(window, np.uint8)])
        context = np.lib.stride_tricks.sliding_window_view(data, before + window)[a]
        back = np.arange(before + 1)
        mask = (back >= (a - hi)[:, None]) & (back <= (a - lo)[:, None])
        dup = repeated(context, mask, gram)
        doc = p.of(a)
        row, start, stop = spans_of(dup, a, window)
        out += [_batch({"g": (start * 31 + row) * 1_000_003, "part": np.full(len(row), part), "doc": doc[row], "start": start - p.starts[doc[row]], "stop": stop - p.starts[doc[row]]}, _MOVED)]
        left = mask & ~dup & elsewhere[k][:, None]
        some = left.any(axis=1)
        row = np.flatnonzero(some & ~hot[k])
        if len(row):
            d = doc[row]
            out.append(_batch({"g": h[row].view(np.int64), "part": np.full(len(row), part), "doc": d, "start": a[row] - p.starts[d], "id": p.ids[d], "tie": p.ties[d], "mask": _fixed(np.packbits(left[row], axis=1)), "context": _fixed(context[row])}, _MOVED))
        row = np.flatnonzero(some & hot[k])
        if len(row):
            r, i = np.nonzero(left[row])
            at, d = a[row][r] - i, doc[row][r]
            one = np.concatenate([_hash(p.data[c : c + CHUNK + window - 1], window, 1) for c in range(0, max(1, len(p.data) - window + 1), CHUNK)])
            out.append(_batch({"g": one[at].view(np.int64), "part": np.full(len(at), part), "doc": d, "start": at - p.starts[d], "id": p.ids[d], "tie": p.ties[d], "window": _fixed(np.lib.stride_tricks.sliding_window_view(p.data, window)[at])}, _MOVED))
        return pa.concat_tables(out)

    return run


class Again:
    """Tells which windows have come before, of rows in order of (hash, rank); holds one window of a hash, and those that share its hash."""

    def __init__(self, window: int):
        self.g = np.empty(0, np.int64)
        self.first = np.empty((0, window), np.uint8)
        self.others: set[tuple[int, bytes]] = set()

    def of(self, g: np.ndarray, windows: np.ndarray) -> np.ndarray:
        held = len(self.g)
        g, windows = np.concatenate([self.g, g]), np.concatenate([self.first, windows])
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        lead = np.repeat(begin, np.diff(np.concatenate([begin, [len(g)]])))
        same = (windows == windows[lead]).all(axis=1)
        again = same & (lead != np.arange(len(g)))
        for k in np.flatnonzero(~same).tolist():
            key = int(g[k]), windows[k].tobytes()
            again[k] = key in self.others
            self.others.add(key)
        self.g, self.first = g[begin[-1:]], windows[begin[-1:]]
        self.others = {x for x in self.others if x[0] == int(g[-1])}
        return again[held:]


def _sort_moved(window: int, gram: int):
    """Rows come sorted by (g, id, tie, start); g never parts equal windows.

    Suffixes of one g are judged together, `hot` of them at most. Windows are judged as they pass, however many are equal.
    """
    before = window - gram

    def out(part, doc, start, stop):
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(doc, pa.int32()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["part", "doc", "start", "stop"])

    def judge(around: pa.Table) -> Iterator[pa.RecordBatch]:
        if around.num_rows > 1:
            at, ident, tie = (around[c].to_numpy() for c in ("start", "id", "tie"))
            order = np.lexsort((at, tie, ident))
            context = np.frombuffer(b"".join(around["context"].to_pylist()), np.uint8).reshape(-1, before + window)[order]
            mask = np.unpackbits(np.frombuffer(b"".join(around["mask"].to_pylist()), np.uint8).reshape(around.num_rows, -1), axis=1, count=before + 1)[order].astype(bool)
            at, part, doc = at[order], around["part"].to_numpy()[order], around["doc"].to_numpy()[order]
            row, start, stop = spans_of(repeated(context, mask, gram), at, window)
            yield out(part[row], doc[row], start, stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        passed = Again(window)
        for b in batches:
            t = pa.Table.from_batches([b])
            no_context, no_window = t["context"].is_null().to_numpy(), t["window"].is_null().to_numpy()
            done = t.filter(pa.array(no_context & no_window))
            if done.num_rows:
                yield from done.select(["part", "doc", "start", "stop"]).combine_chunks().to_batches()
            single = t.filter(pa.array(~no_window))
            if single.num_rows:
                again = passed.of(single["g"].to_numpy(), np.frombuffer(b"".join(single["window"].to_pylist()), np.uint8).reshape(-1, window))
                if again.any():
                    at = single["start"].to_numpy()[again]
                    yield out(single["part"].to_numpy()[again], single["doc"].to_numpy()[again], at, at + window)
            t = t.filter(pa.array(~no_context))
            if not t.num_rows:
                continue
            g = t["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if held and not (cut == 0 and held[-1]["g"][-1].as_py() == g[-1]):
                yield from judge(pa.concat_tables([*held, t.slice(0, cut)]))
                held = [t.slice(cut)]
            elif held:
                held.append(t)
            else:
                if cut:
                    yield from judge(t.slice(0, cut))
                held = [t.slice(cut)]
        if held:
            yield from judge(pa.concat_tables(held))

    return run


CUT = "sha binary, id long, n_removed long, n_spans long, kept_sha256 string"


def _cut_part(window: int, with_text: bool):
    def run(texts: pa.Table, spans: pa.Table) -> pa.Table:
        p = Part(texts, window)
        size = int(p.ends[-1]) if len(p.ends) else 0
        edge = np.zeros(size + 1, np.int64)
        if spans.num_rows:
            base = p.starts[spans["doc"].to_numpy()]
            np.add.at(edge, base + spans["start"].to_numpy(), 1)
            np.add.at(edge, base + spans["stop"].to_numpy(), -1)
        gone = np.cumsum(edge)[:-1] > 0
        rows = {c: [] for c in ("sha", "id", "n_removed", "n_spans", "kept_sha256", "kept")}
        for sha, i, a, b in zip(p.shas, p.ids.tolist(), p.starts.tolist(), p.ends.tolist(), strict=True):
            g = gone[a:b]
            n = int(np.count_nonzero(g))
            rest = p.data[a:b][~g].tobytes() if n else p.data[a:b].tobytes()
            kept = rest.decode("utf-8", "ignore") if with_text else None
            for c, v in (("sha", sha), ("id", None if i == NO_ID else i), ("n_removed", n), ("n_spans", int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if n else 0), ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("kept", kept)):
                rows[c].append(v)
        kinds = {"sha": pa.binary(), "kept_sha256": pa.string(), "kept": pa.string()}
        out = {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()}
        if not with_text:
            del out["kept"]
            return pa.table(out)
        return pa.table(out | {"rest": texts["rest"].take(pa.array(p.places, pa.int64()))})

    return run


def _distinct(parts: int, window: int, with_rest: bool):
    """Drops what a task has seen: a text goes on once, and a later copy only with a smaller id (without the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            out = {"part": [], "sha": [], "id": [], "text": []}
            kept = []
            for at, (i, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                raw = x.as_buffer()
                if raw is None or raw.size < window:
                    continue
                sha, rank = hashlib.sha256(raw).digest(), NO_ID if i is None else i
                if sha in seen and seen[sha] <= rank:
                    continue
                for c, v in (("part", int.from_bytes(sha[8:16], "big") % parts), ("sha", sha), ("id", i), ("text", None if sha in seen else x.as_py())):
                    out[c].append(v)
                seen[sha] = rank
                kept.append(at)
            columns = [pa.array(out["part"], pa.int32()), pa.array(out["sha"], pa.binary()), pa.array(out["id"], pa.int64()), pa.array(out["text"], pa.string())]
            if with_rest:
                columns.append(b.column(2).take(pa.array(kept, pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*out, *["rest"] * with_rest])

    return run


def _schema(told: str, more: list[T.StructField]) -> T.StructType:
    return T.StructType([*T._parse_datatype_string(told).fields, *more])


def _loose(docs: DataFrame, names: list[str]) -> T.StructType:
    """The type of a struct of these columns, each of which may be null, as they are once they have been stored."""

    def loose(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, loose(f.dataType)) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(loose(kind.elementType))
        return T.MapType(kind.keyType, loose(kind.valueType)) if isinstance(kind, T.MapType) else kind

    return T.StructType([T.StructField(c, loose(docs.schema[c].dataType)) for c in names])


def layout(total: int, part_bytes: int = PART_BYTES, most_buckets: int = MOST_BUCKETS) -> tuple[int, int]:
    """Into how many parts `total` bytes of text are dealt, and how many buckets hold these."""
    parts = min(MOST_PARTS, max(1, -(-total // part_bytes)))
    return parts, min(most_buckets, -(-parts // PER_BUCKET))


def distinct_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, rest: list[str] | None = None, part_bytes: int = PART_BYTES, hot: int = HOT, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """One row for each distinct text of window bytes or more: sha, id (its smallest), n_removed, n_spans, kept_sha256.

    rest: names of columns; then also kept (the text without what repeats, and without characters that a cut broke) and
    rest (these columns of the row with the smallest id).
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(quoted(key).cast("long").alias("id"), quoted(text).alias("text"), *([F.struct(*[quoted(c).alias(c) for c in rest]).cast(_loose(docs, rest)).alias("rest")] if rest else []))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts, buckets = layout(total, part_bytes, most_buckets)
    where = new_table(spark, "texts")
    name = "corvane_" + where.rpartition("-")[2]
    more = [rows.schema["rest"]] if rest else []
    distinct = rows.mapInArrow(_distinct(parts, window, bool(rest)), _schema("part int, sha binary, id long, text string", more))
    distinct.repartition(buckets, "part").write.bucketBy(buckets, "part").sortBy("part").option("path", where).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    plain = texts.select("part", "sha", "id", "text")
    first = plain.groupBy("part").applyInArrow(_first_digits(window, gram), FIRST)
    counted = first.withColumn("all", F.sum("n").over(W.partitionBy("h"))).where("all > 1")
    counted = counted.select("part", "h", (F.col("all") > hot).alias("hot"), (F.col("all") > F.col("n")).alias("elsewhere"))
    moved = plain.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(_sort_part(window, gram), MOVED)
    spans = moved.repartition(F.col("g")).sortWithinPartitions("g", "id", "tie", "start").mapInArrow(_sort_moved(window, gram), SPANS)
    return texts.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_cut_part(window, bool(rest)), _schema(CUT + ", kept string" * bool(rest), more))


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **more) -> DataFrame:
    """Of every row: id, n_bytes, n_removed, n_spans, kept_sha256. Texts stay where they are; digests find each row's result."""
    found = distinct_texts(docs, key, text, window, **more).withColumnRenamed("id", "first_id")
    body = F.coalesce(quoted(text), F.lit("")).cast("binary")
    rows = docs.select(quoted(key).cast("long").alias("id"), F.unhex(F.sha2(body, 256)).alias("sha"), F.octet_length(body).cast("long").alias("n_bytes"))
    rows = rows.join(found, "sha", "left")
    short, first = F.col("n_bytes") < window, F.col("id").eqNullSafe(F.col("first_id"))
    return rows.select(
        "id",
        "n_bytes",
        F.when(short, F.lit(0)).when(first, F.col("n_removed")).otherwise(F.col("n_bytes")).cast("long").alias("n_removed"),
        F.when(short, F.lit(0)).when(first, F.col("n_spans")).otherwise(F.lit(1)).cast("long").alias("n_spans"),
        F.when(short, F.lower(F.hex("sha"))).when(first, F.col("kept_sha256")).otherwise(F.lit(EMPTY_SHA)).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, **more) -> DataFrame:
    """docs' columns, with repeats cut out of the texts; rows of which nothing is left go, such as all later copies."""
    rest = [c for c in docs.columns if c != text]
    found = distinct_texts(docs, key, text, window, rest=rest, **more).where("kept <> ''")
    kept = found.select(*[F.col("kept").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns])
    # shorter texts can't repeat a window
    return kept.unionByName(docs.where(F.coalesce(F.octet_length(quoted(text)), F.lit(0)) < window))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


ORACLE_OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM again)) GROUP BY doc_id, run),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS left_part, max(b) AS last, sum(b - a) AS gone, count(*) AS n_spans
  FROM (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(left_part, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
