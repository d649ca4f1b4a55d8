"""Toxicity scores by a convolutional text classifier, trained in numpy by tasks that share the labelled rows among them.

A word's embedding is the sum of hashed ones: of the whole word and of its first 3 to 6 characters.
Filters of widths 1, 2 and 3 run over the words, each filter's greatest value over the text goes
through a rectifier into a logistic output. The embeddings start from the words' smoothed log-odds and noise.
All labelled rows that may teach are used, whole: by a hash of their words four fifths teach the net, and one fifth the thresholds.
The log-odds are counted over all of the former. These are then dealt by hash into parts of some PART_BYTES; each part is learned
from by Adagrad on its own, and the changes are averaged, for each embedding over the parts that changed it. How rows lie in
files or partitions doesn't matter.

On the other fifth a threshold is chosen for each language, as predicted from the text by langid, and scores are shifted so that each
language's threshold lies at 0.3. Their logits are counted in steps of 1 / STEPS, so no rows go to the driver.

Cases: null and empty texts, and texts without words, get the score of the padding alone; if the rows to learn
from lack one label, every text gets the share of label 1 (0 without rows); repeated rows get equal scores;
an empty table gives no rows; a label row without a document, or one document's several labels, are used as
they join; other columns aren't read. If either share of the rows lacks a label, all rows teach both net and thresholds, these for all
languages together. Texts of any length teach and are scored whole; a text above TEXT_BYTES is a step of training of its own.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid
from .common import added, cut, few, quoted, ship

#: Bytes of a step of training, and of a part that is learned from on its own.
TEXT_BYTES, PART_BYTES, SEED = 256 << 10, 8 << 20, 11
#: Passes over the rows if they are one part; more parts make fewer each, one at least.
PASSES = 6
#: Logits are counted in steps of 1 / STEPS up to SPAN on either side.
STEPS, SPAN = 128, 64
#: Buckets and size of embeddings, filters of each width, first characters that are hashed too.
BUCKETS, SIZE, FILTERS, WIDTHS, PREFIXES = 1 << 15, 8, 6, (1, 2, 3), (3, 4, 5, 6)
CUTOFF = 0.3
CHUNK = 1 << 20

#: A-Z in lower case; every other ASCII character but 0-9 and a-z parts words.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def hashes(word: bytes) -> list[int]:
    """Buckets of a word: its own and those of its first characters; 0 is the padding's."""
    s = word.decode("utf-8", "replace")
    return [1 + zlib.crc32(word) % (BUCKETS - 1)] + [1 + zlib.crc32(s[:n].encode(), n) % (BUCKETS - 1) if len(s) > n else 0 for n in PREFIXES]


#: CRC-32's table, and for each prefix the difference that its seed makes after so many bytes, whatever they are.
_CRC = np.array([zlib.crc32(bytes([255 ^ b])) ^ 0xFF000000 for b in range(256)], np.uint32)
_SEEDS = np.array([[zlib.crc32(bytes(k), n) ^ zlib.crc32(bytes(k)) for k in range(4 * n + 1)] + [0] * 4 * (max(PREFIXES) - n) for n in PREFIXES], np.uint32)
#: Words that are hashed at once, and texts whose buckets are marked at once.
BLOCK, MARKED = 1 << 16, 64


def hashed(words: list[bytes]) -> np.ndarray:
    """(len(words), 1 + len(PREFIXES)): hashes() of every word. The words are not empty, and valid UTF-8."""
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.int64)
    most = 4 * max(PREFIXES)  # bytes of the longest prefix
    for i in range(0, len(words), BLOCK):
        some, own = words[i : i + BLOCK], out[i : i + BLOCK]
        own[:, 0] = 1 + np.fromiter(map(zlib.crc32, some), np.int64, len(some)) % (BUCKETS - 1)
        some = [w[: most + 1] for w in some]  # the byte after a prefix says that the word goes on
        data = np.frombuffer(b"".join(some) + bytes(most), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
        starts = np.concatenate([[0], ends[:-1]])
        chars = np.flatnonzero((data & 0xC0) != 0x80)  # where a character starts
        first = np.searchsorted(chars, starts)
        rows = [np.flatnonzero(chars[first + n] < ends) for n in PREFIXES]
        sizes = [chars[first[r] + n] - starts[r] for r, n in zip(rows, PREFIXES, strict=True)]
        state = np.full((1 + max(int(z.max(initial=0)) for z in sizes), len(some)), 0xFFFFFFFF, np.uint32)
        for k in range(len(state) - 1):
            state[k + 1] = _CRC[(state[k] ^ data[starts + k]) & 0xFF] ^ (state[k] >> np.uint32(8))
        for p, (r, z) in enumerate(zip(rows, sizes, strict=True)):
            own[r, 1 + p] = 1 + (~state[z, r] ^ _SEEDS[p, z]).astype(np.int64) % (BUCKETS - 1)
    return out


class Batch:
    """Texts as numbers of distinct words; each text is followed by padding as long as the widest filter less one, and has one word at least."""

    def __init__(self, lists: list[list[bytes]]):
        said = list(itertools.chain.from_iterable(lists))
        words = list(dict.fromkeys(said))
        number = dict(zip(words, range(1, len(words) + 1), strict=True))
        pad = max(WIDTHS) - 1
        many = np.array([len(ws) for ws in lists], np.int64)
        size = np.maximum(many, 1) + pad
        self.starts = np.cumsum(size) - size
        self.ends = self.starts + size - pad
        self.ids = np.zeros(int(size.sum()), np.int64)
        self.ids[np.arange(len(said)) + np.repeat(self.starts - (np.cumsum(many) - many), many)] = np.fromiter(map(number.__getitem__, said), np.int64, len(said))
        self.of = np.concatenate([np.zeros((1, 1 + len(PREFIXES)), np.int64), hashed(words)])
        self.text = np.repeat(np.arange(len(lists)), size)


class Net:
    """Embeddings, filters and output; one forward pass serves training and scoring."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.emb = (rng.standard_normal((BUCKETS, SIZE)) * 0.02).astype(np.float32)
        self.emb[0] = 0
        self.kernel = [(rng.standard_normal((w, SIZE, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
        for k in self.kernel:
            k[:, 0, :] = 0.6
        self.shift = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
        self.bias = np.float32(-1.0)

    def pooled(self, b: Batch, where: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Greatest value of each filter over each text (and its place), and the distinct words' embeddings."""
        own = self.emb[b.of].sum(axis=1)
        best, at = [], []
        n = len(b.ids)
        for k, w in zip(self.kernel, WIDTHS, strict=True):
            z = np.zeros((n, FILTERS), np.float32)
            for d in range(w):
                z[: n - d] += (own @ k[d])[b.ids[d:]]
            dead = np.zeros(n, bool)
            for d in range(max(WIDTHS) - 1):
                dead[b.ends + d] = True
            z[dead] = -1e9
            top = np.maximum.reduceat(z, b.starts, axis=0)
            best.append(top)
            if where:
                hit = z == top[b.text]
                last = np.zeros((len(b.starts), FILTERS), np.int64)
                for f in range(FILTERS):
                    k = np.flatnonzero(hit[:, f])
                    last[b.text[k], f] = k  # the last place of several
                at.append(last)
        return np.concatenate(best, axis=1), np.concatenate(at, axis=1) if where else None, own

    def logits(self, b: Batch) -> np.ndarray:
        top, _, _ = self.pooled(b, False)
        return np.maximum(top + self.shift, 0).astype(np.float64) @ self.out.astype(np.float64) + float(self.bias)

    def learn(self, lists: list[list[bytes]], y: np.ndarray, passes: int = PASSES, rate: float = 0.05, size: int = 64, seed: int = SEED, toxic: float | None = None) -> None:
        """Adagrad on cross-entropy, both labels weighing alike. toxic: the share of label 1 in all rows, if these aren't all."""
        rng = np.random.default_rng(seed)
        toxic = y.mean() if toxic is None else toxic
        share = np.where(y > 0, 0.5 / max(toxic, 1e-9), 0.5 / max(1 - toxic, 1e-9))
        batches = []
        order = rng.permutation(len(lists)).tolist()
        while order:
            rows, held = [], 0
            while order and len(rows) < size and (not rows or held + len(lists[order[-1]]) <= TEXT_BYTES // 4):
                rows.append(order.pop())
                held += len(lists[rows[-1]])
            batches.append((Batch([lists[r] for r in rows]), y[rows], share[rows]))
        seen = {"emb": np.full((BUCKETS, SIZE), 1e-2, np.float32), "kernel": [np.full_like(k, 1e-2) for k in self.kernel], "shift": np.full_like(self.shift, 1e-2), "out": np.full_like(self.out, 1e-2), "bias": 1e-2}

        def step(value, grad, past):
            past += grad * grad
            value -= rate * grad / np.sqrt(past)

        for _ in range(passes):
            for k in rng.permutation(len(batches)):
                b, t, share_b = batches[k]
                top, at, own = self.pooled(b, True)
                act = np.maximum(top + self.shift, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.bias, -30, 30)))
                g = ((p - t) * share_b / len(t)).astype(np.float32)
                back = np.where(top + self.shift > 0, g[:, None] * self.out, 0).astype(np.float32)
                rows, grads = [], []
                changes = []
                for j, w in enumerate(WIDTHS):
                    cols = slice(j * FILTERS, (j + 1) * FILTERS)
                    gk = np.zeros_like(self.kernel[j])
                    for d in range(w):
                        word = b.ids[np.minimum(at[:, cols] + d, len(b.ids) - 1)]
                        e = own[word]
                        gk[d] = np.einsum("nf,nfs->sf", back[:, cols], e)
                        rows.append(word.ravel())
                        grads.append((back[:, cols][:, :, None] * self.kernel[j][d].T[None]).reshape(-1, SIZE))
                    changes.append(gk)
                word, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(word), SIZE), np.float32)
                np.add.at(total, inverse, np.concatenate(grads))
                bucket = b.of[word]
                flat, inverse = np.unique(bucket.ravel(), return_inverse=True)
                sums = np.zeros((len(flat), SIZE), np.float32)
                np.add.at(sums, inverse, np.repeat(total, bucket.shape[1], axis=0))
                live = flat > 0
                flat, sums = flat[live], sums[live]
                seen["emb"][flat] += sums * sums
                self.emb[flat] -= rate * sums / np.sqrt(seen["emb"][flat])
                for j, gk in enumerate(changes):
                    step(self.kernel[j], gk, seen["kernel"][j])
                step(self.shift, back.sum(axis=0), seen["shift"])
                step(self.out, (act * g[:, None]).sum(axis=0), seen["out"])
                seen["bias"] += float(g.sum()) ** 2
                self.bias -= np.float32(rate * g.sum() / np.sqrt(seen["bias"]))


    def flat(self) -> np.ndarray:
        """All that is learned, as rows of SIZE numbers: the embeddings, then the rest."""
        rest = np.concatenate([*(k.ravel() for k in self.kernel), self.shift, self.out, [self.bias]]).astype(np.float32)
        return np.concatenate([self.emb, np.resize(np.concatenate([rest, np.zeros(-len(rest) % SIZE, np.float32)]), (-(-len(rest) // SIZE), SIZE))])

    def put(self, rows: np.ndarray) -> None:
        """Takes what flat() gives."""
        self.emb, rest, i = rows[:BUCKETS].astype(np.float32), rows[BUCKETS:].astype(np.float32).ravel(), 0
        for j, k in enumerate(self.kernel):
            self.kernel[j] = rest[i : i + k.size].reshape(k.shape).copy()
            i += k.size
        n = len(self.shift)
        self.shift, self.out, self.bias = rest[i : i + n].copy(), rest[i + n : i + 2 * n].copy(), np.float32(rest[i + 2 * n])


def ranges(lists: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some CHUNK / 8 words, one text at least."""
    i = 0
    while i < len(lists):
        j, held = i, 0
        while j < len(lists) and (j == i or held < CHUNK // 8):
            held += len(lists[j]) + 3
            j += 1
        yield i, j
        i = j


def held_by(lists: list[list[bytes]], y: np.ndarray) -> np.ndarray:
    """(2, BUCKETS): how many texts of either label hold each bucket."""
    counts = np.zeros(2 * BUCKETS)
    for i, j in ranges(lists):
        b = Batch(lists[i:j])
        for t in range(0, j - i, MARKED):
            held, n = np.zeros(MARKED * BUCKETS, bool), min(MARKED, j - i - t)
            for a in range(int(b.starts[t]), int(b.ends[t + n - 1]), BLOCK):
                z = min(a + BLOCK, int(b.ends[t + n - 1]))
                said = b.ids[a:z] > 0  # padding is no word
                held[((b.text[a:z][said] - t) * BUCKETS)[:, None] + b.of[b.ids[a:z][said]]] = True
            text, bucket = np.divmod(np.flatnonzero(held), BUCKETS)
            counts += np.bincount(y[i + t + text].astype(np.int64) * BUCKETS + bucket, minlength=2 * BUCKETS)
    return counts.reshape(2, BUCKETS)


def log_odds(counts: np.ndarray, share: float, strength: float = 4.0) -> np.ndarray:
    """For each bucket how much more often texts of label 1, which this share of all have, hold it, smoothed towards no difference."""
    odds = np.log((counts[1] + strength * share) / (counts[0] + strength * (1 - share))) - np.log(share / (1 - share))
    odds[0] = 0
    return odds


def started(counts: np.ndarray, share: float) -> Net:
    """A net that knows the words' log-odds."""
    net = Net()
    net.emb[:, 0] += np.clip(log_odds(counts, share), -3, 3).astype(np.float32) / 3
    return net


class Model:
    """A trained net with the languages' thresholds (as logits)."""

    def __init__(self, texts: list[str], y: np.ndarray, language: langid.Model):
        """Learns from these texts in memory; train() does so from tables."""
        self.language = language
        self.constant: float | None = None
        self.limit: dict[str, float] = {}
        self.default = 0.0
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        lists = [words_of(t) for t in texts]
        kept = np.array([is_kept(ws) for ws in lists])
        if len(set(y[kept])) < 2 or len(set(y[~kept])) < 2:
            kept[:] = False
        taught = np.flatnonzero(~kept)
        own = [lists[i] for i in taught]
        self.net = started(held_by(own, y[taught]), y[taught].mean())
        self.net.learn(own, y[taught])
        judged = np.flatnonzero(kept) if kept.any() else taught
        self.judge(self.logits([lists[i] for i in judged]), y[judged], np.ones(len(judged)), language.predict([texts[i] for i in judged])[0])

    def judge(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray, langs: list[str | None]) -> None:
        """Chooses the thresholds from logits, each of which stands for `weight` rows."""
        named = np.array([v or "" for v in langs])
        self.default = self._best(z, y, weight)
        for name in sorted(set(named) - {""}):
            own = named == name
            if min((y * weight)[own].sum(), ((1 - y) * weight)[own].sum()) >= 10:
                self.limit[name] = self._best(z[own], y[own], weight[own])

    @staticmethod
    def _best(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """The middle of the widest gap among the thresholds with the best F1 of the weighted rows."""
        order = np.argsort(-z)
        z, hits = z[order], np.cumsum((y * weight)[order])
        f1 = 2 * hits / (np.cumsum(weight[order]) + (y * weight).sum())
        nxt = np.concatenate([z[1:], [z[-1] - 2]])
        f1[nxt == z] = -1
        good = np.flatnonzero(f1 >= f1.max() - 1e-12)
        i = good[np.argmax((z - nxt)[good])]
        return float((z[i] + nxt[i]) / 2)

    def logits(self, lists: list[list[bytes]]) -> np.ndarray:
        out = np.zeros(len(lists))
        for i, j in ranges(lists):
            out[i:j] = self.net.logits(Batch(lists[i:j]))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held < CHUNK):
                held += len(texts[j] or "")
                j += 1
            z = self.logits([words_of(t) for t in texts[i:j]])
            limit = np.array([self.limit.get(v, self.default) for v in self.language.predict(texts[i:j])[0]])
            out[i:j] = 1 / (1 + np.exp(-np.clip(z - limit + np.log(CUTOFF / (1 - CUTOFF)), -30, 30)))
            i = j
        return out


def is_kept(words: list[bytes]) -> bool:
    """Whether a text is kept from the net, for the thresholds."""
    return zlib.crc32(b" ".join(words)) % 5 == 0


def _labelled(docs: DataFrame, labels: DataFrame, language: langid.Model, key: str, text: str, label: str) -> DataFrame:
    """h, label, kept, words (parted by spaces) and, where kept, the predicted lang of every labelled row that may teach."""
    told = labels.where(langid.may_teach(key)).select(quoted(key).alias("key"), quoted(label).cast("int").alias("label")).where("label in (0, 1) and key is not null").distinct()
    rows = docs.select(quoted(key).alias("key"), quoted(text).alias("text")).join(few(told), "key")
    sent = docs.sparkSession.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            lists = [words_of(t) for t in texts]
            kept = [is_kept(ws) for ws in lists]
            langs = iter(sent.value.predict(list(itertools.compress(texts, kept)))[0])
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(kept), pa.array([b" ".join(ws) for ws in lists], pa.binary()), pa.array([next(langs) if k else None for k in kept], pa.string())], names=["h", "label", "kept", "words", "lang"])

    return cut(rows.select("text", F.xxhash64(F.lit(SEED), "key").alias("h"), "label").mapInArrow(run, "h long, label int, kept boolean, words binary, lang string"))


def _held_by(rows: DataFrame) -> np.ndarray:
    """held_by() of all rows, counted in tasks and added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS))
        for b in batches:
            counts += held_by([ws.split() for ws in b.column(1).to_pylist()], b.column(0).to_numpy())
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c[some].astype(np.int64)) for c in counts)], names=["b", "n0", "n1"])

    counts = np.zeros((2, BUCKETS))
    got = rows.select("label", "words").mapInArrow(run, "b int, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # BUCKETS rows at most
    for t in range(2):
        counts[t, got["b"].to_numpy()] = got[f"n{t}"].to_numpy()
    return counts


def _learned(rows: DataFrame, net: Net, toxic: float, part_bytes: int) -> Net:
    """The net after all rows: each part learns on its own, and what it changes is averaged with the others."""
    size = rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    passes = max(1, PASSES // parts)
    sent = rows.sparkSession.sparkContext.broadcast(net.flat())
    names = [f"v{k}" for k in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, lists, y, held = None, None, [], [], 0

        def learn():
            if lists:
                own.learn(lists, np.array(y, np.float64), passes, toxic=toxic)
            lists.clear()
            y.clear()

        def changes() -> pa.RecordBatch:
            moved = own.flat() - sent.value
            some = np.flatnonzero(moved.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(moved[some, k].astype(np.float64)) for k in range(SIZE))], names=["b", *names])

        for b in batches:
            for part, label, words in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if part != now:
                    if own is not None:
                        learn()
                        yield changes()
                    own, now, held = Net(), part, 0
                    own.put(sent.value)
                elif held > 2 * part_bytes:  # copies of one key
                    learn()
                    held = 0
                lists.append(words.split())
                y.append(label)
                held += len(words)
        if own is not None:
            learn()
            yield changes()

    dealt = rows.select(F.pmod(F.col("h"), F.lit(parts)).alias("part"), "label", "words", "h").repartitionByRange(parts, "part").sortWithinPartitions("part", "h", "words", "label").select("part", "label", "words")
    got = dealt.mapInArrow(run, "b int, " + ", ".join(f"{n} double" for n in names)).groupBy("b").agg(*[F.avg(n).alias(n) for n in names]).toArrow()  # as many rows as flat() has, at most
    flat = net.flat().astype(np.float64)
    flat[got["b"].to_numpy()] += np.stack([got[n].to_numpy() for n in names], axis=1)
    out = Net()
    out.put(flat)
    return out


def _counted(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """Logits of all rows in steps, with label, number of rows and language."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            z = sent.value.logits([ws.split() for ws in b.column(1).to_pylist()])
            step = np.clip(np.floor(z * STEPS), -SPAN * STEPS, SPAN * STEPS).astype(int)
            seen.update(zip(step.tolist(), b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
        z, y, lang = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(y, pa.int32()), pa.array(lang, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["z", "label", "lang", "n"])

    got = rows.select("label", "words", "lang").mapInArrow(run, "z int, label int, lang string, n long").groupBy("z", "label", "lang").agg(F.sum("n").alias("n")).toArrow()
    return (got["z"].to_numpy() + 0.5) / STEPS, got["label"].to_numpy().astype(float), got["n"].to_numpy().astype(float), got["lang"].to_pylist()


def train(docs: DataFrame, labels: DataFrame, language: langid.Model, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_bytes: int = PART_BYTES) -> Model:
    """Learns from all labelled rows that may teach. sample_bytes: of the words of a part that is learned from on its own; all parts are."""
    ship(docs.sparkSession)
    rows = _labelled(docs, labels, language, key, text, label)
    counts = {(r["kept"], r["label"]): r["count"] for r in rows.groupBy("kept", "label").count().collect()}  # four rows at most
    both = [sum(n for (_, t), n in counts.items() if t == k) for k in range(2)]
    model = Model([], np.empty(0), language)
    if not all(both):
        model.constant = both[1] / sum(both) if any(both) else 0.0
        return model
    taught = judged = rows.withColumn("lang", F.lit(None).cast("string"))
    if len(counts) == 4:
        taught, judged, both = rows.where("not kept"), rows.where("kept"), [counts[False, 0], counts[False, 1]]
    toxic = both[1] / sum(both)
    model.constant, model.net = None, _learned(taught, started(_held_by(taught), toxic), toxic, sample_bytes)
    model.judge(*_counted(judged, model))
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column, and its name: the toxicity score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out, (name,) = added(docs, text, "score double", lambda column, _: [pa.array(sent.value.score(column.to_pylist()), pa.float64())])
    return out, name


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), langid.train(docs))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    found, _ = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).cast("int").alias("predicted"))
