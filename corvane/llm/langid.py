"""Language identification in two steps: the family first, then the languages within it.

Texts become hashed counts of 3- and 4-byte strings of their lower-cased UTF-8. A linear support vector
machine for each pair of families votes on the family; then one for each pair of the family's languages
votes on the language. A margin is a mean of weights over the whole text, so a text is scored by one
lookup for each of its strings. The machines are trained by dual coordinate descent (squared hinge loss) on
a bounded sample: at most PER_LANGUAGE texts of each language, the least by a seeded hash.

Cases: a null text, or one without a letter, is `und` with score 0; if no row can be learned from, so is
every text; one single language or family needs no vote and has score 1; rows with null languages or ids
teach nothing; repeated rows are judged alike; an empty table gives no rows; only named columns are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import added, few, quoted, ship

PER_LANGUAGE, SEED = 400, 5
#: Rows of all languages together that may be learned from; the driver holds 48 kB for each.
SAMPLE_ROWS = 16_000
#: Buckets for each length of string.
BUCKETS, GRAMS = 1 << 12, (3, 4)
CHUNK = 1 << 19
UNKNOWN = "und"

#: Families by language code. Other languages are families of their own.
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
    "semitic": "ar he mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def _strings(texts: list[str]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """For ranges of texts: (first, last, for each length (bucket of each string, where it is whole), start of each text)."""
    i = 0
    while i < len(texts):
        j, held, raw = i, 0, []
        while j < len(texts) and (j == i or held < CHUNK):
            raw.append(b"  " + texts[j].lower().encode("utf-8", "replace") + b"  ")
            held += len(raw[-1])
            j += 1
        ends = np.cumsum([len(r) for r in raw])
        starts = ends - [len(r) for r in raw]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        out = []
        for n in GRAMS:
            code = data[: len(data) - n + 1].copy()
            for k in range(1, n):
                code = (code << np.uint32(8)) | data[k : len(data) - n + 1 + k]
            code = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            whole = np.ones(len(data), bool)
            for k in range(1, n):
                whole[ends - k] = False
            out.append((np.concatenate([code, np.zeros(n - 1, np.uint32)]), whole))
        yield i, j, out, starts
        i = j


def features(texts: list[str]) -> np.ndarray:
    """Relative counts (n, len(GRAMS) * BUCKETS) as float32."""
    out = np.zeros((len(texts), len(GRAMS) * BUCKETS), np.float32)
    for i, _, strings, starts in _strings(texts):
        for g, (code, whole) in enumerate(strings):
            for r, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(whole)], strict=True)):
                c = np.bincount(code[a:b][whole[a:b]], minlength=BUCKETS)
                out[i + r, g * BUCKETS : (g + 1) * BUCKETS] = c / max(1, c.sum())
    return out


def margins(texts: list[str], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Margins (n, machines) of whole texts. weights: (len(GRAMS) * BUCKETS, machines)."""
    out = np.tile(bias, (len(texts), 1))
    for i, j, strings, starts in _strings(texts):
        for g, (code, whole) in enumerate(strings):
            own = weights[g * BUCKETS : (g + 1) * BUCKETS]
            count = np.add.reduceat(whole.astype(np.int64), starts)
            for m in range(weights.shape[1]):
                w = own[:, m].copy()[code]
                w[~whole] = 0
                out[i:j, m] += np.add.reduceat(w, starts) / count
    return out


def machine(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, cost: float = 10.0, passes: int = 40, seed: int = SEED) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss) by dual coordinate descent: weights and bias. y: 1 or -1, for all of x or for these rows of it, which aren't copied."""
    rows = np.arange(len(x)) if rows is None else rows
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(rows))
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    damp = 0.5 / (cost * share)
    norm = np.array([float(x[r] @ x[r]) for r in rows]) + 1 + damp  # 1 for the bias
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(rows)):
            own = x[rows[i]]
            slope = y[i] * (float(own @ w) + bias) - 1 + damp[i] * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            most = max(most, abs(slope))
            new = max(alpha[i] - slope / norm[i], 0.0)
            step = (new - alpha[i]) * y[i]
            w += step * own
            bias += step
            alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


class Model:
    """Machines between families and, within each, between languages. x is scaled in place."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families: dict[str, list[str]] = {}
        for code in self.langs:
            self.families.setdefault(family_of(code), []).append(code)
        scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5) if len(x) else np.ones(x.shape[1])
        z = np.multiply(x, scale.astype(np.float32), out=x if x.flags.writeable else None)  # in the sample's own place, which is large
        own, kin = np.array(langs), np.array([family_of(v) for v in langs])
        self.pairs: list[tuple[str, str, str]] = []
        found = []
        tasks = [("", a, b, kin) for a, b in itertools.combinations(sorted(self.families), 2)]
        tasks += [(f, a, b, own) for f, codes in sorted(self.families.items()) for a, b in itertools.combinations(codes, 2)]
        for f, a, b, of in tasks:
            rows = np.flatnonzero((of == a) | (of == b))
            w, c = machine(z, np.where(of[rows] == a, 1.0, -1.0), rows)
            self.pairs.append((f, a, b))
            found.append((w * scale, c))
        self.weights = np.stack([w for w, _ in found], axis=1) if found else np.zeros((x.shape[1], 0))
        self.bias = np.array([c for _, c in found])

    def _vote(self, chance: np.ndarray, scope: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(names) == 1:
            return np.zeros(len(chance), int), np.ones(len(chance))
        votes = np.zeros((len(chance), len(names)))
        least = np.ones((len(chance), len(names)))
        for m, (f, a, b) in enumerate(self.pairs):
            if f == scope and a in names and b in names:
                for name, p in ((a, chance[:, m]), (b, 1 - chance[:, m])):
                    k = names.index(name)
                    votes[:, k] += p
                    least[:, k] = np.minimum(least[:, k], p)
        best = votes.argmax(axis=1)
        return best, least[np.arange(len(best)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        if not some:
            return langs, scores
        chance = 1 / (1 + np.exp(-np.clip(3 * margins([texts[i] for i in some], self.weights, self.bias), -30, 30)))
        names = sorted(self.families)
        kin, sure = self._vote(chance, "", names)
        for k, f in enumerate(names):
            rows = np.flatnonzero(kin == k)
            best, sure_too = self._vote(chance[rows], f, self.families[f])
            for r, b, s in zip(rows.tolist(), best.tolist(), sure_too.tolist(), strict=True):
                langs[some[r]] = self.families[f][b]
                scores[some[r]] = sure[r] * s
        return langs, scores


def may_teach(key: str) -> Column:
    """Rows that may be learned from: those whose crc32 of the id as text isn't 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(quoted(key).cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def sample(rows: DataFrame, by: str, each: int, seed: int = SEED) -> DataFrame:
    """At most `each` rows for every value of column `by`, the least by a seeded hash of column `key`."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.lit(1 << 40))
    # a first cut by the hash leaves little to sort: eight standard deviations more than are wanted pass, and all rows of a small value
    passing = each + 8 * math.ceil(math.sqrt(each)) + 32
    near = rows.join(few(counts), by).where((F.col("n") <= passing) | (h / F.lit(1 << 40) < F.lit(passing) / F.col("n")))
    order = W.partitionBy(by).orderBy(h, F.col("key"))
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each).select(*rows.columns)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from a bounded sample of the rows that may teach."""
    ship(docs.sparkSession)
    rows = docs.where(may_teach(key)).select(quoted(key).alias("key"), quoted(text).alias("text"), quoted(lang).alias("lang")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, langs = (b.column(k).to_pylist() for k in range(3))
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            for a in range(0, len(keep), 64):
                some = keep[a : a + 64]
                x = features([texts[i] for i in some])
                yield pa.RecordBatch.from_pydict({"key": pa.array([str(keys[i]) for i in some]), "lang": pa.array([langs[i] for i in some]), "x": pa.array([r.astype("<f2").tobytes() for r in x * 1000], pa.binary())})

    # of very many languages fewer rows each, so that the driver holds a bounded number
    each = max(1, min(per_language, SAMPLE_ROWS // max(1, rows.select("lang").distinct().count())))
    got = sample(rows, "lang", each).mapInArrow(run, "key string, lang string, x binary").toArrow()
    keys, langs = got["key"].to_pylist(), got["lang"].to_pylist()
    order = sorted(range(len(keys)), key=lambda k: (langs[k], keys[k]))
    x, place = np.empty((len(keys), len(GRAMS) * BUCKETS), np.float32), np.argsort(np.array(order, np.int64))
    at = 0
    for part in got["x"].chunks:
        for v in part:
            x[place[at]] = np.frombuffer(v.as_buffer(), "<f2")
            at += 1
    del got
    x /= 1000
    return Model(x, [langs[k] for k in order])


def identify(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with two more columns, and their names: lang_pred and score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(column: pa.Array, _: list[pa.Array]) -> list[pa.Array]:
        langs, scores = sent.value.predict(column.to_pylist())
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return added(docs, text, "lang_pred string, score double", judge)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found, _ = identify(docs.select("doc_id", "text"), train(docs))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
