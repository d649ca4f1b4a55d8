"""Allow and block verdicts on URLs: host rules first, else a logistic regression on hashed character n-grams.

All of it is DataFrame functions and Spark's own learner: the n-grams of host and path (3 to 5
characters) are hashed into buckets, the weights come from a small labelled table of URLs, and a URL's
score is a sum over a literal array of weights.

Cases: a null URL or one without "://" has an empty host and path, fits no rule, and gets the verdict of
the learner on no n-grams, which is its bias; repeated rows are judged alike; an empty table gives no
rows; only the id and the URL are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 8192
#: (host, path, verdict) of the contract's rules.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Words of hosts for the small labelled table, by what such hosts offer: written down from general knowledge. No word is a part of a host of `pages`, nor holds one (tested).
#: Twice as many are wanted, so that a name is blocked for what it holds and not for being unknown.
UNWANTED = {
    "gambling": "poker slots jackpot roulette blackjack wagering bookmaker lottery",
    "pharmacy": "viagra pharmacy meds cialis tablets steroids painkillers prescription",
    "adult": "porn nude escorts webcam erotic lesbian dating hookup",
    "advertising": "banner popup clicks affiliate sponsor retarget popunder promo",
    "spam": "prizes loans crypto replica giveaway payday coupons bitcoins",
}
WANTED = {
    "learning": "university college school academy lectures students thesis science",
    "reading": "library journal stories handbook archive letters poems reading",
    "news": "weather herald times northern radio gazette evening weekly",
    "culture": "museum orchestra theatre gallery heritage history concert festival",
    "leisure": "gardens mountain recipes cycling kitchen travel harbour forest",
    "public": "council parliament ministry hospital police transport elections citizens",
    "business": "accounting engineering insurance logistics printing consulting furniture bakery",
    "computing": "software compiler database network documentation kernel packages tutorials",
    "places": "london edinburgh toronto brighton netherlands northland riverside westend",
    "people": "family children mothers brothers neighbours wedding gathering together",
}


def names_of(words: str) -> list[str]:
    """Names of hosts: each word by itself, with the next one and with the one after that, by turns with and without a hyphen."""
    each = words.split()
    pairs = [(w, each[(i + step) % len(each)]) for step in (1, 2) for i, w in enumerate(each)]
    return each + [a + "-" * (k % 2) + b for k, (a, b) in enumerate(pairs)]


def labelled_urls(spark: SparkSession, unwanted: dict[str, str] = UNWANTED, wanted: dict[str, str] = WANTED) -> DataFrame:
    """The small labelled table (url, label; 1 is to be blocked): each name under a prefix, a domain and two paths."""
    rows = []
    for label, classes in ((1.0, unwanted), (0.0, wanted)):
        for i, name in enumerate(n for words in classes.values() for n in names_of(words)):
            for j, path in enumerate(("/en/12", "/fr/345/", "/de/6.html", "/es/7890")[i % 2 :: 2]):
                rows.append((f"https://{('', 'www.', 'm.', 'blog.')[(i + j) % 4]}{name}.example.{('com', 'org', 'net')[(i + j) % 3]}{path}", label))
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first :// and the next of / ? #, in lower case; then what lies before the next of ? #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def buckets_of(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of the 3- to 5-grams of host and path, each once."""
    chars = F.split(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), "")
    chars = F.filter(chars, lambda c: c != "")

    def grams(n: int) -> Column:
        last = F.size(chars) - (n - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.array_join(F.slice(chars, i, n), "")), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(*[grams(n) for n in (3, 4, 5)]))


def train(labelled: DataFrame, buckets: int = BUCKETS) -> tuple[list[float], float]:
    """Weights and bias from a small labelled table (url, label)."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select("label", host.alias("host"), path.alias("path")).select("label", buckets_of(F.col("host"), F.col("path"), buckets).alias("at"))
    # sparse vectors of ones at the buckets, of length one
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(buckets)], inputCol="words", outputCol="ones", binary=True)
    sparse = Normalizer(inputCol="ones", outputCol="features").transform(counts.transform(rows.select("label", F.col("at").cast("array<string>").alias("words"))))
    model = LogisticRegression(maxIter=100, regParam=0.0001, standardization=False).fit(sparse.select("label", "features"))
    return [float(x) for x in model.coefficients], float(model.intercept)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""

    def pick(value) -> Column:
        chain = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.lit(value(h, p, v))) for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
        return F.coalesce(*chain) if chain else F.lit(None).cast("string")

    return pick(lambda h, p, v: h + p), pick(lambda h, p, v: v)


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", buckets: int = BUCKETS, cutoff: float = 0.5) -> DataFrame:
    """key, host, path, rule, score (0 to 1, higher: to be blocked) and verdict of every row."""
    weights, bias = train(labelled, buckets)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(quoted(key).alias(key), quoted(url).alias("url")).select(key, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("at", buckets_of(F.col("host"), F.col("path"), buckets))
    held = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded into one literal
    total = F.aggregate("at", F.lit(0.0), lambda s, i: s + F.get(held, i))
    rows = rows.withColumn("score", 1 / (1 + F.exp(-(F.lit(bias) + total / F.sqrt(F.greatest(F.size("at"), F.lit(1)).cast("double"))))))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select(key, "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, F.when(F.col("score") >= cutoff, "block").otherwise("allow")).alias("verdict"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labelled_urls(spark), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")
