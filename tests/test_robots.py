from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from corvane.operators import crawl, vector
from corvane.sources import sinks
from corvane.streaming import usage_stream

FILES = {
    "a.org": "User-agent: *\nDisallow: /private\nAllow: /\n",
    "b.org": "# note\nUser-agent: Other\nDisallow: /\n\nUser-Agent: findbot\nUser-agent: third\nAllow: /x/open # here\nDisallow: /x/\nUser-agent: *\nDisallow: /all\n",
    "c.org": "User-agent: *\nDisallow:\n",
    "d.org": "Disallow: /lost\nUser-agent: *\n\nDisallow: /lost\n",
    "e.org": "User-agent: *\nDisallow: /caf%C3%A9\nDisallow: /q?a=\nCrawl-delay: 3\n",
    "f.org": "",
    "g.org": "User-agent: *\nAllow: /in\nDisallow: *\n",
}
PATHS = ["", "/", "/private/1", "/x/open/2", "/x/shut", "/all/y", "/lost", "/caf%C3%A9/menu", "/café", "/q?a=1", "/q?b=1", "/in/side", "/a+b"]


@pytest.mark.parametrize("agent", ["FindBot/1.0", "Other", "Someone/2"])
def test_robots(spark, agent):
    """Whole files against the standard library's reader."""
    files = spark.createDataFrame([*FILES.items(), ("h.org", None)], "host string, body string")
    urls = [f"https://{host}{path}" for host in [*FILES, "h.org", "none.org"] for path in PATHS]
    rules = crawl.robots_rules(files, agent)
    got = crawl.allowed_in_order(spark.createDataFrame([(u,) for u in urls], "url string"), "url", rules).collect()
    want = {}
    for u in urls:
        reader = RobotFileParser()
        reader.parse(FILES.get(u.split("/")[2], "").splitlines())
        want[u] = reader.can_fetch(agent, u)
    assert {r["url"]: r["allowed"] for r in got} == want


def test_embed_stream(spark, tmp_path):
    """Two runs over a growing folder: each file is embedded once, and a key's last row stays."""
    folder, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    calls = spark.sparkContext.accumulator(0)
    inner = vector.HashEmbedder(4)

    def embedder(texts):
        calls.add(len(texts))
        return inner(texts)

    def run():
        stream = usage_stream.event_stream(spark, folder, "*.parquet", "id long, n long, body string")
        usage_stream.embed_stream(stream, table, "id", "n", "body", embedder, 4, checkpoint)

    write = lambda rows: spark.createDataFrame(rows, "id long, n long, body string").coalesce(1).write.mode("append").parquet(folder)
    write([(1, 1, "a b"), (2, 1, "c")])
    run()
    run()
    write([(1, 2, "z")])
    run()
    rows = {r["id"]: r for r in spark.read.parquet(sinks.newest(spark, table)).select("id", "body", F.col("embedding").alias("v")).collect()}
    assert {k: r["body"] for k, r in rows.items()} == {1: "z", 2: "c"}
    assert list(rows[1]["v"]) == pytest.approx(inner(["z"])[0])
    assert calls.value == 3


def test_rounds_exchange_the_frontier_only(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)] + [(3, 0), (2, None), (None, 5)], "src long, dst long")
    start = spark.createDataFrame([(0,), (None,)], "node long")
    want = [(k, k) for k in range(7)]
    assert sorted(map(tuple, crawl.frontier(edges, start).collect())) == want
    seen, step = crawl.frontier(edges, start), start.select("node")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (crawl._known(seen, step, 2), crawl._steps(edges, step, 2))]
    assert all("Exchange hashpartitioning" not in p and "BroadcastExchange" in p for p in plans)
    monkeypatch.setattr(crawl, "FEW", 0)  # wider levels are joined by an exchange
    assert sorted(map(tuple, crawl.frontier(edges, start).collect())) == want
