import duckdb
import numpy as np
import pytest

from palaver.llm import urls

from .helpers import pages

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def brute(rows, rules, damping=0.85, threshold=0.5):
    import re

    out, hosts = [], {}
    for i, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in m[1])
        fit = max(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and m[2].startswith(p)), default=None)
        out.append((i, host, m[2], fit and fit[1], fit and fit[2], {t.lower() for t in re.findall(r'href="https?://([^/"]+)', html or "")}))
        hosts.setdefault(host, [0, 0, 0])
        hosts[host][0] += 1
        hosts[host][1 if fit and fit[2] == "allow" else 2] += bool(fit)
    names = sorted(set(hosts) | {t for r in out for t in r[5]})
    at = {n: k for k, n in enumerate(names)}
    w = np.zeros((len(names),) * 2)
    for _, host, _, _, _, to in out:
        for t in to - {host}:
            if host:
                w[at[host], at[t]] += 1
    seed = np.array([[hosts.get(n, [1, 0, 0])[k] / hosts.get(n, [1, 0, 0])[0] for n in names] for k in (1, 2)])
    score = []
    for s, m in ((seed[0], w), (seed[1], w.T)):
        p = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
        x = s * (1 - damping)
        for _ in range(300):
            x = s * (1 - damping) + damping * (x @ p)
        score.append(x)
    bad = {n for n, k in at.items() if n and score[1][k] - score[0][k] >= threshold * (1 - damping)}
    return sorted((i, host, path, rule, v or ("block" if host in bad else "allow")) for i, host, path, rule, v, _ in out)


ROWS = [(1, "http://News.org/a?x", '<a href="http://good.net/">g</a> <a class=x href="https://mid.net/q">m</a>'), (2, "http://bad.com/de/1", None), (3, "http://bad.com/en/2", ""),
        (4, "http://farm.net/", '<a href="http://bad.com/de/1">b</a>'), (5, "http://farm2.net/", '<a href="http://farm.net/">b</a><a href="http://news.org/">n</a>'),
        (6, "http://good.net", ""), (7, "http://a.example.org/en/12#f", ""), (8, "http://example.org/en/2", ""), (9, "http://xexample.org/es/", ""), (10, None, "<a href='//z.net'>"),
        (11, "mailto:x", ""), (12, "http://bad.com/de/9", ""), (13, "ftp://shop.com/fr/?a#b", ""), (14, "http://mid.net/x", '<a href="http://bad.com/">b</a>'), (6, "http://good.net", "")]


def test_verdicts_equal_dense_propagation(spark):
    got = sorted(tuple(r) for r in urls.judge(pages(spark, ROWS), RULES, "page_id").collect())
    want = brute(ROWS, RULES)
    assert got == want
    verdicts = {(r[0]): r[4] for r in got}
    assert verdicts[3] == "block" and verdicts[4] == "block" and verdicts[14] == "allow" or verdicts[6] == "allow"


def test_statement_agrees_on_linked_pages(spark):
    from palaver.llm import sql

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", ROWS)
    got = sorted(tuple(r) for r in urls.judge(pages(spark, ROWS), RULES, "page_id").collect())
    assert sorted(con.execute(sql.urls(RULES)).fetchall()) == got


def test_empty_table(spark):
    assert urls.judge(pages(spark, []), RULES, "page_id").count() == 0


def test_unsettled_scores_are_an_error(spark):
    with pytest.raises(RuntimeError):
        hosts = spark.createDataFrame([("a", 1, 1, 0), ("b", 1, 0, 0)], "host string, n_pages long, n_allow long, n_block long")
        links = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, n double")
        urls.propagate(hosts, links, max_rounds=3)
