import random

from nightframe.llm import url_filter


def brute(url, listed, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        best = max(fits)
        return host, path, best[2], best[3]
    return host, path, None, "block" if (host, path) in listed else "allow"


def test_equals_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.org", "B.a.org", "a.com", "x.a.com", "org", "example.org", "w.example.org", "É.net", "aorg", ""]
    tails = ["", "/", "/es/1", "/en/12", "/en/", "/fr/9?q=/de/", "/de/1#x", "?a", "//", "/a://b", "\n/"]
    urls = [rng.choice(["http://", "https://", "", "://"]) + rng.choice(hosts) + rng.choice(tails) for _ in range(400)] + [None, "", "://", "nothing"]
    listed = {("a.com", "/"), ("é.net", ""), ("É.net", "/es/1"), ("aorg", "/de/1")}
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(0, urls[0], "x", "y"), (None, urls[1], "x", "y")], "page_id long, url string, kind string, block string")
    rules = url_filter.rules_frame(spark)
    got = url_filter.judge(df.select("page_id", "url"), spark.createDataFrame(sorted(listed), "host string, path string"), rules).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"], listed, url_filter.RULES), r["url"]


def test_other_columns_stay(spark):
    """Columns with names that the operator uses, and those it puts in place of the page's."""
    names = "page_id url hit best rule verdict host path kind block u_host u_path".split()
    df = spark.createDataFrame([tuple([1, "http://x.com/de/1", *names[2:]])], "page_id long, " + ", ".join(f"{c} string" for c in names[1:]))
    got = url_filter.judge(df, url_filter.listing(df), url_filter.rules_frame(spark))
    assert sorted(got.columns) == sorted(names)
    assert got.first().asDict() == dict(zip(names, names)) | {"page_id": 1, "url": "http://x.com/de/1", "host": "x.com", "path": "/de/1", "rule": "com/de/", "verdict": "block"}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    df = spark.range(4000).selectExpr("'exact' kind", "concat('h', id, '.org') host", "'/' path")
    listed, others = df.filter("cast(substring(host, 2, length(host) - 5) as int) < 2000"), df
    passed = url_filter.possible(others, listed, 2000).count()
    assert 2000 <= passed < 2040


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.listing(none), url_filter.rules_frame(spark, [("a", "/", "block")]).limit(0)).count() == 0
