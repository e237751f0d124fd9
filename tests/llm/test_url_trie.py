import pytest

from locusframe.llm import url_trie
from locusframe.llm.queries import URL_RULES

URLS = [
    "http://a.net/x", "https://x.example.net/en/1", "https://example.net/en", "https://EXAMPLE.com/de/2?q#z", "http://org/fr/", "http://b.org/fr", "x://notnet/", "net/", None, "", "://net", "http://.net/", "http://net:80/", "a://b://net/", "http://example.com/de/?a=/../", "http://net?x/", "http://sub.example.com#/de/",
]
MORE = [("allow", "net", "/ab"), ("block", "example.net", "/e"), ("allow", "net", "")]


def brute(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("rules", [URL_RULES, URL_RULES + MORE])
@pytest.mark.parametrize("limit", [500_000, 1])
def test_against_definition(spark, rules, limit, monkeypatch):
    monkeypatch.setattr(url_trie, "MAX_TRIE_RULES", limit)
    urls = [*URLS, "http://q.net/abc/d", "http://example.net/exx", "http://example.net/ab/"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(None, "http://net/", "r"), (0, urls[0], "r")], "page_id long, url string, rule string")
    got = sorted((r.page_id if r.page_id is not None else -1, r.host, r.path, r.rule, r.verdict) for r in url_trie.url_filter(df, rules).collect())
    want = sorted([(i, *brute(u, rules)) for i, u in enumerate(urls)] + [(-1, *brute("http://net/", rules)), (0, *brute(urls[0], rules))])
    assert got == want
    assert url_trie.url_filter(df.limit(0), rules).count() == 0
