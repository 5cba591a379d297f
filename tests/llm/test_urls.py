import random
import re

from pyspark.sql import functions as F

from nearkin.llm import urls


def plain(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


URLS = [
    "http://A.Example.NET/en/1?x=/y", "https://example.net/EN/1", "http://net/", "http://net", "x://notnet/", "http://a.net?q", None, "", "no host",
    "http://example.com/de/", "http://example.com/de", "http://www.example.com/de/1#/x", "ftp://b.org/fr/9.html", "://org/fr/", "http://org.fr/fr/",
    "http://h/a://b.net/", "http://ÄÖ.net/x", "http://a.net/\n/y", "http://example.net.evil.com/en/", "a://b://c.net/", "http:///path", "http://x.org/fr//",
]


def pages(spark, made):
    return spark.createDataFrame([(i, u, "h", "p", "s") for i, u in made], "page_id bigint, url string, host string, path string, segments string")


def labels(spark, made):
    return spark.createDataFrame(made, "page_id bigint, label int")


def test_hosts_paths_and_rules(spark):
    made = list(enumerate(URLS)) + [(None, "http://a.net/en/"), (0, URLS[0])]
    judged = urls.judge(pages(spark, made), labels(spark, [(0, 1), (1, None), (None, 0), (3, 0), (3, 1)])).collect()
    assert len(judged) == len(made)
    by_id = {r["page_id"]: r for r in judged}
    for i, u in made:
        host, path, best = plain(u)
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")


def test_templates_generalise_merge_and_reject(spark):
    rng = random.Random(1)
    made, known = [], []
    for i in range(600):
        section = rng.choice(["news", "blog", "casino"])
        made.append((i, f"http://shop.example/{section}/{rng.randint(1, 10**6)}"))
        known.append((i, int(section != "casino" or rng.random() < 0.1)))
    made += [(1000 + i, f"http://big.example/user/{rng.getrandbits(60):x}/p{i}") for i in range(300)]
    judged = {r["page_id"]: r for r in urls.judge(pages(spark, made), labels(spark, known)).collect()}
    for i, u in made[:600]:
        casino = "/casino/" in u
        assert judged[i]["template"] == ("/{poorer}/{number}" if casino else "/{purer}/{number}")
        assert judged[i]["verdict"] == ("block" if casino else "allow")
    assert {judged[i]["template"] for i, _ in made[600:]} == {"/{branch}/{hex}/{mixed}"}


def test_deep_paths_and_empty_tables(spark):
    deep = "http://d.example/" + "/".join("abcdefghijklm")
    judged = urls.judge(pages(spark, [(1, deep), (2, deep)]), labels(spark, [])).collect()
    assert len(judged) == 2 and judged[0]["template"].endswith("/{rest}") and judged[0]["path"] == "/" + "/".join("abcdefghijklm")
    assert urls.judge(pages(spark, []), labels(spark, [])).count() == 0


def test_native(spark):
    plan = urls.judge(pages(spark, list(enumerate(URLS))), labels(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and F is not None


def test_classes_small_sections_and_deep_ones(spark):
    made, known = [], []

    def add(url, n, share):
        for i in range(n):
            known.append((len(made), int(i >= n * (1 - share))))
            made.append((len(made), url))

    for section, n, share in (("a", 2000, 0.95), ("b", 300, 0.75), ("c", 300, 0.05)):
        add(f"http://three.example/{section}/x", n, share)
    for k in range(150):
        add(f"http://many.example/s{k}x/y", 20, 0 if k == 77 else 0.95)
    for section, share in (("good", 1), ("bad", 0)):
        add("http://deep.example" + "/d" * 10 + f"/{section}", 40, share)
    judged = urls.judge(pages(spark, made), labels(spark, known)).collect()
    blocked = {r["host"] + r["path"] for r in judged if r["verdict"] == "block"}
    assert blocked == {"three.example/c/x", "many.example/s77x/y", "deep.example" + "/d" * 10 + "/bad"}
