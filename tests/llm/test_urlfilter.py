import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillon.llm import urlfilter as U
from quillon.llm.queries import RULES


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "x") for r in rows], "page_id long, url string, host string, html string")


def brute(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", "", None
    host, path = "".join(c.lower() if c < "\x7f" else c for c in found[1]), found[2]
    fits = [r for _, r in RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


URLS = [
    "http://www.Example.com/en/7", "http://example.com/en/8", "https://a.com/en/", "https://a.com/en", "https://com/en/x", "http://x.example.net/de/8?q", "http://example.net/de/9", "http://net/de/", "http://xnet/de/", "http://a.org/es/1#t", "http://a.org/ES/1", "http://b.org", "http://b.org?x=/en/", "//nope/en/", "plain", "", None, "http://example.com/en/77", "http://evil.com/en/://x.net/de/", "http://a.com/" + "en/" * 500,
]


def test_rules_and_parts_equal_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])]
    got = U.judge(pages(spark, rows), RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            continue
        host, path, rule = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == {t: v for v, t in RULES}[rule]
        assert r.verdict in ("allow", "block")


def test_templates_of_bad_branches_are_rejected(spark):
    rows, bad = [], {}
    for i in range(400):
        kind = ("news", "blog", "offers")[i % 3]
        rows.append((i, f"http://site.test/{kind}/{('a', 'b', 'c', 'd')[i % 4]}/{i}"))
        bad[i] = int(kind == "offers") if i % 2 == 0 else None
    frame = pages(spark, rows).join(spark.createDataFrame(list(bad.items()), "id long, label int"), F.col("page_id") == F.col("id"))
    got = {r.page_id: r for r in U.judge(frame, [], F.col("label")).collect()}
    assert all(got[i].verdict == ("block" if i % 3 == 2 else "allow") for i in range(400))
    assert got[2].template == "/offers/*/#" and {got[i].template for i in (0, 1)} == {"/news/*/#", "/blog/*/#"}


def test_variable_segments_become_wildcards(spark):
    rows = [(i, f"http://site.test/user/{chr(97 + i % 26)}{chr(97 + i // 26)}x/home") for i in range(200)]
    assert {r.template for r in U.judge(pages(spark, rows), []).collect()} == {"/user/*/home"}


def test_labels_come_from_the_text_of_the_page(spark):
    words = " ".join(f"w{i}" for i in range(60))
    texts = {1: words, 2: words + " casino poker bet", 3: " ".join(f"w{i}%%%" for i in range(60)), 4: "casino", 5: None, 6: f"<script>casino ### poker {words}</script><style>% % % % %</style>" + words, 7: "<p class='casino bet poker'>" + words, 8: ""}
    rows = spark.createDataFrame([(i, f"<p>{t}</p>" if t is not None else None) for i, t in texts.items()], "id long, html string")
    got = {r.id: r.bad for r in rows.select("id", U.weak_label(F.col("html")).alias("bad")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: None, 5: None, 6: 0, 7: 0, 8: None}


def test_an_unlabelled_url_is_blocked_by_its_template_alone(spark):
    good, bad = (" ".join(f"{w}{i}" for i in range(50)) for w in ("w", "x%$#"))
    rows = [(i, f"http://site.test/{'plain' if i % 2 else 'other'}/page{i}", good if i % 2 else bad) for i in range(60)]
    rows += [(100, "http://site.test/other/page100", None), (101, "http://site.test/plain/casino", None), (102, "http://site.test/other/page102", "few words")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in U.judge(frame, []).collect()}
    assert (got[100].verdict, got[101].verdict, got[102].verdict) == ("block", "allow", "block")
    assert got[100].template == "/other/page#"


def z(x, n, y, m):
    p, q, pooled = (x + 0.5) / (n + 1), (y + 0.5) / (m + 1), (x + y + 1) / (n + m + 2)
    return abs(p - q) / (pooled * (1 - pooled) * (1 / (n + 1) + 1 / (m + 1))) ** 0.5


def brute_templates(rows):
    """rows: (host, path, label). The same tree, one node after the other."""
    shapes = {}
    for host, path, bad in rows:
        key = host, tuple(s for s in re.sub("[0-9]+", "#", path).split("/") if s)
        got = shapes.setdefault(key, [0, 0, 0])
        got[0] += 1
        got[1] += bad is not None
        got[2] += bad or 0
    now = {key: key[1] for key in shapes}
    for level in range(max(len(s) for _, s in shapes)):
        node = {}
        for (host, shape), template in now.items():
            if len(template) > level:
                child = node.setdefault((host, template[:level]), {}).setdefault(template[level], [0, 0, 0, 0])
                n, labelled, bad = shapes[host, shape]
                for i, v in enumerate((n, labelled, bad, n if len(template) == level + 1 else 0)):
                    child[i] += v
        merged = set()
        for key, children in node.items():
            for name, (n, labelled, bad, ends) in children.items():
                rest = [sum(c[i] for other, c in children.items() if other != name) for i in range(4)]
                proven = labelled >= 5 and rest[1] >= 5
                alike = (not proven or z(bad, labelled, rest[2], rest[1]) < 2.6) and z(ends, n, rest[3], rest[0]) < 2.6
                if len(children) > 1 and (alike or len(children) > 16 and labelled < 5):
                    merged.add((key, name))
        now = {k: (*t[:level], "*", *t[level + 1 :]) if len(t) > level and ((k[0], t[:level]), t[level]) in merged else t for k, t in now.items()}
    total, bad = sum(v[1] for v in shapes.values()), sum(v[2] for v in shapes.values())
    add = lambda keys: [sum(shapes[k][i] for k in keys) for i in (1, 2)]
    out = {}
    for key, template in now.items():
        labelled, wrong = add([k for k in now if k[0] == key[0]])
        host = (wrong + 2 * bad / max(1, total)) / (labelled + 2)
        labelled, wrong = add([k for k in now if k[0] == key[0] and now[k] == template])
        out[key] = "/" + "/".join(template), round((wrong + 2 * host) / (labelled + 2), 6)
    return out


@pytest.mark.parametrize("chars", [U.GROUP_CHARS, 1500, 0])
def test_trees_equal_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(U, "GROUP_CHARS", chars)
    r = random.Random(2)
    rows = []
    for i in range(1500):
        host = f"h{r.randrange(4)}.test"
        parts = [r.choice("abcd"), r.choice(["x", "y", f"u{r.randrange(40)}", "z"]), str(i), *(r.choice("pq") for _ in range(r.choice([0, 0, 1, 5, 9])))][: r.randint(0, 12)]
        bad = r.choice([None, int(r.random() < (0.8 if parts[:1] == ["c"] or "q" in parts[4:] else 0.1))])
        rows.append((i, host, "/".join(["", *parts]), bad))
    frame = spark.createDataFrame([(i, f"http://{h}{p}", b) for i, h, p, b in rows], "page_id long, url string, label int")
    want = brute_templates([(h, p, b) for _, h, p, b in rows])
    assert len({t for t, _ in want.values()}) > 10
    for x in U.judge(frame, [], F.col("label")).collect():
        _, host, path, _ = rows[x.page_id]
        template, purity = want[host, tuple(s for s in re.sub("[0-9]+", "#", path).split("/") if s)]
        assert x.template == template and abs(x.purity - purity) < 2e-6
        assert x.verdict == ("block" if x.purity > 0.5 else "allow")


def test_edges(spark):
    assert U.judge(pages(spark, []), RULES).count() == 0
    deep = "http://deep.example" + "/a/b" * 30
    rows = [(1, None), (2, "http://fine.example/1"), (3, "http://fine.example/1"), (4, deep), (4, deep), (None, "http://fine.example/" + "x" * 100_000)]
    got = U.judge(pages(spark, rows).withColumn("html", F.lit(None).cast("string")).selectExpr("*", "1 shape", "2 bad"), RULES).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} == {"allow"}
    assert {r.template for r in got if r.page_id == 4} == {"/a/b" * 30}


def test_crawler_traps_of_any_depth(spark):
    began = time.time()
    rows = [(1, "http://trap.example" + "/a" * 1000), (2, "http://trap.example" + "/b" * 1000), (3, "http://trap.example" + "/a" * 1200 + "/c")]
    rows += [(10 + i, "http://other.example" + "".join(f"/{chr(97 + i)}{chr(97 + (i * j) % 26)}" for j in range(600))) for i in range(20)]
    frame = spark.createDataFrame([(i, u, None) for i, u in rows], "page_id long, url string, label int")
    got = {r.page_id: r.template for r in U.judge(frame, [], F.col("label")).collect()}
    assert len(got) == 23 and got[1].count("/") == 1000 and set(got[1].split("/")[1:900]) <= {"*", "a"} and time.time() - began < 60
