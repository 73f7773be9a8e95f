import random
import re

import pytest
from pyspark.sql import functions as F

from loomlake.llm import urls


def read(spark, pages, labels=()):
    p = spark.createDataFrame(pages, "page_id long, url string")
    l = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    return {r.page_id: r for r in urls.judge_urls(p, urls.page_labels(l)).collect()}


def brute(pages, bad_of):
    """template and purity of every page by a plain tree: paths are generalised, siblings merged at every level, shares smoothed from the host down."""
    shapes, of_page = {}, {}
    for page, url in pages:
        host, _, rest = url.split("://")[1].partition("/")
        path = "/" + rest
        steps = ["*" if len(s) > urls.LONG else re.sub("[0-9]+", "*", s) for s in path.split("/") if s]
        if len(steps) > urls.DEPTH:
            steps = [*steps[: urls.DEPTH], "/".join(steps[urls.DEPTH :])]
        number = re.search(r"([0-9]{1,18})[^0-9]*$", path)
        of_page[page] = key = (host, tuple(steps), "/" if path.endswith("/") else "")
        seen = shapes.setdefault(key, [0, 0])
        if number and int(number[1]) in bad_of:
            seen[0], seen[1] = seen[0] + 1, seen[1] + bad_of[int(number[1])]
    grown = {key: list(key[1]) for key in shapes}
    for k in range(urls.DEPTH + 1):
        children = {}
        for (host, *_), t in grown.items():
            if len(t) > k:
                children.setdefault((host, tuple(t[:k])), set()).add(t[k])
        for (host, *_), t in grown.items():
            if len(t) > k and len(children.get((host, tuple(t[:k])), ())) > urls.MAX_CHILDREN:
                t[k] = None  # after all children are counted
        for t in grown.values():
            t[:] = ["*" if x is None else x for x in t]

    class Node:
        def __init__(self):
            self.leaves, self.branches, self.n, self.b = {}, {}, 0, 0

    hosts = {}
    for key, t in grown.items():
        n, b = shapes[key]
        node = hosts.setdefault(key[0], Node())
        node.n, node.b = node.n + n, node.b + b
        *above, last = t or [""]
        for step in above:
            node = node.branches.setdefault(step, Node())
            node.n, node.b = node.n + n, node.b + b
        leaf = node.leaves.setdefault(last + key[2], Node())
        leaf.n, leaf.b = leaf.n + n, leaf.b + b
    found = {}

    def judge(node, path, purity):
        siblings = [(c.b / c.n, f"{path}/{name}" + "//" * (kind is node.branches), c) for kind in (node.leaves, node.branches) for name, c in kind.items() if c.n]
        groups = []
        for _, _, c in sorted(siblings, key=lambda x: x[:2]):
            if groups:
                n0, b0 = sum(x.n for x in groups[-1]), sum(x.b for x in groups[-1])
                p = (c.b + b0) / (c.n + n0)
                if (c.b / c.n - b0 / n0) ** 2 > 1.96**2 * p * (1 - p) * (1 / c.n + 1 / n0) + 1e-12:
                    groups.append([c])
                    continue
                groups[-1].append(c)
            else:
                groups.append([c])
        shares = {id(c): (sum(x.b for x in g) + urls.STRENGTH * purity) / (sum(x.n for x in g) + urls.STRENGTH) for g in groups for c in g}
        for name, leaf in node.leaves.items():
            found[f"{path}/{name}"] = shares.get(id(leaf), purity)
        for name, branch in node.branches.items():
            judge(branch, f"{path}/{name}", shares.get(id(branch), purity))

    n, b = sum(h.n for h in hosts.values()), sum(h.b for h in hosts.values())
    out = {}
    for host, node in hosts.items():
        found.clear()
        judge(node, "", (node.b + urls.STRENGTH * (b / n if n else 0.0)) / (node.n + urls.STRENGTH))
        for page, key in of_page.items():
            if key[0] == host:
                *above, last = grown[key] or [""]
                template = "".join(f"/{x}" for x in above) + f"/{last}{key[2]}"
                out[page] = (template, found[template])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_the_tree_equals_a_plain_one(spark, seed):
    rng = random.Random(seed)
    names = [f"n{chr(97 + k)}" for k in range(6)]
    crowd = [f"c{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40)]
    pages = []
    for k in range(900):
        steps = [rng.choice(names) for _ in range(rng.randrange(0, 4))]
        if rng.random() < 0.2:
            steps.insert(min(1, len(steps)), rng.choice(crowd))
        if rng.random() < 0.02:
            steps += ["deep"] * 9 + [rng.choice(names)]
        steps += [rng.choice([f"{k}", f"page-{k}", "x" * 40 + str(k), f"{k}/"])]
        pages.append((k, f"http://{rng.choice(['a.com', 'a.com', 'b.com'])}/" + "/".join(steps)))
    bad_of = {k: int(("na" in u) ^ (rng.random() < 0.1)) for k, u in pages if rng.random() < 0.5}
    got = read(spark, pages, [(k, 1 - b, 0) for k, b in bad_of.items()])
    want = brute(pages, bad_of)
    assert {k: r.template for k, r in got.items()} == {k: t for k, (t, _) in want.items()}
    assert all(abs(got[k].purity - p) < 1e-9 for k, (_, p) in want.items())


def test_alike_branches_share_their_evidence(spark):
    """Branches of one host, each with few labelled pages, all bad, are one branch at their level; a good one stands apart."""
    pages = [(100 * j + k, f"http://h.com/{name}/{chr(97 + k % 3)}/{100 * j + k}") for j, name in enumerate(("one", "two", "three", "good")) for k in range(30)]
    labels = [(100 * j + k, 0, 1) for j in range(3) for k in range(3)] + [(300 + k, 1, 0) for k in range(20)]
    got = read(spark, pages, labels)
    assert {got[100 * j + k].verdict for j in range(3) for k in range(30)} == {"block"} and {got[300 + k].verdict for k in range(30)} == {"allow"}


def test_rules(spark):
    cases = {
        "https://a.net/x": ("a.net", "/x", "net/", "block"), "https://net/": ("net", "/", "net/", "block"), "http://example.net/en/5": ("example.net", "/en/5", "example.net/en/", "allow"),
        "http://m.EXAMPLE.net/en/5?q#f": ("m.example.net", "/en/5", "example.net/en/", "allow"), "http://badexample.net/en/5": ("badexample.net", "/en/5", "net/", "block"),
        "http://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"), "http://example.com/de": ("example.com", "/de", None, "allow"),
        "http://b.org/fr/": ("b.org", "/fr/", "org/fr/", "allow"), "http://a.net": ("a.net", "", None, "allow"), "http://a.net?x": ("a.net", "", None, "allow"), "http://a.net#x/": ("a.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "http://ÉA.org/fr/": ("Éa.org", "/fr/", "org/fr/", "allow"),
    }
    got = read(spark, list(enumerate(cases)))
    for k, want in enumerate(cases.values()):
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == want


def test_bad_templates_are_rejected(spark):
    pages = [(k, f"http://h.com/bad/{k}") for k in range(20)] + [(100 + k, f"http://h.com/good/{100 + k}") for k in range(20)]
    labels = [(k, 0, 1) for k in range(15)] + [(100 + k, 1, 0) for k in range(15)]
    got = read(spark, pages, labels)
    assert all(got[k].verdict == "block" for k in range(20)) and all(got[100 + k].verdict == "allow" for k in range(20))
    assert got[3].template == "/bad/*"


def test_crowded_parents_become_wildcards(spark):
    pages = [(k, f"http://h.com/{chr(97 + k % 26)}{'x' * (k // 26)}/p") for k in range(60)]
    assert {r.template for r in read(spark, pages).values()} == {"/*/p"}


def test_templates_that_differ_only_deep_down(spark):
    """Every level of a path tells templates apart, also beyond the levels that the tree generalises."""
    for depth in (4, 6, 12):
        base = "http://h.com" + "/s" * depth
        pages = [(k, f"{base}/bad/{k}") for k in range(20)] + [(100 + k, f"{base}/good/{100 + k}") for k in range(20)]
        got = read(spark, pages, [(k, 0, 1) for k in range(15)] + [(100 + k, 1, 0) for k in range(15)])
        assert all(got[k].verdict == "block" for k in range(20)) and all(got[100 + k].verdict == "allow" for k in range(20))


def test_unlabelled_templates_join_no_branch(spark):
    """One unlabelled sibling between a good and a bad one must not make them one branch; it takes the share above them."""
    pages = [(k, f"http://h.com/x/{name}/{k}") for name, first in (("a", 0), ("m", 100), ("z", 200)) for k in range(first, first + 40)]
    pages = [(k, u.replace(f"/{k}", f"-{k}")) for k, u in pages]
    labels = [(k, 1, 0) for k in range(30)] + [(200 + k, 0, 0) for k in range(30)]
    got = read(spark, pages, labels)
    assert {got[k].verdict for k in range(40)} == {"allow"} and {got[200 + k].verdict for k in range(40)} == {"block"}
    assert abs(got[110].purity - 0.5) < 1e-9 and got[5].purity < 0.1 and got[205].purity > 0.9


def test_alike_siblings_share_their_evidence(spark):
    """Three siblings of two labelled pages each, all bad, are one branch; alone, none would be rejected as surely."""
    pages = [(10 * j + k, f"http://h.com/x/{name}-{10 * j + k}") for j, name in enumerate("abc") for k in range(5)]
    got = read(spark, pages, [(10 * j + k, 0, 1) for j in range(3) for k in range(2)] + [(900, 1, 0)])
    assert len({r.purity for r in got.values()}) == 1 and {r.verdict for r in got.values()} == {"block"}


def test_odd_rows(spark):
    pages = [(1, "http://a.com/1"), (1, "http://a.com/1"), (None, None), (2, "http://a.com/" + "s/" * 50_000 + "9" * 400)]
    p = spark.createDataFrame(pages, "page_id long, url string").withColumns({"host": F.lit(1), "path": F.lit(2), "template": F.lit(3), "bad": F.lit(4)})
    l = spark.createDataFrame([(1, None, None), (None, 0, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert urls.judge_urls(p, urls.page_labels(l)).count() == 4
    assert urls.judge_urls(p.limit(0), urls.page_labels(l)).count() == 0
    assert urls.judge_urls(p, urls.page_labels(l.limit(0))).count() == 4
