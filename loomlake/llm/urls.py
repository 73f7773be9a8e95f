"""URL filters by a path-template tree.

Fixed host and path rules come first. Every other url is judged by the template of its path: per host, segments
that vary by digits are generalised, then segments whose parent has too many different children become
wildcards, level by level over the whole path; at every level siblings (templates that end there, and branches with all that
lies below them) are merged where their labelled shares do not differ significantly, each tested against all
that its branch holds so far, in the order of their shares. From the host down, each merged branch's share of bad pages is
smoothed towards that of the branch that it hangs from, a host's towards that of all labelled pages; a template is
rejected if its own exceeds one half. What has no labelled pages joins no branch and takes the share above it.

Pages are first counted per host and path shape (partial sums before the shuffle), so a host with a third of all
pages is a handful of rows from there on. The tree is grown by as many steps as the deepest path has levels, at most
DEPTH; what lies deeper stays one last segment, in full. Siblings that are merged are at most three times MAX_CHILDREN by
construction (leaves with and without a slash, and branches). The verdicts join back on host and shape, a join that can be split where one host dominates.

DEPTH, MAX_CHILDREN and LONG are parameters of the tree, alike for every host and size.

Edge cases: a url that is null or has no "://" has an empty host and an empty path, and is judged by that
template; labels that are null count as good, ids without a label as unlabelled; of repeated label rows the
worst counts; repeated pages are judged alike; without labels nothing is rejected; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: verdict, host, path; the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Levels of the tree; the segments below are one last segment.
DEPTH = 8
#: A parent with more different children than this has one wildcard child.
MAX_CHILDREN = 24
#: Segments longer than this are variable.
LONG = 32
#: Siblings are alike if a two-sample test of their bad shares stays within so many deviations.
DEVIATIONS = 1.96
#: Labelled pages that the overall share counts for in smoothing.
STRENGTH = 4
REJECT = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, F.lit("://")) + 3))
    host = common.ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The text of the longest rule that fits, and its verdict; null if none does."""
    texts, verdicts = [], []
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        texts.append(F.when(fits, F.lit(h + p)))
        verdicts.append(F.when(fits, F.lit(verdict)))
    return F.coalesce(*texts), F.coalesce(*verdicts)


def shape(path: Column) -> tuple[Column, Column]:
    """The path's segments, digits and long ones generalised and those beyond DEPTH as one, and whether it ends in a slash."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    general = F.transform(segments, lambda s: F.when(F.length(s) > LONG, "*").otherwise(F.regexp_replace(s, "[0-9]+", "*")))
    deep = F.array_join(F.slice(general, F.lit(DEPTH + 1), F.greatest(F.size(general) - DEPTH, F.lit(0))), "/")
    cut = F.when(F.size(general) > DEPTH, F.concat(F.slice(general, 1, DEPTH), F.array(deep))).otherwise(general)
    return cut.alias("steps"), F.when(F.endswith(path, F.lit("/")), "/").otherwise("").alias("tail")


def page_labels(labels: DataFrame) -> DataFrame:
    """One row per labelled document: of, bad (toxic or of low quality)."""
    bad = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).cast("long")
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of")).agg(F.max(bad).alias("bad"))


def below(steps: Column, k) -> Column:
    """The path of the first k steps."""
    return F.array_join(F.transform(F.slice(steps, F.lit(1), F.lit(k) if isinstance(k, int) else k), lambda s: F.concat(F.lit("/"), s)), "")


def apart(n: Column, b: Column, n0: Column, b0: Column) -> Column:
    """Whether the shares b of n and b0 of n0 differ significantly."""
    return (b * n0 - b0 * n) * (b * n0 - b0 * n) * (n + n0) > DEVIATIONS * DEVIATIONS * (b + b0) * (n + n0 - b - b0) * n * n0


def branches(leaves: Column) -> Column:
    """leaf and branch of each labelled leaf, in the order of their shares; a leaf opens a branch if it stands apart from all of the last one."""
    kind = "array<struct<leaf:string,branch:int>>"
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("b"), F.lit(0).alias("branch"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["n"] > 0) & apart(x["n"], x["b"], acc["n"], acc["b"])
        branch = acc["branch"] + new.cast("int")
        out = F.concat(acc["out"], F.array(F.struct(x["leaf"].alias("leaf"), branch.alias("branch"))))
        return F.struct(F.when(new, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"), F.when(new, x["b"]).otherwise(acc["b"] + x["b"]).alias("b"), branch.alias("branch"), out.alias("out"))

    return F.aggregate(leaves, zero, step, lambda acc: acc["out"])


def judge_templates(shapes: DataFrame) -> DataFrame:
    """(host, steps, tail, bad) rows, bad null where unlabelled, to one row per host and shape: its template and purity."""
    tree = shapes.groupBy("host", "steps", "tail").agg(F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = common.checkpointed(tree.withColumn("t", F.col("steps")))
    levels = tree.agg(F.coalesce(F.max(F.size("steps")), F.lit(0))).first()[0]
    for k in range(min(levels, DEPTH + 1)):
        parent = below(F.col("t"), k)
        crowded = tree.where(F.size("t") > k).select("host", parent.alias("parent"), F.get("t", F.lit(k)).alias("child")).distinct().groupBy("host", "parent").count()
        crowded = crowded.where(F.col("count") > MAX_CHILDREN).select(F.col("host").alias("host_"), F.col("parent").alias("parent_"))
        joined = tree.join(crowded, (F.col("host") == F.col("host_")) & (parent == F.col("parent_")), "left")
        wild = F.transform("t", lambda s, i: F.when(i == F.lit(k), "*").otherwise(s))  # noqa: B023
        general = F.when(F.col("host_").isNotNull(), wild).otherwise(F.col("t"))
        # Written out at each level, as the next one reads it twice.
        tree = common.checkpointed(joined.select("host", "steps", "tail", "seen", "bad", general.alias("t")))
    # The last step with the tail is the leaf; nodes above are told from leaves by two slashes at their end.
    steps = F.when(F.size("t") > 0, F.concat(F.slice("t", F.lit(1), F.size("t") - 1), F.array(F.concat(F.element_at("t", -1), "tail")))).otherwise(F.array("tail"))
    tree = common.checkpointed(tree.select("host", "steps", "tail", "seen", "bad", steps.alias("u")))
    nodes = tree.select("host", "seen", "bad", "u", F.explode(F.sequence(F.lit(1), F.size("u"))).alias("level"))
    node = lambda level: F.concat(below(F.col("u"), level), F.lit("//"))
    parent = F.when(F.col("level") == 1, "").otherwise(node(F.col("level") - 1))
    key = F.when(F.col("level") == F.size("u"), below(F.col("u"), F.size("u"))).otherwise(node(F.col("level")))
    nodes = nodes.groupBy("host", "level", parent.alias("parent"), key.alias("leaf")).agg(F.sum("seen").cast("double").alias("n"), F.sum("bad").cast("double").alias("b"))
    nodes = common.checkpointed(nodes)
    # Alike siblings, leaves and branches with all that is below them, are one branch.
    siblings = nodes.where("n > 0").groupBy("host", "level", "parent").agg(F.array_sort(F.collect_list(F.struct((F.col("b") / F.col("n")).alias("share"), "leaf", "n", "b"))).alias("leaves"))
    own = nodes.join(siblings.select("host", "level", "parent", F.inline(branches(F.col("leaves")))), ["host", "level", "parent", "leaf"])
    totals = own.groupBy("host", "level", "parent", "branch").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    merged = own.select("host", "level", "parent", "leaf", "branch").join(totals, ["host", "level", "parent", "branch"]).select("host", "level", "parent", "leaf", "n", "b")
    merged = common.checkpointed(merged.unionByName(nodes.where("n = 0").select("host", "level", "parent", "leaf", "n", "b")))
    # From the host down, a branch is smoothed towards the one that it hangs from.
    hosts = nodes.where("level = 1").groupBy("host").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    overall = hosts.agg(F.sum("n").alias("all_n"), F.sum("b").alias("all_b")).select(F.when(F.col("all_n") > 0, F.col("all_b") / F.col("all_n")).otherwise(0.0).alias("above"))
    smoothed = ((F.col("b") + STRENGTH * F.col("above")) / (F.col("n") + STRENGTH)).alias("purity")
    upper = hosts.join(F.broadcast(overall)).select("host", F.lit("").alias("leaf"), smoothed)  # one row
    judged = None
    for k in range(1, (tree.agg(F.coalesce(F.max(F.size("u")), F.lit(0))).first()[0]) + 1):
        above = upper.select(F.col("host").alias("host_"), F.col("leaf").alias("parent_"), F.col("purity").alias("above"))
        upper = merged.where(F.col("level") == k).join(above, (F.col("host") == F.col("host_")) & (F.col("parent") == F.col("parent_"))).select("host", "leaf", smoothed)
        upper = common.checkpointed(upper)
        judged = upper if judged is None else judged.unionByName(upper)
    judged = upper if judged is None else judged
    tree = tree.select("host", "steps", "tail", below(F.col("u"), F.size("u")).alias("leaf"))
    return tree.join(judged, ["host", "leaf"]).select("host", "steps", "tail", F.col("leaf").alias("template"), "purity")


def judge_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template, purity. labels: of (the number that ends a page's path), bad."""
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"))
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9]*$", 1).try_cast("long")
    steps, tail = shape(F.col("path"))
    pages = pages.select("*", rule.alias("rule"), ruled.alias("ruled"), number.alias("number"), steps, tail)
    judged = judge_templates(pages.join(labels, F.col("number") == F.col("of"), "left").select("host", "steps", "tail", "bad"))
    judged = judged.select(*(F.col(c).alias(f"{c}_") for c in ("host", "steps", "tail")), "template", "purity")
    same = (F.col("host") == F.col("host_")) & (F.col("steps") == F.col("steps_")) & (F.col("tail") == F.col("tail_"))
    verdict = F.coalesce("ruled", F.when(F.col("purity") > REJECT, "block").otherwise("allow"))
    return pages.join(judged, same).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def oracle() -> str:
    """The same in DuckDB's SQL."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{what(v, h, p)}'" for v, h, p in rules) + " END"
    general = f"list_transform(seg, lambda x: CASE WHEN length(x) > {LONG} THEN '*' ELSE regexp_replace(x, '[0-9]+', '*', 'g') END)"
    path_of = lambda t, k: f"array_to_string(list_transform({t}[1:{k}], lambda x: '/' || x), '')"
    levels = ""
    for k in range(DEPTH + 1):
        levels += f"""
k{k} AS (SELECT host, {path_of('t', k)} AS parent FROM c{k} WHERE len(t) > {k} GROUP BY 1, 2 HAVING count(DISTINCT t[{k + 1}]) > {MAX_CHILDREN}),
c{k + 1} AS (SELECT x.* REPLACE (CASE WHEN y.host IS NOT NULL THEN list_transform(x.t, lambda s, i: CASE WHEN i = {k + 1} THEN '*' ELSE s END) ELSE x.t END AS t) FROM c{k} x LEFT JOIN k{k} y ON x.host = y.host AND {path_of('x.t', k)} = y.parent),"""
    test = f"(s.b * w.n - w.b * s.n) * (s.b * w.n - w.b * s.n) * (s.n + w.n) > {DEVIATIONS * DEVIATIONS} * (s.b + w.b) * (s.n + w.n - s.b - w.b) * s.n * w.n"
    return rf"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
hp AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{common.UPPER}', '{common.LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
p0 AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled, TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) AS number, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM hp),
p1 AS (SELECT *, {general} AS gen, CASE WHEN suffix(path, '/') THEN '/' ELSE '' END AS tail FROM p0),
p AS (SELECT page_id, host, path, rule, ruled, number, CASE WHEN len(gen) > {DEPTH} THEN list_append(gen[1:{DEPTH}], array_to_string(gen[{DEPTH + 1}:], '/')) ELSE gen END AS steps, tail FROM p1),
l AS (SELECT doc_id AS of_id, max(CAST(coalesce(toxic = 1 OR quality = 0, false) AS BIGINT)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c0 AS (SELECT host, steps, tail, steps AS t, count(bad) AS seen, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN l ON number = of_id GROUP BY host, steps, tail),{levels}
f AS (SELECT host, steps, tail, seen, bad, CASE WHEN len(t) > 0 THEN list_append(t[1:len(t) - 1], t[len(t)] || tail) ELSE [tail] END AS u FROM c{DEPTH + 1}),
e AS (SELECT *, unnest(range(1, len(u) + 1)) AS level FROM f),
g AS (SELECT host, level, parent, leaf, CAST(sum(seen) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS b FROM (
  SELECT host, level, seen, bad, CASE WHEN level = 1 THEN '' ELSE {path_of('u', '(level - 1)')} || '//' END AS parent, {path_of('u', 'level')} || CASE WHEN level = len(u) THEN '' ELSE '//' END AS leaf FROM e) GROUP BY host, level, parent, leaf),
sib AS (SELECT *, row_number() OVER (PARTITION BY host, level, parent ORDER BY b / n, leaf) AS i FROM g WHERE n > 0),
w(host, level, parent, i, leaf, n, b, branch) AS (SELECT host, level, parent, i, leaf, n, b, 0 FROM sib WHERE i = 1
UNION ALL SELECT s.host, s.level, s.parent, s.i, s.leaf, CASE WHEN {test} THEN s.n ELSE s.n + w.n END, CASE WHEN {test} THEN s.b ELSE s.b + w.b END, w.branch + CASE WHEN {test} THEN 1 ELSE 0 END FROM w JOIN sib s ON s.host = w.host AND s.level = w.level AND s.parent = w.parent AND s.i = w.i + 1),
x AS (SELECT w.host, w.level, w.parent, w.leaf, sum(sib.n) OVER y AS n, sum(sib.b) OVER y AS b FROM w JOIN sib USING (host, level, parent, i) WINDOW y AS (PARTITION BY w.host, w.level, w.parent, w.branch)
UNION ALL SELECT host, level, parent, leaf, n, b FROM g WHERE n = 0),
h AS (SELECT host, sum(n) AS n, sum(b) AS b FROM g WHERE level = 1 GROUP BY host),
o AS (SELECT CASE WHEN sum(n) > 0 THEN sum(b) / sum(n) ELSE 0 END AS prior FROM h),
v(host, level, leaf, purity) AS (SELECT host, CAST(0 AS BIGINT), '', (b + {STRENGTH} * prior) / (n + {STRENGTH}) FROM h, o
UNION ALL SELECT x.host, x.level, x.leaf, (x.b + {STRENGTH} * v.purity) / (x.n + {STRENGTH}) FROM v JOIN x ON x.host = v.host AND x.level = v.level + 1 AND x.parent = v.leaf),
m AS (SELECT f.host, f.steps, f.tail, v.leaf AS template, purity FROM f JOIN v ON f.host = v.host AND v.level = len(f.u) AND v.leaf = {path_of('f.u', 'len(f.u)')})
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN purity > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM p JOIN m ON p.host = m.host AND p.steps = m.steps AND p.tail = m.tail"""
