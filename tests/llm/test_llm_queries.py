"""The registered queries against their SQL, and the pipeline's stages against plain checks."""

import re

import duckdb
import pytest

import corpus_pipeline
from loomlake.llm import decontam, lines, quality, queries
from test_quality import plain_features

TABLES = "documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, data), duck.sql(queries.ORACLES[name])
    assert dict(df.dtypes) == {c: TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types, strict=True)}
    names = sorted(df.columns)
    ours = sorted(tuple(str(r[c]) for c in names) for r in df.collect())
    assert ours == sorted(tuple(str(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())


def test_every_operator_has_a_query():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []
    assert "pipeline" in queries.QUERIES and [n for n, _ in corpus_pipeline.STAGES]


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] // 2
    assert len({r.text for r in docs.collect()}) == counts[-1]
    words = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())
    bench = [words(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert not [d for d in docs.collect() if any(b in words(d.text) for b in bench)]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in mixed} <= set(before) and max(r.mix_copy for r in mixed) <= 3


def test_pipeline_of_odd_rows(spark, data, odd, none):
    """Each stage on nulls, empty and very long texts, repeats and clashing names; each on an empty table."""
    read = lambda df: sorted(str(r) for r in df.collect())
    before = read(odd)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, none, data).count() == 0, name
    kept = read(stages["quality classifier"](spark, odd, data))
    assert set(kept) <= set(before) and len(kept) <= len(before)
    assert read(stages["line dedup"](spark, odd, data)) == before
    near = stages["near duplicates"](spark, odd, data)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near.collect()) == [(False, 1), (False, 4), (False, 5), (False, 7), (False, 8), (True, 0)]
    assert near.columns == odd.columns
    assert read(stages["benchmark decontamination"](spark, odd, data)) == before
    mixed = stages["mixing to weights"](spark, odd, data).collect()
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    assert {(r.doc_id, r.text) for r in mixed} <= texts and {r.mix_copy for r in mixed} <= {1, 2, 3}
    assert all(r.words == len((r.text or "").split()) for r in mixed)


def near_duplicate_survivors(texts):
    """Of doc_id to text, the smallest id of each group by exact similarities of all pairs of texts that share a shingle."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {}
    for d, t in texts.items():
        sets.setdefault(shingles(t), []).append(d)
    bodies = list(sets)
    holders, shared = {}, {}
    for k, s in enumerate(bodies):
        for x in s:
            for j in holders.setdefault(x, []):
                shared[j, k] = shared.get((j, k), 0) + 1
            holders[x].append(k)
    group = list(range(len(bodies)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for (j, k), n in shared.items():
        if 100 * n >= 80 * (len(bodies[j]) + len(bodies[k]) - n):
            group[max(root(j), root(k))] = min(root(j), root(k))
    least = {}
    for k, s in enumerate(bodies):
        least[root(k)] = min([least.get(root(k), sets[s][0]), *sets[s]])
    return set(least.values())


def test_near_duplicate_stage_equals_brute_force(spark):
    """The stage on a whole table against exact similarities."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, "/root/testdata/sf0.01").collect()}
    assert kept == near_duplicate_survivors({r.doc_id: r.text or "" for r in docs.collect()})


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_run_equals_plain_stages(spark, sf):
    """All rows of run() against a plain form of every stage: rules weighed one by one, templates of all lines, exact similarities, all alignments, and the mixture's SQL."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    intercept, rules = quality.fit_rules(quality.training_rows(docs, labels))
    good = []
    for r in docs.collect():
        x = plain_features(r.text or "")
        total = intercept + sum(w for rule, w in rules if all(x[f] <= v if side == "<=" else x[f] > v for f, side, v in rule))
        assert abs(total) > 1e-9
        if total > 0:
            good.append((r.doc_id, r.lang, r.source, r.text))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")

    def stored(name, rows):
        duck.sql(f"CREATE TABLE {name} (doc_id BIGINT, lang VARCHAR, source VARCHAR, text VARCHAR)")
        duck.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", rows)
        return rows

    stored("good", good)
    cleaned = stored("cleaned", duck.sql(f"WITH {lines.oracle_ctes('good')} SELECT doc_id, lang, source, CASE WHEN n_dropped > 0 THEN kept ELSE text END FROM ld JOIN lt USING (row)").fetchall())
    single = near_duplicate_survivors({d: t or "" for d, _, _, t in cleaned})
    stored("single", [r for r in cleaned if r[0] in single])
    stored("documents", duck.sql(f"WITH {decontam.oracle_ctes('single')} SELECT doc_id, lang, source, text FROM dr WHERE row NOT IN (SELECT row FROM leaks)").fetchall())
    mixture = f"WITH mix AS ({queries.ORACLES['op8_source_mix']}) SELECT d.*, unnest(range(1, copies + 1)) AS mix_copy, size AS words FROM documents d JOIN mix ON d.doc_id = mix.doc_id"
    want = duck.sql(mixture).fetchall()
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "lang", "source", "text", "mix_copy", "words").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    counts = [docs.count(), len(good), len(single), len({r[0] for r in want})]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[1] > 0 and sum(a[3] != b[3] for a, b in zip(sorted(good), sorted(cleaned), strict=True)) > 0
