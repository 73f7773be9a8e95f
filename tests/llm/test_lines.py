from loomlake.llm import lines


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.text for r in lines.drop_lines(docs).collect()}


def own(k, n=6):
    return "\n".join(f"document{chr(97 + k)} has own line{chr(97 + j)} of words{chr(97 + (k * 7 + j) % 26)} number{chr(97 + (k * 3 + j * 5) % 26)} here" for j in range(n))


def test_recurring_templates_go(spark):
    passage = " ".join(f"passage{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    texts = [own(k, 30) + f"\nPage {k} of {k * 11} printed on day {k}\n{passage}\n\nend{chr(97 + k)} it" for k in range(5)]
    got = run(spark, texts)
    for k in range(5):
        assert "printed on day" not in got[k] and passage not in got[k]
        assert got[k] == own(k, 30) + f"\n\nend{chr(97 + k)} it"


def test_fields_that_are_words(spark):
    line = "dear customer your parcel from {} will arrive at the place that you have named in your last order with us today or later"
    names = ["berlin", "oslo", "madrid", "paris", "rome"]  # each variant once
    got = run(spark, [own(k, 30) + "\n" + line.format(n) for k, n in enumerate(names)])
    assert all(got[k] == own(k, 30) for k in range(5))


def test_two_templates_in_one_leaf(spark):
    """Two families of boilerplate of equal length and equal leading words."""
    one = "please note that the office in {} is closed on all public days of the year until further notice is given"
    two = "please note that every order from {} will be shipped within four days after we have received your full payment"
    names = ["berlin", "oslo", "madrid", "paris", "rome", "bern"]
    got = run(spark, [own(k, 30) + "\n" + (one, two)[k % 2].format(n) for k, n in enumerate(names)])
    assert all(got[k] == own(k, 30) for k in range(6))


def test_short_lines_must_be_equal(spark):
    """Lines of one leaf that share only their length and leading words stay, whatever else recurs in it."""
    texts = [own(k, 30) + "\nsee also the footer\nsee also " + f"topic{chr(97 + k)} name{chr(97 + k)}" for k in range(5)]
    got = run(spark, texts)
    assert all(got[k] == texts[k].replace("\nsee also the footer", "") for k in range(5))


def test_large_boilerplate_on_short_pages(spark):
    """A passage of 60 words goes from pages that have a dozen words of their own."""
    passage = " ".join(f"passage{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    got = run(spark, [own(k, 2) + "\n" + passage for k in range(4)])
    assert all(got[k] == own(k, 2) for k in range(4))


def test_prefilters_lose_nothing(spark):
    """Recall of planted templates with up to two variable stretches, against the plain rule over all pairs of texts."""
    import random

    rng = random.Random(8)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    families = [[rng.choice(words) for _ in range(rng.randrange(3, 30))] for _ in range(12)]
    texts = []
    for k in range(60):
        line = list(rng.choice(families))
        for _ in range(rng.randrange(3)):
            line[rng.randrange(2, len(line))] = rng.choice(words)
        texts.append("\n".join([" ".join(rng.choice(words) for _ in range(20)) for _ in range(5)] + [" ".join(line)]))

    def templates(line):
        t = line.split()
        rest = len(t) - 2
        m = min(rest, 8)
        cuts = [2 + k * rest // m for k in range(m + 1)] if m > 0 else []
        g = [tuple(t[cuts[k] : cuts[k + 1]]) for k in range(m)]
        return {(len(t), *t[:2], p, *(g[k] for k in range(m) if p >> k & 1)) for p in lines.patterns(max(m, 0))}

    carriers = {}
    for k, text in enumerate(texts):
        for line in text.split("\n"):
            for t in templates(line):
                carriers.setdefault(t, set()).add(k)
    want = {k: "\n".join(x for x in text.split("\n") if not any(len(carriers[t]) >= 3 for t in templates(x))) for k, text in enumerate(texts)}
    got = run(spark, texts)
    assert got == want and sum(w != t for w, t in zip(want.values(), texts, strict=True)) > 30


def test_shuffled_join_drops_the_same(spark, monkeypatch):
    monkeypatch.setattr(lines, "MAX_BROADCAST", -1)
    got = run(spark, [own(k, 30) + "\nthe same closing line" for k in range(4)])
    assert all(got[k] == own(k, 30) for k in range(4))


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, own(k, 30) + "\nthe same closing line") for k in range(3)], "doc_id long, text string").withColumns({c: F.lit(c) for c in ("line_dropped", "line_doc_id", "dropped", "gone_body", "body", "row", "left", "leaf", "pos", "g")})
    kept = lines.drop_lines(docs)
    assert kept.columns == docs.columns and all(r.text == own(r.doc_id, 30) and r.left == "left" for r in kept.collect())


def test_copies_stay_whole(spark):
    text = own(0, 10)
    near = text.replace("linea", "lineq")
    got = run(spark, [text, text, text, text + "\nx y", near, own(5)])
    assert got == {0: text, 1: text, 2: text, 3: text + "\nx y", 4: near, 5: own(5)}


def test_two_documents_do_not_make_boilerplate(spark):
    texts = [own(k) + "\nthe same closing line" for k in range(2)]
    assert run(spark, texts) == dict(enumerate(texts))


def test_odd_rows(spark, odd, none):
    kept = lines.drop_lines(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r) for r in kept.collect()) == sorted(str(r) for r in odd.collect())
    assert lines.drop_lines(none).count() == 0
    assert lines.line_report(odd).count() == odd.count()


def test_counts_are_updated(spark):
    docs = spark.createDataFrame([(k, own(k, 30) + "\nsame old line here", 1) for k in range(4)], "doc_id long, text string, n_chars long")
    assert all(r.n_chars == len(r.text) for r in lines.drop_lines(docs).collect())


def test_words_of_equal_short_hashes_stay_apart(spark):
    """wibffj and wjbacd have one 32-bit hash: no line of three documents recurs by it."""
    texts = [own(k, 30) + f"\nalpha beta {w}" for k, w in enumerate(["wibffj", "wibffj", "wjbacd"])]
    assert run(spark, texts) == dict(enumerate(texts))
    texts = [own(k, 30) + "\nalpha beta wibffj" for k in range(3)]
    assert run(spark, texts) == {k: own(k, 30) for k in range(3)}
