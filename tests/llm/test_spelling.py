import random
import re
import zlib

import pytest

from loomlake.llm import spelling


def brute(rows):
    counts = {}
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {u: [w for w in words if one_apart(u, w)] for u in words}
    form = {}
    for u, own in near.items():
        best = min(own, key=lambda w: (-words[w], w), default=None)
        form[u] = best if best is not None and words[best] >= 10 * words[u] else None
    out = []
    for u, n in words.items():
        root = u
        while form[root] is not None:
            root = form[root]
        out.append((u, form[u], root, n, len(near[u]), words[form[u]] if form[u] is not None else None))
    return sorted(out, key=str)


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.spelling_variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def edited(rng, w, letters):
    k = rng.randrange(len(w) + 1)
    return rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])


@pytest.mark.parametrize("most,shard", [(1024, 4096), (7, 8)])
def test_equals_brute_force(spark, monkeypatch, most, shard):
    """With whole halves, and with halves that are cut further as far as it goes."""
    monkeypatch.setattr(spelling, "MAX_SEGMENT", most)
    monkeypatch.setattr(spelling, "SHARD", shard)
    rng = random.Random(most)
    letters = "abÀÿ×"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "abababab"]
    for _ in range(2):
        words += [edited(rng, w, letters) for w in words]
    rows = [(k, " ".join(rng.choices(words, k=20)).replace("b", "B", 1)) for k in range(60)]
    rows += [(1000 + k, " ".join([words[0], words[25]] * 40)) for k in range(6)]
    assert variants(spark, rows) == brute(rows)


def test_chains_lead_to_their_end(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ERRORS", 1 << 40)
    counts = {"wwwwwwwa": 2, "wwwwwwab": 20, "wwwwwwabc": 200, "wwwwwwabcd": 2000, "zzzzzzz": 2, "zzzzzzzz": 20, "yyyyyyy": 2, "yyyyyyya": 20, "yyyyyyyb": 20}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    got = {r[0]: r for r in variants(spark, rows)}
    assert got["wwwwwwab"][1:3] == ("wwwwwwabc", "wwwwwwabcd") and got["wwwwwwabcd"][1:3] == (None, "wwwwwwabcd")
    assert got["wwwwwwwa"][2] in ("wwwwwwwa", "wwwwwwabcd") and got["zzzzzzz"][1:3] == ("zzzzzzzz", "zzzzzzzz")
    assert got["yyyyyyy"] == ("yyyyyyy", "yyyyyyya", "yyyyyyya", 2, 2, 20)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in spelling.spelling_variants(odd).collect()), key=str) == brute(rows)
    assert spelling.spelling_variants(none).count() == 0
    long = "q" * 50_000
    rows = [(1, long), (2, long + " " + long[1:]), (3, long[1:])]
    assert variants(spark, rows) == brute(rows)


def test_one_edit():
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab", k=rng.randrange(6))) for _ in range(60)]
    for a in texts:
        for b in texts:
            if abs(len(a) - len(b)) <= 1:
                assert spelling.one_edit(a, b) == one_apart(a, b)
