"""Vector codes, source divergence and URL filters against brute-force versions, their SQL and odd tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegraph.llm import divergence, url_filter, vector_codes
from clausegraph.llm.queries import ORACLES, QUERIES
from tests.test_oracles import TABLES, plain

CLASHES = ("code", "key", "n", "row", "v", "heaps", "place", "host", "path", "short", "digest", "terms", "kind", "term", "docs", "p", "q", "rank", "value", "item", "found")


def clash(df):
    """With columns whose names operators might use."""
    return df.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_divergence", "op13_url_filter"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert len(found) and sorted(found.columns) == sorted(want.columns) and plain(found) == plain(want)


# vector codes

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_codes(rows, rounds=6):
    """(vec_id, label, code, error) by plain Lloyd in Python's whole numbers, and the final entries."""
    kept = [(i, l, [math.floor(4096 * x) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], []
    d = len(kept[0][2]) // 8
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(v, p) for _, _, v in kept[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            owned = defaultdict(list)
            for _, _, v in kept:
                owned[near(part(v, p), books[p])[1]].append(part(v, p))
            for e, vs in owned.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out = []
    for i, l, v in kept:
        found = [near(part(v, p), books[p]) for p in range(8)]
        out.append((i, l, bytes(e for _, e in found), sum(e for e, _ in found)))
    return out, [c for book in books for entry in book for c in entry]


def made(kind, n, d, seed=1):
    rng = random.Random(seed)
    if kind == "ties":  # few values, so that many distances are equal
        return [(i, [rng.choice((-1, 0, 1)) / 4096 for _ in range(d)], rng.choice((None, 1, 2))) for i in range(n)]
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(20)]
    return [(i, [c + rng.gauss(0, 0.05 if kind == "clusters" else 1) for c in rng.choice(centres)], i % 3) for i in range(n)]


@pytest.mark.parametrize(("kind", "n", "d"), [("ties", 300, 16), ("clusters", 500, 16), ("spread", 400, 8), ("ties", 9, 8), ("spread", 1, 8), ("clusters", 40, 64)])
def test_codes_against_plain_lloyd(spark, kind, n, d, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 64)
    table = spark.createDataFrame(made(kind, n, d), VECTORS)
    rows = [tuple(r) for r in table.collect()]  # as floats of 32 bits
    want, entries = brute_codes(rows)
    codes, books, _ = vector_codes.compress(table.repartition(3))
    assert Counter((r.vec_id, r.label, bytes(r.code), r.error) for r in codes.collect()) == Counter(want)
    assert books.ravel().tolist() == entries


def test_bounds_spare_scans(spark):
    table = spark.createDataFrame(made("clusters", 2000, 32), VECTORS)
    _, _, scans = vector_codes.compress(table, rounds=10)  # entries move far in the first rounds, so most parts are scanned there
    assert scans[0] == 8 * 2000 and all(s < 8 * 2000 / 4 for s in scans[3:])


def test_heaps_keep_their_order_when_packed():
    rng = random.Random(4)
    heaps, held = vector_codes.Heaps(16), defaultdict(list)
    for step in range(30):
        at, rows = rng.randrange(128), list(range(step * 50, step * 50 + 50))
        keys = [rng.uniform(-9, 9) for _ in rows]
        heaps.push(at, keys, rows)
        held[at] += zip(keys, rows, strict=True)
        heaps = vector_codes.Heaps(16, heaps.packed())
        for at in list(held):
            drift = rng.uniform(-9, 0)
            popped = heaps.pop(at, drift)
            assert sorted(popped) == sorted(r for k, r in held[at] if k <= drift)
            held[at] = [(k, r) for k, r in held[at] if k > drift]


def test_a_skipped_part_is_never_wrong():
    """After every round each part's entry is the first of the nearest, whether it was scanned or not."""
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (500, 8, 3))
    books = x[:16].transpose(1, 0, 2).copy()
    heaps, drift = vector_codes.Heaps(16), np.zeros((8, 16))
    for n in range(12):
        _, _, scanned = vector_codes.settle(x, heaps, books, drift, n == 0)
        assert n == 0 or scanned <= 4000
        want = np.stack([((x[:, p, None, :] - books[p]) ** 2).sum(2).argmin(1) for p in range(8)], 1)
        assert (heaps.owners(500) == want).all()
        moved = books + rng.integers(-3, 4, books.shape) * (rng.random((8, 16, 1)) < 0.3)
        move = np.sqrt(((moved - books) ** 2).sum(2).astype(float))
        drift = drift + (move + np.array([[np.delete(m, e).max() for e in range(16)] for m in move])) * (1 + vector_codes.SLIP)
        books = moved


def test_codes_of_odd_rows(spark):
    good = made("clusters", 30, 16)
    odd = [(100, None, 1), (101, [None] * 16, 1), (102, [math.nan] + [0.0] * 15, 1), (103, [math.inf] * 16, None), (104, [-math.inf] * 16, None)]
    unfit = [(200, [0.5] * 8, 1), (201, [], 1), (202, [1e30] * 16, None), (203, [0.5] * 17, 5)]
    repeats = [(None, [0.1] * 16, None), (None, [0.1] * 16, None), (3, [0.2] * 16, 9), good[4]]
    table = spark.createDataFrame(good + odd + unfit + repeats, VECTORS)
    want, entries = brute_codes([tuple(r) for r in spark.createDataFrame(good + repeats, VECTORS).collect()])
    codes, books, _ = vector_codes.compress(clash(table))
    found = [(r.vec_id, r.label, r.code and bytes(r.code), r.error) for r in codes.collect()]
    assert Counter(found) == Counter(want + [(i, l, None, None) for i, _, l in unfit])
    assert books.ravel().tolist() == entries


def test_codes_query_of_odd_tables(spark, tmp_path):
    good = made("clusters", 40, 16)
    rows = [*good, (50, [0.0] * 16, None), (51, [0.25] * 16, None), (52, None, None), (53, [0.5] * 8, 77)]
    clash(spark.createDataFrame(rows, VECTORS)).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, entries = brute_codes([tuple(r) for r in spark.createDataFrame(rows[:-2], VECTORS).collect()])
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    found = QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in found} == {(i, c.hex(), e, sums[l]) for i, l, c, e in want} | {(53, None, None, None)}
    assert {r.codebooks_sha256 for r in found} == {hashlib.sha256(",".join(map(str, entries)).encode()).hexdigest()}


def test_codes_of_nothing(spark, tmp_path):
    spark.createDataFrame([(1, None, 1)], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op11_vector_codes"](spark, str(tmp_path))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and found.count() == 0


# source divergence

DOCS = "doc_id long, text string, lang string, source string"


def brute_audit(rows, least):
    groups, counts, held = set(), Counter(), defaultdict(set)
    for n, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower):
            counts[lang, source, term] += 1
            held[lang, term].add(n)
    kept = defaultdict(list)
    for (lang, term), docs in held.items():
        if len(docs) >= least:
            kept[lang].append(term)
    out, p, q = [], {}, {}
    for lang in {g[0] for g in groups}:
        v, sources = kept[lang], sorted(s for g, s in groups if g == lang)
        whole = {t: sum(counts[lang, s, t] for s in sources) for t in v}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (sum(whole.values()) + 5 * len(v)) for t in v}
        for s in sources:
            total = sum(counts[lang, s, t] for t in v)
            p[s] = {t: 1 + 10**9 * (counts[lang, s, t] + 5) // (total + 5 * len(v)) for t in v}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in v)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in v if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, x, r) for r, (i, x) in enumerate(ranked, 1) if part == "pair" or r <= 50]
    return Counter(out)


def texts(n, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a, b in itertools.product("Abcdéß", "xyzÄ漢")] + ["it's", "a_b", "x9y", "😀", "\u00a0"]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(("en", "en", "de", None)), rng.choice(("a", "a", "b", "c", "", None))) for i in range(n)]


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
def test_audit_against_brute_force(spark, most_bytes):
    rows = texts(200) + [(None, None, "fr", "only"), (1, "", "xx", "one"), (1, "", "xx", "two"), (2, "Rare words", "xx", None), (3, "long " * 50_000 + "Ärger", "de", "b"), (3, "long " * 50_000 + "Ärger", "de", "b")]
    found = divergence.audit(clash(spark.createDataFrame(rows, DOCS)).repartition(5), least_docs=4, most_bytes=most_bytes)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in found.collect()) == brute_audit(rows, 4)


def test_audit_cuts_terms_at_fifty_and_keeps_all_pairs(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    rows = [(i, " ".join(words[i % 3 :: 3] * 3), "en", f"s{i % 60:02}") for i in range(240)]
    found = Counter(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOCS), least_docs=4).collect())
    assert found == brute_audit(rows, 4)
    assert max(r[5] for r in found if r[2] == "pair") == 59


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    alone = divergence.audit(spark.createDataFrame([(1, None, None, None)], DOCS))
    assert alone.count() == 0


def test_no_python_runs_in_the_audit(spark, sf):
    plan = QUERIES["op12_divergence"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# URL filters

PAGES = "page_id long, url string, html string"
URLS = ["http://WWW.Example.com/en/1?x=/de/#a", "https://example.com", "http://example.com?q", "http://example.com/#", "no scheme/en/", "", None, "://", "http:///en/", "x://y://net/es/1", "https://a.net/es/", "https://net/es/x", "https://b.a.net./fr/", "https://planet/fr/", "http://com/", "http://example.com/EN/", "ftp://user@www.example.com:80/en/", "http://example.com/en/\n/x y", "http://ä.NET/fr/é", f"http://{'a.' * 2000}com/{'en/' * 5000}"]
RULES = [*url_filter.RULES, ("", "", "block"), ("example.com", "", "allow"), ("example.com", "/e", "block"), ("a.net", "/es/", "allow"), ("com", "/en/en/en/", "block"), ("NET", "/fr/é", "block"), (None, "/en/", "allow"), ("y:", "", "block")]


def brute_judge(url, rules, otherwise="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    host = lower(host)
    best = None
    for h, p, v in rules:
        h, p = lower(h or ""), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), h + p, v))
    return host, path, best and best[2], best[3] if best else otherwise


@pytest.mark.parametrize("most_bytes", [32 << 20, 0])
@pytest.mark.parametrize("rules", [RULES, url_filter.RULES, RULES[:1]])
def test_filter_against_brute_force(spark, rules, most_bytes):
    pages = spark.createDataFrame([(i if i % 5 else None, u, "x") for i, u in enumerate(URLS * 2)], PAGES)
    found = url_filter.judge(clash(pages), spark.createDataFrame(rules, "host string, path string, verdict string"), most_bytes=most_bytes)
    want = Counter((i if i % 5 else None, *brute_judge(u, rules)) for i, u in enumerate(URLS * 2))
    assert Counter(tuple(r) for r in found.collect()) == want


def test_filter_of_random_rules(spark):
    rng = random.Random(6)
    host = lambda: ".".join(rng.choices("ab", k=rng.randrange(1, 5)))
    path = lambda: "".join(rng.choices("/xy", k=rng.randrange(0, 6)))
    rules = list({(h, p): (h, p, rng.choice(("allow", "block"))) for h, p in ((host(), path()) for _ in range(300))}.values())
    urls = [(i, f"s://{host()}/{path()}", None) for i in range(500)]
    for most_bytes in (32 << 20, 0):
        found = url_filter.judge(spark.createDataFrame(urls, PAGES), spark.createDataFrame(rules, "host string, path string, verdict string"), most_bytes=most_bytes, otherwise="block")
        assert {tuple(r) for r in found.collect()} == {(i, *brute_judge(u, rules, "block")) for i, u, _ in urls}


def test_short_prefixes_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHORT", 0)  # all expressions collide
    found = url_filter.judge(spark.createDataFrame([(1, "http://a.com/x", ""), (2, "http://b.com/x", "")], PAGES), spark.createDataFrame([("a.com", "/x", "block"), ("c.com", "/x", "block")], "host string, path string, verdict string"))
    assert {(r.page_id, r.rule, r.verdict) for r in found.collect()} == {(1, "a.com/x", "block"), (2, None, "allow")}


def test_filter_repeated_rules_and_nothing(spark):
    schema = "host string, path string, verdict string"
    twice = spark.createDataFrame([("a.com", "/", "block"), ("A.com", "/", "allow"), ("a.com", "/", "allow")], schema)
    page = spark.createDataFrame([(1, "http://a.com/", "")], PAGES)
    assert [tuple(r) for r in url_filter.judge(page, twice).collect()] == [(1, "a.com", "/", "a.com/", "block")]
    assert [tuple(r) for r in url_filter.judge(page, spark.createDataFrame([], schema)).collect()] == [(1, "a.com", "/", None, "allow")]
    assert url_filter.judge(spark.createDataFrame([], PAGES), twice).count() == 0
