"""The training-data operators against brute-force versions, round trips and edge cases."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegraph.llm import common, ctw, encode, exact_dedup, html_text, langid, mixing, packing, quality, simhash, token_files, warc
from clausegraph.llm.common import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows, and columns with clashing names."""
    long = "alpha beta gamma delta " * 6000
    rows = [(1, "Alpha Beta", "en", "a"), (2, "alpha beta", "en", "a"), (3, None, None, None), (4, "", "en", None), (5, "\t \n", "de", "b"), (6, long, "en", "a"), (6, long, "en", "a"), (None, "alpha beta", "en", "a"), (None, None, None, None), (7, "ÄÖ äö ÄÖ", "de", "b"), (8, "äö äö äö", "de", "b"), (-9, "x", "en", "b"), (10, "1234 !!", "en", "b")]
    made = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], DOCS)
    return made.withColumns({c: F.lit(7) for c in ("kept", "_sha", "fp", "block", "_doc", "score", "tokens", "_g", "row", "_id", "component_id")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# exact dedup


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return Counter(out), len(groups)


def test_exact_groups(odd, docs, empty):
    for table in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        found = exact_dedup.exact_groups(table).collect()
        want, n = brute_groups(rows)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
        kept = [r for r in found if r["kept"]]
        assert len(kept) == n and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_keeps_columns(odd, empty):
    stay = exact_dedup.exact_dedup(odd)
    assert stay.columns == odd.columns
    assert Counter(r["doc_id"] for r in stay.collect()) == Counter([2, 4, 5, 6, 7, 8, -9, 10])
    assert exact_dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_no_bound_of_the_filter_changes_a_group(spark, monkeypatch, broadcast):
    """A crowded filter, a filter too large for a broadcast, and hot groups."""
    monkeypatch.setattr(exact_dedup, "WORD_KEYS", 2000)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    rows = [(i, f"t{i % 6000}" if i % 3 else "Hot", "en", "s", 1) for i in range(9000)]
    frame = spark.createDataFrame(rows, DOCS)
    found = exact_dedup.exact_groups(frame).collect()
    want = brute_groups([r[:2] for r in rows])[0]
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    assert Counter(r["doc_id"] for r in exact_dedup.exact_dedup(frame).collect()) == Counter({keep for _, keep, _, _ in want})


def test_filter_lets_few_unique_rows_through(spark):
    rows = spark.range(20_000).select(F.sha2(F.when(F.col("id") % 10 == 0, F.col("id") % 400).otherwise(F.col("id")).cast("string"), 256).alias("_sha")).cache()
    repeated = rows.groupBy("_sha").count().where("count > 1")
    marked = exact_dedup.Filter(rows, 20_000).mark(rows)
    assert marked.join(repeated, "_sha", "left_semi").where("not _possible").count() == 0
    assert marked.join(repeated, "_sha", "left_anti").where("_possible").count() < 0.05 * 20_000


# encoding, packing, token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_encode_as_whole_texts(docs, library):
    texts = [r["text"] for r in docs.select("text").collect()]
    texts += ["a  b", "a\tb", " a", "a ", "\n\na b", "a\n\nb", "a\n b", "a \nb", "a\x1cb c", "it's 'll x's.", "<|endoftext|> x.", "x <|endoftext|> y", "a b<|endoftext|>c\nd", "", "a\r\nb", "\n", "ü ß\nö.", "a\u0085b\nc d", "a  b", "é. x", "漢字, 漢", "x.!?.. ...", ".\n.", "9. a1. 1a,", None]
    found = encode.Encoder(encode.default_path()).encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library(t) for t in texts]


def check_packing(rows, table, library, window=2048):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(Counter)
    for r in table:
        ids = [*library(r["text"]), 1]
        for start in range(0, len(ids), window):
            part = np.asarray(ids[start : start + window], "<u4").tobytes()
            want[r["doc_id"]][(start, len(part) // 4, zlib.crc32(part), len(ids))] += 1
    assert {k: Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in v) for k, v in pieces.items()} == dict(want)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window


def test_added_tokens_are_the_library_s(library):
    assert library("x <|endoftext|> y") == [87, 220, 50256, 331]
    found = encode.Encoder(encode.default_path()).encode(["x <|endoftext|> y"])
    assert np.frombuffer(found[0], "<u4").tolist() == [87, 220, 50256, 331]


def test_packing_pads_little(docs):
    rows = packing.pack(docs.coalesce(1)).collect()
    windows = {r["sequence_id"] for r in rows}
    assert len(windows) <= 1 + sum(r["length"] for r in rows) / (0.995 * 2048)


def test_packing(odd, docs, empty, library):
    for table in (odd, docs):
        check_packing(packing.pack(table).collect(), table.collect(), library)
    assert packing.pack(empty).count() == 0


def test_best_fit_is_the_tightest():
    rng = random.Random(5)
    for window in (7, 64, 100):
        lengths = np.array([rng.randint(1, window) for _ in range(500)])
        number, offset = packing.best_fit(lengths, window)
        rooms, want = [], {}
        for i in np.argsort(-lengths, kind="stable").tolist():
            fits = [r for r in rooms if r >= lengths[i]]
            room = min(fits) if fits else window
            if fits:
                rooms.remove(room)
            want[i] = window - room
            if room - lengths[i]:
                rooms.append(room - lengths[i])
        assert [want[i] for i in range(500)] == offset.tolist()
        assert len(set(number.tolist())) == number.max() + 1


@pytest.mark.parametrize("bits", [1, 5, 11, 16, 17, 31])
def test_bit_packing(bits, tmp_path):
    rng = np.random.default_rng(bits)
    texts = [rng.integers(0, 1 << bits, n).astype("<u4") for n in (0, 1, 7, 70_000, 3, 0, 66_000, 12)]
    out = token_files.Writer(f"file://{tmp_path}/x.tids", bits)
    for k, ids in enumerate(texts):
        out.add(None if k == 0 else k, ids.tobytes())
    out.close()
    reader = token_files.Reader(f"file://{tmp_path}/x.tids")
    back = list(reader)
    assert [d for d, _, _ in back] == [None, *range(1, 8)]
    assert all(np.array_equal(a, b) for (_, _, a), b in zip(back, texts, strict=True))
    assert all(np.array_equal(reader.document(k), texts[k]) for k in range(8))


def test_token_files(spark, odd, docs, empty, library):
    for table in (odd, docs):
        folder = new_folder(spark, "t")
        found = token_files.read_tokens(token_files.write_tokens(table, folder, rows_a_shard=40)).collect()
        at, want = 0, []
        rows = sorted(table.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
        for r in rows:
            ids = [*library(r["text"]), 2]
            want.append((r["doc_id"], at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    assert token_files.read_tokens(token_files.write_tokens(empty, new_folder(spark, "t"))).count() == 0


# SimHash


def brute_fingerprint(spark_hash, text):
    w = [x.decode() for x in words(lower(text))]
    if not w:
        return 0
    h = [spark_hash(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, fp, least.get(find(i))) for i, (d, fp) in enumerate(fps))


def test_simhash(spark, odd, docs, empty):
    import xxhash

    for table in (odd, docs):
        rows = table.collect()
        want = brute_components([(r["doc_id"], brute_fingerprint(lambda s: xxhash.xxh64_intdigest(s.encode(), 42), r["text"])) for r in rows])
        found = simhash.near_groups(table).collect()
        assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == want
    assert simhash.near_groups(empty).count() == 0
    native = spark.range(1).select(F.xxhash64(F.lit("ab cd ef"))).first()[0]
    assert native % (1 << 64) == xxhash.xxh64_intdigest(b"ab cd ef", 42)


@pytest.mark.parametrize("group_rows", [20_000, 30])
def test_links_find_all_components(spark, monkeypatch, group_rows):
    """Random and clustered fingerprints; with small groups, the hot keys are cut into blocks."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(200)}
    centre = rng.getrandbits(64)
    for _ in range(400):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        fps.add(x)
    for f in list(fps)[:150]:
        fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    roots = {r["v"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    found = defaultdict(set)
    for f in fps:
        found[roots.get(f, f"alone {f}")].add(f)
    want = brute_components(list(enumerate(fps)))
    groups = defaultdict(set)
    for _, fp, least in want:
        groups[least].add(fp)
    assert {frozenset(x) for x in found.values()} == {frozenset(x) for x in groups.values()}


@pytest.mark.parametrize("hot", [5_000, 5])
def test_components_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(400, i) for i in range(401, 460)] + [(i, i + 1) for i in range(500, 540)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r["v"]: r["root"] for r in simhash.components(frame).collect()}
    assert found == {v: find(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}
    assert simhash.components(frame.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        simhash.components(frame, most_rounds=1)


def test_near_dedup_keeps_one(docs, odd):
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    stay = simhash.near_dedup(docs)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted({c for c in groups.values()})
    assert simhash.near_dedup(odd).columns == odd.columns
    # 1 and 2 are equal texts; 3, 4, 5 and one row without an id are zero; 6 is there twice; 8 says 7's words.
    assert Counter(r["doc_id"] for r in simhash.near_dedup(odd).collect()) == Counter([1, 3, 6, 7, 8, -9, 10])


def test_near_dedup_goes_by_row(spark, empty):
    text, near, other = (" ".join(f"{k}{i}" for i in range(300)) for k in ("a", "a", "b"))
    near = near.replace(" ", "  ")
    rows = [(6, near, "en", "s", 1), (1, text, "en", "s", 1), (6, other, "en", "s", 1), (7, other, "en", "s", 1), (None, text, "en", "s", 1), (None, "alone it stands", "en", "s", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    assert simhash.near_groups(frame).where("component_id = 1").count() == 3
    assert Counter(r["text"] for r in simhash.near_dedup(frame).collect()) == Counter([text, other, "alone it stands"])
    twice = simhash.near_dedup(frame.union(frame)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in twice) == Counter([(1, text), (6, other), (None, "alone it stands")])
    assert simhash.near_dedup(empty).count() == 0


# language ID


def test_language(spark, docs, odd, empty):
    split = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = langid.fit(split, ~F.col("held_out"))
    found = {r["doc_id"]: r for r in langid.predict(split, model, keep=("held_out",)).collect()}
    held = [r for r in split.collect() if r["held_out"] and r["lang"]]
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    rows = langid.predict(odd, model).collect()
    assert len(rows) == odd.count() and all((r["lang_pred"] == "und") == (r["doc_id"] in (3, 4, 5, 10) or r["doc_id"] is None and r["languages"] == {}) for r in rows)
    none = langid.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    assert langid.keep_identified(docs).columns == docs.columns


def test_mixture_finds_both_languages(docs):
    model = langid.fit(docs, F.lit(True))
    text = {lang: " ".join(r["text"] for r in docs.where(F.col("lang") == lang).limit(8).collect())[:6000] for lang in ("de", "fr")}
    lang, score, both = model.infer(text["de"][:5000] + " " + text["fr"][:3000])
    assert lang == "de" and set(both) == {"de", "fr"} and 0.5 < score < 0.75
    one = model.infer(text["de"])
    assert one[0] == "de" and one[1] > 0.95


def test_more_than_eight_languages_in_a_text():
    counts = np.full((12, langid.BUCKETS), 0.0)
    letters = [chr(0x3041 + 3 * k) for k in range(12)]
    texts = [f"{c * 4} " * 60 for c in letters]
    for k, t in enumerate(texts):
        counts[k] = np.bincount(langid.trigrams(t * 20), minlength=langid.BUCKETS)
    model = langid.Model([f"l{k:02}" for k in range(12)], counts, np.full(12, 1 / 12))
    assert set(model.infer(" ".join(texts))[2]) == set(model.languages)


def test_inference_by_brute_force(docs):
    """Trigrams, distributions, expectation-maximisation and the choice of the set, written once more from the docstring."""
    import re

    rows = docs.select("doc_id", "text", "lang").collect()
    fold = lambda t: bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {t.lower()} ".encode())

    def grams(t):
        b = fold(t)
        return Counter((int.from_bytes(b[i : i + 3], "big") * 2654435761 % (1 << 32)) >> 16 for i in range(len(b) - 2) if b[i : i + 3] != b"   ")

    languages = sorted({r["lang"] for r in rows if r["lang"]})
    counts = {l: sum((grams(r["text"]) for r in rows if r["lang"] == l and r["text"]), Counter()) for l in languages}
    total = {l: sum(c.values()) + 0.1 * (1 << 16) for l, c in counts.items()}
    labelled = Counter(r["lang"] for r in rows if r["lang"])
    model = langid.fit(docs, F.lit(True))
    assert model.languages == languages

    def em(n, chosen):
        share, size = {l: 1 / len(chosen) for l in chosen}, sum(n.values())
        p = {g: {l: (counts[l][g] + 0.1) / total[l] for l in chosen} for g in n}
        for _ in range(25):
            new = dict.fromkeys(chosen, 0.0)
            for g, k in n.items():
                whole = sum(share[l] * p[g][l] for l in chosen)
                for l in chosen:
                    new[l] += k * share[l] * p[g][l] / whole / size
            done = max(abs(new[l] - share[l]) for l in chosen) < 1e-3
            share = new
            if done:
                break
        return share, sum(k * math.log(sum(share[l] * p[g][l] for l in chosen)) for g, k in n.items())

    for r in rows[::4]:
        n = grams(r["text"] or "")
        if not n or not re.search(r"[^\W\d_]", r["text"]):
            assert model.infer(r["text"]) == ("und", 0.0, {})
            continue
        alone = {l: sum(k * math.log((counts[l][g] + 0.1) / total[l]) for g, k in n.items()) for l in languages}
        best = max(languages, key=lambda l: alone[l] + math.log(labelled[l] / sum(labelled.values())))
        cost = 3.0 * math.log(sum(n.values()) + 1)
        share, full = em(n, languages)
        chosen, shares, value = [best], {best: 1.0}, alone[best]
        if full - value > cost:
            order = [best, *sorted((l for l in languages if l != best), key=lambda l: -share[l])]
            for size in range(2, len(order) + 1):
                share, log_l = em(n, order[:size])
                if log_l - cost * (size - 1) <= value:
                    break
                shares, value = share, log_l - cost * (size - 1)
        lang, score, found = model.infer(r["text"])
        assert set(found) == set(shares) and lang == max(shares, key=shares.get)
        assert all(found[l] == pytest.approx(shares[l], abs=5e-3) for l in shares) and score == pytest.approx(shares[lang], abs=5e-3)


# language-model scoring


def brute_tree_weight(counts, context, depth):
    """Weighted block probability of a node by the definition; counts: {(context bytes, newest first): (zeros, ones)}."""
    zeros, ones = counts.get(context, (0, 0))
    own = 1.0
    for k in range(zeros):
        own *= (k + 0.5) / (k + 1)
    for k in range(ones):
        own *= (k + 0.5) / (zeros + k + 1)
    if len(context) == depth:
        return own
    below = math.prod(brute_tree_weight(counts, c, depth) for c in counts if len(c) == len(context) + 1 and c[: len(context)] == context)
    return 0.5 * own + 0.5 * below


def brute_log10(corpus, text, depth):
    """Ratio of the root's weighted probability with and without one more bit, for every bit of the text."""
    counts = defaultdict(lambda: defaultdict(lambda: [0, 0]))

    def steps(t):
        data = bytes([255]) * depth + t.encode() + bytes([255])
        for i in range(depth, len(data)):
            for k in range(8):
                yield (1 << k) | data[i] >> (8 - k), data[i] >> (7 - k) & 1, tuple(reversed(data[i - depth : i]))

    for t in corpus:
        for node, bit, past in steps(t):
            for d in range(depth + 1):
                counts[node][past[:d]][bit] += 1
    total = 0.0
    for node, bit, past in steps(text):
        tree = {c: tuple(v) for c, v in counts[node].items()}
        before = brute_tree_weight(tree, (), depth)
        for d in range(depth + 1):
            z = list(tree.get(past[:d], (0, 0)))
            z[bit] += 1
            tree[past[:d]] = tuple(z)
        total += math.log10(brute_tree_weight(tree, (), depth) / before)
    return total


def test_tree_is_context_tree_weighting(spark):
    corpus = ["abab abba", "abc", "ba", ""]
    frame = spark.createDataFrame([(t,) for t in corpus], "text string")
    for depth in (0, 1, 2):
        tree = ctw.fit_tree(ctw.count_corpus(frame, depth), depth)
        for text in ("ab", "abca", "zz", "", "bab abq"):
            keys, _ = ctw.strings([text], depth)
            assert tree.score(keys).sum() == pytest.approx(brute_log10(corpus, text, depth), abs=1e-4)
    probability = sum(10 ** tree.log10_of(np.array([(ord("a") << 16) | (ord("b") << 8) | x], np.uint64))[0] for x in range(256))
    assert probability == pytest.approx(1, abs=1e-4)


def test_query_scores_by_brute_force(spark):
    corpus = ["abab abba", "abc", "ba", "", "Abba ab"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*corpus, "abba zz", None])], "doc_id long, text string")
    for depth in (2, 3):
        found = ctw.score_texts(frame, F.col("doc_id") < len(corpus), depth=depth).collect()
        for r in found:
            text = [*corpus, "abba zz", ""][r["doc_id"]]
            assert r["score"] == pytest.approx(brute_log10(corpus, text, depth), abs=1e-4)


def test_heads_keep_their_bound(spark):
    counts = [1] * 500 + [2] * 100 + [3] * 40 + [10, 11, 50, 1000]
    rows = spark.createDataFrame([(n,) for n in counts], "n long")
    for most in (0, 3, 4, 44, 100, 10_000):
        least = ctw._least(rows, most)
        taken = sum(n > least for n in counts)
        assert taken <= most and (least == 0 or taken + counts.count(least) > most)


def test_scores(spark, docs, odd, empty, monkeypatch):
    monkeypatch.setattr(ctw, "HEAD_WORDS", 500)
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        trained = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0
        is_trained = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
        c = Counter()
        for r in rows:
            if is_trained(r["doc_id"]):
                c.update([*words(lower(r["text"])), b""])
        n, v = sum(c.values()), len(c)
        want = Counter()
        for r in rows:
            w = [*words(lower(r["text"])), b""]
            want[(r["doc_id"], is_trained(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5))] += 1
        found = ctw.score_texts(table, trained).collect()
        assert Counter((r["doc_id"], r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found) == want
        assert all(r["score"] < 0 for r in found)
    assert ctw.score_texts(empty, trained).count() == 0
    none = ctw.score_texts(docs, F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["bits_per_byte"] == pytest.approx(8) for r in none)


@pytest.mark.parametrize("depth", [ctw.DEPTH, ctw.MOST_DEPTH])
def test_scores_have_one_depth_at_every_size(spark, docs, monkeypatch, depth):
    """No bound on tables, broadcasts or partitions changes a score."""
    trained = F.col("doc_id") % 3 != 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    tree = ctw.fit_tree(ctw.count_corpus(docs.where(trained).select("text"), depth), depth)
    for name, bound in (("HEAD_STRINGS", 500), ("PART_STRINGS", 2000)):
        monkeypatch.setattr(ctw, name, bound)
    found = ctw.score_texts(docs, trained, depth=depth).collect()
    assert len(found) == docs.count()
    for r in found:
        keys, _ = ctw.strings([texts[r["doc_id"]]], depth)
        want = tree.score(keys).sum()
        assert r["score"] == pytest.approx(want, rel=1e-5)
        assert r["bits_per_byte"] == pytest.approx(-want / math.log10(2) / len(keys), rel=1e-5)


# quality


def brute_stats(text):
    w = [x.decode() for x in words(text)]
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_statistics(docs, odd, empty):
    for table in (docs, odd):
        found = quality.judge(table).collect()
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == Counter((r["doc_id"], *brute_stats(r["text"])) for r in table.collect())
        assert all(not (r["kept"] and r["base_failed"]) for r in found)
    assert quality.judge(empty).count() == 0


def test_outliers_go_and_others_stay(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 400))), "en", f"s{i % 2}", 0) for i in range(600)]
    bad = [(1000 + i, " ".join(rng.choice(vocabulary).upper() + "$$|" for _ in range(120)), "en", "s0", 0) for i in range(40)]
    kept = {r["doc_id"] for r in quality.judge(spark.createDataFrame(rows + bad, DOCS)).collect() if r["kept"]}
    assert not kept & {r[0] for r in bad}
    assert len(kept) >= 0.99 * len(rows)


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality.P)) @ rng.normal(size=(quality.P, quality.P))
    frame = spark.createDataFrame([("g", *map(float, r)) for r in x], ["_g", *[f"x{i}" for i in range(quality.P)]])
    p = quality.estimates(frame).first()
    low = np.array([[p[f"l{i}_{j}"] if j <= i else 0 for j in range(quality.P)] for i in range(quality.P)])
    m = np.array([p[f"m{i}"] for i in range(quality.P)])
    found = [r["d2"] for r in quality.with_distance(frame.join(quality.estimates(frame), "_g")).orderBy("x0").collect()]
    inverse = np.linalg.inv(low @ low.T)
    want = [float((r - m) @ inverse @ (r - m)) for r in x[np.argsort(x[:, 0])]]
    assert np.allclose(found, want)


def brute_verdicts(rows, least_rows):
    """doc_id: (kept, distance) of rows (doc_id, lang, source, text), by numpy from the module's docstring."""
    floors, share, p = np.array(quality.FLOORS), 0.75, quality.P
    x, group = {}, {}
    for i, lang, source, text in rows:
        n, chars, symbols, dup, repeats, failed = brute_stats(text)
        lines = sum(1 for line in (text or "").split("\n") if words(line))
        if not failed:
            capitals = sum("A" <= c <= "Z" for c in text)
            x[i] = [math.log(chars / n), math.log(n), math.sqrt(symbols / n), math.sqrt(dup / (lines + 1)), math.sqrt(repeats / n), math.sqrt(capitals / chars)]
            group[i] = (lang, source)
    sizes, langs = Counter(group.values()), Counter(g[0] for g in group.values())
    level = lambda g: g if sizes[g] >= least_rows else g[:1] if langs[g[0]] >= least_rows else () if len(x) >= least_rows else None
    members = defaultdict(list)
    for i, g in group.items():
        members[level(g)].append(i)

    def first_bin(bins, part):
        return np.sort(bins)[max(0, math.ceil(part * len(bins)) - 1)]

    def median(v):
        return np.array([first_bin(np.sign(c) * np.floor(np.abs(c) / (f / 32) + 0.5), 0.5) * f / 32 for c, f in zip(v.T, floors)])

    def distance(v, m, s):
        return np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(s), v - m)

    bins = lambda d: np.floor(np.log(np.maximum(d, 1e-12)) * 200)
    ridge = np.diag(floors**2)
    out = {i: (False, None) for i, *_ in rows}
    for g, ids in members.items():
        if g is None:
            out |= dict.fromkeys(ids, (True, None))
            continue
        v = np.array([x[i] for i in ids])
        m = median(v)
        w = np.sqrt((median(np.abs(v - m)) * 1.4826) ** 2 + floors**2)
        z = (v - m) / w
        r = np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        starts = [np.eye(p), (z / r).T @ (z / r) / len(v) * p, np.tanh(z).T @ np.tanh(z) / len(v)]
        starts = [(m, a * np.outer(w, w) + ridge) for a in starts]

        def step(m, s):
            d = bins(distance(v, m, s))
            core = v[d <= first_bin(d, share)]
            return core.mean(axis=0), np.cov(core.T, bias=True) + ridge

        for _ in range(2):
            starts = [step(*a) for a in starts]
        best = min(starts, key=lambda a: np.linalg.slogdet(a[1])[1])
        for _ in range(28):
            new = step(*best)
            if np.linalg.slogdet(new[1])[1] >= np.linalg.slogdet(best[1])[1] - 1e-3:
                break
            best = new
        d = distance(v, *best)
        scale = max(1.0, math.exp((first_bin(bins(d), 0.5) + 0.5) / 200) / 5.348120627447116)
        out |= {i: (bool(q / scale <= quality.chi2_quantile(1e-15)), q / scale) for i, q in zip(ids, d)}
    return out


@pytest.mark.parametrize("least_rows", [25, 60])
def test_verdicts_by_brute_force(spark, docs, monkeypatch, least_rows):
    monkeypatch.setattr(quality, "LEAST_ROWS", least_rows)
    table = docs if least_rows != 25 else docs.union(docs.where("n_chars > 800").selectExpr("doc_id + 10000", "concat(upper(text), ' $$$ | ')", "lang", "source", "n_chars").limit(6))
    table = table.cache()
    want = brute_verdicts([(r["doc_id"], r["lang"], r["source"], r["text"]) for r in table.collect()], least_rows)
    found = {r["doc_id"]: r for r in quality.judge(table).collect()}
    assert found.keys() == want.keys()
    for i, (kept, distance) in want.items():
        assert found[i]["kept"] == kept
        assert (found[i]["distance"] is None) == (distance is None)
        assert distance is None or found[i]["distance"] == pytest.approx(distance, rel=1e-3, abs=1e-6)
    assert least_rows != 25 or not all(k for k, d in want.values() if d is not None)


def test_chi2_quantiles():
    assert quality.chi2_quantile(0.5) == pytest.approx(5.348120627447116)
    assert quality.chi2_quantile(0.001) == pytest.approx(22.457744484825323)


def test_a_constant_statistic_and_a_group_at_the_floor(spark):
    rng = random.Random(3)
    vocabulary = [f"{'abcdefghij'[i % 10]}{i}" for i in range(500)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(80))
    for n in (quality.LEAST_ROWS - 1, quality.LEAST_ROWS):
        rows = [(i, text(), "en", "s", 0) for i in range(n - 1)] + [(n, text().upper() + " $$ ||| " * 40, "en", "s", 0)]
        found = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
        assert (found[n]["distance"] is None) == (n < quality.LEAST_ROWS) and found[n]["kept"] == (n < quality.LEAST_ROWS)
        assert all(r["kept"] for i, r in found.items() if i != n)


# mixing


def spark_hash(*values):
    """Spark's xxhash64 of integers given as (value, bytes) pairs and of texts; null leaves the seed."""
    import xxhash

    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def brute_mix(rows, max_epochs, seed, block_tokens):
    """Counter of (doc_id, source, copies, rounded places) from rows (doc_id, text, source)."""
    tokens, count = Counter(), Counter()
    for _, text, source in rows:
        tokens[source] += len(words(text))
        count[source] += 1
    total = sum(tokens.values())
    known = {s: t for s, t in tokens.items() if t}
    most, least = max(known.values()), min(known.values())
    a = 1 - math.log(max_epochs) / math.log(most / least) if most / least > max_epochs else 0.0
    power = {s: (t / total) ** a for s, t in known.items()}
    z = sum(power.values())
    budget = most / ((most / total) ** a / z)
    out = Counter()
    for s in count:
        epochs = power[s] / z * budget / tokens[s] if s in known else 1.0
        epochs = round(epochs) if abs(epochs - round(epochs)) < 1e-9 else epochs
        full, rest = math.floor(epochs), math.floor((epochs - math.floor(epochs)) * tokens[s])
        n_blocks = max(64, -(-tokens[s] // block_tokens)) + 1
        place = lambda e, b, s=s: spark_hash(s, (e, 8), (b, 8), (seed, 4)) % (1 << 30)
        blocks = defaultdict(list)
        for i, text, source in rows:
            if source == s:
                key = spark_hash(None if i is None else (i, 8), text)
                blocks[spark_hash((key, 8), (seed, 4)) % n_blocks].append((key, i, len(words(text))))
        left, extra = rest, set()
        for b in sorted(blocks, key=lambda b: (place(full, b), b)):
            here = sum(t for _, _, t in blocks[b])
            if left <= 0:
                break
            if left >= here:
                extra |= {k for k, _, _ in blocks[b]}
            else:
                run = 0
                keys = sorted({k for k, _, _ in blocks[b]}, key=lambda k: (spark_hash((k, 8), (seed, 4), (full, 8)), k))
                for k in keys:
                    run += sum(t for key, _, t in blocks[b] if key == k)
                    if run > left:
                        break
                    extra.add(k)
            left -= here
        for b, members in blocks.items():
            for k, i, _ in members:
                copies = full + (k in extra)
                out[(i, s, copies, tuple(round((min(place(e, b) / (1 << 30), epochs - e) + e) / epochs, 9) for e in range(copies)))] += 1
    return out


@pytest.mark.parametrize("block_tokens", [1_000_000, 400])
def test_mixing_by_brute_force(docs, odd, monkeypatch, block_tokens):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block_tokens)
    for table in (docs, odd):
        want = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in table.collect()], 2.5, mixing.SEED, block_tokens)
        found = mixing.mix(table, max_epochs=2.5).collect()
        assert Counter((r["doc_id"], r["source"], r["copies"], tuple(round(p, 9) for p in r["places"])) for r in found) == want


def test_small_sources_are_permuted_in_many_blocks(docs):
    """Copies of a source's documents lie all over an epoch, not in a few runs."""
    by, size = defaultdict(set), Counter()
    for r in mixing.mix(docs, max_epochs=3.0).collect():
        by[r["source"]].add(r["places"][0])
        size[r["source"]] += 1
    assert all(len(by[s]) >= min(32, size[s] // 3) for s in by)


def test_mixed_rows_lie_in_the_order_of_their_places(docs):
    places = {}
    for r in mixing.mix(docs, max_epochs=3.0).collect():
        places[r["doc_id"]] = r["places"]
        assert r["places"] == sorted(r["places"]) and all(0 <= p <= 1 for p in r["places"])
    laid = [r["doc_id"] for r in mixing.mix(docs, max_epochs=3.0, whole=True).select("doc_id").collect()]
    met, order = Counter(), []
    for i in laid:
        order.append(places[i][met[i]])
        met[i] += 1
    assert order == sorted(order) and met == Counter({i: len(p) for i, p in places.items()})
    apart = [k for k, i in enumerate(laid[1:]) if i == laid[k]]
    assert len(apart) < 0.05 * len(laid)  # copies of a document are not neighbours


def test_mixing(spark, docs, odd, empty):
    for table in (docs, odd):
        found = mixing.mix(table, max_epochs=3.0).collect()
        assert Counter((r["doc_id"], r["source"], r["n_tokens"]) for r in found) == Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in table.collect())
        by = defaultdict(list)
        for r in found:
            by[r["source"]].append(r)
        for rows in by.values():
            total, epochs = sum(r["n_tokens"] for r in rows), rows[0]["epochs"]
            emitted = sum(r["n_tokens"] * r["copies"] for r in rows)
            assert 1 <= epochs <= 3.0 + 1e-6 and all(r["copies"] in (math.floor(epochs), math.floor(epochs) + 1) for r in rows)
            assert math.floor(epochs) * total <= emitted <= epochs * total + 1e-6
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(empty, whole=True).count() == 0 and mixing.mix(empty, whole=True).columns == empty.columns
    whole = mixing.mix(odd, whole=True)
    assert whole.columns == odd.columns and whole.count() == sum(r["copies"] for r in mixing.mix(odd).collect())


def test_exponent(spark):
    tokens = {"a": 1000, "b": 100, "c": 10}
    shares = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    a = mixing.exponent(shares, max_epochs=4.0)
    assert (1000 / 10) ** (1 - a) == pytest.approx(4.0)
    assert mixing.exponent(shares, max_epochs=1000.0) == 0.0

    def entropy(a):
        w = np.array([t / 1110 for t in tokens.values()]) ** a
        w /= w.sum()
        return -(w * np.log(w)).sum()

    a = mixing.exponent(shares, target_entropy=0.9)
    assert entropy(a) == pytest.approx(0.9, abs=1e-6)
    a = mixing.exponent(shares, max_epochs=4.0, budget=1110.0)
    w = np.array([t / 1110 for t in tokens.values()]) ** a
    assert (w / w.sum())[2] * 1110 / 10 == pytest.approx(4.0, abs=1e-6)


def test_partial_epoch_by_brute_force(spark):
    """A source of one border block: its documents in hash order while the budget lasts."""
    rows = [(i, "w " * (i % 7 + 1), "en", "big" if i < 200 else "small", 0) for i in range(230)]
    found = mixing.mix(spark.createDataFrame(rows, DOCS), max_epochs=2.5).collect()
    small = [r for r in found if r["source"] == "small"]
    total = sum(r["n_tokens"] for r in small)
    rest = sum(r["n_tokens"] * (r["copies"] - 2) for r in small)
    assert 0.5 * total - 8 <= rest <= 0.5 * total


# WARC

PAGES = "page_id long, url string, html string"


def test_archives(spark, sf):
    odd_pages = [(1, "http://a.example/x?y=1", "<p>same"), (2, None, "<p>same"), (3, "http://b.example/\r\nz", None), (-4, "not a url", ""), (None, "http://a.example/", "<p>same"), (5, "http://a.example:99999/", "é" * 50_000), (6, "http://[bad", "x"), (6, "http://[bad", "x")]
    for table in (spark.createDataFrame(odd_pages, PAGES).repartition(3), spark.read.parquet(f"{sf}/pages.parquet")):
        folder = new_folder(spark, "w")
        entries = warc.write_archives(table.withColumn("first", F.lit(1)), folder)
        warc.write_index(entries, folder)
        found = warc.read_archives(warc.look_up(entries.select("key").distinct(), folder), 3, with_payload=True).collect()
        rows = table.collect()
        first = {}
        for r in rows:
            key = r["html"] or ""
            if r["page_id"] is not None:
                first[key] = min(first.get(key, r["page_id"]), r["page_id"])
        n = Counter(r["html"] or "" for r in rows)
        want = Counter()
        for r in rows:
            data = (r["html"] or "").encode()
            f = first.get(r["html"] or "") if n[r["html"] or ""] > 1 else None
            f = None if f == r["page_id"] else f
            want[(r["page_id"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if f is None else "revisit", f, data if f is None else None)] += 1
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in found) == want
        for r in rows:
            assert r["page_id"] in [x["page_id"] for x in warc.lookup(folder, r["url"])]
        assert warc.lookup(folder, "http://nowhere.example/") == []
    blank = spark.createDataFrame([], PAGES)
    entries = warc.write_archives(blank, new_folder(spark, "w"))
    assert entries.count() == 0
    folder = new_folder(spark, "w")
    assert warc.write_index(entries, folder).count() == 0
    assert warc.read_archives(warc.look_up(entries.select("key").distinct(), folder), 1).count() == 0
    assert warc.lookup(folder, "http://a.example/") == []


def test_index_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "INDEX_ROWS", 50)
    rows = [(i, f"http://h{i % 13}.example/{i // 2 % 40}", str(i)) for i in range(200)]
    folder = new_folder(spark, "w")
    blocks = warc.write_index(warc.write_archives(spark.createDataFrame(rows, PAGES), folder), folder)
    assert blocks.count() > 25
    for url in {u for _, u, _ in rows}:
        assert sorted(x["page_id"] for x in warc.lookup(folder, url)) == [i for i, u, _ in rows if u == url]


def test_reading_back_goes_through_the_directory(spark, monkeypatch):
    """Every record is found over many blocks and files, a hot key's too; a directory cut short hides what it no longer names."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    monkeypatch.setattr(warc, "INDEX_ROWS", 60)
    rows = [(i, None if i % 3 == 0 else f"http://h{i % 13}.example/{i % 40}", str(i)) for i in range(300)]
    folder = new_folder(spark, "w")
    entries = warc.write_archives(spark.createDataFrame(rows, PAGES), folder)
    warc.write_index(entries, folder)
    read = lambda: sorted(r["page_id"] for r in warc.read_archives(warc.look_up(entries.select("key").distinct(), folder), 2).collect())
    assert read() == list(range(300))
    system, inner = common.file_system(folder)
    from pyarrow import fs

    names = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".dir")]
    assert len(names) > 1
    for name in names:
        with system.open_input_file(name) as f:
            lines = f.read().splitlines(keepends=True)
        with system.open_output_stream(name) as f:
            f.write(b"".join(lines[:1]))
    assert 0 < len(read()) < 300


def test_small_payloads_are_responses(spark):
    folder = new_folder(spark, "w")
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "y" * 9), (4, "d", "y" * 9)], PAGES)
    assert {r["page_id"]: r["type"] for r in warc.write_archives(pages, folder, least_bytes=5).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# HTML


def text_of(html):
    blocks = html_text.blocks_of(html)
    return html_text.main_text(blocks, html_text.repeated([[b[0] for b in blocks]])[0])


def test_main_text_of_marked_pages():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>
    <script>var t="</p>";</script><div class="cookie-notice">Cookies</div><div class=sidebar><p>Side</div><main><article><h1>Title &amp; more</h1><!-- x -->
    <p>One <b>two<br>three</b>\n four<p>Fish&nbsp;&#8364; 5<form><input>Go</form><ul><li>a<li>b</ul><aside>rel</aside><section id="comments"><p>Nice!</section><footer>by me</footer></article></main><footer>foot</footer></body></html>"""
    assert text_of(page) == "Title & more\n\nOne two three four\n\nFish € 5\n\na\n\nb"
    assert text_of(None) == text_of("") == "" and text_of("plain  text") == "plain text"
    assert text_of("<p>a<![if x]>b<![endif]><p>c</p></div><p>d") == "ab\n\nc\n\nd"
    assert text_of("<table><tr><td>x<td>y<tr><td>z</table>") == "x\n\ny\n\nz"


def test_main_text_keeps_every_article_but_teasers():
    body = " ".join(f"w{i}" for i in range(40))
    assert text_of(f"<main><h1>Title</h1><p>lead</p><article><p>{body}</article><p>end</main>") == f"Title\n\nlead\n\n{body}\n\nend"
    assert text_of(f"<article><p>{body}</article><article><p>a shorter second part</article>") == f"{body}\n\na shorter second part"
    assert text_of(f"<article><p>{body}</article><article><h2><a href=x>Another story here</a></h2><p>soon</article>") == body
    assert text_of("<article><a href=x>Only this</a></article>") == "Only this"
    teaser = " ".join(f"t{i}" for i in range(9))
    blocks = [html_text.blocks_of(f"<article><p>{body} {k}</article><article><p>{teaser}</article>") for k in range(2)]
    covered = html_text.repeated([[f"{k} x", teaser] for k in range(2)])
    assert [html_text.main_text(b, c) for b, c in zip(blocks, covered, strict=True)] == [f"{body} 0", f"{body} 1"]
    assert html_text.main_text(blocks[0], np.array([0.9, 1.0])) == f"{body} 0\n\n{teaser}"


def test_repeats_by_brute_force():
    rng = random.Random(2)
    boiler = " ".join(f"b{i}" for i in range(12))
    pages = [[boiler, " ".join(f"w{rng.randint(0, 400)}" for _ in range(60))] for _ in range(9)] + [["x y"]]
    found = html_text.repeated(pages)
    streams = [[w for b in p for w in [*b.split(), None]] for p in pages]
    seen = defaultdict(set)
    for k, s in enumerate(streams):
        for i in range(len(s) - 7):
            seen[tuple(s[i : i + 8])].add(k)
    for k, (p, s) in enumerate(zip(pages, streams, strict=True)):
        covered = {j for i in range(len(s) - 7) if len(seen[tuple(s[i : i + 8])]) > 1 for j in range(i, i + 8)}
        at, want = 0, []
        for b in p:
            n = len(b.split())
            want.append(sum(j in covered for j in range(at, at + n)) / n)
            at += n + 1
        assert np.allclose(found[k], want)
    assert found[0][0] == 1.0 and found[0][1] < 0.2


def test_suffix_order():
    rng = np.random.default_rng(4)
    for words_ in (rng.integers(0, 3, 200), np.zeros(40, np.int64), np.tile(rng.integers(0, 9, 30), 4), np.arange(7)):
        order, shared = html_text.suffix_order(words_)
        suffixes = [tuple(words_[i:].tolist()) for i in order]
        assert suffixes == sorted(tuple(words_[i:].tolist()) for i in range(len(words_)))
        for a, b, n in zip(suffixes[:-1], suffixes[1:], shared[1:].tolist(), strict=True):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_partial_marks_inside_an_article_need_a_repeated_run(spark):
    own = lambda i: " ".join(f"u{i}x{j}" for j in range(30))
    pages = [f"<article><p>{own(i)}</p><section id='side-effects'><p>Nausea {own(i + 50)}</section><p class='share-price'>It rose {i}</p><div class='post-share'>Tell all of your friends about this on every network now</div><div class='comments-area'>Nice {i}</div><div class='newsletter'>Join</div></article>" for i in range(6)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(pages)], PAGES)).collect()}
    assert found == {i: f"{own(i)}\n\nNausea {own(i + 50)}\n\nIt rose {i}" for i in range(6)}


def test_no_article_is_lost_to_a_name_or_a_form():
    body = " ".join(f"w{i}" for i in range(60))
    assert text_of(f"<html><body><form><p>{body}</p><input name=q></form></body></html>") == body
    assert text_of(f"<form><div>Menu x</div><article><p>{body}</article><p>rest</form>") == body
    assert text_of(f"<p>{body}</p><form><p>Your name</form>") == body and text_of(f"<article><p>{body}<form><p>Your comment</form></article>") == body
    for name in ("cookie-recipe", "comment-on-law", "newsletter-history", "side-effects"):
        assert text_of(f"<div class={name}><p>{body}</div>") == text_of(f"<article><div id={name}><p>{body}</div></article>") == body
        assert text_of(f"<div class={name}><article><p>{body}</article></div>") == body
    for name in ("notice", "related", "navigation"):
        assert text_of(f"<article><h2 id={name}>Head</h2><section class={name}><p>{body}</section><div class={name}><p>See too</div></article>") == f"Head\n\n{body}"
        assert text_of(f"<article><p>x<div class={name}><a href=x>{body}</a></div></article>") == "x"
        assert text_of(f"<p>x<div class={name}><p>{body}</div>") == "x"
    for name in ("comments", "comment-list", "comments-area", "cookie-banner", "newsletter-signup"):
        assert text_of(f"<article><p>x<div class={name}><p>{body}</div></article>") == text_of(f"<p>x<div class={name}><p>{body}</div>") == "x"


def test_repeated_runs_decide_a_section_of_an_article(spark):
    """Without the runs each page would keep the notice that all have."""
    own = lambda i: " ".join(f"u{i}x{j}" for j in range(60))
    notice = " ".join(f"n{j}" for j in range(60))
    pages = [f"<article><p>{own(i)}</p><div class=notice><p>{notice if i else own(99)}</div><form><p>{own(i + 50)}</form></article>" for i in range(5)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(pages)], PAGES)).collect()}
    assert found == {i: own(i) if i else f"{own(0)}\n\n{own(99)}" for i in range(5)}
    kept = html_text.blocks_of(pages[1])
    assert html_text.main_text(kept, np.zeros(len(kept))) == f"{own(1)}\n\n{notice}"


def test_nesting_takes_no_time():
    import time

    began = time.perf_counter()
    assert html_text.blocks_of("<article>" + "<b>x " * 40_000 + "</b>" * 40_000 + "</article>") == [("x " * 39_999 + "x", 1, False)]
    assert len(html_text.blocks_of("<article>" + "<form><div class=notice><p>x " * 20_000 + "</article>")) == 20_000
    assert time.perf_counter() - began < 20


def test_plainly_independent_pages_do_not_depend(spark, sf):
    fixture = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    page = "<html><head><title>t</title></head><body>{before}<article{attr}>{start}Text of it {inside}</article>{after}</body></html>"
    rng = random.Random(8)
    befores = ["", "<nav><a>x</a></nav>", "<!-- <article> -->", "<!-- a --><div class=ad>x</div>", "<div hidden>", "<script>'<article>'</script>", "<div><div>x</div></div>", "<header>", "<script>'</script>'<!--</script>", "<p>x", "<main>"]
    parts = {"before": befores, "attr": ["", " class=comment", " hidden"], "start": ["", "<h1>", "<p> <b>", "<nav>", "<form>", "<div hidden>"], "inside": ["", "<p class='post-share'>x", "<p id=x>y", "<p>z"], "after": ["", "<article>more</article>", "<div class=x-share>y</div>", "<footer>f</footer>"]}
    made = [page.format(**{k: rng.choice(v) for k, v in parts.items()}) for _ in range(1500)] + ["<article></article><p>x", "<html><body><article><!-- x --></article><p>y", "", None]
    rows = spark.createDataFrame([(h,) for h in fixture + made], "html string")
    told = [r for r in rows.select("html", html_text.plainly_independent(F.col("html")).alias("sure")).collect() if r["sure"]]
    assert all(not html_text.depends(html_text.blocks_of(r["html"])) and html_text.articles_of(html_text.blocks_of(r["html"])) for r in told)
    assert len(told) > len(fixture) and sum(r["html"] in set(fixture) for r in told) > 0.9 * len(fixture)


def test_main_text_of_odd_tables(spark):
    """Clashing columns, repeated rows, very long and deeply nested pages, and many pages without id and url."""
    long = "<p>" + " ".join(f"w{i % 5000}" for i in range(60_000))
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://h.example/1", long), (2, "http://h.example/2", deep), (3, None, "<p>x"), (3, None, "<p>x"), (4, "http://h.example/4", "")] + [(None, None, f"<p>page {i}") for i in range(40)]
    table = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("host", "part", "blocks", "articles", "text", "hash", "groups", "_host")})
    found = html_text.extract(table).collect()
    assert Counter((r["page_id"], r["text"]) for r in found if r["page_id"] != 1) == Counter([(2, "deep"), (3, "x"), (3, "x"), (4, ""), *((None, f"page {i}") for i in range(40))])
    assert next(r["n_chars"] for r in found if r["page_id"] == 1) == len(" ".join(f"w{i % 5000}" for i in range(60_000)))


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    menu = "Home News Sport Weather Travel Money Contact About Imprint"
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><p>{' '.join(f'u{i}x{j}' for j in range(30))}</p>") for i in range(20)]
    rows += [(100, None, None), (101, "http://other.example/", "<p>alone")]
    found = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(found[i]["text"] == " ".join(f"u{i}x{j}" for j in range(30)) for i in range(20))
    assert found[100]["text"] == "" and found[101]["text"] == "alone" and found[101]["n_chars"] == 5
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_repeats_are_found_over_the_whole_host(spark, monkeypatch):
    """A stretch on two pages of a host goes however the pages are dealt to groups; copies of a page do not repeat each other."""
    own = lambda i, n=30: " ".join(f"u{i}x{j}" for j in range(n))
    shared = lambda i: " ".join(f"s{i}x{j}" for j in range(12))
    rows = [(i, f"http://h.example/{i}", f"<div>{shared(i // 2)}</div><p>{own(i)}</p>") for i in range(40)]
    rows += [(i, f"http://h.example/{i}", f"<p>{own('copy')}</p>") for i in range(100, 110)]
    rows += [(200, "http://h.example/200", f"<div>{own('quoted')}</div><p>{own(200)}"), (201, "http://h.example/201", f"<article><p>{own('quoted')}</article>")]
    rows += [(i, f"http://marked.example/{i}", f"<article><p>{own('all')}</article>") for i in range(300, 320)]
    pages = spark.createDataFrame(rows, PAGES)
    want = {i: own(i) for i in [*range(40), 200]} | dict.fromkeys(range(100, 110), own("copy")) | {201: own("quoted")} | dict.fromkeys(range(300, 320), own("all"))
    for group in (1000, 4):
        monkeypatch.setattr(html_text, "GROUP_PAGES", group)
        assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == want


def test_marked_articles_are_whole(spark, sf):
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL).group(1)
        import html as H

        parts = [re.sub(r"\s+", " ", H.unescape(re.sub(r"</?b>", "", p).replace("<br>", " "))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert found[r["page_id"]] == "\n\n".join(p for p in parts if p)


def test_every_label_is_a_language(spark, empty):
    """More labels than the model has room for at full width: the buckets get fewer, no label is left out."""
    rows = [(i * 10 + j, " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{w}" for w in ("ana", "bele", "ciri", "dono") * 5), f"l{i:03}", "s") for i in range(260) for j in range(3)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(made, F.lit(True), cells=260 << 12)
    assert len(model.languages) == 260 and model.buckets == 1 << 12
    found = langid.predict(made, model, keep=("lang",))
    right = found.where("lang = lang_pred").count()
    assert right >= 0.98 * len(rows)
    assert langid.keep_identified(empty).count() == 0
    assert langid.buckets_for(200) == 1 << 16 and langid.buckets_for(201) == 1 << 15 and langid.buckets_for(10**6) == langid.LEAST_BUCKETS
    assert (langid.trigrams("Über alles", 1 << 12) == langid.trigrams("Über alles") >> 4).all()


# pipeline


def test_pipeline_stages(spark, docs, sf):
    import corpus_pipeline as C

    table, kept = docs, []
    for k, (_, stage) in enumerate(C.STAGES):
        table = stage(spark, table, sf).cache()
        if k < 4:
            assert table.columns == docs.columns
            kept.append(table.collect())
    ids = [Counter(r["doc_id"] for r in rows) for rows in kept]
    want = {max(r["doc_id"] for r in kept[0] if lower(r["text"]) == t) for t in {lower(r["text"]) for r in kept[0]}}
    assert ids[1] == Counter(want)
    groups = brute_components([(r["doc_id"], simhash.fingerprint(r["text"])) for r in kept[1]])
    assert ids[2] == Counter({c for _, _, c in groups})
    assert set(ids[3]) == set(ids[2]) and all(1 <= n <= 5 for n in ids[3].values())
    pieces = Counter()
    for r in table.collect():
        pieces[r["doc_id"]] += r["start"] == 0
    assert pieces == ids[3]
    assert len(kept[0]) >= 0.97 * docs.count()


def test_clashing_columns_go_through(spark, odd, sf):
    import corpus_pipeline as C

    table = odd
    for _, stage in C.STAGES:
        table = stage(spark, table, sf)
    assert table.count() > 0


def test_empty_tables_go_through(spark, empty, sf):
    import corpus_pipeline as C

    table = empty
    for _, stage in C.STAGES:
        table = stage(spark, table, sf)
        assert table.count() == 0


def test_pipeline_run_by_brute_force(spark, docs, sf):
    """run() over the whole table: the documents that stay, each copy's ids whole and in order, windows gapless."""
    from tokenizers import Tokenizer

    import corpus_pipeline as C

    known = {r["doc_id"] for r in C.identify(spark, docs, sf).select("doc_id").collect()}
    by = defaultdict(list)
    for r in docs.collect():
        if r["doc_id"] in known:
            by[lower(r["text"])].append(r)
    alone = [max(rows, key=lambda r: r["doc_id"]) for rows in by.values()]
    stay = {c for _, _, c in brute_components([(r["doc_id"], simhash.fingerprint(r["text"])) for r in alone])}
    mixed = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in alone if r["doc_id"] in stay], mixing.MAX_EPOCHS, mixing.SEED, mixing.BLOCK_TOKENS)
    copies = {i: n for i, _, n, _ in mixed}
    t, found = Tokenizer.from_file(encode.default_path()), defaultdict(Counter)
    text, windows = {r["doc_id"]: r["text"] or "" for r in alone}, defaultdict(list)
    for r in C.run(spark, sf).collect():
        found[r["doc_id"]][(r["start"], r["length"], r["ids_crc32"])] += 1
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(found) == stay
    for i, pieces in found.items():
        ids = np.asarray([*t.encode(text[i], add_special_tokens=False).ids, 1], "<u4")
        assert all(zlib.crc32(ids[at : at + n].tobytes()) == crc for at, n, crc in pieces)
        assert Counter(k for (at, n, _), times in pieces.items() for k in range(at, at + n) for _ in range(times)) == Counter(dict.fromkeys(range(len(ids)), copies[i]))
    for held in windows.values():
        held.sort()
        assert [at for at, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
