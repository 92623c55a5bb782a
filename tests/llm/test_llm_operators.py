"""Each operator against brute force on small tables, with nulls, empty and very long texts, ties, repeated rows, empty tables
and extra columns whose names clash with the operators' own."""

import collections
import hashlib
import html
import math
import random
import re
import string
import zlib

import numpy as np
import pytest

from wiretally.llm import (
    components, edit_match, html_text, packing, partenum, quality, suffix_dedup, suffix_tree, token_files, tokenizer, toxicity, url_filter)

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, n string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, equal texts, clashing columns."""
    rng = np.random.default_rng(3)
    words = ["alpha", "beta,", "Gamma", "delta.", "é́té", "x", "<|endoftext|>", "don't", "1,234.5"]
    prose = lambda n: " ".join(rng.choice(words, n))
    long = prose(30_000)
    texts = [None, "", "   ", "a", prose(40), prose(400), long, "\x1c.. ... \u3000 z", "!!!"]
    rows = [(k, x) for k, x in enumerate(texts)] + [(100, texts[5]), (100, texts[5]), (101, texts[5] + " tail"), (None, texts[4]), (None, None)]
    return spark.createDataFrame([(d, x, "en", None if d == 3 else "s", 1, 0.5, "r", "n") for d, x in rows], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words_of(text):
    return (text or "").encode().lower().split()


def ids_of(text):
    from tokenizers import Tokenizer
    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(tokenizer.default_tokenizer())
    return np.array([*ids_of.t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


# 1, 10

@pytest.mark.parametrize("most", [2, 9, 5000, 49408, 2**32])
@pytest.mark.parametrize("n", [0, 1, 61, 4095, 4097, 20_000])
def test_segments_decode_to_what_was_coded(most, n):
    ids = [np.random.default_rng(n).integers(0, most, n).astype("<u4"), np.array([2], "<u4")]
    back, got = token_files.decode_segment(token_files.encode_segment([None, -7], ids))
    assert back == [None, -7] and all((a == b).all() for a, b in zip(ids, got, strict=True))


def test_token_files(spark, odd, docs, none):
    for table in (odd, docs.limit(60)):
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        at, expected = 0, []
        for r in rows:
            ids = ids_of(r.text)
            expected.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted(map(tuple, token_files.token_digest(table).collect()), key=lambda r: r[1]) == expected
    assert token_files.token_digest(none).count() == 0


def test_packing_uses_each_id_once_and_pads_nothing(spark, odd, docs, none):
    for table in (odd, docs):
        got = packing.pack_documents(table).collect()
        sequences = collections.defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append(r)
        for pieces in sequences.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 4096 and at & (at - 1) == 0
        wanted = collections.Counter(len(ids_of(r.text)) for r in table.collect())
        assert sum(r.length for r in got) == sum(k * v for k, v in wanted.items())
    texts = {r.doc_id: ids_of(r.text) for r in docs.collect()}
    assert all(zlib.crc32(texts[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32 and len(texts[r.doc_id]) == r.doc_tokens for r in got)
    assert packing.pack_documents(none).count() == 0


# 2

def test_base_scores_and_better_model(spark, odd, docs, none):
    got = suffix_tree.score_documents(docs).collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs.collect()}
    tokens = {r.doc_id: [*words_of(r.text), b""] for r in docs.collect()}
    count = collections.Counter(w for d, x in tokens.items() if not held[d] for w in x)
    total, kinds = sum(count.values()), len(count)
    for r in got:
        x = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(x), sum(w in count for w in x), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in x), rel_tol=1e-9)
        assert r.score < 0
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert suffix_tree.score_documents(odd).count() == odd.count() and suffix_tree.score_documents(none).count() == 0


def test_the_tree_does_not_shrink_as_the_corpus_grows(spark):
    rare = "one rare pair here"
    filler = " ".join(f"w{k}" for k in range(500)) + " "
    train = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2]
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    rows = [(held, rare)] + [(k, rare) for k in train[:2]] + [(train[3], filler * 5000)]  # 2.5 million tokens more
    got = suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).where("held_out").first()
    assert got.train_tokens > 2_000_000 and got.score > got.base_score + 10


def test_next_token_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(5)
    text = " ".join(rng.choice(["a", "b", "c"], 3000, p=[.6, .3, .1]))
    blocks = suffix_tree.word_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    types = spark.createDataFrame([(w.encode(), n) for w, n in collections.Counter(text.split()).items()], "word binary, c long")
    tree = suffix_tree.SuffixTree(suffix_tree.frequent_grams(blocks, 2), types, 3001, 2)
    from wiretally.llm.common import word_hashes
    for before in (["a"], ["b", "a"], ["c", "a", "b"]):
        seen = dict(zip("abc", (text.split().count(x) for x in "abc"), strict=True)) | {"": 1}
        p = [tree.score(word_hashes([*(w.encode() for w in before), w.encode()]), np.zeros(len(before) + 1, np.int64),
                        np.array([0.1] * len(before) + [n / 3001]))[-1] for w, n in seen.items()]
        assert abs(sum(p) - 1) < 1e-9


# 3

def test_url_rules_and_list(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    urls = [None, "", "no scheme", "http://", "http://COM/", "https://a.example.com/en/x?q", "https://WWW.Example.com/en/", "http://x.www.example.com/en/1",
            "http://notexample.com/en/", "http://b.net/es/#t", "http://b.net/es", "http://net/fr/", "http://b.org/p.html?x", "https://www.b.org/p/", "http://b.org/q",
            "a://b://c/d", "http://É.com/", "http://example.com"] * 2
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, key string")
    listed = spark.createDataFrame([("b.org", "/p")], "host string, path string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, rules), listed).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit)[2:] if fit else (None, "block" if re.sub(r"^(www|m)\.", "", host) + re.sub(r"(/|\.html)$", "", path) == "b.org/p" else "allow")
        r = got[k]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), u
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, rules), listed).count() == 0
    assert url_filter.judge_urls(pages, url_filter.rule_table(spark, []), listed.limit(0)).where("verdict = 'allow'").count() == len(urls)


# 4

def test_main_text_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9:].split("</article>")[0]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


def test_main_text_of_odd_pages():
    page = ("<body><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies, ok? Yes.</div><div class=sidebar><p>Related, and more.</p></div>"
            "<div class=content><h2>Title</h2><p>First, with <i>so</i>me text &amp;&nbsp;marks. It goes on, and on.<p>Short.<ul><li>one<li>two</ul></div>"
            "<form><p>Your name, please.</p></form><div class='comments'><p>Great, thanks! Loved it.</p></div><script>var a='<p>no</p>'</script>")
    assert html_text.main_text(page) == "Title First, with some text & marks. It goes on, and on. Short. one two"
    assert [html_text.main_text(x) for x in (None, "", "<nav>x</nav>", "plain", "<p>cut <b", "<p>&am")] == ["", "", "", "plain", "cut", "&am"]
    assert len(html_text.main_text("<p>" + "word, " * 200_000)) == 1_200_000 - 1


# 5

def brute_repeats(rows, length=50):
    first, out = {}, []
    for d, b in rows:
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            first[s] = min(first.get(s, d), d)
    for d, b in rows:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < d:
                covered[i:i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_order():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 700):
        text = rng.integers(1, 3, n).astype(np.uint8)
        raw = text.tobytes() + bytes(80)
        order = suffix_dedup.suffix_order(text)
        assert sorted(order.tolist()) == list(range(n)) and [raw[i:i + 60] for i in order] == sorted(raw[i:i + 60] for i in range(n))


def test_removed_bytes(spark, odd, docs, none):
    small = odd.where("doc_id is null or doc_id <> 6")
    for table in (small, docs.limit(120)):
        rows = table.select("doc_id", "text").collect()
        expected = brute_repeats([(suffix_dedup.LAST if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in rows])
        got = suffix_dedup.remove_repeats(table).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr((r.doc_id, *e)) for r, e in zip(rows, expected, strict=True))
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(odd).count() == odd.count()


def test_a_passage_repeated_inside_the_later_document(spark):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choices(string.ascii_letters, k=n))
    shared, before, behind = text(60), text(100), text(100)
    rows = [(1, text(40) + shared + text(70)), (2, before + shared + behind + text(33) + before + shared + behind), (2, text(9) + before + shared + behind)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats([(d, x.encode()) for d, x in rows]))
    assert sorted(r.n_removed for r in got) == [0, 60, 120]


def test_a_phrase_with_very_many_neighbours_is_no_single_task(spark, monkeypatch):
    draw = random.Random(6)
    text = lambda n: "".join(draw.choices(string.ascii_letters, k=n))
    pool = text(20_000)  # the phrase around its least hash is the anchor of nearly all strings it is in
    places, codes, _, _ = suffix_dedup.anchors(pool.encode())
    phrase = pool[places[codes.argmin()]:][:24]
    before, behind = ([text(18) for _ in range(70)] for _ in range(2))
    place = lambda: text(40) + draw.choice(before) + phrase + draw.choice(behind) + text(40)
    rows = [(k // 2, place() + (place() if k % 5 == 0 else "")) for k in range(6000)]
    sorted_shards, sizes = suffix_dedup._sorted_shards, []

    def seen(parts):
        sizes.append(parts.groupBy("anchor").agg({"bytes": "count"}).agg({"count(bytes)": "max"}).first()[0] or 0)
        return sorted_shards(parts)

    monkeypatch.setattr(suffix_dedup, "_sorted_shards", seen)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    expected = brute_repeats([(d, x.encode()) for d, x in rows])
    assert sum(e[1] for e in expected) > 100_000
    assert sorted(map(tuple, got)) == sorted(expected)
    assert max(sizes) * suffix_dedup.LENGTH <= 256 << 10


# 6

def brute_components(rows, size, num, den):
    sets, parent = [], list(range(len(rows)))
    for _, x in rows:
        w = words_of(x)
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * den >= num * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = collections.defaultdict(list)
    for k, (d, _) in enumerate(rows):
        least[root(k)] += [d] if d is not None else []
    return [(d, len(sets[k]), min(least[root(k)], default=None)) for k, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("size, threshold", [(4, (85, 100)), (5, (4, 5)), (2, (7, 10))])
def test_jaccard_components(spark, odd, docs, none, size, threshold):
    rng = np.random.default_rng(1)
    base = " ".join(f"w{k}" for k in rng.integers(0, 900, 300)).split()
    near = [(1000 + k, " ".join(w if rng.random() > k / 900 else f"z{rng.integers(0, 9)}" for w in base)) for k in range(60)]
    planted = spark.createDataFrame(near + [(2000, "one"), (2001, "ONE"), (2002, "one two")], "doc_id long, text string")
    for table in (odd, docs.limit(100), planted):
        rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
        got = [tuple(r) for r in partenum.jaccard_components(table, size, threshold).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute_components(rows, size, *threshold)))
    assert partenum.jaccard_components(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in components.components(edges).collect()} == {**dict.fromkeys(range(1, 201), 0), 501: 500}


def test_one_of_each_keeps_columns(odd):
    kept = partenum.one_of_each(odd, 5, (4, 5))
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 100 not in ids and 101 not in ids and 5 in ids and ids.count(None) == 2


# 7

def test_myers_distance_equals_the_plain_table():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, text = rng.integers(0, 3, rng.integers(1, 90)).tolist(), rng.integers(0, 3, rng.integers(0, 60)).tolist()
        row = list(range(len(item) + 1))
        best = row[-1]
        for w in text:
            new = [0]
            for k, x in enumerate(item):
                new.append(min(row[k] + (x != w), row[k + 1] + 1, new[k] + 1))
            row = new
            best = min(best, row[-1])
        assert edit_match.best_match(item, text)[0] == best


def test_benchmark_items_are_found_up_to_their_budget(spark, odd, none):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "short item"), (1, " ".join(item))], "item_id long, text string")
    changed = lambda k: [w if i % 5 or i >= 5 * k else "CHANGED" for i, w in enumerate(item)]
    rows = [(k, "lead " * 9 + " ".join(changed(k)).upper() + ", tail" * 9) for k in range(4)] + [(9, "a short, item here"), (10, "short x item"), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.budget) for r in edit_match.benchmark_hits(docs, bench).collect()}
    assert got == {(0, 1): (0, 3), (1, 1): (1, 3), (2, 1): (2, 3), (3, 1): (3, 3), (9, 4): (0, 0)}
    assert sorted(r.doc_id for r in edit_match.without_benchmark(docs, bench).collect()) == [10, 11]
    assert edit_match.without_benchmark(odd, bench).columns == odd.columns and edit_match.without_benchmark(odd, bench.limit(0)).count() == odd.count()
    assert edit_match.benchmark_hits(none, bench).count() == 0


# 8

def test_text_statistics():
    rng = np.random.default_rng(4)
    for text in ["", " \n\n", "a b c d e a b c d e", "é # x\né # x\n\n y", *(" ".join(rng.choice(list("abc"), 60)) + "\nabc\nabc" for _ in range(20))]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
        repeated = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality.text_stats(text.encode())[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def test_quality_rejects_junk_and_keeps_prose(spark, odd, none):
    rng = np.random.default_rng(6)
    prose = [" ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(40, 300))) + "." for _ in range(300)]
    junk = [" ".join(w + "#$%" for w in p.split()) for p in prose[:12]]
    table = spark.createDataFrame([(k, x, "en", "s") for k, x in enumerate(prose + junk)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge_quality(table).collect()}
    assert sum(kept[k] for k in range(300)) >= 297 and not any(kept[k] for k in range(300, 312))
    got = quality.judge_quality(odd)
    assert got.count() == odd.count() and got.where("kept is null").count() == 0 and quality.judge_quality(none).count() == 0


# 9

def test_toxicity_on_held_out_rows(spark, odd, none):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows, labels = [], []
    for k in range(900):
        words, bad = list(rng.choice(vocabulary, 40)), bool(k % 3 == 0)
        if bad:
            words[int(rng.integers(40))] = str(rng.choice(["zzscum", "ZZMORON,", "zzfool"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.judge_toxicity(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    mixed = toxicity.judge_toxicity(odd, marks)
    assert mixed.count() == odd.count() and mixed.where("score is null or predicted is null").count() == 0
    assert toxicity.judge_toxicity(none, marks.limit(0)).count() == 0
    assert toxicity.without_toxic(odd, docs, marks).columns == odd.columns
