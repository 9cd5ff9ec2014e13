"""Operators of the corpus subpackage against brute force and on edge cases."""

import hashlib
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import connect, differences
from tidemark.llm import bpe_codec, decontaminate, html_text, near_dup, pii, quality_classifier, quality_rules, queries, sharding, substring_dedup, token_count

WORDS = "stone river lamp quiet orange seven walked under bright tables morning never glass finds green wood paper train over small house".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, kept boolean, shard int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(30, 200)) for _ in range(40)]
    near = [t.replace(" ", " x ", 1) for t in base[:6]]
    out = [None, "", "", " \n ", "a", "é" * 49, "z" * 3000, "ab " * 900, *base, *base[:8], *near]
    out += [base[9][:120] + prose(rng, 40), "mail bob.x@example.com or +1 (017) 555-7713 and 10.0.0.256 10.0.0.25, card 4111 1111 1111 1111"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", True, 3) for i, t in enumerate(texts)]
    rows += [(None, texts[10], None, None, None, None, None, None), rows[12], rows[12]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark, texts):
    return spark.createDataFrame([(i, int(i > 7), 0) for i in range(len(texts))] + [(None, 1, 0), (11, None, None)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(spark, docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = by_id(token_count.count_tokens(docs, path))
    assert token_count.count_tokens(docs, path).count() == docs.count()
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids))
    assert token_count.count_tokens(empty(spark), path).count() == 0


ODD = ["<|endoftext|> x <|startoftext|>", "it's we're 'S", "ΣΑΣ ΟΔΟΣ", "İstanbul ß", "e\u0301 \ufb01", "日本語 テキスト", "\x00\x01 a", "½ ² Ⅷ", "😀👩‍👩‍👧"]


@pytest.mark.parametrize("text", ODD)
def test_tokenizers_on_odd_texts(text):
    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    assert token_count.counter(a).count(text) == len(Tokenizer.from_file(a).encode(text, add_special_tokens=False).ids)
    ids = Tokenizer.from_file(b).encode(text, add_special_tokens=False).ids
    mine = bpe_codec.codec(b).encode(text)
    assert np.frombuffer(mine, "<u4").tolist() == ids
    assert bpe_codec.codec(b).decode(mine) == Tokenizer.from_file(b).decode(ids, skip_special_tokens=False)


def test_codec_on_every_code_point():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, mine = Tokenizer.from_file(path), bpe_codec.codec(path)
    texts = [f"a{chr(c)}b {chr(c)}1" for c in range(0x33480) if not 0xD800 <= c < 0xE000]
    want = lib.encode_batch(texts, add_special_tokens=False)
    wrong = [hex(ord(t[1])) for t, w in zip(texts, want) if np.frombuffer(mine.encode(t), "<u4").tolist() != w.ids]
    assert wrong == []


def test_codec(spark, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = by_id(bpe_codec.digests(bpe_codec.encode_decode(docs, path)))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec.encode_decode(empty(spark), path).count() == 0


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words += re.findall(r"\w+", data)


def test_html_words_on_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        v = Visible()
        v.feed(r.html)
        assert re.findall(r"\w+", got[r.page_id]) == v.words


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a<div>b <b>c</b>  d</div>", "a\n\nb c d"),
        ("<ul><li>one<li>two<ol><li>x</ol></ul>", "- one\n- two\n  1. x"),
        ("<table><tr><th>Name<th>Qty<tr><td>Kiwi fruit<td>3</table>", "Name        Qty\nKiwi fruit  3"),
        ("a<span hidden>no</span><i style='display: none'>no</i> b", "a b"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("x<!-- y", "x"),
        ("1 < 2 &amp z", "1 < 2 & z"),
        ("<div>" * 30000 + "deep", "deep"),
        ("<table><tr><td><table><tr><td>a<td>b<tr><td>c</table><td>d<tr><td>e<td>f</table>", "a b c  d\ne      f"),
        *((("<table><tr><td>" * n + "deep" + "<td>side</table>" * n), "deep" + "  " * (n == 1) + " " * (n > 1) + "side" + " side" * (n - 2) + "  side" * (n > 1)) for n in (1, 2, 9, 40, 3000)),
    ],
)
def test_html_layout(html, text):
    assert html_text.html_to_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a<svg><title>no</title><defs><text>no</text></defs><rect/><desc/><text>seen</text></svg>b", "aseenb"),
        ("<math><mi>x</mi><annotation>no</annotation></math> <object data=q>fallback</object>", "x fallback"),
    ],
)
def test_html_drawings(html, text):
    assert html_text.html_to_text(html) == text


def test_sharding(spark, docs, texts):
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    slots, where, size = {}, {}, Counter()
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r.size
        if r.doc_id is not None:
            where.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert all(len(s) == 1 for s in where.values())
    groups = Counter()
    for r in docs.collect():
        groups[hashlib.sha256((r.text or "").encode()).hexdigest()] += len((r.text or "").encode()) + 1
    left, alone, top = sum(groups.values()), 0, sorted(groups.values(), reverse=True)
    while alone < 15 and top[alone] * (16 - alone) >= left:
        left, alone = left - top[alone], alone + 1
    order = [groups[k] for k in sorted(groups) if groups[k] not in top[:alone]]

    def fits(c):
        n, used = 1, 0
        for x in order:
            if used + x > c:
                n, used = n + 1, 0
            used += x
        return n <= 16 - alone

    best = next(c for c in range(max(order), left + 1) if fits(c))
    assert max(size.values()) == max(best, *top[:alone], 0)
    assert sharding.shard(empty(spark)).count() == 0


def brute_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer("[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer("\\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_pii_base_matches():
    rng = random.Random(1)
    for alphabet in ("a1.@-+ ()b29%_é\n", "123 -.+()"):
        for _ in range(4000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert sorted(pii.base_matches(t)[0]) == brute_spans(t)
    assert pii.base_matches("a" * 400000)[0] == []


def test_pii(spark, docs, texts):
    got = by_id(pii.find_spans(docs))
    last = got[len(texts) - 1]
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 1, 1, 1)
    assert got[0].spans == "" and pii.find_spans(empty(spark)).count() == 0
    clean = by_id(pii.redact(docs))
    assert "bob.x@" not in clean[len(texts) - 1].text and clean[0].text is None and clean[10].text == texts[10]


def test_pii_classifier_scores_features_whatever_the_votes(spark):
    # the labelers agree on assigned hex keys; a key of equal features but other votes is judged by those features
    seen = [f'token = "{hashlib.md5(str(i).encode()).hexdigest()}"' for i in range(40)] + [f"chapter: abcdefghijklmnopqrst{'x' * (i % 4)}" for i in range(40)]
    model = pii.train(spark.createDataFrame(list(enumerate(seen)), "doc_id long, text string"))
    assert model is not None and len(model) == 1 + pii.N_FEATURES
    unseen = 'my words\ntoken = "0123456789abcdef0123456789abcde9"'
    assert [k for k, _, _ in pii.spans_of(unseen, model)[1]] == [4] and pii.spans_of(seen[45], model)[1] == []
    assert pii.spans_of(unseen, None)[1] == []


def test_pii_posteriors_are_those_of_plain_expectation_maximisation():
    rng = random.Random(6)
    patterns = sorted({(rng.randrange(3**pii.N_VOTES), rng.randrange(1 << pii.N_FEATURES), rng.randrange(1, 50)) for _ in range(60)})
    votes = [[p[0] // 3**i % 3 for i in range(pii.N_VOTES)] for p in patterns]
    post = [(v.count(1) + 1) / (v.count(1) + v.count(2) + 2) for v in votes]
    for _ in range(5):
        prior = sum(p[2] * q for p, q in zip(patterns, post)) / sum(p[2] for p in patterns)
        prior = min(0.98, max(0.02, prior))
        new = []
        for v in votes:
            odds = np.log(prior / (1 - prior))
            for i, x in enumerate(v):
                if x:
                    mass = [[sum(p[2] * (q if c else 1 - q) for p, q, u in zip(patterns, post, votes) if u[i] in at) for at in ((x,), (1, 2))] for c in (0, 1)]
                    odds += np.log((mass[1][0] + 1) / (mass[1][1] + 2)) - np.log((mass[0][0] + 1) / (mass[0][1] + 2))
            new.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        post = new
    assert pii.posteriors(patterns, 5) == pytest.approx(post)


def spark_hash(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), h)
    return h % quality_rules.BUCKETS if h < 1 << 63 else (h - (1 << 64)) % quality_rules.BUCKETS


def test_quality_score_is_the_mean_log_ratio(spark, docs, labels):
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    rows = [(r.doc_id, regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0b\f\r]+", r.text or "")) for r in docs.collect()]
    grams = lambda w: [(0, spark_hash(a)) for a in w] + [(1, spark_hash(a, b)) for a, b in zip(w, w[1:])]
    raw, target = Counter(), Counter()
    for d, w in rows:
        raw.update(grams(w))
        target.update(grams(w) if d in good else ())
    total = lambda c, k: sum(n for (kind, _), n in c.items() if kind == k)
    ratio = lambda g: np.log((target[g] + 1) / (total(target, g[0]) + quality_rules.BUCKETS)) - np.log((raw[g] + 1) / (total(raw, g[0]) + quality_rules.BUCKETS))
    got = quality_rules.measure(docs, labels)
    scores = by_id(got)
    for d, w in rows:
        want = sum(map(ratio, grams(w))) / max(1, 2 * len(w) - 1)
        assert scores[d].score == pytest.approx(want, abs=1e-9)
        assert scores[d].kept == (not scores[d].base_failed and scores[d].score >= quality_rules.THRESHOLD)
    assert got.where("kept").count() == got.where("not base_failed and score >= -0.5").count()


def test_quality_rules(spark, docs, labels, texts):
    got = by_id(quality_rules.measure(docs, labels))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in quality_rules.measure(docs, labels).collect())
    assert quality_rules.measure(empty(spark), labels.limit(0)).count() == 0


def test_quality_rules_count_all_trusted_rows(spark):
    n = 20_100
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("good").alias("text"))
    w = quality_rules.log_ratios(docs, quality_rules.trusted_rows(docs.select("doc_id", F.lit(1).alias("quality")))).first()["w"]
    # all rows are trusted, so both models are the same
    assert max(map(abs, w)) < 1e-12


def test_quality_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) / len(out) >= 0.95


def test_quality_classifier_trains_on_each_id_once(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    once, often = (quality_classifier.train(d, labels) for d in (docs, docs.unionAll(docs).unionAll(docs)))
    assert all((a == b).all() if hasattr(a, "all") else a == b for a, b in zip(once.values(), often.values()))


def test_quality_classifier_edges(spark, docs, labels, texts):
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.classify(empty(spark), labels).count() == 0
    assert all(r.score == pytest.approx(0.7) for r in quality_classifier.classify(docs, labels.limit(0)).collect())


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(3000):
        s = [rng.randrange(rng.choice([2, 3, 5])) + 2 for _ in range(rng.randrange(1, 40))] + [1]
        assert substring_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def without_repeats(rows):
    """What is left of every (doc_id, text), by looking each 50-byte string up."""
    rows = [(d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in rows:
        for i in range(len(b) - 49) if d is not None else ():
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, b in rows:
        cut = bytearray(len(b))
        for i in range(len(b) - 49) if d is not None else ():
            if first[b[i : i + 50]] < d:
                cut[i : i + 50] = b"\1" * 50
        spans = sum(bool(c) and (i == 0 or not cut[i - 1]) for i, c in enumerate(cut))
        out.append((str(d), len(b), sum(cut), spans, bytes(x for x, c in zip(b, cut) if not c)))
    return sorted(out)


def removed(df, **limits):
    return sorted((str(r[0]), *r[1:4], bytes(r[4])) for r in substring_dedup.remove_repeats(df, **limits).collect())


def test_substring_dedup(spark, docs):
    assert removed(docs) == without_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize(("kind", "limits"), [("long", {}), ("int", {"hot": 20}), ("long", {"split": 3}), ("long", {"hot": 70, "split": 4}), ("string", {})])
def test_substring_dedup_of_edited_copies_and_repeated_ids(spark, kind, limits):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcde\u00e9") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passages, rows = some(300).split(), [some(12) for _ in range(6)], []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(12)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts = (" ".join(t[: rng.randrange(20, 300)]), f"{some(rng.randrange(20))} {rng.choice(passages)} {some(20)}", "z" * rng.randrange(200) + "ab " * rng.randrange(100), some(100))
        # ids below zero, and several texts of one id
        rows.append((rng.randrange(-20, 110), rng.choice(texts)))
    rows += [(None, " ".join(base)), (3, None), (4, ""), *rows[5:8]]
    if kind == "string":
        rows = [(None if d is None else f"x{d}", t) for d, t in rows]
    assert removed(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3), **limits) == without_repeats(rows)


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(400):
        a, b = (np.array([rng.randrange(6) for _ in range(rng.randrange(1, 25))], np.uint64) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert near_dup.common(a, b, 99) == near_dup.common_dense(a, b, 99) == t[-1, -1]


def test_near_dup(spark, docs, texts):
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    h = [near_dup.shingles(t or "") for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or near_dup.similarity(h[i], h[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {i: got[i] for i in range(len(texts))} == {i: find(i) for i in range(len(texts))}
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({find(i) for i in range(len(texts))})
    assert near_dup.classes(empty(spark)).count() == 0


def test_keep_one_of_repeated_and_missing_ids(spark):
    rng = random.Random(31)
    x, y, z, w = (prose(rng, 80) for _ in range(4))
    rows = [(5, x), (7, x), (7, y), (8, y), (3, z), (3, w), (None, x), (None, "only here"), (None, "only here"), (7, y)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(5, x), (7, y), (3, z), (3, w), (0, "only here")])


def test_near_copies_that_only_share_buckets_of_a_common_passage(spark):
    rng = random.Random(21)
    # 40 pairs of near copies hold one passage of four fifths of their words, and are not near to other pairs
    passage, rows = prose(rng, 800), []
    for i in range(40):
        own = prose(rng, 110)
        rows += [(2 * i + k, f"{passage} {own} {prose(rng, 90)}") for k in range(2)]
    h = [near_dup.shingles(t) for _, t in rows]
    assert all((near_dup.similarity(h[i], h[j]) >= 0.8) == (i // 2 == j // 2) for i in range(80) for j in range(i))
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(80)}


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(15, 60)).replace("0", "q")) for i in range(30)] + [(30, None), (31, ""), (None, "lone words here")]
    clean = [(i, prose(rng, 300)) for i in range(60)]
    dirty = [(100 + i, prose(rng, 90) + " " + items[i][1] + " " + prose(rng, 90)) for i in range(20)]

    def paraphrase(t):
        w = t.split()
        return " ".join(x for k, x in enumerate(w) if k % 6 != 2)

    dirty += [(200 + i, prose(rng, 70) + " " + paraphrase(items[i][1]) + " " + prose(rng, 50)) for i in range(20, 30)]
    docs = spark.createDataFrame([*clean, *dirty, (900, None), (901, ""), (None, items[3][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.hits(docs, bench).collect()}
    assert got == {(100 + i, i) for i in range(20)} | {(200 + i, i) for i in range(20, 30)} | {(None, 3)}
    left = decontaminate.remove_hits(docs, bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in clean} | {900, 901} and left.columns == docs.columns
    more = docs.union(spark.createDataFrame([(100, "clean words under the id of a hit")], "doc_id long, text string"))
    assert {r.text for r in decontaminate.remove_hits(more, bench).where("doc_id = 100").collect()} == {"clean words under the id of a hit"}
    assert decontaminate.hits(docs, bench.limit(0)).count() == 0
    assert decontaminate.hits(docs.limit(0), bench).count() == 0


def test_decontamination_finds_what_a_comparison_of_all_finds(spark):
    rng = random.Random(28)
    items = [(i, prose(rng, rng.randrange(20, 150))) for i in range(25)]

    def edited(t, share):
        return " ".join(rng.choice(WORDS) + "x" if rng.random() < share / 2 else w for w in t.split() if rng.random() >= share / 2)

    rows = [(i, f"{prose(rng, rng.randrange(100))} {edited(rng.choice(items)[1], rng.choice((0, 0.1, 0.2, 0.3, 0.45)))} {prose(rng, rng.randrange(100))}") for i in range(150)]
    bench, step = decontaminate.Bench(items), decontaminate.STRIDE
    want = set()
    for d, t in rows:
        words = [bench.terms.get(w, -1) for w in decontaminate.WORD.findall(t.lower())]
        for at in range(0, max(1, len(words) - step), step):
            passage = [w for w in words[at : at + 2 * step] if w >= 0]
            for item, s, least, less in bench.parts:
                cover, answer = decontaminate.judge(passage, s)
                if cover >= least or cover >= less and answer:
                    want.add((d, item))
    got = {(r.doc_id, r.item_id) for r in decontaminate.hits(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.95 * len(want)


def test_decontamination_of_an_item_that_a_third_of_the_rows_hold(spark):
    rng = random.Random(18)
    # each row has other words about the same paraphrase; the words that this left out stay rare
    items = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(8)]
    held = " ".join(w for k, w in enumerate(items[0][1].split()) if k % 4 != 3)
    # a part of an item that is in order but for a few words, and one that has just its first half
    weak = " ".join(items[1][1].split()[:19])
    rows = [(i, f"{prose(rng, 30)} {held if i % 3 == 0 else weak if i % 3 == 1 else ''} {prose(rng, 30)}") for i in range(120)]
    rows.append((500, prose(rng, 20) + " " + items[2][1]))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.hits(docs, bench).collect()}
    assert got == {(i, 0) for i in range(0, 120, 3)} | {(500, 2)}


def test_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == t[-1, -1]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_parts_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).select("doc_id").collect()
    ids = {r.doc_id for r in out}
    assert 0 < len(out) == len(ids) < docs.count()
    good = {r.doc_id for r in quality_rules.measure(docs, spark.read.parquet(f"{sf}/labels.parquet")).where(F.col("kept")).collect()}
    assert ids <= good


LAYOUT = [
    ("a<br><br>b", "a\n\nb"),
    ("a<br>b<br>", "a\nb"),
    ("<p>a<br></p><p>b</p>", "a\n\nb"),
    ("<ol start=-3><li>x<li>y</ol>", "-3. x\n-2. y"),
    ("<ol><li>x<li value=5>y<li>z</ol>", "1. x\n5. y\n6. z"),
    ("<ol reversed><li>x<li>y</ol>", "2. x\n1. y"),
    ("<input type=submit value=Send><input type=hidden value=no><input placeholder=Name><input type=checkbox value=no>", "SendName"),
    ("<table><tr><td rowspan=2>a</td><td>bb</td><td>c</td></tr><tr><td>d</td><td>e</td></tr><tr><td>f</td><td>g</td><td>h</td></tr></table>", "a  bb  c\n   d   e\nf  g   h"),
    ("<table><tr><th>n</th><th colspan=2>long words</th></tr><tr><td rowspan=0>1</td><td>2</td><td>3</td></tr><tr><td>4</td></tr></table>", "n  long words\n1  2  3\n   4"),
]


@pytest.mark.parametrize(("html", "text"), LAYOUT)
def test_html_layout(html, text):
    assert html_text.html_to_text(html) == text


def test_html_of_odd_tables(spark):
    rows = [(None, "<p>x</p>", "clash", "clash"), (1, None, None, "t"), (1, "", "u", "t"), (2, "<ul><li>" * 300 + "deep", "u", "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "text"] and sorted((r.page_id or 0, r.text.strip(" -")) for r in got.collect()) == [(0, "x"), (1, ""), (1, ""), (2, "deep")]
    assert html_text.extract(pages.limit(0)).count() == 0
