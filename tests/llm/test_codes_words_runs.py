"""Piece codec, spelling variants and periodic runs against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import periodic_runs, piece_codec, queries, spelling_variants

SCHEMA = "doc_id long, text string, lang string, n long, word string, runs string, s string, root string"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def table(spark, texts, ids=None):
    rows = [(i, t, "en", 1, "clash", "clash", "clash", "clash") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


ODD = ["", " ", "\n", "\n\n a", "▁▁a ▁", "日本語 テキスト", "😀👩‍👩‍👧", "\x00 a\x00b", "<s> </s> <unk> <0x0A>", "é" * 49, "z" * 3000, "=" * 5000, "a,b.c_d-e('x');", "can't %%% ###", "\t\tx\r\ny", "word, word. word&&&"]


def test_pieces_equal_the_library(library):
    rng = random.Random(3)
    parts = [*"abcdehistnor  \n\t=-*#▁éü日ア,.&", "the", "ing", "tion", "▁▁", "    ", "==", "----"]
    texts = ODD + [" " * n + w + " " * m for n in range(40) for w in ("", "a", "日", "▁x") for m in (0, 1, 16, 33)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(200))) for _ in range(3000)]
    texts += [f"a{chr(c)}b {chr(c)}1" for c in range(0, 0x20000, 7) if not 0xD800 <= c < 0xE000]
    mine = piece_codec.PieceCodec(PATH)
    for t, ids, got in zip(texts, library.encode(texts, add_eos=True), mine.encode(texts)):
        assert got.tolist() == ids, t
        assert mine.decode(ids) == library.decode(ids), t


def test_pieces_decode_any_ids(library):
    rng, mine = random.Random(8), piece_codec.codec(PATH)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(3, 300) for _ in range(rng.randrange(12))]
        assert mine.decode(ids) == library.decode(ids)


def test_full_cache_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_WORDS", 50)
    monkeypatch.setattr(piece_codec, "SYMBOLS", 40)
    mine = piece_codec.PieceCodec(PATH)
    texts = ODD + [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    for at in range(0, len(texts), 5):
        assert [x.tolist() for x in mine.encode(texts[at : at + 5])] == library.encode(texts[at : at + 5], add_eos=True)


def test_piece_query_columns(spark, library):
    docs = table(spark, [*ODD, None, ODD[5]], [*range(len(ODD)), None, 5])
    got = piece_codec.digests(piece_codec.encode_decode(docs, PATH)).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        ids = library.encode(ODD[r.doc_id] if r.doc_id is not None else "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert piece_codec.encode_decode(docs.limit(0), PATH).count() == 0


def test_another_kind_of_model_is_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError):
        piece_codec.PieceCodec(str(tmp_path / "m"))


# ---- spelling variants


def vocabulary(rows, every=199):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def variants(count):
    keys = defaultdict(set)
    for w in count:
        keys[w].add(w)
        for i in range(len(w)):
            keys[w[:i] + w[i + 1 :]].add(w)

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = defaultdict(set)
    for group in keys.values():
        for a in group:
            links[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, n in count.items():
        best = min(((-count[x], x) for x in links[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(links[w]), count.get(form[w])) for w, n in count.items()}


def result(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = variants(vocabulary([(r.doc_id, r.text) for r in docs.collect()]))
    rows = queries.QUERIES["op12_spelling_variants"](spark, sf)
    assert rows.count() == len(want) and result(rows) == want and len([w for w in want if w[1]]) > 3


@pytest.mark.parametrize("group", [20_000, 3, 1])
def test_variants_with_any_size_of_subtrie(spark, group):
    rng = random.Random(group)
    count = {}
    stems = ["aaaaaa", "aaaaaaaaaaaa", "abcabcabc", "étéétéété", "commonprefixandmore" * 2]
    for s in stems:
        for _ in range(60):
            w = s
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w) + 1)
                w = w[:i] + rng.choice(["", "a", "b", "ÿ"]) + w[i + rng.randrange(2) :]
            if len(w) >= 6:
                count[w] = rng.choice([5, 6, 30, 151, 800])
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    assert result(spelling_variants.group_variants(words, group=group)) == variants(count)


def test_variants_of_odd_tables(spark):
    docs = table(spark, [None, "", "Ab 12", "Stones stönes STONES x stones stones", "stones", "x" * 200_000], [1, 2, 3, 4, None, 6]).union(table(spark, ["stone's stones"] * 6, [9] * 6))
    rows = [(r.doc_id if r.doc_id is not None else "", r.text) for r in docs.collect()]
    assert result(spelling_variants.group_variants(spelling_variants.count_words(docs, drop_every=199))) == variants(vocabulary(rows))
    assert spelling_variants.group_variants(spelling_variants.count_words(docs.limit(0))).count() == 0
    assert {(r.word, r.n) for r in spelling_variants.count_words(docs).collect()} == set(vocabulary(rows, 1 << 40).items())


# ---- periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, length = i, j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(4000):
        k, w = rng.choice([1, 2, 2, 3, 4, 9]), []
        while len(w) < rng.randrange(60):
            block = [str(rng.randrange(k)) for _ in range(rng.randrange(1, 7))]
            w += block * rng.randrange(1, 8) if rng.random() < 0.4 else block[:1]
        found = periodic_runs.runs_of(w)
        assert found == brute_runs(w)
        assert periodic_runs.collapse(w, found) == " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found))


def test_run_query_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n ", "a", "a " * 6, "a b\x1c " * 9, "é é " * 40, *[" ".join(rng.choice("ab") for _ in range(rng.randrange(90))) for _ in range(150)]]
    docs = table(spark, [*texts, "x x x x x x", texts[4]], [*range(len(texts)), None, 4])
    got = periodic_runs.summaries(periodic_runs.find_runs(periodic_runs.plant_repeats(docs))).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        w = planted(r.doc_id, texts[r.doc_id] if r.doc_id is not None else "x x x x x x")
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3)), r.doc_id
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)))
    assert periodic_runs.summaries(periodic_runs.find_runs(periodic_runs.plant_repeats(docs.limit(0)))).count() == 0


def test_run_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: planted(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.QUERIES["op13_periodic_runs"](spark, sf).collect()
    assert len(got) == len(want) and any(r.n_runs for r in got)
    for r in got:
        runs = brute_runs(want[r.doc_id])
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)))


def test_clashing_columns_are_ignored(spark):
    docs = table(spark, ["a b c d e f"], [1])
    assert piece_codec.encode_decode(docs, PATH).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert spelling_variants.count_words(docs).columns == ["word", "n"]
    assert periodic_runs.find_runs(docs.withColumn("h", F.lit(1))).columns == ["doc_id", "n_words", "runs", "collapsed"]
