"""Corpus operators against SQL on the smallest tables, brute force on fixtures, round trips and held-out data."""

import hashlib
import io
import random
import struct
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece

from fieldtrace.llm import core, decontaminate, files, html_wrapper, line_quality, near_dedup, pseudo_likelihood, registry, sentence_pieces, substring_dedup, token_files, url_rules, warc_zip
from tools.check_oracle import compare

TABLES = ("documents", "pages", "benchmark")


def lorem(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op5_near_dedup", "op7_url_rules", "op9_warc_zip", "op10_line_quality"])
def test_against_sql(spark, sf_dir, name):
    registry.load()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    status, _, _, info = compare(spark, con, name, sf_dir)
    assert status == "OK", info


# --- shared pieces

def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (5, 5), (1000, 1 << 12), (1000, 1 << 40)):
        v = np.sort(rng.choice(top, n, replace=False) if top < 1 << 20 else np.unique(rng.integers(0, top, n)))
        assert core.unpack(core.pack(v, top)).tolist() == v.tolist()


def test_rolling_hash_depends_on_all_words_in_order():
    h = core.hash_words([str(i).encode() for i in range(60)])
    for k in (1, 2, 5, 31, 50):
        assert core.rolling(h, k)[3] == core.rolling(h[3:3 + k], k)[0]
        assert len(core.rolling(h, k)) == 61 - k
    swapped = h.copy()
    swapped[[4, 5]] = swapped[[5, 4]]
    assert core.rolling(h, 50)[0] != core.rolling(swapped, 50)[0]


# --- 1

PAGE = "<html><body><div class='top'>{site}</div><div class='body'><h2>{title}</h2><p>{text}</p><p>Read more on our site</p></div><div class='base'>{base}</div></body></html>"


def test_wrapper_is_learnt_where_no_element_names_it(spark):
    rng = random.Random(3)
    bodies = [lorem(rng, 30) for _ in range(12)]
    rows = [(i, f"http://a.b/{i}", PAGE.format(site="The Site", title=f"T{i}", text=t, base=("left", "right")[i % 2])) for i, t in enumerate(bodies)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\n{t}" for i, t in enumerate(bodies)}


def test_pages_nest_to_any_depth_and_may_hold_stray_end_tags(spark):
    rng = random.Random(61)
    pages = [(i, f"http://a.b/{i}", "<div>" * depth + f"<p>{lorem(rng, 20)} end{i}" + "</b></div>" * 9) for i, depth in enumerate([3, 3, 4, 5, 6, 7, 900, 100_000])]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == 8 and all(got[i].endswith(f"end{i}") for i in range(8))
    assert html_wrapper.content("<p>a<b>b" * 3 + "</i>" * 20_000 + "c") == "ab\nab\nabc"


@pytest.mark.parametrize("frame", ["<div>{}</div>", "<article>{}</article>"])
def test_long_constant_notice_is_template(spark, frame):
    rng = random.Random(62)
    notice = lorem(rng, 120)
    bodies = [lorem(rng, 60, 5000) for _ in range(40)]
    copies = [bodies[0]] * 30  # copies of one page make nothing of it constant
    rows = [(i, f"http://a.b/{i}", "<body>" + frame.format(f"<div class='lead'>The Site</div><p>{t}</p><div class='low'>{notice}</div>") + "</body>") for i, t in enumerate(bodies + copies)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(bodies + copies))


def test_article_without_what_surrounds_it():
    page = ("<html><head><title>x</title></head><body class='has-sidebar'><header>Site</header><nav><a href='/'>Home</a></nav><article><header><h1>A &amp; B</h1></header>"
            "<p>one <b>two</b>\n three<br>four<p>five&nbsp;six<div class='cookie-notice'>ok?</div><ul><li>x<li>y</ul><form>f</form><section id='comments'>no</section></article>"
            "<aside>s</aside><footer>&copy;</footer><script>var t='</p>'</script><di")
    assert html_wrapper.content(page) == "A & B\none two three four\nfive six\nx\ny"
    assert html_wrapper.content("") == ""


def test_matching_is_ordered_and_largest():
    ref = '["r",["a"],["b",["x"],["y"]],["c"]]'
    assert html_wrapper.align('["r",["b",["y"]],["c"]]', ref) == (0, 2, 4, 5)
    assert html_wrapper.align('["q"]', ref) == (-1,)


# --- 2

def brute_leaks(texts, items):
    out = set()
    index = decontaminate.Index(items)
    for d, text in texts:
        h = core.rolling(core.hash_words(decontaminate.words(text.encode())), 5)
        for i, t in items:
            own = core.rolling(core.hash_words(decontaminate.words(t)), 5)
            for a in range(max(1, len(h) - len(own) + 1)):
                x, y = (decontaminate.Counter(v.tolist()) for v in (h[a:a + len(own)], own))
                if len(h) and decontaminate.weighted_jaccard(x, y, lambda s: index.weights.get(s, decontaminate.SCALE)) >= 0.8:
                    out.add((d, i))
    return out


def test_leaks_like_brute_force(spark):
    rng = random.Random(5)
    items = [(i, lorem(rng, rng.randrange(15, 60)).encode()) for i in range(20)] + [(90, b"two words")]
    texts = []
    for d in range(60):
        parts = lorem(rng, 80).split()
        if d % 3 == 0:
            leak = items[d % 20][1].decode().split()
            for _ in range(d % 4):
                leak[rng.randrange(len(leak))] = "Changed!"
            parts[40:40] = leak
        texts.append((d, " ".join(parts)))
    texts.append((60, items[3][1].decode().upper() + "."))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text binary").selectExpr("item_id", "string(text) text")).collect()}
    want = brute_leaks(texts, [x for x in items if x[0] != 90])
    assert got == want and len(want) > 5


@pytest.mark.parametrize("block", [1000, 5])
def test_items_that_share_text_leak_like_others(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEMS", block)
    rng = random.Random(6)
    text = lambda n: lorem(rng, n, 100_000)
    twice, thrice, template = text(60), text(60), text(30)
    templated = [f"{template} {text(30)}" for _ in range(8)]
    items = [(0, twice), *[(10 + k, t) for k, t in enumerate(templated)], (1, twice), (2, thrice), (3, thrice), (4, thrice)]

    def leak(item, at):
        w = item.split()
        w[at] = "changed"
        return f"{text(50)} {' '.join(w)} {text(50)}"

    texts = [(0, leak(twice, 30)), (1, leak(thrice, 30)), (2, leak(templated[3], 10)), (3, f"{text(50)} {template} {text(80)}")]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 2), (1, 3), (1, 4), (2, 13)}
    assert all(abs(got[k] - 51 / 61) < 1e-9 for k in got if k[0] < 2)


def test_every_fingerprint_within_the_radius_is_found():
    rng = np.random.default_rng(2)
    index = decontaminate.Index([(0, b" ".join(b"a%d" % i for i in range(20)))])
    bits = [rng.choice(64, k, replace=False) for k in range(decontaminate.RADIUS + 4) for _ in range(50)]
    prints = np.array([index.prints[0] ^ np.uint64(sum(1 << int(b) for b in own)) for own in bits], np.uint64)
    window, _, distance = index.near(20, prints)
    assert sorted(window.tolist()) == [k for k, own in enumerate(bits) if len(own) <= decontaminate.RADIUS]
    assert all(distance[k] == len(bits[w]) for k, w in enumerate(window))


# --- 3

def test_token_files_hold_the_tokenizers_ids(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, lorem(rng, rng.randrange(1, 300))) for i in range(120)] + [(500, None), (501, ""), (502, "a  b\n\n c <|endoftext|> 日本 "), (500, "again")]
    manifest = token_files.write(docs_of(spark, rows))
    got = token_files.read(manifest).orderBy("start").collect()
    plain = token_files._encoder(token_files.TOKENIZER)._tokenizer
    at = 0
    for r, (doc, text) in zip(got, sorted(rows, key=lambda x: (x[0], x[1] or "")), strict=True):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (doc, at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    shard = token_files.ShardReader(manifest.first()["uri"])
    assert shard.document(7) == next(bytes(r["ids"]) for r in got if r["doc_id"] == 7)
    with pytest.raises(KeyError):
        shard.document(10_000)


def test_units_give_the_ids_of_whole_texts():
    coder = token_files.Encoder()
    texts = ["", " ", "a", " a  b\n\nc\td ", "it's he'll 've", "\x1c x \x85 y", "日本語 🎉", "x\n y", "<|endoftext|> z"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [x.ids for x in coder._tokenizer.encode_batch(texts, add_special_tokens=False)]


# --- 4

def brute_removed(rows, window):
    first = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = (t or "").split()
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < d for k in range(window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def test_removed_words_like_brute_force(spark):
    rng = random.Random(11)
    passage = lorem(rng, 70)
    rows = [(i, lorem(rng, 40, 5) + " " + (passage if i % 4 == 0 else "") + "\n" + lorem(rng, 60, 3)) for i in range(80)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (201, None), (202, "")]
    for window in (10, 50):
        assert sorted(tuple(r) for r in substring_dedup.removed_words(docs_of(spark, rows), window).collect()) == brute_removed(rows, window)


def test_what_is_left_keeps_its_white_space(spark):
    rng = random.Random(12)
    p = lorem(rng, 55)
    rows = [(1, p), (2, f"Start\n\n{p}  the  end"), (3, "short")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs_of(spark, rows)).collect()}
    assert got == {1: p, 2: "Start  the  end", 3: "short"}


# --- 5

def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(root, a), find(root, b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(root, d), d == find(root, d)) for d in sets)


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


@pytest.mark.parametrize("small", [64, 3])
def test_components_like_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(13)
    rows, base = [], lorem(rng, 150).split()
    for i in range(40):  # a chain of drifting copies and a fan of copies, each with its own edits
        if i % 8 == 0:
            base[rng.randrange(150)] = f"drift{i}"
        own = list(base)
        for _ in range(i % 3):
            own[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, lorem(rng, 120)) for i in range(30)] + [(200, "one two"), (201, "One  TWO"), (202, "one two three"), (203, None), (204, " ")]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs_of(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute_components(rows)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(17)
    for n, shared in ((400, 380), (400, 300), (60, 55)):
        truth, got = shared / (2 * n - shared), []
        for _ in range(40):
            h = rng.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
            a, b = near_dedup.registers(np.zeros(n, np.int64), h[:n], 1), near_dedup.registers(np.zeros(n, np.int64), h[n - shared:], 1)
            got.append(near_dedup.estimate(a, b, np.array([n]), np.array([n]))[0][0])
        assert abs(np.mean(got) - truth) < 0.03


# --- 6

def test_both_sides_predict_better_than_frequencies(spark):
    rng = random.Random(19)
    def text(n):  # every token is the sum of its neighbours' halves: both sides tell it
        return " ".join(f"t{k % 7}" if k % 2 else f"u{(k // 2) % 5}" for k in range(rng.randrange(50), rng.randrange(50) + 60 + n))
    docs = docs_of(spark, [(i, text(100)) for i in range(300)])
    words = pseudo_likelihood.vocabulary(docs)
    weights = pseudo_likelihood.train(pseudo_likelihood.tokenised(docs, words), rounds=9)
    known = pseudo_likelihood.Vocabulary(words)
    row, lengths = pseudo_likelihood.padded([known.tokens(text(100).encode()) for _ in range(30)])
    at = pseudo_likelihood.positions(lengths)
    share = np.bincount(row[at], minlength=pseudo_likelihood.TOKENS) / len(at)
    assert pseudo_likelihood.log_likelihood(weights, row, at).mean() > np.log(share[row[at]]).mean() + 0.1


def test_the_rounds_of_the_query_train_every_token_once():
    import pyarrow as pa

    known = pseudo_likelihood.Vocabulary([b"a", b"b"])
    texts = [b"a b", b"a", b"", b"b a b a b a b a b a b", b"a b c d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([known.tokens(t) for t in texts], pa.binary())], names=["doc_id", "data"])
    weights = pseudo_likelihood.start().tobytes()
    trained = [sum(n for out in pseudo_likelihood._train(weights, turn % pseudo_likelihood.STRIDE)([batch]) for n in out.column("n").to_pylist()) for turn in range(pseudo_likelihood.ROUNDS)]
    assert sum(trained) == 18


def test_tokens_grow_with_the_vocabulary(spark):
    rng = random.Random(20)
    texts = [" ".join(f"v{rng.randrange(400_000)}" for _ in range(2000)) for _ in range(300)]
    docs = docs_of(spark, list(enumerate(texts)))
    words = pseudo_likelihood.vocabulary(docs)
    assert len(words) > 767
    rows = pseudo_likelihood.tokenised(docs, words)
    weights = pseudo_likelihood.train(rows, n_words=len(words))
    assert pseudo_likelihood.classes_of(weights) == pseudo_likelihood.classes_for(len(words)) > 32
    got = pseudo_likelihood.score(rows, weights).collect()
    assert len(got) == 300 and all(-30 < r["mean_log_likelihood"] < 0 for r in got)


def test_probabilities_sum_to_one_and_gradients_descend():
    rng = np.random.default_rng(23)
    weights, row = pseudo_likelihood.start(), rng.integers(1, 1024, 40).astype(np.int32)
    total = 0.0
    for t in range(pseudo_likelihood.TOKENS):
        row[20] = t
        total += float(np.exp(pseudo_likelihood.log_likelihood(weights, row, np.array([20])))[0])
    assert abs(total - 1) < 1e-3
    at = np.arange(5, 35)
    before = pseudo_likelihood.log_likelihood(weights, row, at).sum()
    base, moved = weights.copy(), weights.copy()
    pseudo_likelihood.step(moved, row, at, 1e-1)
    grad = (base - moved).astype(np.float64) / (1e-1 / len(at))  # gradient of the negative sum
    k = int(np.argmax(np.abs(grad)))
    nudged = base.copy()
    nudged[k] += 1e-2
    slope = (before - pseudo_likelihood.log_likelihood(nudged, row, at).sum()) / 1e-2
    assert abs(slope - grad[k]) < 0.05 * abs(grad[k]) + 0.05
    assert pseudo_likelihood.log_likelihood(moved, row, at).sum() > before


# --- 7

def test_rules_like_brute_force_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "ROWS", 40)
    rng = random.Random(29)
    hosts = ["com", "a.com", "b.a.com", "ba.com", "x.org", "a.x.org", "net"]
    paths = ["", "/", "/e", "/en/", "/en/7", "/en/77"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(25))}.values())
    urls = [(i, f"http://{rng.choice(hosts + ['A.COM', 'q.b.a.com'])}{rng.choice([*paths, '/en/777x', '/fr'])}{rng.choice(['', '?q=http://c.d/', '#t'])}") for i in range(600)] + [(700, None), (701, "no url"), (701, "://")]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(spark.createDataFrame(urls, "page_id long, url string"), url_rules.rule_table(spark, rules)).collect())
    want = []
    for i, u in urls:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
        want.append((i, host, path, best and best[0] + best[1], best[2] if best else "allow"))
    assert got == sorted(want)


def test_rules_of_the_contract(spark):
    assert set(url_rules.RULES) == {("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")}
    urls = [(1, "http://a.example.net/de/7"), (2, "http://a.example.net/de/81"), (3, "http://a.example.com/en/7"), (4, "http://b.com/en/"), (5, "http://x.org/es/"), (6, "http://x.org/de/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(spark.createDataFrame(urls, "page_id long, url string"), url_rules.rule_table(spark)).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("example.com/en/7", "allow"), 4: ("com/en/", "block"), 5: ("org/es/", "block"), 6: (None, "allow")}


# --- 8

def test_pieces_are_the_librarys(tables):
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL), sentence_pieces.Coder()
    texts = ["", " ", "a", " a  b\n\nc\td é中 ", "   ", "x▁y", "日本語🎉🎉", "\0abc", "a" * 40, "<s></s><0x0A>", "=" * 37, "def f(self):\r\n        return x", "ﬁ Ⅷ ½ ﻿"]
    texts += [r["text"] for r in tables.documents.limit(150).collect()]
    got = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [sp.encode(t) for t in texts]
    assert [coder.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]


def test_a_full_memory_forgets_nothing_it_needs(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 10)
    coder, rng = sentence_pieces.Coder(), random.Random(31)
    for _ in range(5):
        texts = [lorem(rng, 30) for _ in range(4)]
        assert [coder.decode(x) for x in coder.encode(texts)] == texts


def test_encode_and_decode_frames(spark):
    rows = [(1, "one  two\n"), (2, None), (None, "three")]
    back = sentence_pieces.decoded(sentence_pieces.encoded(docs_of(spark, rows))).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == [(0, "three"), (1, "one  two\n"), (2, "")]


# --- 9

def test_archives_and_records(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (7, "http://c/", "small"), (8, "http://d/\r\nX: 1", "small"), (9, "u", None), (None, "n", big), (5, "http://b/", big)]
    manifest = warc_zip.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc_zip.read(manifest).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i, len((t or "").encode()), sha(t), "revisit" if t == big and i != 5 else "response", 5 if t == big and i != 5 else None) for i, _, t in rows]
    assert got == sorted(want, key=str)
    with files.Ranges(manifest.first()["uri"]) as f:
        archive = warc_zip.Archive(f)
        fields, payload = archive.record(*archive.index()[0])
        assert fields["WARC-Type"] in ("response", "revisit") and len(payload) in (0, int(fields["X-Payload-Length"]))


class Bytes:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def read(self, offset, length):
        return self.data[offset:offset + length]


def test_zip64_directories_are_followed():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("indexes/index.cdx", "0 3 1 ab\n")
        z.writestr("archive/data.warc.gz", b"abcdef")
        z.writestr(zipfile.ZipInfo("packed"), b"zzz" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"PK-comment"
    data = buffer.getvalue()
    end = data.rfind(b"PK\5\6")
    count, size, offset = struct.unpack_from("<HII", data, end + 10)
    directory = data[offset:offset + size]
    # the first entry's sizes and offset move to a ZIP64 field, and the end record points to a ZIP64 one
    n_name, = struct.unpack_from("<H", directory, 28)
    plain, header = struct.unpack_from("<I", directory, 24)[0], struct.unpack_from("<I", directory, 42)[0]
    extra = struct.pack("<HHQQQ", 1, 24, plain, plain, header)
    entry = bytearray(directory[:46 + n_name] + extra)
    struct.pack_into("<II", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<H", entry, 30, len(extra))
    struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
    directory = bytes(entry) + directory[46 + n_name:]
    wide = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(directory), offset)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, offset + len(directory), 1)
    last = b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    archive = warc_zip.Archive(Bytes(data[:offset] + directory + wide + locator + last))
    assert set(archive.members) == {"indexes/index.cdx", "archive/data.warc.gz"} and archive.index() == [(0, 3)]
    at, n = archive.locate("archive/data.warc.gz")
    assert data[at:at + n] == b"abcdef"
    with pytest.raises(ValueError):
        warc_zip.Archive(Bytes(b"no zip" * 10))


# --- 10

def test_common_lines_go_and_copies_do_not_count(spark):
    rng = random.Random(37)
    banner = "Sign up for our letter today and every day after today again"
    copy = "\n".join(lorem(rng, 12) for _ in range(6))
    rows = [(i, "h", f"{lorem(rng, 40)}\n{banner if i % 2 else lorem(rng, 12)}") for i in range(100)]
    rows += [(1000 + i, "h", copy) for i in range(60)] + [(2000, "h", banner), (2001, None, banner), (2002, "h", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    facts = line_quality.line_facts(docs)
    common = line_quality.common_lines(facts, min_docs=20, share=0.02).collect()
    assert [(r["host"], r["line"]) for r in common] == [("h", line_quality.line_hash(banner.encode()))]
    kept = {r["doc_id"]: r for r in line_quality.judge(docs, min_docs=20).collect()}
    assert kept[1]["kept"] and kept[1000]["kept"] and kept[2000]["depleted"] and not kept[2000]["kept"] and kept[2001]["kept"] and not kept[2002]["kept"]
    cleaned = {r["doc_id"]: r["text"] for r in line_quality.clean(docs, min_docs=20).collect()}
    assert banner not in cleaned[1] and cleaned[1000] == copy and 2000 not in cleaned


def test_long_shared_notices_hide_no_common_line(spark):
    rng = random.Random(38)
    notices = [lorem(rng, 60), lorem(rng, 70)]
    banner, copy = "Sign up for our letter today and again", [lorem(rng, 14) for _ in range(8)]
    rows = [(i, "h", "\n".join([lorem(rng, 6), *notices, banner])) for i in range(150)]
    for i in range(120):  # near copies: one word of one line is another
        own = [x.split() for x in copy]
        own[i % 2][5] = f"edit{i % 7}"
        rows.append((1000 + i, "h", "\n".join(" ".join(x) for x in own)))
    rows += [(5000 + i, "h", rows[0][2]) for i in range(4000)]  # copies raise no bound
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    common = {r["line"] for r in line_quality.common_lines(line_quality.line_facts(docs), min_docs=50, share=0.1).collect()}
    assert common == {line_quality.line_hash(x.encode()) for x in [*notices, banner]}
    kept = {r["doc_id"]: r["kept"] for r in line_quality.judge(docs, min_docs=50, share=0.1).collect()}
    assert not any(kept[i] for i in range(150)) and all(kept[1000 + i] for i in range(120))


def common_of(docs):
    return {r["line"] for r in line_quality.common_lines(line_quality.line_facts(docs)).collect()}


def test_small_hosts_lose_their_banner(spark):
    rng = random.Random(51)
    banner = "All rights are with the weekly paper of our town"
    rows = [(i, "h", f"{lorem(rng, 30)}\n{banner}") for i in range(90)] + [(500 + i, "few", f"{lorem(rng, 30)}\n{banner}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert [(r["host"], r["line"], r["n_docs"], r["bound"]) for r in line_quality.common_lines(line_quality.line_facts(docs)).collect()] == [("h", line_quality.line_hash(banner.encode()), 90, 5.0)]
    cleaned = {r["doc_id"]: r["text"] for r in line_quality.clean(docs).collect()}
    assert len(cleaned) == 95 and all((banner in t) == (k >= 500) for k, t in cleaned.items())


def test_bylines_hide_no_banner(spark):
    rng = random.Random(52)
    banner = "Read all of it in the printed paper"
    by = "This article was first published by the weekend desk of our paper number {}"
    docs = spark.createDataFrame([(i, "h", f"{by.format(i)}\n{lorem(rng, 9)}\n{banner}") for i in range(400)], "doc_id long, source string, text string")
    assert common_of(docs) == {line_quality.line_hash(banner.encode())}


def test_near_copies_keep_their_lines(spark):
    rng = random.Random(53)
    lines = [lorem(rng, 25, 3000).split() for _ in range(8)]
    rows = [(i, "h", lorem(rng, 60, 3000)) for i in range(100)]
    for i in range(500):  # three words of each copy are others
        own = [list(x) for x in lines]
        for _ in range(3):
            own[rng.randrange(8)][rng.randrange(25)] = f"edit{rng.randrange(10 ** 6)}"
        rows.append((1000 + i, "h", "\n".join(" ".join(x) for x in own)))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert common_of(docs) == set() and all(r["kept"] for r in line_quality.judge(docs).collect())


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rng = random.Random(54)
    banner = "All rights are with the weekly paper of our town"
    rows = [(i, "h", f"{lorem(rng, 30)}\n{banner}") for i in range(20)] + [(7, "h", lorem(rng, 40)), (7, "h", f"one two\n{banner}")]
    got = [(r["n_words"], r["lost_words"], r["kept"]) for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("doc_id = 7").collect()]
    assert sorted(got, key=str) == [(12, 10, False), (40, 10, True), (40, None, True)]


def test_quality_rules_against_sql_where_lines_go(spark, tmp_path):
    rng = random.Random(55)
    notice, banner = " ".join(f"n{k}" for k in range(50)), "Sign up for our letter"
    by = "This article was first published by the weekend desk of our paper number {}"
    rows = [(i, "a", "\n".join([lorem(rng, 8), notice, banner])) for i in range(60)]
    rows += [(100 + i, "b", "\n".join([by.format(i), lorem(rng, rng.randrange(4, 14)), banner])) for i in range(80)]
    line = [lorem(rng, 12).split() for _ in range(5)]
    for i in range(60):
        own = [list(x) for x in line]
        own[i % 5][rng.randrange(12)] = f"e{i}"
        rows.append((300 + i, "a" if i % 2 else None, "\n".join(" ".join(x) for x in own)))
    rows += [(400 + i, "a", rows[3][2].upper()) for i in range(30)] + [(500, "a", None), (501, "a", ""), (502, None, banner)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    registry.load()
    status, _, _, info = compare(spark, con, "op10_line_quality", str(tmp_path))
    assert status == "OK", info
    kept = {r["doc_id"]: r["kept"] for r in line_quality.op10(spark, str(tmp_path)).collect()}
    assert not any(kept[i] for i in range(60)) and all(kept[i] for i in range(300, 360))


def test_heavy_light_tells_wanted_texts_before_a_shuffle(spark):
    """Of many texts those of a few ids go on, before any exchange of texts."""
    from fieldtrace.llm import heavy_light
    rows = spark.range(5000).selectExpr("id * 7 - 900 AS doc_id", "encode(concat('text ', id), 'utf-8') AS data").unionByName(spark.sql("SELECT cast(NULL AS long) AS doc_id, encode('none', 'utf-8') AS data"))
    wanted = spark.range(0, 5000, 50).selectExpr("id * 7 - 900 AS _doc")
    got = heavy_light.among(rows, wanted)
    ids = {r["doc_id"] for r in got.collect()}
    assert {r["_doc"] for r in wanted.collect()} <= ids and len(ids) < 150
    pairs = spark.createDataFrame([(-900, -893)], "a long, b long")
    plan = heavy_light.decide(pairs, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan
