"""Whitening, collocations and the size-aware join: SQL, brute force, odd rows."""

import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrace.llm import collocations, heavy_light, registry, whitening
from tools.check_oracle import compare


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in "n component phrase rank words f part data path dim y c key size rep node hub".split() if c not in df.columns])


# --- 11

def brute_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    d = x - x.mean(0)
    value, vector = np.linalg.eigh(d.T @ d / len(d))
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return d @ vector / np.sqrt(value), value / np.trace(d.T @ d / len(d))


def embedding_rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_whitening_like_brute_force(spark):
    rng = np.random.default_rng(3)
    for d in (3, 40):
        base = (rng.standard_normal((200, d)) @ rng.standard_normal((d, d)) + 5).astype(np.float32)
        rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
        got = whitening.whiten(embedding_rows(spark, rows)).orderBy("vec_id", "component").collect()
        k = min(d, 32)
        want, share = brute_whitening(base, k)
        mine = np.array([r["whitened"] for r in got]).reshape(200, k)
        sign = np.sign((mine * want).sum(0))
        assert np.abs(mine * sign - want).max() < 1e-7
        assert np.allclose([r["explained"] for r in got[:k]], share, rtol=1e-9)
        x = (np.floor(64 * base.astype(float)) + 1_000_000).astype(int)
        s = x.sum(0)
        assert [r["deviation"] for r in got[::k]] == [sum(int(v) ** 2 for v in 200 * row - s) for row in x]
        assert all(r["n"] == 200 and r["identity_error"] < 1e-9 for r in got)


def test_feast_finds_clusters_and_rank():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    for spectrum in (np.ones(30), np.r_[np.ones(20), np.zeros(10)], np.r_[5, 5, 5, np.linspace(1, 1 + 1e-13, 27)], np.r_[1e6, np.full(29, 1e-3)], 2.0 ** -np.arange(30)):
        a = q @ np.diag(spectrum) @ q.T
        a = (a + a.T) / 2
        value, vector = whitening.feast(a, 12)
        assert np.allclose(value, np.sort(spectrum)[::-1][:12], atol=1e-12 * spectrum.max())
        assert np.abs(vector.T @ vector - np.eye(12)).max() < 1e-12
        assert np.abs(a @ vector - vector * value).max() < 1e-11 * spectrum.max()
    assert len(whitening.feast(np.zeros((4, 4)), 2)[0]) == 0


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for d in (1, 2, 17):
        a = rng.standard_normal((d, d))
        a = a + a.T
        assert [whitening.inertia(a, s) for s in (-1.0, 0.0, 0.7)] == [(np.linalg.eigvalsh(a) > s).sum() for s in (-1.0, 0.0, 0.7)]
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_exact_sums_of_large_entries():
    rng = np.random.default_rng(4)
    for top in (100, 1 << 30, 1 << 50):
        y = rng.integers(-top, top, (50, 4))
        assert whitening.gram(y).tolist() == [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(4)] for i in range(4)]


def test_whitening_cases(spark):
    good = [(i, [float(i), float(i * i % 7), 1.0], 0) for i in range(10)]
    odd = [(20, None, 0), (21, [1.0, None, 2.0], 0), (22, [1.0, float("nan"), 2.0], 0), (23, [float("inf"), 0.0, 0.0], 0), (24, [], 0), (25, [1.0, 2.0], 0), (26, [1e30, 0.0, 0.0], 0)]
    more = [(None, [3.0, 3.0, 1.0], None), (1, [1.0, 1.0, 1.0], 0)]
    out = whitening.whiten(clash(embedding_rows(spark, good + odd + more))).collect()
    assert sorted({r["vec_id"] for r in out}, key=str) == sorted([*range(10), None], key=str)
    assert len(out) == 12 * 2 and {r["n"] for r in out} == {12}  # the third dimension has no variance
    assert whitening.whiten(clash(embedding_rows(spark, odd[:5]))).count() == 0
    assert whitening.whiten(embedding_rows(spark, [(1, [1.0, 2.0], 0)] * 3)).count() == 0
    big = whitening.whiten(embedding_rows(spark, [(i, [float(i) * 2 ** 38], 0) for i in range(5)])).collect()
    assert len(big) == 5 and all(r["deviation"] is None for r in big if r["vec_id"] in (0, 4)) and abs(sum(r["whitened"] ** 2 for r in big) / 5 - 1) < 1e-9


# --- 12

def brute_collocations(rows, least, top):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for sep in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(sep, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, c in counts.items():
        candidates = {p: f for p, f in c.items() if f >= least and len(p) > 1}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * f >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, f in candidates.items()):
                continue
            score, k = min((int(Fraction(1000 * a * total[lang], c[p[:k]] * c[p[k:]])), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 3000)
    monkeypatch.setattr(collocations, "EACH", 2000)


def test_collocations_like_brute_force(spark, small):
    rng = random.Random(8)
    words = [*"the of a to and In on".split(), *(f"w{i}" for i in range(30)), "é", "z\x01"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randrange(40)))
        rows.append((i, text + (" new york city hall annex x" if i % 3 else ""), rng.choice(["en", "de", None])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    cols = "lang rank phrase a l r n score".split()
    got = sorted(tuple(r[c] for c in cols) for r in collocations.collocations(docs, least=4, top=50).collect())
    assert got == brute_collocations([(r[1], r[2]) for r in rows], 4, 50)
    assert len(got) > 60


def test_packed_windows_come_back():
    rng = np.random.default_rng(5)
    words = sorted({f"w{i}".encode() for i in range(70_000)})
    cols = [rng.integers(0, 2, 90_000), *rng.integers(0, len(words) + 1, (5, 90_000))]
    cols, count = collocations.sort_sum([*cols[:1], *cols[1:]], np.ones(90_000, np.int64))
    lang, back, n, known, langs = collocations.unpacked(collocations.packed(cols, count, words, [b"de", b"en"]))
    full = np.array([b"", *known], object)
    assert (full[back] == np.array([b"", *words], object)[np.array(cols[1:])]).all() and (n == count).all() and (lang == cols[0]).all() and langs == [b"de", b"en"]


def test_scores_pass_64_bits():
    assert collocations.scored(10 ** 15, 10 ** 16, [10 ** 16, 10 ** 15, 10 ** 15], [0, 10 ** 15, 10 ** 15])[0] == 10 ** 4
    assert collocations.scored(100, 10 ** 6, [10 ** 6, 200, 100], [0, 100, 200])[1:] == (1, 200, 200)


def test_collocation_cases(spark, small):
    rows = [(1, "a b " * 50, "en"), (1, "a b " * 50, "en"), (None, "A\tB, c", None), (2, None, "en"), (3, "", None), (4, " \n.,", "en"), (5, "q " * 200_000, "und")]
    out = {(r["lang"], r["phrase"]): r for r in collocations.collocations(clash(spark.createDataFrame(rows, "doc_id long, text string, lang string")), least=3).collect()}
    assert ("en", "a b") in out and out["en", "a b"]["a"] == 100 and out["en", "a b"]["n"] == 200
    assert out["und", "q q"]["a"] == 199_999 and out["und", "q q"]["n"] == 200_003
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


# --- 13

def brute_join(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        if i is not None:
            sets[i] = {tuple(w[j:j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {i: (len(s), root(i)) for i, s in sets.items()}


def joined(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in heavy_light.join_components(docs).collect()}


def test_needed_and_subsets():
    for a in range(1, 60):
        for b in range(a, 60):
            c = heavy_light.needed(a, b)
            assert 100 * c >= 85 * (a + b - c) and 100 * (c - 1) < 85 * (a + b - c + 1)
            if c <= a:  # a link is possible: both enumerate the size, and the rare parts must meet
                assert c in heavy_light.subset_sizes(a, 60) and c in heavy_light.subset_sizes(b, 60)
                assert c > a - heavy_light.prefix(a) and c > b - heavy_light.prefix(b)
    assert heavy_light.boundary({5: 10, 9: 10, 30: 5}) >= 9 and heavy_light.boundary({20: 1000}) < 20


@pytest.mark.parametrize("most,short,block", [(None, 32, 4 << 20), (0, 32, 4 << 20), (None, 2, 3000), (20, 2, 2000)])
def test_join_like_brute_force(spark, monkeypatch, most, short, block):
    if most is not None:
        monkeypatch.setattr(heavy_light, "boundary", lambda sizes: most)
    monkeypatch.setattr(heavy_light, "SHORT", short)
    monkeypatch.setattr(heavy_light, "BLOCK_BYTES", block)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for size in [4, 6, 8, 9, 10, 12, 13, 15, 16, 17, 20, 24, 30, 45, 80, 120] * 2:
        base = [word() for _ in range(size + 3)]
        for k in range(8):
            copy = list(base)
            for _ in range(rng.randrange(3) if k else 0):
                at = rng.choice([0, len(copy) - 1, rng.randrange(len(copy))])
                if rng.random() < 0.5:
                    copy[at] = word()
                else:
                    copy[at:at] = [word()]
            rows.append((len(rows), " ".join(copy)))
    centre = [word() for _ in range(150)]
    for k in range(40):  # linked with the centre, mostly not with one another; the centre has a high number
        rows.append((len(rows), " ".join(centre + [f"tail{k}_{j}" for j in range(20)])))
    rows.append((len(rows), " ".join(centre)))
    common = [word() for _ in range(30)]
    for k in range(40):  # a shared passage links nothing
        rows.append((len(rows), " ".join([word() for _ in range(60)] + common)))
    rng.shuffle(rows)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute_join(rows)


def test_join_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "A b C d e"), (2, "a B c D e"), (3, None), (4, ""), (5, " \n\t"), (6, "a b"), (7, "a b"), (8, "b a"), (2, "a B c D e"), (None, "a b"), (None, None), (9, long), (10, long)]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((tuple(r) for r in heavy_light.join_components(docs).collect()), key=str)
    want = {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (977, 9), 10: (977, 9), None: (1, None)}
    assert got == sorted([*((i, *v) for i, v in want.items()), (2, 2, 1), (None, 0, None)], key=str)
    assert heavy_light.join_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op12_collocations", "op13_heavy_light"])
def test_against_sql(spark, sf_dir, name):
    registry.load()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    status, _, _, info = compare(spark, con, name, sf_dir)
    assert status == "OK", info
