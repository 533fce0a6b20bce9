"""Secret scans, importance resampling and whitening against plain versions, and on odd tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from foliant.llm import leaks, resample, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, owner string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 7, "own column") for r in rows], DOCS)


# --- secrets


def plain_secrets(rows, copied=5):
    """What find_secrets returns, one document after another."""
    keyword = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    patterns = [(re.compile(keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)]
    owners, named, rnd, found = collections.defaultdict(set), set(), set(), []
    for i, text, _, source in rows:
        text = text or ""
        base = sorted((m.start(), k, m.end(), m[g]) for k, (p, g, n) in enumerate(patterns) for m in p.finditer(text) if len(m[g]) >= n)
        bare = []
        for m in re.finditer("[A-Za-z0-9+/_.=-]+", text):
            v = m[0].strip("+/_.=-").split("=")[-1]
            if len(m[0]) >= 12 and len(v) >= 12 and leaks.looks_random(v) and not any(a < m.end() and z > m.start() for a, _, z, _ in base):
                z = m.start() + len(m[0].rstrip("+/_.=-"))
                bare.append((z - len(v), 3, z, v))
        spans = [(a, k, z, s.strip("+/_.=-").split("=")[-1]) for a, k, z, s in base + bare]
        for _, k, _, v in spans:
            owners[v].add(source)
            if k < 3:
                named.add(v)
            if leaks.looks_random(v):
                rnd.add(v)
        found.append((i, spans))
    out = []
    for i, spans in found:
        few = lambda v: len(owners[v]) < copied
        listed = sorted(s for s in spans if s[1] < 3 or (few(s[3]) and (s[3] in named or leaks.looks_evident(s[3]))))
        text = lambda ss: ",".join(f"{leaks.KINDS[k]}:{a}:{z}" for a, k, z, _ in ss)
        n = [sum(s[1] == k for s in listed) for k in range(3)]
        sha = hashlib.sha256(text([s for s in listed if s[1] < 3]).encode()).hexdigest()
        out.append((i, *n, sha, text(listed), sum(few(s[3]) and s[3] in rnd for s in listed), sum(not few(s[3]) for s in listed)))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


SECRET = "hQ7rT2mZx9LpW4vK1nB8"


def secret_rows():
    rng = random.Random(4)
    rows = [
        (1, f"password={SECRET} here", "en", "s1"), (2, f"pasted {SECRET}. twice {SECRET}", "en", "s1"), (3, "é" * 50 + f" Api_Key\" : '{SECRET}'", "fr", None),
        (4, None, "en", "s1"), (5, "", None, None), (6, "password=token=abcdef token: token: abcdef", "en", "s"), (6, "password=token=abcdef token: token: abcdef", "en", "s"),
        (None, "paſſword=notascii99 toKen=abc", "en", "s"), (8, "AKIAAKIA" + "Z" * 12 + " AKIA123 " + "0123456789abcdef" * 2 + "g", "en", "s"),
        (9, "x " * 50_000 + "secret=" + "ab12" * 5_000 + " tail", "en", "s"), (10, "token=AKIA" + "Q" * 20 + "deadbeef" * 4, "en", "s2"),
        (11, "evident Zx81kQpL0vWmN3tRb6Ys and url a/b/c=" + SECRET + "==", "en", "s3"),
    ]
    rows += [(20 + k, f"copied api_key = {'c0p1ed' * 3}XyZ and bare {'c0p1ed' * 3}XyZ", "en", f"o{k}") for k in range(7)]
    alphabet = "ab019=._-/+ AKIZ\n\"':passwordtokensecret"
    for k in range(40, 240):
        parts = [rng.choice((" ", "password", "=", ":", " ", "AKIA", "secret", "0a1b2c3d4e5f6a7b8c9d0e1f", SECRET[::-1], "'", "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))))) for _ in range(rng.randrange(12))]
        rows.append((k, "".join(parts), "en", f"s{k % 3}"))
    return rows


def test_secrets_equal_plain_version(spark):
    rows = secret_rows()
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied")
    got = sorted((tuple(r[n] for n in names) for r in leaks.find_secrets(frame(spark, rows).repartition(3)).collect()), key=key)
    assert got == sorted(plain_secrets(rows), key=key)
    by = {r[0]: r for r in got}
    assert "bare" in by[2][5] and by[2][6] == 2 and by[4][5] == "" and by[6][1] == 1 and by[8][2:4] == (1, 1)
    assert by[20][7] == 1 and "bare" not in by[20][5]
    assert leaks.find_secrets(frame(spark, [])).count() == 0


def test_ownership_counts_owners_and_repositories(spark):
    rows = [("a", "o1", "r1", True, True), ("a", "o1", "r1", False, True), ("a", "o1", "r2", False, True), ("a", None, "r3", False, True), ("b", "o1", "r1", False, False)]
    flat = spark.createDataFrame(rows, "value string, owner string, repository string, named boolean, random boolean")
    got = {r.value: (r.n_owners, r.n_repositories, r.n_places, r.named, r.copied, r.live) for r in leaks.ownership(flat, 2).collect()}
    assert got == {"a": (2, 3, 4, True, True, False), "b": (1, 1, 1, False, False, False)}


# --- resampling


def plain_resample(rows, target, most=1, modulus=10_000, min_words=20, percent=10, seed=2024):
    def runs(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % modulus
    s = collections.Counter(bucket(f) for _, t in rows for f in runs(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in runs(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        words, features = runs(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + modulus) / ((s[b] + 1) * (nt + modulus)))) for b in map(bucket, features))
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(features), weight, score, None, len(words) >= min_words and i is not None])
    pool = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(pool[: len(pool) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=key)


@pytest.mark.parametrize("most,percent", [(1, 10), (3, 37), (1, 100), (2, 0)])
def test_resampling_equals_plain_version(spark, most, percent):
    rng = random.Random(most)
    words = ["alpha", "Beta", "gämma", "δ", "x1", "the", "0", "zeta-eta", "O'Neil"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(-60, 240)]
    rows += [(500, None), (501, ""), (None, "no id " * 30), (502, "long " * 40_000), (503, "w" * 3_000), (504, "same " * 30), (504, "same " * 30), ((1 << 63) - 1, "beta " * 25), (-(1 << 63), "beta " * 25)]
    target = ["beta gämma the the", None, "", "x1 x1 beta"]
    docs = frame(spark, [(i, t, None, None) for i, t in rows]).repartition(3)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, bench, most=most, percent=percent).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got), key=key) == plain_resample(rows, target, most, percent=percent)


def test_resampling_of_odd_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(frame(spark, []), bench).count() == 0
    got = resample.resample(frame(spark, [(1, "a " * 30, None, None)] * 20), bench, percent=25).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0] * 15 + [1, 2, 3, 4, 5]


def test_kth_key_is_exact_over_all_longs(spark):
    rng = random.Random(9)
    rows = [(rng.choice((0, -5, 1 << 40, -(1 << 63), (1 << 63) - 1, rng.randrange(-9, 9))), rng.randrange(-(1 << 62), 1 << 62), k) for k in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(3).cache()
    for k in (1, 2, 57, 200, 399, 400):
        found = resample.kth_key(df, ["a", "b", "c"], k)
        assert found == sorted(rows)[k - 1] and df.where(resample.up_to(["a", "b", "c"], found)).count() == k


def test_pieces_keep_words_whole():
    text = b"ab cd-ef " * 100 + b"x" * 500 + b" end"
    for size in (1, 7, 64, 5000):
        parts = list(resample.pieces(text, size))
        assert b"".join(parts) == text
        assert [w for p in parts for w in resample.item_words(p)] == resample.item_words(text)


# --- whitening


def plain_whitening(vectors, k=16):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    k = min(k, len(sums))
    rows = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    return n, [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x], rows @ axes[:, ::-1][:, :k] / np.sqrt(values[::-1][:k]), values[::-1][:k] / values.sum()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, label int, x string, n int")


def test_whitening_equals_plain_version(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(300, 24)) * np.linspace(3, 0.2, 24) + rng.normal(size=24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(i, base[0].tolist()) for i in range(400, 500)] + [(None, base[1].tolist()), (7, base[2].tolist())]
    odd = [(600, None), (601, [None] * 24), (602, [float("nan")] * 24), (603, [float("inf")] + [0.0] * 23), (604, []), (605, [1.0])]
    got = whitening.whiten(vectors(spark, rows + odd).repartition(3)).collect()
    n, deviation, scores, explained = plain_whitening([v for _, v in rows])
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    by = collections.defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    signs = np.array([math.copysign(1, scores[0][k]) * math.copysign(1, next(r.whitened for r in by[0] if r.component == k + 1)) for k in range(16)])
    for (i, _), d, s in zip(rows, deviation, scores, strict=True):
        if i not in (None, 7):
            own = sorted(by[i], key=lambda r: r.component)
            assert [r.deviation for r in own] == [d] * 16
            assert np.allclose([r.whitened for r in own], s * signs, atol=1e-8)
            assert np.allclose([r.explained for r in own], explained, rtol=1e-10)
    assert max(r.identity_error for r in got) < 1e-9 and len(by[7]) == 32 and len(by[None]) == 16


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])])).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained) for r in one} == {(1, 0, None, None)}
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [4.0, 2.0])])).collect()
    assert sorted((r.component, r.whitened is None) for r in flat) == [(1, False)] * 3 + [(2, True)] * 3 and flat[0].identity_error < 1e-9
    wide = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 1.0])])).collect()
    assert len(wide) == 6 and {r.deviation for r in wide if r.vec_id < 3} == {None}


def test_deviations_are_exact_beyond_doubles():
    x = np.array([[10**12, 5], [-(10**12), 7], [3, 3]], np.int64)
    n, sums = 3, [3, 15]
    whole, left = np.array([1, 5]), np.array([0, 0])
    assert whitening.deviations(x, whole, left, n) == [s if (s := sum((n * int(a) - t) ** 2 for a, t in zip(r, sums, strict=True))) < 1 << 63 else None for r in x]
