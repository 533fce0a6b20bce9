"""Every operator against a plain version, and on odd tables."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from foliant.llm import bitpack, decontaminate, gam, html, katz, neardup, pieces, rules, sharding, toxicity  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "s"), (2, "", None, None), (3, " \n\t", "en", "s"), (4, "one", "en", None), (5, "é ü\n\nx  y", "fr", "s"), (5, "é ü\n\nx  y", "fr", "s"), (None, "no id here", "en", "s"), (9, "word " * 3000, "en", "s")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = list(ODD)
    for i in range(20, 60):
        base = prose(i % 8, 120).split()
        for _ in range(rng.choice((0, 1, 2, 6))):
            base[rng.randrange(len(base))] = prose(rng.random(), 1)
        rows.append((i, " ".join(base) + (" idiot " * (i % 5 == 0)), rng.choice(("en", "de")), f"s{i % 2}"))
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(20, 60)] + [(None, 1, 1), (21, None, None), (22, 0, 1), (22, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_sharding_balances_and_gathers(spark, docs):
    got = sharding.shard_documents(docs, shards=4).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes[s] for s in range(4)) <= 1 and len(got) == docs.count()
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    many = spark.createDataFrame([(i, f"t{i % 50}" if i < 200 else f"u{i}") for i in range(1000)], "doc_id long, text string")
    groups = collections.defaultdict(set)
    for r in sharding.shard_documents(many, shards=4).collect():
        groups[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_flows_conserve_rows():
    rng = random.Random(2)
    for _ in range(50):
        wishes = {(i, j): rng.randint(0, 9) for i in range(4) for j in (-2, -1, 0, 1, 2, 3) if i != j}
        net = collections.Counter()
        for s, want, lo, hi, to in sharding.flows(wishes, 4):
            assert 0 <= lo < hi <= wishes[s, want]
            net[s] -= hi - lo
            net[to] += hi - lo
        assert not any(net.values())


def test_rules_count_like_plain(docs, texts):
    got = collections.defaultdict(list)
    for r in rules.quality_rules(docs, min_group=5).collect():
        got[r.doc_id].append(r)
    for d, t in texts:
        w = t.split()
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip()]
        r = got[d][0]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.quality_rules(docs.limit(0)).count() == 0


def test_robust_estimate_finds_planted_outliers(spark):
    rng = np.random.default_rng(0)
    rows = [(i, prose(i, int(rng.integers(80, 200))), "en", "s", 0) for i in range(300)] + [(1000 + i, prose(i, 90).replace(" ", "### "), "en", "s", 0) for i in range(20)]
    kept = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(kept[1000 + i] for i in range(20)) and sum(kept[i] for i in range(300)) >= 297


def test_decontamination_equals_plain_windows(spark, docs, texts):
    src = dict(t for t in texts if t[0])
    items = [("a", " ".join(src[20].split()[5:40])), ("b", "ONE"), ("c", None), ("d", " ".join(src[21].split()[:13])), ("d2", "abc-" + src[22][:80]), ("e", "zz yy")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = collections.defaultdict(set)
    for k, t in items:
        w = decontaminate.item_words((t or "").encode())
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(k)
    for block in (10**6, 5):  # one automaton, and one an item
        out = decontaminate.decontaminate(docs.withColumnRenamed("source", "decontamination"), bench, block_words=block).collect()
        assert len(out) == len(texts)
        for r in out:
            w, hit, found = decontaminate.item_words((r.text or "").encode()), set(), set()
            for n in {len(k) for k in windows}:
                for i in range(len(w) - n + 1):
                    if s := windows.get(tuple(w[i : i + n])):
                        found |= s
                        hit |= set(range(i, i + n))
            d = r.decontamination
            assert (d.n_words, d.n_hit, d.n_items, d.contaminated) == (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
            if hit:
                assert len(decontaminate.item_words(d.clean.encode())) == len(w) - len(hit)


def test_near_duplicates_equal_plain(docs, texts):
    sets = collections.defaultdict(set)
    for d, t in texts:
        w = t.lower().split()
        sets[d] |= {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    ids = sorted(k for k in sets if k is not None)
    root = {k: k for k in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    for r in neardup.near_duplicates(docs).collect():
        if r.doc_id is not None:
            assert (r.component_id, r.n_shingles, r.kept) == (root[r.doc_id], len(sets[r.doc_id]), r.doc_id == root[r.doc_id])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(1)
    most = neardup.CHUNKS * (neardup.ERRORS + 1) - 1
    for _ in range(300):
        a = rng.integers(0, 1 << 16, neardup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rng.permutation(neardup.SYMBOLS)[:most]] ^= 1
        k = neardup.chunk_keys(np.stack([a, b]))
        assert set(k[0]) & set(k[1])


def test_katz_equals_plain_and_sums_to_one(docs, texts):
    out = katz.katz_scores(docs).collect()
    rows = [(d, t.lower().split() + ["</s>"]) for d, t in texts]
    train = [w for d, w in rows if d is None or zlib.crc32(str(d).encode()) % 10]
    uni = collections.Counter(x for w in train for x in w)
    bi = collections.Counter(p for w in train for p in zip(["<s>", *w[:-1]], w, strict=True))
    hist = collections.Counter()
    for (h, _), c in bi.items():
        hist[h] += c
    few = lambda c: np.array([0] + [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)], float)
    du, db = katz.discounts(few(uni)), katz.discounts(few(bi))
    cut = lambda c, d: float(katz.discounted(np.array([c]), d)[0])
    n = sum(uni.values())
    p1 = {w: cut(c, du) / n for w, c in uni.items()}
    unknown = 1 - sum(p1.values())
    left, mass = collections.Counter(), collections.Counter()
    for (h, w), c in bi.items():
        left[h] += c - cut(c, db)
        mass[h] += p1[w]

    def p(h, w):
        if (h, w) in bi:
            return cut(bi[h, w], db) / hist[h]
        return p1.get(w, unknown) * (left[h] / hist[h] / (1 - mass[h]) if h in hist else 1)

    for h in list(hist)[:5]:
        assert math.isclose(sum(p(h, w) for w in [*uni, "never met"]), 1, rel_tol=1e-9)
    want = collections.defaultdict(list)
    for d, w in rows:
        want[d].append((len(w), sum(x in uni for x in w), sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (len(uni) + 1))) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True))))
    assert len(out) == len(rows)
    for r in out:
        k = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (k[0], k[1], n)
        assert math.isclose(r.base_score, k[2], rel_tol=1e-9) and math.isclose(r.score, k[3], rel_tol=1e-12)
    assert katz.katz_scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 13, 16, 17, 20, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(ids, bits), len(ids), bits) == ids).all()
    s = bitpack.Segment(bitpack.write_segment([3, 4], [1, 10_000], ids, bits))
    assert (s.range(4000, 9000) == ids[4000:9000]).all() and [len(x) for _, x in s.documents()] == [1, 10_000]


def test_token_table(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    own = docs.where("doc_id is not null")
    at = 0
    want = sorted((d, t) for d, t in texts if d is not None)
    for r, (d, t) in zip(sorted(bitpack.packed_tokens(own, path).collect(), key=lambda r: (r.doc_id, r.start)), want, strict=True):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pieces_round_trip_and_order(docs):
    model = public_tokenizers.path("piece_bpe_32k.model")
    lat = pieces.PieceLattice(model)
    for t in ("", " ", "▁x ▁", "a\n\n b\t", "日本😀", "héllo wörld"):
        found = lat.encode_batch([t], 4)[0]
        scores = [s for s, _ in found]
        assert scores == sorted(scores, reverse=True) and len({i.tobytes() for _, i in found}) == len(found)
        assert all(lat.decode(i) == t for _, i in found)
        assert all(math.isclose(s, sum(lat.scores.get(x, lat.byte_score) for x in i.tolist()), abs_tol=1e-6) for s, i in found)
    assert all(r.pieces.exact for r in pieces.encode_pieces(docs, model).collect())


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit_gam(x[:3000], y[:3000])
    assert {0, 1} in [set(p) for p in model.pairs] and ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    assert 0 < gam.fit_gam(x[:0], y[:0]).score(x[:1])[0] < 1


def test_classifiers_on_odd_tables(docs, labels):
    for f in (gam.quality_scores, toxicity.toxicity_scores):
        for lab in (labels, labels.limit(0)):
            out = f(docs, lab).collect()
            assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)


def test_convolution_finds_rare_words():
    rng = random.Random(0)
    make = lambda bad: toxicity.word_slots((prose(rng.random(), 150) + (" you idiot" if bad else "") + " " + prose(rng.random(), 50)).encode())
    y = np.array([i % 2 for i in range(400)], float)
    x = [make(v) for v in y]
    net = toxicity.fit_cnn(x[:300], y[:300])
    assert ((toxicity.cnn_scores(net, x[300:]) >= 0.5) == y[300:]).mean() > 0.97


def test_main_text():
    page = (
        "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class='ad banner'>Buy</div><article><h1>On &amp; off</h1><p><b>First  para&nbsp;one<br>goes on."
        "<p>Short.</p><form>name</form><div id=comments><p>Nice!</p></div></article><aside>More</aside><footer>&copy; me</footer>"
    )
    assert html.main_text(page) == "On & off First para one goes on. Short."
    assert html.main_text("") == "" and html.main_text("<![x<p>y") == "y"
