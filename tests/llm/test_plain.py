"""Operators against plain versions, and the cases that their docstrings define."""

import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("foliant.llm")

from foliant.llm import bitpack, decontaminate, gam, html, neardup, pieces, rules, sharding, toxicity  # noqa: E402
from foliant.tables import Scratch  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.01"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


# --- pieces


@pytest.fixture(scope="module")
def lat():
    return pieces.PieceLattice(public_tokenizers.path("piece_bpe_32k.model"))


def every_segmentation(lat, unit):
    normal = {p.decode().replace(" ", pieces.BLANK): i for i, p in enumerate(lat.pieces) if i in lat.scores}

    def rest(at):
        if at == len(unit):
            yield 0.0, ()
            return
        for end in range(at + 1, min(len(unit), at + lat.longest) + 1):
            if (i := normal.get(unit[at:end])) is not None:
                for s, ids in rest(end):
                    yield lat.scores[i] + s, (i, *ids)
        if unit[at] not in normal:
            own = lat._spell(unit[at])
            for s, ids in rest(at + 1):
                yield lat.byte_score * len(own) + s, (*own, *ids)

    return sorted(rest(0), key=lambda x: -x[0])


def test_n_best_equals_full_enumeration(lat):
    rng = random.Random(5)
    for _ in range(60):
        unit = pieces.BLANK + "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 7)))
        want = every_segmentation(lat, unit)
        for n in (1, 3, 8):
            got = lat.search(unit, n)
            assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]]) and len({ids for _, ids in got}) == len(got) == min(n, len(want))
            assert {ids for _, ids in got} <= {ids for _, ids in want}


def test_long_unbroken_text_and_ties(lat):
    began = time.process_time()
    (found,) = lat.encode_batch(["x" * 20_000], 3)
    assert time.process_time() - began < 8
    assert [lat.decode(ids) for _, ids in found] == ["x" * 20_000] * 3 and len({ids.tobytes() for _, ids in found}) == 3


# --- quality rules


def plain_estimate(x, share, steps):
    """Centre and covariance by the same steps over whole arrays."""
    floors = np.array(list(rules.FLOORS.values()))
    cells = np.floor(x * rules.FINE / floors)

    def at(values, part):
        v = np.sort(values)
        return v[math.ceil(part * len(v)) - 1]

    med = np.array([at(c, 0.5) for c in cells.T])
    mad = np.array([at(np.abs(c - m), 0.5) for c, m in zip(cells.T, med, strict=True)])
    centre, spread = (med + 0.5) * floors / rules.FINE, np.maximum(1.4826 * (mad + 0.5) * floors / rules.FINE, floors)
    best = None
    for names in (rules.X, ["x_word", "x_symbol"]):
        m, p = centre, np.diag([1 / s**2 if a in names else 0.0 for a, s in zip(rules.X, spread, strict=True)])
        for _ in range(steps):
            d = np.maximum(np.einsum("ni,ij,nj->n", x - m, p, x - m), 0)
            bins = np.floor(np.log2(d + 1e-9) * rules.OCTAVE)
            kept = x[bins <= at(bins, share)]
            m = kept.mean(0)
            cov = np.cov(kept.T, bias=True) * rules.consistency(share) + np.diag(floors**2)
            p = np.linalg.inv(cov)
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-9:
            best = (det, m, p)
    return best[1], best[2]


def test_robust_estimates_equal_plain(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal([5, 1.6, 0.3, 0.02, 0.01], [0.8, 0.05, 0.4, 0.02, 0.03], (400, 5)), rng.normal([5, 2, 5, 0.3, 0.2], 0.2, (60, 5))])
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "_g string, " + ", ".join(f"{a} double" for a in rules.X))
    got = rules.robust_estimates(df, Scratch(spark, "t"), 1).first()
    m, p = plain_estimate(x, 0.75, 3)
    assert np.allclose([got[f"m_{i}"] for i in range(5)], m, atol=1e-6)
    assert np.allclose([got[f"p_{i}_{j}"] for i, j in rules.LOWER], [p[i, j] * (1 if i == j else 2) for i, j in rules.LOWER], rtol=1e-5, atol=1e-5)


def test_each_statistic_rejects_alone_and_symbols_are_counted(spark):
    sound = [(i, "\n".join(prose(100 * i + k, 12) for k in range(12)), "en", "s") for i in range(260)]
    line = prose("line", 12)
    lines = "\n".join([line] * 30 + [prose(f"w{k}", 12) for k in range(4)])
    odd = [(1000, " ".join([prose("twice", 35)] * 2 + [prose("rest", 75)]), "en", "s"), (1001, "\n".join(f"{a}\n \n{a}x" for a in prose("u", 40).split()) + "\n" + "\n".join(["-"] * 130), "en", "s"), (1002, "#a $b <c> " * 5, None, None), (1003, lines, "en", "s")]
    got = {r.doc_id: r for r in rules.quality_rules(table(spark, sound + odd)).collect()}
    assert all(got[i].kept for i in range(260))
    assert not got[1000].base_failed and not got[1000].kept and not got[1001].kept
    assert got[1002].n_symbols == 20 and got[1002].base_failed and got[1003].base_failed
    assert abs(rules.chi2_share(rules.chi2_quantile(0.95, 5), 5) - 0.95) < 1e-9 and abs(rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


# --- shards


def test_groups_that_fit_stay_whole(spark):
    rows = [(i, "same text" if i < 40 else f"own {i}", "en", "s") for i in range(1000)] + [(None, None, None, None), (7, "é", "en", "s")]
    out = sharding.shard_documents(table(spark, rows))
    got = out.collect()
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"same text")}) == 1
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    edges = sharding.cut_edges(out).first()
    assert (edges.edges, edges["cut"]) == (780, 0)


# --- packed ids


def test_rows_without_an_id_come_first(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(5, "b", "en", "s"), (None, "a a", "en", "s"), (None, None, "en", "s"), (2, "", "en", "s")]
    got = sorted(bitpack.packed_tokens(table(spark, rows), path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 2, 5] and got[0].n_tokens == 1 and got[0].start == 0
    assert bitpack.packed_tokens(table(spark, rows).limit(0), path).count() == 0


# --- decontamination


def test_other_columns_may_have_any_name(spark):
    docs = table(spark, [(1, prose(1, 30), "en", "s"), (None, None, "en", "s")])
    odd = docs.withColumnsRenamed({"lang": "_hit", "source": "_items", "n_chars": "key"})
    bench = spark.createDataFrame([("i", prose(1, 30)), ("j", "zz zz"), ("k", prose(2, 60))], "item_id string, text string")
    for block in (10**6, 20):
        rows = sorted(decontaminate.decontaminate(odd, bench, block_words=block).collect(), key=lambda r: r.doc_id or 0)
        assert rows[1].asDict().keys() == {"doc_id", "text", "_hit", "_items", "key", "decontamination"} and rows[1]["_hit"] == "en"
        assert (rows[1].decontamination.n_hit, rows[1].decontamination.n_items, rows[1].decontamination.clean.strip()) == (30, 1, "")
        assert rows[0].decontamination.n_words == 0 and not rows[0].decontamination.contaminated


# --- near-duplicates


def test_repeated_and_missing_ids(spark):
    a, b = prose("a", 60), prose("b", 60)
    rows = [(9, a, "", ""), (3, a, "", ""), (9, b, "", ""), (8, b + " x", "", ""), (None, a, "", ""), (4, "", "", ""), (1, prose("c", 9), "", "")]
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([(9, 3, False), (3, 3, True), (9, 3, False), (8, 3, False), (0, None, True), (4, 4, True), (1, 1, True)], key=str)


def test_signature_join_finds_pairs_at_the_threshold():
    """Pairs at a similarity of 0.8 that share no bucket: none of 4,000 (expected share 4e-5)."""
    rng = np.random.default_rng(8)
    missed = 0
    for _ in range(4000):
        s = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        pair = np.stack([neardup.signature(s[:81]), neardup.signature(s[9:])])
        k = neardup.chunk_keys(pair)
        missed += not set(k[0]) & set(k[1])
    assert missed <= 2
    for n in range(1, 60):
        assert neardup.prefix_length(n, 80, 100) == n - math.ceil(n * 4 / 5) + 1
    s = np.sort(rng.integers(0, 1 << 48, 50, dtype=np.uint64))
    assert (neardup.unpack_set(neardup.pack_set(s)) == s.view(np.int64)).all()


# --- classifiers


def test_pooled_rows_equal_direct_convolution():
    rng = np.random.default_rng(2)
    net = toxicity.Cnn(rng.normal(size=(toxicity.PARTS, toxicity.SLOTS, 4)).astype(np.float32), {w: rng.normal(size=(w, 4, 3)).astype(np.float32) for w in (1, 2, 3)}, {w: rng.normal(size=3) for w in (1, 2, 3)}, rng.normal(size=9), 0.1)
    texts = [toxicity.word_slots(t.encode()) for t in ("", "one", prose(1, 5), prose(2, 70))]
    for slots, got in zip(texts, toxicity.cnn_scores(net, texts), strict=True):
        words = [net.embedding[range(toxicity.PARTS), s].sum(0) for s in slots] + [np.zeros(4)] * max(0, 3 - len(slots))
        pools = [max([0.0, *(sum(words[i + o] @ net.filters[w][o] for o in range(w))[m] + net.bias[w][m] for i in range(len(words) - w + 1))]) for w in (1, 2, 3) for m in range(3)]
        assert math.isclose(got, 1 / (1 + math.exp(-(np.dot(pools, net.out) + net.out_bias))), rel_tol=1e-4)


def test_additive_scores_are_sums_of_looked_up_bins():
    rng = np.random.default_rng(4)
    x = rng.random((800, 4)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    model = gam.fit_gam(x, y, rounds=15)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        at = [sum(row[j] >= e for e in edges) for j, edges in enumerate(model.edges)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, at, strict=True))
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[at[i] * model.pair_bins // (len(model.edges[i]) + 1), at[j] * model.pair_bins // (len(model.edges[j]) + 1)]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_classifiers_hold_on_unseen_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    for scores, label, least in ((gam.quality_scores, "quality", 0.95), (toxicity.toxicity_scores, "toxic", 0.85)):
        rows = scores(docs, labels).where("held_out").join(labels, "doc_id").select("score", label).collect()
        good, bad = ([r.score for r in rows if r[label] == v] for v in (1, 0))
        assert good and bad and np.mean([g > b for g, b in itertools.product(good, bad)]) >= least


# --- main text

PLAIN = (
    "<html><body><div><ul><li><a href=/a>Home page</a></li><li><a href=/b>All news</a></li></ul></div><div><h1>A title</h1>"
    + "".join(f"<p>{prose(k, 40)}.</p>" for k in range(4))
    + "<p>Short one.</p><ul><li>First point</li><li>Second point</li></ul>"
    + f"<p>{prose(9, 50)}.</p></div><div><a href=/x>Terms</a> | <a href=/y>Privacy</a></div></body></html>"
)


def test_density_decides_without_an_article(monkeypatch):
    want = " ".join(["A title", *[prose(k, 40) + "." for k in range(4)], "Short one.", "First point", "Second point", prose(9, 50) + "."])
    assert html.main_text(PLAIN) == want
    monkeypatch.setattr(html, "smoothed", lambda r, sigma=1: np.ones(len(r)))
    assert html.main_text(PLAIN) != want


def test_smoothing_equals_plain():
    r = np.random.default_rng(0).random(30) * 100
    weights = {k: math.exp(-0.5 * k * k) for k in range(-3, 4)}
    want = [sum(w * r[min(max(i + k, 0), 29)] for k, w in weights.items()) / sum(weights.values()) for i in range(30)]
    assert np.allclose(html.smoothed(r), want)


def test_layout_words_and_nesting():
    page = f"<body><div class='page has-sidebar'><div class='sidebar'>Other things</div><h1>On top</h1><p>{prose(1, 60)}</p></div></body>"
    assert html.main_text(page) == f"On top {prose(1, 60)}"
    began = time.process_time()
    for deep in ("<div>x" * 50_000, "<p><td>" + "<i>" * 50_000 + "<ul>" * 50_000, "<article><div>" * 20_000):
        html.main_text(deep)
    assert time.process_time() - began < 30


def test_equal_items_cost_as_one():
    """Thousands of equal short items take the time of one, and all of them are named."""
    import time

    from foliant.llm.decontaminate import Automaton

    words = [b"a", b"b"] * 1500
    took = {}
    for n in (1, 9000):
        automaton = Automaton([(str(k), [b"a", b"b"]) for k in range(n)] + [(f"long{k}", [b"a", b"b"] * 8) for k in range(n)])
        began = time.perf_counter()
        hit, names = automaton.scan(words)
        took[n] = time.perf_counter() - began
        assert hit.all() and names == {str(k) for k in range(n)} | {f"long{k}" for k in range(n)}
    assert took[9000] < 5 * took[1] + 0.2


def test_whole_texts_have_the_n_best_of_all_segmentations(lat):
    """Of texts of several units, ids and scores of the n best equal those of every segmentation."""
    texts = ["ab cd", "a\nbc", "to be", "é x", "  two", "in on", "▁a b", "a"]
    for n in (1, 2, 3, 6):
        for text, found in zip(texts, lat.encode_batch(texts, n), strict=True):
            each = [every_segmentation(lat, u) for u in lat.units(text)]
            whole = sorted((sum(s for s, _ in parts) for parts in itertools.product(*each)), reverse=True)[:n]
            assert np.allclose([s for s, _ in found], whole, atol=1e-6)
            every = {tuple(i for _, ids in parts for i in ids) for parts in itertools.product(*each)}
            own = [tuple(ids.tolist()) for _, ids in found]
            assert len(set(own)) == len(own) and set(own) <= every
            assert lat.decode(own[0]) == text
