"""The operators of this package over the whole synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.bitpack import packed_tokens
from foliant.llm.common import table
from foliant.llm.decontaminate import decontaminate
from foliant.llm.gam import quality_scores
from foliant.llm.html import extract_text
from foliant.llm.katz import katz_scores
from foliant.llm.leaks import find_secrets
from foliant.llm.neardup import near_duplicates
from foliant.llm.pieces import encode_pieces
from foliant.llm.resample import resample
from foliant.llm.rules import quality_rules
from foliant.llm.sharding import shard_documents
from foliant.llm.toxicity import toxicity_scores
from foliant.llm.whitening import whiten


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *[f"decontamination.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=(80, 100)).select("doc_id", "n_shingles", "component_id", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sentencepiece_nbest(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = encode_pieces(docs, model or vocabulary("piece_bpe_32k.model"), n=3)
    return found.select("doc_id", *[f"pieces.{c}" for c in ("n_pieces", "ids_crc32", "scores", "crcs", "exact")])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_token_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packed_tokens(table(spark, sf_dir, "documents"), tokenizer or vocabulary("byte_bpe_50k.json"), end_id=2)


def op10_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_html_extraction, op3_sharding, op4_decontamination, op5_minhash_neardup, op6_toxicity, op7_sentencepiece_nbest, op8_quality_rules, op9_token_packing, op10_katz_scoring, op11_secret_scans, op12_importance_resampling, op13_embedding_whitening)
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_BLANK_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Pattern by kind of span, and the group that holds the secret.
_SECRETS = {
    0: ("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2),
    1: ("AKIA[A-Z0-9]{16,}", 0), 2: ("[0-9a-f]{24,}", 0), 3: ("[A-Za-z0-9+/_.=-]{12,}", 0),
}
_FOUND = " UNION ALL ".join(
    f"SELECT r, {k} AS kind, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {g}) AS g, string_split_regex(text, '{p}') AS s FROM d" for k, (p, g) in _SECRETS.items()
)
#: crc32 of distinct words, byte by byte over a table made by its rule.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_BYTES = "list_transform(range(len(hex(encode(w))) // 2), lambda i: (instr('0123456789ABCDEF', hex(encode(w))[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', hex(encode(w))[2 * i + 2]) - 1)"
ORACLES: dict[str, str] = {
    "op11_secret_scans": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('s' || source, 'n') AS owner, coalesce('s' || source, 'n') || chr(1) || coalesce('s' || lang, 'n') AS repo FROM documents),
        f AS ({_FOUND}),
        one AS (SELECT r, kind, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM f),
        spot AS (SELECT r, kind, g[i] AS secret, m[i] AS whole, list_sum(list_transform(s[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS a FROM one),
        base AS (SELECT r, kind, a::BIGINT AS a, (a + len(whole))::BIGINT AS z, secret FROM spot WHERE kind < 3 AND (kind > 0 OR len(secret) >= 6)),
        trimmed AS (SELECT r, a, rtrim(whole, '+/_.=-') AS w, whole FROM spot WHERE kind = 3),
        cut AS (SELECT r, (a + len(w) - len(regexp_extract(ltrim(w, '+/_.=-'), '[^=]*$')))::BIGINT AS a, (a + len(w))::BIGINT AS z, regexp_extract(ltrim(w, '+/_.=-'), '[^=]*$') AS v
            FROM trimmed t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = t.r AND b.a < t.a + len(t.whole) AND b.z > t.a)),
        c AS (SELECT r, kind, a, z, regexp_extract(trim(secret, '+/_.=-'), '[^=]*$') AS v FROM base UNION ALL SELECT r, 3, a, z, v FROM cut WHERE len(v) >= 12),
        looked AS (SELECT *, len(list_distinct(string_split(v, ''))) >= 8 AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(lower(v), 'example|sample|dummy|changeme|placeholder|your|test|xxxx|1234|abcd') AS rnd,
            len(v) >= 20 AND len(list_distinct(string_split(v, ''))) >= 12 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AS long_one FROM c),
        kept AS (SELECT * FROM looked WHERE kind < 3 OR rnd),
        k AS (SELECT v, count(DISTINCT owner) >= 5 AS copied, bool_or(kind < 3) AS known, bool_or(rnd) AS rnd_any FROM kept JOIN d USING (r) GROUP BY v),
        l AS (SELECT r, kind, a, z, copied, NOT copied AND rnd_any AS live FROM kept JOIN k USING (v) WHERE kind < 3 OR (NOT copied AND (known OR (long_one AND rnd)))),
        n AS (SELECT *, ['assign', 'access', 'hex', 'bare'][kind + 1] || ':' || a || ':' || z AS t FROM l),
        g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(t, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS b,
            string_agg(t, ',' ORDER BY a, kind) AS spans, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE copied) AS n_copied FROM n GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
        coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g USING (r)""",
    "op12_importance_resampling": f"""
        WITH tab AS (SELECT {_CRC_TABLE} AS t), d AS (SELECT row_number() OVER () AS r, doc_id, {_BENCH_WORDS} AS ws FROM documents), i AS (SELECT {_BENCH_WORDS} AS ws FROM benchmark),
        dw AS (SELECT r, unnest(ws) AS w FROM d), iw AS (SELECT unnest(ws) AS w FROM i), v AS (SELECT w, {_BYTES} AS bs FROM (SELECT w FROM dw UNION SELECT w FROM iw)),
        h AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bs, lambda x: x::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b FROM v, tab),
        s AS (SELECT b, count(*) AS s FROM dw JOIN h USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM iw JOIN h USING (w) GROUP BY b),
        tot AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM iw)::DOUBLE AS t_all),
        gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM (SELECT DISTINCT b FROM h) LEFT JOIN s USING (b) LEFT JOIN t USING (b), tot),
        wt AS (SELECT r, sum(g)::BIGINT AS weight FROM dw JOIN h USING (w) JOIN gain USING (b) GROUP BY r),
        noise AS (SELECT r, doc_id, len(ws) AS n_features, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda j: (instr('0123456789abcdef', sha256('2024:' || doc_id)[j]) - 1)::BIGINT)), lambda x, y: x * 16 + y) AS x FROM d),
        sc AS (SELECT r, doc_id, n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((x + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM noise LEFT JOIN wt USING (r)),
        o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= 20 AND score IS NOT NULL)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM o) * 10 // 100 THEN rank END AS rank FROM sc LEFT JOIN o USING (r)""",
    "op4_decontamination": f"""
        WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS ws FROM documents), i AS (SELECT item_id::VARCHAR AS item, {_BENCH_WORDS} AS ws FROM benchmark),
        sizes AS (SELECT DISTINCT least(13, len(ws)) AS n FROM i WHERE len(ws) > 0),
        iw AS (SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS k FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
        dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, sizes)),
        m AS (SELECT doc_id, p, dw.n, item FROM dw JOIN iw USING (n, k)),
        hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY 1),
        its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM m GROUP BY 1)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op5_minhash_neardup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_BLANK_WORDS} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + least(4, len(ws)) - 1], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_n >= 80 * (p.n + q.n - both_n)),
        r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, z.c AS component_id, d.doc_id = z.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(root) AS c FROM r GROUP BY 1) z ON z.id = d.doc_id""",
}
