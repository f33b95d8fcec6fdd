"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausewise.llm.common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.language_id import language_of

    return language_of(documents(spark, sf_dir))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.matroska import media_digest

    return media_digest(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from clausewise.llm.byte_bpe import encode_and_decode

    return encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.fingerprints import edited_likeness

    return edited_likeness(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.mixing import mixed_words

    return mixed_words(documents(spark, sf_dir))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.ngram_join import join

    return join(documents(spark, sf_dir), k=3, percent=90)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from clausewise.llm.packing import packed

    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from clausewise.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.sanitise import digest

    return digest(documents(spark, sf_dir))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.suffix_tree import scored

    return scored(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.collocations import collocations

    return collocations(documents(spark, sf_dir))


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.burst_trie import nodes

    return nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_matroska": op2_matroska,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_lz_fingerprint": op4_lz_fingerprint,
    "op5_mixing": op5_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_suffix_tree": op10_suffix_tree,
    "op11_collocations": op11_collocations,
    "op12_burst_trie": op12_burst_trie,
    "op13_toxicity": op13_toxicity,
}
#: The n-gram join by all pairs that share a shingle, collocations by all n-grams, the trie by all prefixes; the others' whole results have no SQL form and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op11_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p) WHERE len(w) > 0),
o AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, phrase, m, count(*) AS f FROM o GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, m, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM k JOIN (SELECT lang, phrase, f FROM f) x ON x.lang = k.lang AND x.phrase = k.x JOIN (SELECT lang, phrase, f FROM f) y ON y.lang = k.lang AND y.phrase = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, m, n, unnest(range(1, m - n + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS n) WHERE n < m) GROUP BY ALL),
g AS (SELECT b.lang, b.phrase, a, l, r, score FROM b LEFT JOIN i USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM g JOIN t USING (lang) QUALIFY rank <= 2000""",
    "op12_burst_trie": r"""
WITH RECURSIVE b AS (SELECT n, n AS c, 0 AS k FROM range(256) r(n) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8),
bytes AS (SELECT list(c ORDER BY n) AS tab FROM b WHERE k = 8),
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 4294967295::BIGINT AS c, 1 AS i FROM ids UNION ALL SELECT conv_id, s, xor(c >> 8, tab[CAST((xor(c, ascii(s[i])) & 255) + 1 AS INT)]), i + 1 FROM crc, bytes WHERE i <= length(s)),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(c, 4294967295) % 6 AS h FROM crc WHERE i = length(s) + 1),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT h.conv_id, 0 AS part, place, role, text FROM h JOIN t ON t.conv_id = base AND place < h UNION ALL SELECT conv_id, 1, place, role, text FROM h JOIN t USING (conv_id) WHERE place >= h),
d AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, md5(string_agg(md5(length(role) || ':' || role || ':' || md5(text)), '') OVER w) AS k FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
p AS (SELECT conv_id, depth, k, chars FROM d UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY ALL),
u AS (SELECT n.k, q.k AS up FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
c AS (SELECT up AS k, count(*) AS n_children FROM u GROUP BY 1),
a AS (SELECT q.k, sum(CASE WHEN c.k IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens FROM n LEFT JOIN c ON c.k = n.k JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY 1),
e AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT * FROM p QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY 1)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n LEFT JOIN u ON u.k = n.k LEFT JOIN n m ON m.k = u.up LEFT JOIN c ON c.k = n.k JOIN a ON a.k = n.k LEFT JOIN e ON e.k = n.k""",
}
