"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embdup, html, langid, neardup, packing, phrases, sharding, substring, suffix, tokens, toxicity, variants
from tessera.shared import save

from .common import crc_mod, read


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = decontam.find_contamination(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.link_near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held_out))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = tokens.count_tokens(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    pieces = save(packing.cut_pieces(docs, tokenizer_file("byte_bpe_50k.json")))
    return packing.pack_pieces(pieces)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(read(spark, sf_dir, "documents", "doc_id", "text"), drop_every=199)
    return variants.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(read(spark, sf_dir, "documents", "lang", "text"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_passages(read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_decontaminate": op2_decontaminate,
    "op3_shards": op3_shards,
    "op4_language": op4_language,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_near_vectors": op6_near_vectors,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_pack": op9_pack,
    "op10_main_text": op10_main_text,
    "op11_variants": op11_variants,
    "op12_phrases": op12_phrases,
    "op13_passages": op13_passages,
}

ORACLES = {
    "op2_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
bg AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
dg AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN bg ON dg.gram = bg.gram AND dg.n = bg.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    # crc32 bit by bit over the bytes of '<doc_id>:<run>'; forms are followed by a recursive join
    "op11_variants": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS c, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
bits AS (
  SELECT run, c, list_concat([4294967295::BIGINT], flatten(list_transform(generate_series(1, len(x) // 2),
    lambda i: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: (((strpos('0123456789ABCDEF', x[2*i-1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2*i]) - 1) >> k) & 1)))) AS b FROM per),
crc AS (SELECT run, c, xor(list_reduce(b, lambda s, v: xor(s >> 1, (xor(s, v) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT) AS h FROM bits),
dropped AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM crc),
words AS (SELECT word, sum(c)::BIGINT AS n FROM dropped WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
less AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS d FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.d = b.d WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.d = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS f, max(m) AS fn FROM pairs GROUP BY 1),
known AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN fn >= 5 * n THEN f END AS form, CASE WHEN fn >= 5 * n THEN fn END AS form_n FROM words LEFT JOIN best USING (word)),
roots AS (SELECT word, form AS at FROM known UNION ALL SELECT r.word, k.form FROM roots r JOIN known k ON r.at = k.word),
last AS (SELECT r.word, r.at AS root FROM roots r JOIN known k ON r.at = k.word WHERE k.form IS NULL)
SELECT known.word, form, coalesce(root, known.word) AS root, n, n_near, form_n FROM known LEFT JOIN last ON known.word = last.word
""",
    "op12_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k+1:], ' ') AS q FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
scored AS (SELECT x.lang, x.m, x.phrase, x.a, k, l.f AS l, r.f AS r, (2000000 * x.a) // (l.f + r.f) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.p AND l.m = x.k JOIN f r ON r.lang = x.lang AND r.phrase = x.q AND r.m = x.m - x.k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM (SELECT lang, a, w, n, unnest(generate_series(1, m - n + 1)) AS i FROM c, (SELECT unnest([2, 3]) AS n) WHERE n < m)),
cover AS (SELECT lang, phrase, max(a) AS cover FROM inner_ GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN cover USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < 80 * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM kept JOIN sizes USING (lang)) WHERE rank <= 2000
""",
    "op13_passages": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i : i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM later),
gone AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY 1),
places AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM places ANTI JOIN covered USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    # bytes as pairs of hexadecimal digits
    "op1_repeats": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 100)) AS w FROM (SELECT doc_id, h, unnest(generate_series(1, len(h) // 2 - 49)) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM g) WHERE doc_id > first),
covered AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM later),
gone AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM covered) GROUP BY 1),
bytes AS (SELECT doc_id, p, substr(h, 2 * p - 1, 2) AS b FROM (SELECT doc_id, h, unnest(generate_series(1, len(h) // 2)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM gone))),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS k FROM bytes ANTI JOIN covered USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op5_near_duplicates": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ends.b FROM reach JOIN ends ON ends.a = reach.b)
SELECT a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id, min(b) = a AS kept FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
""",
    "op6_near_vectors": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT r.a AS vec_id, (SELECT count(*) FROM links WHERE links.a = r.a)::BIGINT AS n_links, min(b) AS component_id, min(b) = r.a AS kept FROM reach r GROUP BY r.a
""",
}
