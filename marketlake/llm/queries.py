"""The queries of the dealt operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import alignment, audit, bpe, exact, html, licenses, minhash, mixing, packing, pivots, quality, repeats, toxicity
from marketlake.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op6_exact_dedup", r"""
WITH bare AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t, length(coalesce(text, '')) AS n
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size
  FROM bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM ranked""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, sf_dir, "documents"))


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(ids, ranks)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_suffix_array_dedup")
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def held_out() -> Column:
    """The quarter of the documents whose labels are not learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, read(spark, sf_dir, "labels").filter(~held_out()))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op4_exact_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""")
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(pivots.scaled(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


_TEMPLATES = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(licenses.TEMPLATES))


@query("op1_license_scan", rf"""
WITH templates AS (SELECT * FROM (VALUES {_TEMPLATES}) t(template, license, statement)),
template_terms AS (
  SELECT template, license, term, count(*) AS times
  FROM (SELECT template, license, unnest(regexp_extract_all(lower(statement), '{licenses.TERM}')) AS term FROM templates) GROUP BY ALL),
files AS (
  SELECT doc_id, '/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents),
file_terms AS (SELECT doc_id, regexp_extract_all(lower(text), '{licenses.TERM}') AS terms FROM files),
total AS (SELECT count(*) AS n_texts FROM files),
frequencies AS (
  SELECT v.term, count(f.term) AS n FROM (SELECT DISTINCT term FROM template_terms) v
  LEFT JOIN (SELECT unnest(list_distinct(terms)) AS term FROM file_terms) f USING (term) GROUP BY v.term),
weights AS (SELECT term, ln((n_texts + 1.0) / (n + 1.0)) + 1 AS idf FROM frequencies, total),
template AS (SELECT template, license, term, times * idf AS w FROM template_terms JOIN weights USING (term)),
template_length AS (SELECT template, sqrt(sum(w * w)) AS their_length FROM template GROUP BY template),
units AS (
  SELECT DISTINCT doc_id, trim(unit) AS unit FROM (
    SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS unit FROM files
    UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM files)
  WHERE regexp_matches(lower(unit), '{licenses.SIGNAL}')),
unit_terms AS (
  SELECT unit, term, count(*) AS times
  FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '{licenses.TERM}')) AS term FROM (SELECT DISTINCT unit FROM units)) GROUP BY ALL),
own AS (SELECT unit, term, times, times * coalesce(idf, ln(n_texts + 1.0) + 1) AS x FROM unit_terms LEFT JOIN weights USING (term), total),
unit_length AS (SELECT unit, sqrt(sum(x * x)) AS length, sum(times) AS n_terms FROM own GROUP BY unit),
near AS (
  SELECT unit, template, license, n_terms, round(dot / (length * their_length), 6) AS similarity
  FROM (SELECT unit, template, license, sum(x * w) AS dot FROM own JOIN template USING (term) GROUP BY ALL)
  JOIN unit_length USING (unit) JOIN template_length USING (template)),
matched AS (
  SELECT unit, license, similarity, n_terms FROM near WHERE similarity >= {licenses.LEAST}
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY similarity DESC, template) = 1),
said AS (
  SELECT u.doc_id, license, similarity, n_terms / len(terms) AS share
  FROM units u JOIN matched USING (unit) JOIN file_terms t ON t.doc_id = u.doc_id
  QUALIFY row_number() OVER (PARTITION BY u.doc_id ORDER BY similarity DESC, license DESC) = 1),
found AS (
  SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, license, similarity, share FROM files f LEFT JOIN said USING (doc_id)),
of_dir AS (
  SELECT dir AS above, license, similarity FROM found WHERE license IS NOT NULL AND (share >= {licenses.SHARE} OR regexp_matches(path, '{licenses.NAMES}'))
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, path, license) = 1),
dirs AS (
  SELECT dir, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS above
  FROM (SELECT DISTINCT dir, string_split(dir, '/') AS parts FROM found)),
nearest AS (
  SELECT dir, above, license, similarity FROM dirs JOIN of_dir USING (above)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
SELECT f.path, coalesce(f.license, n.license) AS license, coalesce(f.similarity, n.similarity) AS similarity,
       CASE WHEN f.license IS NOT NULL THEN 'own' WHEN n.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS evidence,
       CASE WHEN f.license IS NULL THEN n.above END AS from_dir, f.doc_id
FROM found f LEFT JOIN nearest n USING (dir)""")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: a directory for each source and language. Units are picked by words, as the SQL does."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), "doc_id", F.lit(".txt"))
    found = licenses.scan(docs.select(path.alias("path"), "text"), signal=licenses.SIGNAL)
    return found.withColumn("doc_id", F.regexp_extract("path", r"/([0-9-]+)\.txt$", 1).cast("long"))


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: list_concat([ascii(c)::BIGINT], repeat([-1::BIGINT], 8))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""
_CELL = "SELECT doc_id, n, good, '{0}' AS feature, {0} AS bin FROM measured"


@query("op7_quality_classifier", rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, source, '/' || lang AS section FROM documents),
known AS (
  SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND {_CRC} % 4 <> 2 GROUP BY doc_id),
places AS (
  SELECT try_cast(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS doc_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
         regexp_extract(url, '^https?://[^/]+(/[^/]*)', 1) AS path FROM pages
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY host, path) = 1),
parts AS (
  SELECT d.doc_id, text, coalesce(p.host, source, '') AS host, coalesce(p.path, section, '') AS path,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split(text, chr(10)) AS l, greatest(length(text), 1) AS chars
  FROM docs d LEFT JOIN places p ON p.doc_id = d.doc_id),
measured AS (
  SELECT row_number() OVER () AS n, p.doc_id, host, path, good,
    least(length(bin(len(w))), 23) AS words, least(len(list_distinct(w)) * 20 // greatest(len(w), 1), 20) AS "distinct",
    least(len(regexp_extract_all(text, '[#$%&*|!+=<>{{}}~^_@]')) * 200 // chars, 23) AS signs,
    least(len(regexp_extract_all(text, '[A-Z]')) * 40 // chars, 23) AS capitals,
    least(len(regexp_extract_all(text, '[0-9]')) * 200 // chars, 23) AS digits,
    least(length(text) // greatest(len(w), 1), 23) AS length, least(len(list_distinct(l)) * 20 // len(l), 20) AS lines
  FROM parts p LEFT JOIN known k ON k.doc_id = p.doc_id),
cells AS ({" UNION ALL ".join(_CELL.format(f if f != "distinct" else chr(34) + f + chr(34)) for f in quality.FEATURES)}),
total AS (SELECT sum(good) AS g, sum(1 - good) AS b, sum(good) / count(good) AS rate FROM measured),
counted AS (SELECT feature, bin, coalesce(sum(good), 0) AS cg, coalesce(sum(1 - good), 0) AS cb FROM cells GROUP BY ALL),
evident AS (
  SELECT n, {quality.TEMPER} * sum(ln((cg + 1.0) / (g + 24.0)) - ln((cb + 1.0) / (b + 24.0))) AS evidence
  FROM cells JOIN counted USING (feature, bin), total GROUP BY n),
weighed AS (
  SELECT m.n, doc_id, host, path, evidence, CASE WHEN good IS NULL THEN {quality.UNLABELLED} ELSE 1.0 END::DOUBLE AS w,
         (CASE WHEN good IS NULL THEN {quality.UNLABELLED} ELSE 1.0 END * coalesce(good, 1 / (1 + exp(-(ln(rate / (1 - rate)) + evidence)))))::DOUBLE AS y
  FROM measured m JOIN evident e ON e.n = m.n, total),
paths AS (SELECT host, path, sum(w) AS pn, sum(y) AS ps FROM weighed GROUP BY ALL),
hosts AS (SELECT host, sum(pn) AS hn, sum(ps) AS hs FROM paths GROUP BY host),
shrink AS (
  SELECT rate, least(1000.0, greatest(1.0, c / greatest(hv - c * hc / ht, 1e-6))) AS kh, least(1000.0, greatest(1.0, c / greatest(pv - c * pc / pt, 1e-6))) AS kp
  FROM (SELECT rate, rate * (1 - rate) AS c,
          (SELECT count(*) FROM hosts) AS hc, (SELECT sum(hn) FROM hosts) AS ht, (SELECT sum(hn * (hs / hn - rate) ** 2) / sum(hn) FROM hosts) AS hv,
          (SELECT count(*) FROM paths) AS pc, (SELECT sum(pn) FROM paths) AS pt, (SELECT sum(pn * (ps / pn - rate) ** 2) / sum(pn) FROM paths) AS pv
        FROM total)),
placed AS (
  SELECT doc_id, host, path, evidence, greatest(1e-6, least(1 - 1e-6, (ps - y + kp * (hs - y + kh * rate) / (hn - w + kh)) / (pn - w + kp))) AS prior
  FROM weighed JOIN paths USING (host, path) JOIN hosts USING (host), shrink),
scored AS (SELECT *, 1 / (1 + exp(-(ln(prior / (1 - prior)) + evidence))) AS score FROM placed)
SELECT doc_id, host, path, {_CRC} % 4 = 2 AS held_out, round(evidence, 6) AS evidence, round(prior, 6) AS prior, round(score, 6) AS score,
       (score >= 0.5)::INTEGER AS predicted FROM scored""")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is placed by the page that holds it (the last number of its url), else by its source and language."""
    pages = read(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"/([0-9]+)", 1).try_cast("long").alias("doc_id"),
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+(/[^/]*)", 1).alias("path"))
    places = pages.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("host", "path")).alias("page")).select("doc_id", "page.*")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.concat(F.lit("/"), "lang").alias("path"))
    found = quality.score(docs, read(spark, sf_dir, "labels").filter(~held_out()), places)
    return found.select("doc_id", "host", "path", held_out().alias("held_out"), *[F.round(c, 6).alias(c) for c in ("evidence", "prior", "score")],
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op12_filter_audit", r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
masks AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > least, false)::INT AS mask FROM words),
said AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counted AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM masks LEFT JOIN said USING (doc_id) GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, step,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM counted, steps GROUP BY part, filter_order, step""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.align(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), public_tokenizers.PATTERN).documents


def unseen() -> Column:
    """The seventh of the documents that the language model does not learn from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2


@query("op13_context_mixing")
def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.score(docs, mixing.fit(docs.filter(~F.coalesce(unseen(), F.lit(False)))), held_out=unseen())
