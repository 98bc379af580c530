"""The registered ``opN_*`` queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphsweep.llm import bpe, decontam, licenses, near_dedup, quality, secrets, simhash, spelling, suffix_dedup, toxicity, warc, whitening
from glyphsweep.llm import exact_dedup as exact
from glyphsweep.llm.common import table

#: The vocabulary that op6 encodes with, by the name the installed package knows.
VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query()
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document outside 200-byte strings that start twice in the corpus."""
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


@query()
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base spans, and all spans."""
    return secrets.digest_columns(secrets.scan(table(spark, sf_dir, "documents")))


@query(r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
-- base32: every 10 hexadecimal digits are 40 bits, 8 digits of 5 bits
c AS (SELECT page_id, g, i, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             CAST((CAST('0x' || substr(h, 10 * g + 1, 10) AS UBIGINT) >> (35 - 5 * i)) & 31 AS INTEGER) + 1, 1) AS digit
      FROM p, range(4) AS a(g), range(8) AS b(i)),
d AS (SELECT page_id, string_agg(digit, '' ORDER BY g, i) AS payload_digest FROM c GROUP BY page_id)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g JOIN d USING (page_id)
""")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the positive-unlabelled quality model."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return licenses.licence_scan(table(spark, sf_dir, "documents"))


@query()
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; ids and text as digests."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


DECONTAM_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
bs AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, w[s:s + 12] AS x FROM bs),
sizes AS (SELECT DISTINCT len(x) AS n FROM bw),
ds AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT r, s, n, w[s:s + n - 1] AS x FROM ds),
m AS (SELECT r, s, n, item_id FROM dw JOIN bw USING (x)),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS q FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, sha256(string_agg(v, ',' ORDER BY v)) AS h
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS v FROM m) GROUP BY r),
-- near: all words of a window within three more words; looked for around its rarest word
ww AS (SELECT DISTINCT x FROM bw),
terms AS (SELECT DISTINCT unnest(x) AS term FROM ww),
pos AS (SELECT r, term, p FROM (SELECT r, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM d) JOIN terms USING (term)),
freq AS (SELECT term, count(*) AS n FROM pos GROUP BY term),
rare AS (SELECT x, arg_min(term, (n, term)) AS term FROM (SELECT x, unnest(x) AS term FROM ww) JOIN freq USING (term) GROUP BY x),
near AS (SELECT DISTINCT q.r, x FROM pos q JOIN rare USING (term) JOIN d ON d.r = q.r
         WHERE len(list_filter(range(greatest(p - len(x) - 2, 1), p + 1), lambda s: list_has_all(w[s:s + len(x) + 2], x))) > 0),
c AS (SELECT r, count(DISTINCT item_id) AS n_near FROM near JOIN bw USING (x) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN p USING (r) LEFT JOIN i USING (r) LEFT JOIN c USING (r)
"""


@query(DECONTAM_SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in documents: words hit, items met, contamination."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "content_hash")


@query()
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the factorization machine."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(r"""
WITH n AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies by complete content, one row per document."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words one edit apart in all documents, their frequent forms and the forms' ends."""
    return spelling.variants(table(spark, sf_dir, "documents"))


@query()
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their components."""
    return simhash.near_components(table(spark, sf_dir, "documents"))


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the whitened principal components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
