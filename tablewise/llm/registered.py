"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm import alignment, bpe, decontam, fixity, interpolation, knn, langid, licences, periodic, quality, secretscan, simhash, urls
from tablewise.session import read_table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def remainder(divisor: int):
    """crc32(doc_id as text) mod divisor; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every vector whose id is divisible by 50."""
    return knn.top_k(read_table(spark, sf_dir, "embeddings"))


ORACLE["op1_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, min([CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS a
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  GROUP BY vec_id),
q AS (SELECT vec_id AS query_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM v WHERE vec_id % 50 = 0),
c AS (SELECT vec_id, unnest(a) AS y, generate_subscripts(a, 1) AS i FROM v),
s AS (SELECT query_id, vec_id, CAST(sum(x * y) AS BIGINT) AS score FROM q JOIN c USING (i) WHERE query_id <> vec_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query
def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (3-word shingles, 3 bits)."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op3_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of every document, learned from four fifths of them."""
    return interpolation.score(read_table(spark, sf_dir, "documents"), remainder(5) != 1, remainder(5) == 1)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, remainder(3) != 1)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


#: Records of a file in the audited archive.
FILE_RECORDS = 1000


def archive(pages: DataFrame) -> DataFrame:
    """The pages as ordered records of archive files: ``file``, ``number``, ``offset``, ``data``."""
    data = fixity.warc_record(F.col("url"), F.lit("response"), F.col("html"))
    rows = pages.where("page_id is not null").select(
        F.format_string("pages-%06d.warc", F.floor(F.col("page_id") / FILE_RECORDS).cast("long")).alias("file"),
        F.pmod("page_id", F.lit(FILE_RECORDS)).cast("long").alias("number"), "page_id", data.alias("data"),
    )
    before = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one file's records
    sizes = rows.groupBy("file", "number").agg(F.max(F.octet_length("data")).cast("long").alias("size"))
    offsets = sizes.select("file", "number", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, ["file", "number"])


def damaged(records: DataFrame) -> DataFrame:
    """A second replica: some records are lost, some cut short, some have one byte changed."""
    page, data = F.col("page_id"), F.col("data")
    short = F.substring(data, F.lit(1), F.octet_length(data) - 7)
    changed = F.concat(F.substring(data, F.lit(1), F.octet_length(data) - 5), F.lit(b"#"), F.substring(data, F.octet_length(data) - 3, F.lit(4)))
    return records.where(page % 389 != 11).withColumn("data", F.when(page % 211 == 7, short).when(page % 97 == 5, changed).otherwise(data))


@query
def op5_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in which a damaged replica of the page archive differs from the first."""
    first = archive(read_table(spark, sf_dir, "pages"))
    found = fixity.audit(first, damaged(first))
    page = F.regexp_extract("file", "([0-9]+)", 1).cast("long") * FILE_RECORDS + F.col("number")
    return found.select("file", "number", page.alias("page_id"), "offset", "size", "fault")


ORACLE["op5_merkle_fixity_audit"] = r"""
WITH r AS (
  SELECT format('pages-{:06d}.warc', CAST(floor(page_id / 1000) AS BIGINT)) AS file, page_id % 1000 AS number, page_id,
         octet_length(encode(E'WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: ' || coalesce(url, '') || E'\r\nWARC-Payload-Digest: sha256:' || sha256(coalesce(html, ''))
           || E'\r\nContent-Type: text/html\r\nContent-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || E'\r\n\r\n'))
         + octet_length(encode(coalesce(html, ''))) + 4 AS size
  FROM pages WHERE page_id IS NOT NULL),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY file ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT file, number, page_id, CAST(before AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size,
       CASE WHEN page_id % 389 = 11 THEN 'missing' WHEN page_id % 211 = 7 THEN 'length' ELSE 'content' END AS fault
FROM o WHERE page_id % 389 = 11 OR page_id % 211 = 7 OR page_id % 97 = 5
"""


@query
def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents name or quote, with the sentences that match."""
    found = licences.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licence", F.array_join("rule", ",").alias("rule"), "first_sentence", "last_sentence")


def _licence_sql() -> str:
    names = list(licences.SENTENCES)
    known = ", ".join(f"({names.index(n) + 1}, '{s}')" for n, s in licences.SENTENCES.items())
    rules = ", ".join(f"({k}, '{licence}', '{','.join(ids)}', {i}, {names.index(x) + 1}, {len(ids)})" for k, (licence, ids) in enumerate(licences.RULES) for i, x in enumerate(ids))
    return rf"""
WITH known(id, norm) AS (VALUES {known}), rules(rule_no, licence, rule, k, id, n) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)) AS cut FROM documents WHERE text IS NOT NULL),
s AS (SELECT row_no, doc_id, unnest(cut) AS s, generate_subscripts(cut, 1) - 1 AS nr FROM d),
u AS (SELECT row_no, doc_id, nr, 0 AS j, s FROM s
      UNION ALL SELECT row_no, doc_id, nr, unnest(range(1, len(string_split(s, chr(10))) + 1)), unnest(string_split(s, chr(10))) FROM s WHERE contains(s, chr(10))),
f AS (SELECT row_no, doc_id, nr, id, row_number() OVER (PARTITION BY row_no ORDER BY nr, j) AS place
      FROM u JOIN known ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = norm),
m AS (SELECT row_no, doc_id, rule_no, licence, rule, n, place - k AS start, nr, nr - lag(nr, 1, nr) OVER (PARTITION BY row_no, rule_no, place - k ORDER BY k) AS gap FROM f JOIN rules USING (id)),
g AS (SELECT row_no, doc_id, rule_no, licence, rule, n, min(nr) AS first_sentence, max(nr) AS last_sentence FROM m
      GROUP BY row_no, doc_id, rule_no, licence, rule, n, start HAVING count(*) = n AND max(gap) <= {licences.GAP + 1})
SELECT doc_id, licence, rule, CAST(first_sentence AS INTEGER) AS first_sentence, CAST(last_sentence AS INTEGER) AS last_sentence FROM g a
WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.row_no = a.row_no AND b.n > a.n AND a.first_sentence >= b.first_sentence AND a.last_sentence <= b.last_sentence)
"""


ORACLE["op6_licence_scan"] = _licence_sql()


@query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which benchmark items, up to a fifth of the words edited."""
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op8_quality_by_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of every document under a model of the trusted ones."""
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoded bytes, as digests."""
    return bpe.digest(bpe.tokenize(read_table(spark, sf_dir, "documents")))


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.judge(read_table(spark, sf_dir, "pages"))


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: fixed formats and strings that a vocabulary encodes badly."""
    return secretscan.digest(secretscan.find_secrets(read_table(spark, sf_dir, "documents")))


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece tokenizer on every document, scored by corpus-wide counts."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return alignment.digest(alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; a tenth of the texts repeat a stretch of their words to the end.

    Which and how is set by crc32(doc_id as text); a null doc_id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = F.when(F.col("__h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", h.alias("__h"), F.floor(h / 10).cast("long").alias("__g")).withColumn("__w", chosen)
    n, g = F.size("__w").cast("long"), F.col("__g")
    rows = rows.withColumn("__a", F.when(n > 0, g % n))  # null: the text stays
    left = n - F.col("__a")
    rows = rows.withColumn("__left", left).withColumn("__p", 1 + F.floor(left / (3 + g % 8)).cast("long"))
    left, period = F.col("__left"), F.col("__p").cast("int")
    stretch = F.slice("__w", (F.col("__a") + 1).cast("int"), period)
    repeats = F.slice(F.flatten(F.array_repeat(stretch, F.ceil(left / period).cast("int"))), F.lit(1), left.cast("int"))
    words = F.concat(F.slice("__w", F.lit(1), F.col("__a").cast("int")), repeats)
    return rows.select("doc_id", F.when(F.col("__a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of them made periodic, and digests of the text without repeats."""
    return periodic.digest(periodic.collapse_runs(with_planted_runs(read_table(spark, sf_dir, "documents"))))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from documents to token ids."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
