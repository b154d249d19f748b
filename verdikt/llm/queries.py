"""The queries of this subpackage over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm import ann, decontaminate, jaccard, language, lm, merkle, mixing, runs, spotsigs, suffixes, surrogates, urls, wavelet
from verdikt.llm.rows import sent
from verdikt.llm.store import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = ann.neighbours(vectors, vectors.where("vec_id % 100 = 0"), 10, "vec_id", "embedding")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: The rules that the contract of op2 gives.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = mixing.copies(_table(spark, sf_dir, "documents"))
    each = decided.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken, "copies")


#: Stands for a secret that a caller keeps; results depend on it.
PII_KEY = "surrogate key of the registered query"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replaced(docs, PII_KEY)


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.without_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return left.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        # What is left as text; a cut inside a character leaves a replacement mark.
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = jaccard.similar(docs, "doc_id", "text", size=3, share=Fraction(9, 10))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    docs = _table(spark, sf_dir, "documents")
    wavelet.write_tokens(docs, path, tokenizer_path("byte_bpe_50k.json"))
    shards = wavelet.read_shards(spark, path, docs.schema["doc_id"].dataType)
    return wavelet.token_digests(shards).withColumnRenamed("id", "doc_id")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    marked = docs.join(sent(good.where("good")), "doc_id", "left")
    return lm.scored(marked, F.col("good")).withColumnRenamed("id", "doc_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def _decimal_crc(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def _periodic_ends(docs: DataFrame) -> DataFrame:
    """The contract's texts: a tenth of them repeat a stretch up to their end."""
    h = _decimal_crc("doc_id")
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    # One row in a list: what follows reads the words instead of finding them again.
    cut = docs.select("doc_id", "text", F.inline(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g")))))
    n = F.size("w")
    cut = cut.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    made = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), F.lit(1), n), " ")
    return cut.select("doc_id", F.when(F.col("p").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.repeated(_periodic_ends(_table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("n"), r.start.alias("s"), r.period.alias("q"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    found = found.withColumn("best", longest)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.q").alias("period"),
        F.expr("(1000 * -best.n) div best.q").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lowered = {"text": F.translate("text", urls.UPPER, urls.LOWER)}
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    leaves = merkle.tree(docs, columns, "source", "doc_id", lowered, _decimal_crc("doc_id") % 5 == 0)
    return merkle.proven(leaves).withColumnRenamed("id", "doc_id")


def op13_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.beside_edits(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_vectors": op1_nearest_vectors,
    "op2_url_filter": op2_url_filter,
    "op3_source_mix": op3_source_mix,
    "op4_surrogates": op4_surrogates,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_decontamination": op6_decontamination,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_token_files": op8_token_files,
    "op9_lm_scores": op9_lm_scores,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spot_signatures": op13_spot_signatures,
}

_LOWER = f"'{urls.UPPER}', '{urls.LOWER}'"
_RULES = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in URL_RULES)
_OP2 = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
),
fits AS (
  SELECT page_id, max_by(h || p, length(h) * 1000 + length(p)) AS rule, max_by(action, length(h) * 1000 + length(p)) AS action
  FROM parts JOIN (VALUES {_RULES}) r(h, p, action) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, '{urls.DEFAULT}') AS verdict FROM parts LEFT JOIN fits USING (page_id)"""

_WORDS = f"regexp_extract_all(translate(text, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_W = decontaminate.WINDOW
_OP6 = f"""
WITH docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT item_id, unnest(CASE WHEN len(w) >= {_W} THEN list_transform(range(1, len(w) - {_W - 2}), lambda i: w[i:i + {_W - 1}])
    WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM items
),
sizes AS (SELECT DISTINCT len(g) AS n FROM windows),
places AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'g': w[i:i + n - 1]}})) AS e
  FROM docs, sizes WHERE len(w) >= n
),
hits AS (SELECT doc_id, item_id, n, e.i AS i FROM places JOIN windows ON e.g = windows.g),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS t
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""



def _leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + "))"


#: CRC-32 of an id's digits: fixed values of that checksum, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), 4294967295), 4294967295)"""


def _levels(name: str, leaves: str) -> str:
    """Nodes of all levels, and the digests before and behind each of them."""
    return f"""
{name} AS (
  SELECT 0 AS level, part, place AS p, n, digest AS d FROM {leaves}
  UNION ALL
  SELECT level + 1, part, p // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY p)) FROM {name} WHERE n > 1
  GROUP BY level, part, p // 16, n
),
{name}_way AS (
  SELECT a.level, a.part, a.p, coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r
  FROM {name} a JOIN {name} b ON a.level = b.level AND a.part = b.part AND a.p // 16 = b.p // 16 WHERE a.n > 1
  GROUP BY a.level, a.part, a.p
)"""


_OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '-') AS part, {_leaf("text")} AS digest,
    CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(f"translate(text, {_LOWER})")} ELSE {_leaf("text")} END AS changed FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, digest) - 1 AS place,
    count(*) OVER (PARTITION BY part) AS n FROM leaves
),{_levels("low", "placed")},
subroots AS (
  SELECT part AS source, '' AS part, d AS digest, row_number() OVER (ORDER BY part) - 1 AS place, count(*) OVER () AS n
  FROM low WHERE n = 1
),{_levels("high", "subroots")},
steps AS (
  SELECT doc_id, changed, place, p.part, w.level, w.l, w.r
  FROM placed p JOIN low_way w ON w.part = p.part AND w.p = place // (16 ** level)::BIGINT
  UNION ALL
  SELECT doc_id, changed, p.place, p.part, 100 + w.level, w.l, w.r
  FROM placed p JOIN subroots s ON s.source = p.part JOIN high_way w ON w.p = s.place // (16 ** level)::BIGINT
),
ways AS (
  SELECT part, place, string_agg(l || r, '' ORDER BY level) AS siblings, list(l || '|' || r ORDER BY level) AS way FROM steps GROUP BY ALL
),
ends AS (
  SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, (SELECT d FROM high WHERE n = 1) AS root, coalesce(siblings, '') AS siblings,
    list_reduce(coalesce(way, []), lambda v, w: sha256(split_part(w, '|', 1) || v || split_part(w, '|', 2)), p.changed) AS folded_root
  FROM placed p JOIN subroots s ON s.source = p.part LEFT JOIN ways w ON w.part = p.part AND w.place = p.place
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM ends"""

ORACLES: dict[str, str] = {"op2_url_filter": _OP2, "op6_decontamination": _OP6, "op12_merkle_manifest": _OP12}
