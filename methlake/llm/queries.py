"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methlake.functions.binding import let
from methlake.llm import backoff, bpe, fm_index, language, lines, neighbours, piece_bpe, prefix_trie, quality, runs, sharding, simhash, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


#: Windows of 20 words that also start earlier, and what is left without their words.
WORDS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS k FROM v),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM h),
c AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(s, s + 20))))) AS gone FROM r WHERE n > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""


def language_model(spark: SparkSession, sf_dir: str) -> language.LanguageModel:
    """Learned from the folds that are not held out."""
    return language.fit(table(spark, sf_dir, "documents").where(fold(3) != 1).select("text", "lang"))


@query("op1_substring_dedup", WORDS_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    named = language.predict(docs, language_model(spark, sf_dir))
    return named.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


@query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), out="text")
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def ranks() -> bpe.Ranks:
    return bpe.Ranks.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ranks()
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), known).drop("text"), known)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(5) == 0
    model = quality.fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


#: A word's score: its trigram if that occurs twice at least, else 0.4 times its bigram's, else 0.4 times its share.
BACKOFF_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
t AS (SELECT doc_id, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c,
  CASE WHEN i > 1 THEN w[i - 1] END AS pa, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS pb FROM p),
ca AS (SELECT a AS g, count(*) AS n FROM t GROUP BY a), cb AS (SELECT b AS g, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b),
cc AS (SELECT c AS g, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY c), z AS (SELECT count(*) AS n FROM t),
s AS (SELECT t.doc_id, CASE WHEN cc.n >= 2 THEN ln(cc.n / qb.n)
  ELSE (CASE WHEN c IS NULL THEN 0 ELSE ln(0.4) END) + (CASE WHEN cb.n >= 2 THEN ln(cb.n / qa.n) ELSE (CASE WHEN b IS NULL THEN 0 ELSE ln(0.4) END) + ln(ca.n / z.n) END) END AS s
  FROM t JOIN ca ON t.a = ca.g LEFT JOIN cb ON t.b = cb.g LEFT JOIN cc ON t.c = cc.g LEFT JOIN ca qa ON t.pa = qa.g LEFT JOIN cb qb ON t.pb = qb.g CROSS JOIN z),
e AS (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS log_score,
  CASE WHEN len(w) > 0 THEN round(s / len(w), 4) ELSE 0 END AS per_word FROM d LEFT JOIN e ON d.doc_id = e.doc_id
"""


@query("op9_lm_scores", BACKOFF_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = backoff.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("per_word", 4).alias("per_word"))


@query("op10_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"))


@query("op11_piece_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = piece_bpe.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = piece_bpe.decode(piece_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), known).drop("text"), known)
    return coded.select("doc_id", piece_bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def looped(doc_id: Column, text: Column) -> Column:
    """Every tenth text by its id's hash, its words from one place on repeating; a null id leaves the text as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        return let(F.struct((g % n).cast("int").alias("a"), n.alias("n")), lambda s: let(
            F.floor((s["n"] - s["a"]) / (3 + g % 8)).cast("int") + 1,
            lambda p: F.concat_ws(" ", F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, s["a"] + (i - s["a"]) % p)))),
        ))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words, repeated)).otherwise(text)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.find(docs, keep_text=False)
    milli = lambda r: F.floor(1000 * r["length"] / r["period"]).cast("bigint")

    def better(best: Column, r: Column) -> Column:  # runs come by start, then period, so only a greater exponent wins
        return F.when(best["length"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    best = F.col("best")
    return found.withColumn("best", F.aggregate("runs", none, better)).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        milli(best).alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Nodes as digests of the rebuilt turns' lists; a subtree is summed over pairs of a node and each of its ancestors.
TRIE_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT c, c - c % 5 AS b,
  xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda j: [CAST(ascii(substr(CAST(c AS VARCHAR), j, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, v: CASE WHEN v >= 0 THEN xor(s, v) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295) % 9 AS h FROM t),
p AS (SELECT k.c, 0 AS o, t.i, t.r, t.x FROM k JOIN t ON t.c = k.b AND t.i <= k.h UNION ALL SELECT k.c, 1, t.i, t.r, t.x FROM k JOIN t ON t.c = k.c AND t.i > k.h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o, i) AS d, r, x FROM p),
g AS (SELECT c, list(sha256(concat(length(r), ':', r, x)) ORDER BY d) AS l, list(CAST(strlen(x) AS BIGINT) ORDER BY d) AS z FROM q GROUP BY c),
m AS (SELECT c, unnest(range(1, len(l) + 1)) AS d, l, z FROM g),
w AS (SELECT c, d, sha256(array_to_string(l[1:d], ',')) AS id, CASE WHEN d > 1 THEN sha256(array_to_string(l[1:d - 1], ',')) ELSE '' END AS up, z[d] AS z, d = len(l) AS e FROM m
  UNION ALL SELECT k.c, 0, '', NULL, 0, g.c IS NULL FROM k LEFT JOIN g ON g.c = k.c),
n AS (SELECT id, d, min(c) AS c, min(up) AS up, count(*) AS n, min(z) AS z, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE e), '')) AS ends FROM w GROUP BY id, d),
f AS (SELECT up AS id, count(*) AS f FROM n WHERE d > 0 GROUP BY up),
a AS (SELECT w.id, w.d, sum((n.n - 1) * n.z) AS saved, count(*) FILTER (WHERE f.f IS NULL) AS leaves FROM n LEFT JOIN f ON f.id = n.id JOIN w ON w.c = n.c AND w.d <= n.d GROUP BY w.id, w.d)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, u.c AS parent_conv_id, n.n AS n_convs, coalesce(f.f, 0) AS n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n u ON u.id = n.up AND u.d = n.d - 1 LEFT JOIN f ON f.id = n.id JOIN a ON a.id = n.id AND a.d = n.d
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    shared = F.crc32(conv.cast("string").cast("binary")) % 9
    turns, members = prefix_trie.spliced(prefix_trie.turns_of(table(spark, sf_dir, "conversations")), conv - conv % 5, shared, 8)
    return prefix_trie.trie(turns, members).drop("n_ends")
