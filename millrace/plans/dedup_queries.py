"""Dedup, exclusion, guards and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, guard
from .fixtures import RECORDS, normal_sql, records, squeeze_sql, table, values


def exact_dedup(spark, d):
    return dedup.first_of(records(spark, d), T.sha(F.col("text"))).select(F.col("ord").alias("doc_id"), "source")


def normalized_dedup(spark, d):
    return dedup.first_of(records(spark, d), T.sha(T.normal(F.col("text")))).select(F.col("ord").alias("doc_id"), "source")


def output_dedup(spark, d):
    """Case kept, white space squeezed: over the turns of conversations, the first turn of each text."""
    c = table(spark, d, "conversations").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    return dedup.first_of(c, T.sha(T.squeeze(F.col("text")))).select("conv_id", "turn")


def exclusion_antijoin(spark, d):
    """Documents that equal none of the excluded texts, here those of the first sources."""
    r = records(spark, d)
    return dedup.excluded(r, r.where(F.col("source").isin("src1", "src2"))).select(F.col("ord").alias("doc_id"))


def content_ids(spark, d):
    return records(spark, d).select(F.substring(T.sha(F.col("text")), 1, 16).alias("id")).groupBy("id").agg(F.count("*").alias("copies"))


def first_lines(spark, d):
    """Rows seen before in an earlier output, found by id: what a resumed run still has to do."""
    r = records(spark, d).withColumn("id", F.substring(T.sha(F.col("text")), 1, 16))
    done = r.where(F.col("ord") < 100).select("id").distinct()
    return r.join(done, "id", "left_anti").groupBy("id").agg(F.min("ord").alias("doc_id"))


def signatures(spark, d):
    return guard.signatures(guard.tasks(spark), guard.references(spark)).select("kind", "value", "name")


def decontaminate(spark, d):
    """Reasons in order: text hash, assertion, description, definition with two literals."""
    s = guard.signatures(guard.tasks(spark), guard.references(spark))
    return guard.reasons(values(spark, guard.CANDIDATES), s).select("id", "reason")


def decontaminate_hash(spark, d):
    """Documents that are a benchmark item, raw or normalized."""
    r, b = records(spark, d), table(spark, d, "benchmark")
    bad = b.select(F.explode(F.array(T.sha(F.col("text")), T.sha(T.normal(F.col("text"))))).alias("h")).distinct()
    both = r.select("ord", F.explode(F.array_distinct(F.array(T.sha(F.col("text")), T.sha(T.normal(F.col("text")))))).alias("h"))
    hit = both.join(bad, "h", "left_semi").select("ord").distinct().withColumn("hit", F.lit(True))
    return r.select("ord").join(hit, "ord", "left").select(F.col("ord").alias("doc_id"), F.coalesce("hit", F.lit(False)).alias("contaminated"))


def decontaminate_substring(spark, d):
    """Documents that contain a whole benchmark item, by an equi-join on the item's first word 6-gram, then verified."""
    return guard.containing(records(spark, d).select("ord", "text"), table(spark, d, "benchmark")).select(F.col("ord").alias("doc_id"), "item_id")


def drop_gate(spark, d):
    """The share of documents that decontamination removes, against the highest share allowed."""
    n = records(spark, d).agg(F.count("*").alias("total"))
    hit = guard.containing(records(spark, d).select("ord", "text"), table(spark, d, "benchmark")).select("ord").distinct().agg(F.count("*").alias("removed"))
    return n.crossJoin(hit).select("total", "removed", (F.col("removed") / F.col("total")).alias("fraction"), (F.col("removed") / F.col("total") <= 0.05).alias("passed"))


def eval_guard(spark, d):
    return guard.eval_reasons(values(spark, guard.BRIEFS)).select("id", "reason")


def word_sets(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(T.word_set(F.col("text"))).cast("long").alias("n"), F.array_join(F.array_sort(T.word_set(F.col("text"))), " ").alias("words"))


def jaccard_pairs(spark, d):
    return dedup.similar_pairs(records(spark, d), 0.82)


def near_dup_greedy(spark, d):
    """Keep-first survivors of word-set similarity; a row is compared with rows that stay only."""
    r = records(spark, d).select("ord", "text", "language")
    member, near = dedup.similar_sets(r, 0.82)
    # a later row of a class always goes: with its first row, or with the earlier partner that took that one
    copies = member.where("id <> first").select("id")
    kept = dedup.greedy_survivors(r.select("ord"), near).join(copies, F.col("ord") == F.col("id"), "left_anti")
    return kept.select(F.col("ord").alias("doc_id"))


def ngram_containment(spark, d):
    """Per benchmark item the share of its word 8-grams that occur in the documents."""
    words = lambda c: F.filter(F.split(T.squeeze(c), " "), lambda w: w != "")
    items = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.ngram_hashes(words(F.col("text")), 8))).alias("g"))
    grams = items.select("g").distinct()
    found = records(spark, d).select(F.explode(F.array_distinct(T.ngram_hashes(words(F.col("text")), 8))).alias("g")).join(grams, "g", "left_semi").distinct().withColumn("hit", F.lit(1))
    per = items.join(found, "g", "left").groupBy("item_id").agg(F.count("*").alias("grams"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"))
    return table(spark, d, "benchmark").select("item_id").join(per, "item_id", "left").select("item_id", F.coalesce("grams", F.lit(0)).cast("long").alias("grams"), (F.col("found") / F.col("grams")).alias("containment"))


QUERIES = {
    f.__name__: f
    for f in (exact_dedup, normalized_dedup, output_dedup, exclusion_antijoin, content_ids, first_lines, signatures, decontaminate, decontaminate_hash, decontaminate_substring, drop_gate, eval_guard, word_sets, jaccard_pairs, near_dup_greedy, ngram_containment)
}
_SETS = "CASE WHEN TRUE THEN list_distinct([lower(x) FOR x IN regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*') IF length(x) > 2]) END"
_PAIRS = f"""s AS (SELECT doc_id AS id, lang, {_SETS} AS w FROM documents), i AS (SELECT id, lang, len(w) AS n, unnest(w) AS x FROM s),
 c AS (SELECT a.id AS l, b.id AS r, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM i a JOIN i b ON a.lang = b.lang AND a.x = b.x AND a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n GROUP BY a.id, b.id),
 p AS (SELECT l AS "left", r AS "right", k / (n + m - k) AS jaccard FROM c WHERE k / (n + m - k) >= 0.82)"""
_W = f"[x FOR x IN string_split({squeeze_sql('text')}, ' ') IF x <> '']"
_G = "[array_to_string(w[i:i + 7], ' ') FOR i IN range(1, len(w) - 6)]"
_first = lambda key: f"SELECT ord AS doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ord) AS rn FROM rec) WHERE rn = 1"
SQL = {
    "exact_dedup": f"WITH {RECORDS} {_first('sha256(text)')}",
    "normalized_dedup": f"WITH {RECORDS} {_first(f'sha256({normal_sql("text")})')}",
    "output_dedup": f"SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY {squeeze_sql('text')} ORDER BY conv_id * 1000 + turn) AS rn FROM conversations) WHERE rn = 1",
    "exclusion_antijoin": f"WITH {RECORDS}, x AS (SELECT text FROM rec WHERE source IN ('src1', 'src2')) SELECT ord AS doc_id FROM rec WHERE text NOT IN (SELECT text FROM x) AND {normal_sql('text')} NOT IN (SELECT {normal_sql('text')} FROM x)",
    "content_ids": "SELECT substr(sha256(text), 1, 16) AS id, count(*) AS copies FROM documents GROUP BY ALL",
    "first_lines": "SELECT substr(sha256(text), 1, 16) AS id, min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id < 100) GROUP BY ALL",
    "decontaminate_hash": f"SELECT doc_id, {normal_sql('text')} IN (SELECT {normal_sql('text')} FROM benchmark) AS contaminated FROM documents",
    "decontaminate_substring": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "drop_gate": "SELECT count(*) AS total, count(*) FILTER (hit) AS removed, count(*) FILTER (hit) / count(*) AS fraction, count(*) FILTER (hit) / count(*) <= 0.05 AS passed FROM (SELECT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text)) AS hit FROM documents d)",
    "word_sets": f"SELECT item_id, len(w)::BIGINT AS n, array_to_string(list_sort(w), ' ') AS words FROM (SELECT item_id, {_SETS} AS w FROM benchmark)",
    "jaccard_pairs": f"WITH {_PAIRS} SELECT * FROM p",
    "ngram_containment": f"""WITH b AS (SELECT item_id, {_W} AS w FROM benchmark), d AS (SELECT {_W} AS w FROM documents), g AS (SELECT item_id, unnest(list_distinct({_G})) AS g FROM b),
 f AS (SELECT DISTINCT unnest({_G}) AS g FROM d) SELECT b.item_id, count(g.g) AS grams, CASE WHEN count(g.g) > 0 THEN count(f.g) / count(g.g) END AS containment FROM b LEFT JOIN g USING (item_id) LEFT JOIN f ON g.g = f.g GROUP BY b.item_id""",
}
