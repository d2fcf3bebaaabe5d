"""Line dedup by distinct-site spread: HyperLogLog per line hash, exact counts near the threshold, boilerplate removal.

Every non-blank line of every text gets a 64-bit hash of its trimmed form: blanks, tabs and the other characters
0x09-0x0D go from its ends, so a line is the same before \\n and before \\r\\n. The spread of a line is the number of
distinct sites (`source`) whose documents hold it. A HyperLogLog sketch is kept as rows (line, register, rank), so
sketches merge by a plain max aggregation: map-side first, then by line, whatever the share of one site or one line.
A line seen twice by one site leaves one row. The estimate settles lines far from the threshold; lines near it get an
exact distinct count. Lines of at least `min_sites` sites are boilerplate: every occurrence goes but the first one
(smallest doc_id, then position), so no passage disappears from the corpus altogether.

The estimate drops a line only if it is more than the slack under the threshold. For four sites that takes two
coincidences among 4,096 registers, 7 in 16.8 million such lines; lines that pass are never removed on an estimate near
the threshold. A second, independent hash of each hit keeps lines apart that share the first one.

Defined cases: a null text counts as empty and is returned unchanged; a null site is a site of its own; blank lines are
never removed, nor is a line end's \\r alone; repeated rows hold equal lines and are treated alike; an empty table gives an
empty table; columns of any other name pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import column, cut, fresh, only, skew_lookup, table, text_or_empty

#: 2**REGISTER_BITS registers a sketch; only those that were hit take a row.
REGISTER_BITS = 12
MIN_SITES = 4


#: What counts as blank at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame, text: str, site: str, doc: str) -> DataFrame:
    """(doc, text hash, pos, line hash, second line hash, site hash) of each non-blank line; blanks are cut off at its ends."""
    return (
        docs.select(column(doc).alias("_d"), F.xxhash64(column(text)).alias("_t"), F.xxhash64(F.coalesce(F.concat(F.lit("s"), column(site).cast("string")), F.lit("n"))).alias("_s"), F.posexplode(F.split(F.coalesce(column(text).cast("string"), F.lit("")), "\n")).alias("_pos", "_l"))
        .withColumn("_l", F.btrim("_l", F.lit(BLANKS)))
        .where(F.col("_l") != "")
        .select("_d", "_t", "_s", "_pos", F.xxhash64("_l").alias("_h"), F.xxhash64(F.lit(1), "_l").alias("_h2"))
    )


def spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines that at least min_sites sites hold, with their numbers of occurrences: (_h, _c)."""
    m = 1 << REGISTER_BITS
    register = F.col("_s").bitwiseAND(m - 1).cast("int")
    rest = F.shiftrightunsigned("_s", REGISTER_BITS)
    rank = F.when(rest == 0, 64 - REGISTER_BITS + 1).otherwise(64 - REGISTER_BITS - F.floor(F.log2(rest.cast("double"))).cast("int"))
    sketch = lines.groupBy("_h", register.alias("_r")).agg(F.max(rank.cast("int")).alias("_k"), F.count("*").alias("_c"))
    raw = sketch.groupBy("_h").agg(F.count("*").alias("_hit"), F.sum(F.pow(F.lit(2.0), -F.col("_k"))).alias("_p"), F.sum("_c").alias("_c"))
    est = estimate(F.col("_hit"), F.col("_p"), m)
    # 4 standard errors each way, and one and a half sites at least
    slack = max(1.5, 4 * 1.04 / math.sqrt(m) * min_sites)
    settled = cut(raw.select("_h", "_c", est.alias("_e")).where(F.col("_e") >= min_sites - slack), "line-spread")
    sure = settled.where(F.col("_e") > min_sites + slack).select("_h", "_c")
    near = settled.where(F.col("_e") <= min_sites + slack).select("_h", "_c")
    sites = skew_lookup(lines.select("_h", "_s"), near.withColumn("_w", F.col("_c")), "_h", "_w", "inner").groupBy("_h", "_s").agg(F.max("_c").alias("_c"))
    exact = sites.groupBy("_h").agg(F.count("*").alias("_n"), F.max("_c").alias("_c")).where(F.col("_n") >= min_sites).select("_h", "_c")
    return sure.unionByName(exact)


def estimate(hit: Column, p: Column, m: int) -> Column:
    """The HyperLogLog estimate of a sketch whose hit registers sum to p, by linear counting while many are empty."""
    empty = F.lit(m) - hit
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (p + empty)
    return F.when((raw <= 2.5 * m) & (empty > 0), F.lit(float(m)) * F.log(F.lit(float(m)) / empty)).otherwise(raw)


def removals(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", doc: str = "doc_id") -> DataFrame:
    """(_d, _t, _gone): for each document that loses lines the positions of these. A document is its id and text."""
    lines = _lines(docs, text, site, doc)
    bad = cut(spread(lines, min_sites), "line-boilerplate")
    hits = cut(skew_lookup(lines, bad.withColumn("_w", F.col("_c")), "_h", "_w", "inner").select("_h", "_h2", "_s", "_d", "_t", "_pos"), "line-hits", bad)
    at = F.struct(F.col("_d").isNull().alias("x"), F.col("_d").alias("d"), F.col("_t").alias("t"), F.col("_pos").alias("p"))
    # by both hashes: lines that share the first alone may have too few sites each
    per = hits.groupBy("_h", "_h2", "_s").agg(F.min(at).alias("_f"), F.count("*").alias("_w"))
    line = F.xxhash64("_h", "_h2")
    first = per.groupBy("_h", "_h2").agg(F.min("_f").alias("_f"), F.sum("_w").alias("_w"), F.count("*").alias("_n")).where(F.col("_n") >= min_sites).select(line.alias("_key"), "_f", "_w")
    first = cut(first, "line-first")
    gone = skew_lookup(hits.select(line.alias("_key"), "_d", "_t", "_pos"), first, "_key", "_w", "inner").where(~at.eqNullSafe(F.col("_f")))
    return gone.groupBy("_d", "_t").agg(F.collect_set("_pos").alias("_gone"))


def remove_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", doc: str = "doc_id", keep_counts: bool = False) -> DataFrame:
    """docs with boilerplate lines taken out of `text`; with keep_counts also n_lines and n_removed."""
    gone = removals(docs, min_sites, text, site, doc)
    d, t, lost, hashed = (fresh(docs, n) for n in ("_d", "_t", "_gone", "_th"))
    gone = gone.toDF(d, t, lost).hint("merge")  # documents that lose lines are as many as the corpus makes them: never broadcast
    j = docs.withColumn(hashed, F.xxhash64(column(text))).join(gone, column(doc).eqNullSafe(F.col(d)) & (F.col(hashed) == F.col(t)), "left")
    parts = F.split(F.coalesce(column(text).cast("string"), F.lit("")), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(lost))
    # the lambda variable holds the lines: split once a row, not once a line
    kept = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay, lambda i: F.element_at(p, i + 1)), "\n")), 1)
    out = {text: F.when(F.col(lost).isNull(), column(text)).otherwise(kept)}
    names = list(docs.columns)
    if keep_counts:
        out |= {"n_lines": F.size(parts).cast("long"), "n_removed": F.coalesce(F.size(lost), F.lit(0)).cast("long")}
        names += [n for n in ("n_lines", "n_removed") if n not in names]
    return only(j.withColumns(out), names)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: how many lines it has, how many go, and the MD5 of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_lines(docs, keep_counts=True).select("doc_id", "n_lines", "n_removed", F.length(text_or_empty()).cast("long").alias("kept_chars"), F.md5(text_or_empty()).alias("kept_md5"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, text, source, unnest(parts) AS raw, unnest(range(len(parts))) AS pos FROM d),
n AS (SELECT *, trim(raw, {_BLANK}) AS line FROM l WHERE trim(raw, {_BLANK}) <> ''),
b AS (SELECT line FROM n GROUP BY line HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {MIN_SITES}),
h AS (SELECT n.*, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS rn FROM n JOIN b USING (line)),
g AS (SELECT doc_id, text, list(pos) AS gone FROM h WHERE rn > 1 GROUP BY doc_id, text),
k AS (SELECT d.doc_id, len(d.parts) AS n_lines, coalesce(len(g.gone), 0) AS n_removed,
  array_to_string([d.parts[i + 1] FOR i IN range(len(d.parts)) IF NOT list_contains(coalesce(g.gone, []), i)], chr(10)) AS kept
  FROM d LEFT JOIN g ON d.doc_id = g.doc_id AND d.text = g.text)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(coalesce(kept, ''))::BIGINT AS kept_chars, md5(coalesce(kept, '')) AS kept_md5 FROM k
"""
