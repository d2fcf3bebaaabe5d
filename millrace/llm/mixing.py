"""Mixing sources to target weights by hash-threshold histograms.

A document's hash of its id places it on a line of 2**60 points. Per source, words are summed by hash bucket; the
bucket in which the running sum crosses the source's budget is refined by the next bits until it holds a single hash,
which gives a threshold: documents below it are taken once more than the others. Nothing is sorted by document, the
same id falls on the same side whatever the budget (a smaller budget takes a subset), and reruns agree.

A source whose target is r times its size takes every document floor(r) times and those under the threshold once more.

Sums run by (source, bucket) with map-side combination, so a source with a third of all rows costs no more than others.
The budgets live in one row per source and join as a normal table.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its own, ordered last; repeated
rows have one hash and go together; an empty table gives an empty result; with no words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import column, cut, fresh, only, skew_lookup, table

HASH_BITS = 60
#: Bits of the hash settled in a round; five rounds settle all.
ROUND_BITS = 12
CAP = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    """The number of runs of characters other than blank and 0x09-0x0D."""
    clean = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(clean, r"[\x20\x09-\x0D]+", "")).cast("long")


def doc_hash(key: Column) -> Column:
    """60 bits of an MD5, which other engines can compute as well."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, cap: int = CAP) -> DataFrame:
    """_src, _total, _rows and _num/_den (target = _num/_den words) of each source from (_src, _total, _rows).

    Weights run 1, 2, 3 over the sources by code point, null last. A target stops at cap times the source's size and
    the excess is shared again by weight: sources that reach their cap at the common level are fixed there, and what is
    left makes the level of the others, until none is above. The sums are integers, without rounding before the one
    division. Sources may be as many as domains are: their places come from a range partitioning, the level from sums.
    """
    spark = totals.sparkSession
    part = cut(totals.repartitionByRange("_src").withColumn("_part", F.spark_partition_id()), "mix-sources")
    before, parts = 0, []
    for r in part.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row a partition
        parts.append((r[0], before))
        before += r[1]
    starts = spark.createDataFrame(parts, "_part int, _start long")
    # decimals: the products below outgrow 64 bits with many words and many sources
    dec = "decimal(38,0)"
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy("_src")) - 1
    w = part.join(F.broadcast(starts), "_part").select("_src", "_total", "_rows", (place % 3 + 1).cast(dec).alias("_w"))
    w = cut(w, "mix-weights", part)
    everything = [F.sum("_total").cast(dec), F.sum("_w").cast(dec)]
    num, den = w.agg(*everything).first()
    all_num, all_den, capped = num or 0, den or 0, F.lit(False)
    top = F.lit(cap) * F.col("_total")
    num, den = all_num, all_den
    while den:
        capped = F.lit(int(num)).cast(dec) * F.col("_w") >= top.cast(dec) * F.lit(int(den)).cast(dec)
        over, weight = w.where(capped).agg(F.sum(top).cast(dec), F.sum("_w").cast(dec)).first()
        now = all_num - (over or 0), all_den - (weight or 0)
        if now == (num, den):
            break
        num, den = now
    return w.select(
        "_src",
        "_total",
        "_rows",
        F.when(capped, top.cast(dec)).otherwise(F.lit(int(num)).cast(dec) * F.col("_w")).alias("_num"),
        F.when(capped, F.lit(1)).otherwise(F.lit(int(den or 1))).cast(dec).alias("_den"),
    )


def source_key(c: Column) -> Column:
    """A source as a string that is never null and sorts by code point, a null last."""
    return F.coalesce(F.concat(F.lit("a"), c.cast("string")), F.lit("b"))


def plan(sized: DataFrame) -> DataFrame:
    """(_src, _total, _rows, _target, _times, _below): each source's budget from rows (_src, _size, _h).

    Documents with _h < _below are taken _times + 1 times, the others _times.
    """
    totals = sized.groupBy("_src").agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows"))
    t = targets(totals)
    exact = F.when(F.col("_total") == 0, F.lit(0).cast("long")).otherwise(F.expr("_num div (_den * _total)"))
    state = t.withColumn("_times", exact).select(
        "_src",
        "_total",
        "_rows",
        (F.col("_num").cast("double") / F.col("_den").cast("double")).alias("_target"),
        "_times",
        # words still wanted after _times whole rounds, times _den, in integers
        (F.col("_num") - F.col("_times") * F.col("_total") * F.col("_den")).alias("_want"),
        "_den",
        F.lit(0).cast("long").alias("_prefix"),  # the boundary bucket so far
        F.lit(0).cast("long").alias("_sum"),  # words below it
        F.lit(True).alias("_open"),
        F.lit(0).cast("long").alias("_below"),
    )
    state = cut(state, "mix-state")
    for done in range(0, HASH_BITS, ROUND_BITS):
        shift = HASH_BITS - done - ROUND_BITS
        live = state.where("_open")
        if not live.head(1):
            break
        inside = sized
        if done:  # the key holds the bucket, so a hot source is no hot key
            edges = live.select(F.col("_src").alias("_src2"), F.col("_prefix").alias("_p2"))
            inside = sized.join(edges, (F.col("_src") == F.col("_src2")) & (F.shiftright("_h", shift + ROUND_BITS) == F.col("_p2")), "left_semi")
        hist = inside.groupBy("_src", F.shiftright("_h", shift).alias("_b")).agg(F.sum("_size").alias("_s"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        hist = hist.join(live.select("_src", "_sum", "_want", "_den"), "_src")
        # a source has at most 2**ROUND_BITS buckets
        run = Window.partitionBy("_src").orderBy("_b")
        hist = hist.withColumn("_before", F.col("_sum") + F.coalesce(F.sum("_s").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # the boundary: the first bucket whose end comes nearer to or beyond the middle of what is wanted
        crossing = hist.where((F.col("_before") + F.col("_s")) * F.col("_den") >= F.col("_want"))
        edge = crossing.groupBy("_src").agg(F.min(F.struct("_b", "_before", "_s", "_lo", "_hi")).alias("_e"))
        joined = state.join(edge, "_src", "left")
        single = F.col("_e._lo") == F.col("_e._hi")
        take_it = (F.lit(2) * F.col("_e._before") + F.col("_e._s")) * F.col("_den") <= F.lit(2) * F.col("_want")
        was = F.col("_open")
        state = cut(
            joined.select(
                "_src",
                "_total",
                "_rows",
                "_target",
                "_times",
                "_want",
                "_den",
                F.when(was & F.col("_e").isNotNull(), F.col("_e._b")).otherwise(F.col("_prefix")).alias("_prefix"),
                F.when(was & F.col("_e").isNotNull(), F.col("_e._before")).otherwise(F.col("_sum")).alias("_sum"),
                (was & F.col("_e").isNotNull() & ~single).alias("_open"),
                # without a crossing bucket all that is inside is wanted: every hash is below
                F.when(was & F.col("_e").isNull(), F.lit(1 << HASH_BITS))
                .when(was & single, F.col("_e._lo") + F.when(take_it, 1).otherwise(0))
                .otherwise(F.col("_below"))
                .alias("_below"),
            ),
            "mix-state",
            state,
        )
    return state.select("_src", "_total", "_rows", "_target", "_times", "_below")


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    words = word_count(F.coalesce(column(text).cast("string"), F.lit("")))
    return docs.select(column(key).alias("_key"), source_key(column(source)).alias("_src"), words.alias("_size"), doc_hash(column(key)).alias("_h"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken) for each row of docs."""
    sized = cut(_sized(docs, key, text, source), "mix-sizes")
    p = plan(sized)
    j = skew_lookup(sized, p, "_src", "_rows", "inner")
    copies = F.col("_times") + F.when(F.col("_h") < F.col("_below"), 1).otherwise(0)
    return j.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (copies * F.col("_size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs in the mixture: each row as many times as it is taken; the thresholds alone join, not the decisions."""
    sized = _sized(docs, key, text, source).drop("_key")
    sized = cut(sized, "mix-sizes")
    src, h, rows, times, below, n = (fresh(docs, x) for x in ("_src", "_mh", "_rows", "_times", "_below", "_n"))
    p = plan(sized).select(F.col("_src").alias(src), F.col("_rows").alias(rows), F.col("_times").alias(times), F.col("_below").alias(below))
    j = skew_lookup(docs.withColumns({h: doc_hash(column(key)), src: source_key(column(source))}), p, src, rows, "inner")
    copies = (F.col(times) + F.when(F.col(h) < F.col(below), 1).otherwise(0)).cast("int")
    return only(j.withColumn(n, F.explode(F.array_repeat(F.lit(1), copies))), docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
o AS (SELECT *, sum(total) OVER () - coalesce(sum({CAP} * total) OVER (ORDER BY {CAP} * total / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY {CAP} * total / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS den FROM w),
c AS (SELECT *, num * w >= {CAP} * total * den AS capped FROM o),
v AS (SELECT max(struct_pack(den := den, num := num)) AS l FROM c WHERE NOT capped),
t AS (SELECT source, total, (CASE WHEN capped THEN {CAP} * total ELSE l.num * w END)::BIGINT AS n, (CASE WHEN capped THEN 1 ELSE l.den END)::BIGINT AS m FROM c, v),
q AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE n // (m * total) END AS times FROM t),
g AS (SELECT d.source, h, sum(size)::BIGINT AS x FROM d GROUP BY ALL),
r AS (SELECT g.source, g.h, q.times, (2 * sum(x) OVER (PARTITION BY g.source ORDER BY h) - x) * m <= 2 * (n - times * total * m) AS more FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source)
SELECT d.doc_id, d.size, q.total AS source_size, q.n::DOUBLE / q.m::DOUBLE AS target, ((q.times + r.more::INT) * d.size)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h
"""
