"""Quotas, caps, interleaving, packing, orders, limits and set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import select as S
from .fixtures import RECORDS, counted, fraction_sql, records, table, values


def quota_prefix(spark, d):
    """Documents of each category in order while the bytes before them are under the category's target."""
    target = F.when(F.col("category") == "code", 300_000).when(F.col("category") == "english", 200_000).otherwise(100_000)
    return S.quota_prefix(counted(records(spark, d)).drop("text"), "bytes", "category", target, ["ord"]).select(F.col("ord").alias("doc_id"), "category", "bytes")


def language_quota(spark, d):
    """The same by language, with the target of 'other' for languages that have none of their own."""
    targets = values(spark, "SELECT * FROM (VALUES ('en', 400000L), ('de', 50000L), ('other', 20000L)) AS t(language, target)")
    r = counted(records(spark, d)).drop("text").join(targets, "language", "left").withColumn("target", F.coalesce("target", F.lit(20_000)))
    return S.quota_prefix(r, "bytes", "language", F.col("target"), ["ord"]).select(F.col("ord").alias("doc_id"), "language")


def repository_cap(spark, d):
    """Documents that still fit their repository's cap; a later, smaller one may fit when an earlier did not.

    The repositories are independent of each other: a fold per repository over (order, size).
    """

    def step(b: pd.DataFrame, used: dict) -> pd.DataFrame:
        ok = []
        for repo, n in zip(b["repository"], b["bytes"]):
            fits = used.get(repo, 0) + n <= 60_000
            ok.append(fits)
            used[repo] = used.get(repo, 0) + (n if fits else 0)
        return pd.DataFrame({"doc_id": b["ord"], "accepted": ok})

    r = counted(records(spark, d)).select("ord", "repository", "bytes")
    return S.keyed_fold(r, "repository", ["ord"], step, "doc_id long, accepted boolean")


def collector_fold(spark, d):
    """All stateful reasons at once, in order: repository quota, quota, exact and normalized duplicate."""
    r = counted(records(spark, d)).select("ord", "repository", "category", "bytes", T.sha(F.col("text")).alias("e"), T.sha(T.normal(F.col("text"))).alias("n"))

    def step(b: pd.DataFrame, s: dict) -> pd.DataFrame:
        repo, cat, seen_e, seen_n = (s.setdefault(k, v) for k, v in (("r", {}), ("c", {}), ("e", set()), ("n", set())))
        out = []
        for x in b.itertuples():
            if repo.get(x.repository, 0) + x.bytes > 100_000:
                out.append("repository_quota")
            elif cat.get(x.category, 0) >= 500_000:
                out.append("quota")
            elif x.e in seen_e:
                out.append("exact_duplicate")
            elif x.n in seen_n:
                out.append("normalized_duplicate")
            else:
                out.append("accepted")
                seen_e.add(x.e)
                seen_n.add(x.n)
                repo[x.repository] = repo.get(x.repository, 0) + x.bytes
                cat[x.category] = cat.get(x.category, 0) + x.bytes
        return pd.DataFrame({"doc_id": b["ord"], "reason": out})

    return S.ordered_fold(r, ["ord"], step, "doc_id long, reason string")


def document_cap(spark, d):
    """At most 30 documents of a (source, repository), but for the exempt."""
    r = records(spark, d)
    return S.top_per(r, "repository", 30, ["ord"]).where(F.col("source") != "src3").unionByName(r.where(F.col("source") == "src3")).select(F.col("ord").alias("doc_id"), "repository")


def family_topk(spark, d):
    """Ten of each repository by priority, then by priority overall until the tokens reach the target."""
    r = counted(records(spark, d)).withColumn("priority", T.sha(F.concat_ws(":", F.lit("5"), "path"))).drop("text")
    return S.quota_prefix(S.top_per(r, "repository", 10, ["priority"]), "tokens", None, F.lit(30_000), ["priority"]).select(F.col("ord").alias("doc_id"), "repository", "tokens")


def pool_select(spark, d):
    """Pools in a fixed order with one set of seen texts: by priority, no text twice, stop at the pool's tokens."""
    r = counted(records(spark, d)).withColumn("priority", T.sha(F.concat_ws(":", F.lit("9"), "path")))
    r = r.select("ord", "tokens", "priority", T.sha(T.squeeze(F.col("text"))).alias("h"), F.when(F.col("category") == "code", 0).when(F.col("category") == "english", 1).otherwise(2).alias("pool"))

    def step(b: pd.DataFrame, s: dict) -> pd.DataFrame:
        seen, got = s.setdefault("seen", set()), s.setdefault("got", {})
        keep = []
        for x in b.itertuples():
            ok = got.get(x.pool, 0) < (40_000, 30_000, 20_000)[x.pool] and x.h not in seen
            keep.append(ok)
            if ok:
                seen.add(x.h)
                got[x.pool] = got.get(x.pool, 0) + x.tokens
        return pd.DataFrame({"doc_id": b["ord"], "pool": b["pool"], "keep": keep})[keep]

    return S.ordered_fold(r, ["pool", "priority"], step, "doc_id long, pool int, keep boolean").select("doc_id", "pool")


def teacher_replay(spark, d):
    """Rows times replays, in order of replay, until the tokens reach the target; the last may pass it."""
    r = counted(records(spark, d)).where(F.col("source") == "src4").select("ord", "repository", "tokens")
    rep = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("replay"))
    got = S.quota_prefix(rep, "tokens", None, F.lit(60_000), ["replay", "ord"])
    return got.select(F.col("ord").alias("doc_id"), "replay", F.when(F.col("replay") > 0, F.concat("repository", F.lit("/replay-"), "replay")).otherwise(F.col("repository")).alias("repository"))


def token_split(spark, d):
    """Whole documents: the first tokens to validation, the next to training, the rest to neither."""
    r = S.with_before(counted(records(spark, d)).select("ord", "tokens"), F.col("tokens"), ["ord"], into="b")
    return r.select(F.col("ord").alias("doc_id"), F.when(F.col("b") < 20_000, "validation").when(F.col("b") < 200_000, "train").otherwise("unused").alias("part"))


def positional_cut(spark, d):
    """A 90/10 cut of the token stream by position: how many tokens of each document fall on each side."""
    r = S.with_before(counted(records(spark, d)).select("ord", "tokens"), F.col("tokens"), ["ord"], into="b")
    total = r.agg(F.floor(F.sum("tokens") * 0.9).cast("long").alias("cut"))
    left = F.least(F.greatest(F.col("cut") - F.col("b"), F.lit(0)), F.col("tokens"))
    return r.crossJoin(total).select(F.col("ord").alias("doc_id"), left.cast("long").alias("train"), (F.col("tokens") - left).cast("long").alias("held"))


_WEIGHT = "CASE source WHEN 'src0' THEN 4.0 WHEN 'src1' THEN 2.0 ELSE 1.0 END"


def token_share_mix(spark, d):
    """The order of a mix by weight: a global sort by emitted tokens over weight equals the step-by-step choice."""
    r = counted(records(spark, d)).select("ord", "source", "tokens", F.expr(_WEIGHT).cast("double").alias("weight"))
    return S.with_rank(S.interleave(r, "tokens", "source", "weight", ["ord"]), ["at", "source"], "position").select(F.col("ord").alias("doc_id"), "position")


def budget_split(spark, d):
    """Native texts until 70 % of a budget, then others from the rows not used until the whole of it."""
    r = counted(records(spark, d)).select("ord", "tokens", T.sha(F.concat_ws(":", F.lit("3"), "path")).alias("h"))
    part = S.with_before(r, F.col("tokens"), ["h"], into="b").withColumn("part", F.when(F.col("b") < 70_000, "native").otherwise("pair"))
    return S.with_before(part, F.col("tokens"), ["h"], ["part"], "b2").where((F.col("part") == "native") | (F.col("b2") < 30_000)).select(F.col("ord").alias("doc_id"), "part")


def repeat_factor(spark, d):
    """How often a category is to be repeated for a share of 0.3, half to even, between 1 and 4; and its rows repeated."""
    t = counted(records(spark, d)).groupBy("category").agg(F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy())
    return t.select("category", "tokens", F.least(F.lit(4), F.greatest(F.lit(1), F.bround(F.lit(0.3) * (total - F.col("tokens")) / (F.lit(0.7) * F.col("tokens")), 0))).cast("int").alias("factor"))


def next_fit_pack(spark, d):
    """Next-fit rows of 513 tokens for each source's documents of at most that length."""
    r = counted(records(spark, d)).where(F.col("tokens").between(1, 513)).select("source", "ord", "tokens")
    return S.next_fit(r, "source", "ord", "tokens", 513).withColumnRenamed("ord", "doc_id")


def stride_sample(spark, d):
    return S.with_rank(records(spark, d).select("ord"), ["ord"], "rn").where(F.col("rn") % 80 == 0).select(F.col("ord").alias("doc_id"))


def stable_order(spark, d):
    """The seeded order of paths by hash, as ranks."""
    r = records(spark, d).select("ord", T.sha(F.concat_ws(":", F.lit("13"), F.col("path"))).alias("h"))
    return S.with_rank(r, ["h"], "place").select(F.col("ord").alias("doc_id"), "place")


def offset_limit(spark, d):
    """A page after a total order: skip 100, take 50."""
    return records(spark, d).orderBy("ord").offset(100).limit(50).select(F.col("ord").alias("doc_id"), "source")


def top_common(spark, d):
    """The fifteen most common event types and users; ties by name."""
    e = table(spark, d, "events")
    return e.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "user_id").limit(15)


def set_operations(spark, d):
    """(source, language) of documents with a license line and of labelled ones: in both, in the first alone, and in any."""
    r = records(spark, d)
    a = r.where("license <> 'OWNED'").select("source", "language")
    b = r.join(table(spark, d, "labels").select("doc_id").distinct(), F.col("ord") == F.col("doc_id"), "left_semi").select("source", "language")
    tag = lambda df, what: df.select(F.lit(what).alias("op"), "source", "language")
    return tag(a.intersect(b), "intersect").unionByName(tag(a.subtract(b), "except")).unionByName(tag(a.union(b).distinct(), "union"))


def split_leakage(spark, d):
    """Repositories on both sides of the split by repository: none."""
    r = records(spark, d).withColumn("v", T.seeded(17, F.col("repository")) < 0.2)
    return r.where("v").select("repository").intersect(r.where("NOT v").select("repository")).agg(F.count("*").alias("shared"))


def union_sources(spark, d):
    """Documents, pages and conversations as one corpus in the order of the sources."""
    docs = records(spark, d).select(F.lit(0).alias("rank"), F.col("ord").alias("id"), F.lit("documents").alias("origin"), "text")
    pages = table(spark, d, "pages").select(F.lit(1).alias("rank"), F.col("page_id").alias("id"), F.lit("pages").alias("origin"), F.col("html").alias("text"))
    conv = table(spark, d, "conversations").select(F.lit(2).alias("rank"), F.col("conv_id").alias("id"), F.lit("conversations").alias("origin"), "text")
    return docs.unionByName(pages).unionByName(conv).groupBy("rank", "origin").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def largest_remainder(spark, d):
    shares = values(spark, "SELECT * FROM (VALUES ('a', 0.35D, 0), ('b', 0.25D, 1), ('c', 0.2D, 2), ('d', 0.05D, 3), ('e', 0.05D, 4), ('f', 0.1D, 5)) AS t(name, share, rank)")
    return S.largest_remainder(shares, 37).select("name", F.col("allocated").cast("long").alias("allocated"))


_FUNCS = (quota_prefix, language_quota, repository_cap, collector_fold, document_cap, family_topk, pool_select, teacher_replay, token_split, positional_cut, token_share_mix, budget_split, repeat_factor, next_fit_pack, stride_sample, stable_order, offset_limit, top_common, set_operations, split_leakage, union_sources, largest_remainder)
QUERIES = {f.__name__: f for f in _FUNCS}
_sum = lambda c, part, order: f"coalesce(sum({c}) OVER ({f'PARTITION BY {part} ' if part else ''}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
SQL = {
    "quota_prefix": f"WITH {RECORDS}, q AS (SELECT *, {_sum('bytes', 'category', 'ord')} AS b FROM rec) SELECT ord AS doc_id, category, bytes FROM q WHERE b < CASE category WHEN 'code' THEN 300000 WHEN 'english' THEN 200000 ELSE 100000 END",
    "language_quota": f"WITH {RECORDS}, q AS (SELECT *, {_sum('bytes', 'language', 'ord')} AS b FROM rec) SELECT ord AS doc_id, language FROM q WHERE b < CASE language WHEN 'en' THEN 400000 WHEN 'de' THEN 50000 ELSE 20000 END",
    "repository_cap": f"""WITH RECURSIVE {RECORDS}, n AS (SELECT ord, repository, bytes, row_number() OVER (PARTITION BY repository ORDER BY ord) AS i FROM rec),
 f AS (SELECT n.*, CASE WHEN bytes <= 60000 THEN bytes ELSE 0 END AS used, bytes <= 60000 AS ok FROM n WHERE i = 1 UNION ALL
 SELECT n.ord, n.repository, n.bytes, n.i, CASE WHEN f.used + n.bytes <= 60000 THEN f.used + n.bytes ELSE f.used END, f.used + n.bytes <= 60000 FROM f JOIN n ON n.repository = f.repository AND n.i = f.i + 1)
 SELECT ord AS doc_id, ok AS accepted FROM f""",
    "document_cap": f"WITH {RECORDS} SELECT ord AS doc_id, repository FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY ord) AS rn FROM rec) WHERE rn <= 30 OR source = 'src3'",
    "family_topk": f"WITH {RECORDS}, p AS (SELECT *, sha256('5:' || path) AS pr FROM rec), t AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY pr) AS rn FROM p), q AS (SELECT *, {_sum('tokens', '', 'pr')} AS b FROM t WHERE rn <= 10) SELECT ord AS doc_id, repository, tokens FROM q WHERE b < 30000",
    "teacher_replay": f"WITH {RECORDS}, r AS (SELECT rec.*, replay FROM rec, range(5) t(replay) WHERE source = 'src4'), q AS (SELECT *, {_sum('tokens', '', 'replay, ord')} AS b FROM r) SELECT ord AS doc_id, replay::INT AS replay, CASE WHEN replay > 0 THEN repository || '/replay-' || replay ELSE repository END AS repository FROM q WHERE b < 60000",
    "token_split": f"WITH {RECORDS}, q AS (SELECT *, {_sum('tokens', '', 'ord')} AS b FROM rec) SELECT ord AS doc_id, CASE WHEN b < 20000 THEN 'validation' WHEN b < 200000 THEN 'train' ELSE 'unused' END AS part FROM q",
    "positional_cut": f"WITH {RECORDS}, q AS (SELECT ord, tokens, {_sum('tokens', '', 'ord')} AS b, floor(sum(tokens) OVER () * 0.9) AS cut FROM rec), l AS (SELECT *, least(greatest(cut - b, 0), tokens)::BIGINT AS l FROM q) SELECT ord AS doc_id, l AS train, tokens - l AS held FROM l",
    "token_share_mix": f"WITH {RECORDS}, q AS (SELECT *, {_sum('greatest(1, tokens)', 'source', 'ord')} / ({_WEIGHT})::DOUBLE AS emitted FROM rec) SELECT ord AS doc_id, row_number() OVER (ORDER BY emitted, source) AS position FROM q",
    "budget_split": f"WITH {RECORDS}, h AS (SELECT *, sha256('3:' || path) AS h FROM rec), q AS (SELECT *, {_sum('tokens', '', 'h')} AS b FROM h), p AS (SELECT *, CASE WHEN b < 70000 THEN 'native' ELSE 'pair' END AS part FROM q), s AS (SELECT *, {_sum('tokens', 'part', 'h')} AS b2 FROM p) SELECT ord AS doc_id, part FROM s WHERE part = 'native' OR b2 < 30000",
    "repeat_factor": f"WITH {RECORDS}, t AS (SELECT category, sum(tokens)::BIGINT AS tokens FROM rec GROUP BY 1) SELECT category, tokens, least(4, greatest(1, round_even(0.3 * (sum(tokens) OVER () - tokens) / (0.7 * tokens), 0)))::INT AS factor FROM t",
    "next_fit_pack": f"""WITH RECURSIVE {RECORDS}, n AS (SELECT ord, source, tokens, row_number() OVER (PARTITION BY source ORDER BY ord) AS i FROM rec WHERE tokens BETWEEN 1 AND 513),
 f AS (SELECT n.*, tokens AS used, 0::BIGINT AS row FROM n WHERE i = 1 UNION ALL SELECT n.ord, n.source, n.tokens, n.i, CASE WHEN f.used + n.tokens > 513 THEN n.tokens ELSE f.used + n.tokens END, f.row + (f.used + n.tokens > 513)::INT FROM f JOIN n ON n.source = f.source AND n.i = f.i + 1)
 SELECT source, ord AS doc_id, row FROM f""",
    "stride_sample": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn % 80 = 0",
    "stable_order": f"WITH {RECORDS} SELECT ord AS doc_id, row_number() OVER (ORDER BY sha256('13:' || path)) AS place FROM rec",
    "offset_limit": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100",
    "top_common": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type, user_id LIMIT 15",
    "set_operations": f"""WITH {RECORDS}, a AS (SELECT source, language FROM rec WHERE license <> 'OWNED'), b AS (SELECT source, language FROM rec WHERE ord IN (SELECT doc_id FROM labels))
 SELECT 'intersect' AS op, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'union', * FROM (SELECT * FROM a UNION SELECT * FROM b)""",
    "split_leakage": f"WITH {RECORDS}, v AS (SELECT repository, {fraction_sql("sha256('17:' || repository)")} < 0.2 AS v FROM rec) SELECT count(*) AS shared FROM (SELECT repository FROM v WHERE v INTERSECT SELECT repository FROM v WHERE NOT v)",
    "union_sources": "SELECT 0 AS rank, 'documents' AS origin, count(*) AS docs, sum(strlen(text))::BIGINT AS bytes FROM documents UNION ALL SELECT 1, 'pages', count(*), sum(strlen(html))::BIGINT FROM pages UNION ALL SELECT 2, 'conversations', count(*), sum(strlen(text))::BIGINT FROM conversations",
    "largest_remainder": """WITH t AS (SELECT *, share * 37 AS x FROM (VALUES ('a', 0.35::DOUBLE, 0), ('b', 0.25::DOUBLE, 1), ('c', 0.2::DOUBLE, 2), ('d', 0.05::DOUBLE, 3), ('e', 0.05::DOUBLE, 4), ('f', 0.1::DOUBLE, 5)) AS t(name, share, rank))
 SELECT name, (floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, rank) <= 37 - sum(floor(x)) OVER ())::INT)::BIGINT AS allocated FROM t""",
}
