"""Smaller rules: language buckets, acceptance cascades, lookups with a fallback, completions' verdicts, framing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import examples as X
from ..operators import select as S
from .fixtures import RECORDS, counted, records, squeeze_sql, table, values


def replay_strip(spark, d):
    r = values(spark, "SELECT * FROM (VALUES ('a/b/replay-3'), ('a/replay-x'), ('replay-1'), ('c/replay-12')) AS t(repository)")
    return r.select("repository", F.regexp_replace("repository", r"/replay-[0-9]+$", "").alias("base"))


WANTED = "SELECT * FROM (VALUES ('m:7b'), ('m'), ('q:1b'), ('zz:3')) AS t(name)"
MODELS = "SELECT * FROM (VALUES ('m:7b', 1), ('m', 2), ('q', 3)) AS t(name, id)"


def name_fallback(spark, d):
    """A lookup by the exact name, else by the part before the colon, else the default 0."""
    w, m = values(spark, WANTED), values(spark, MODELS)
    exact = w.join(m.withColumnRenamed("id", "exact"), "name", "left").withColumn("base", F.split_part("name", F.lit(":"), F.lit(1)))
    return exact.join(m.select(F.col("name").alias("base"), F.col("id").alias("by_base")), "base", "left").select("name", F.coalesce("exact", "by_base", F.lit(0)).alias("id"))


def suffix_stop(spark, d):
    """The first substantial line of what follows a hole: where a completion is to stop."""
    r = records(spark, d)
    substantial = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 4)
    return r.select(F.col("ord").alias("doc_id"), F.try_element_at(substantial, F.lit(1)).alias("stop"))


def smoke_fractions(spark, d):
    """Shares of conversations' turns that end with a full stop, are short, and are the assistant's."""
    c = table(spark, d, "conversations")
    share = lambda x: F.avg(x.cast("int"))
    return c.groupBy("role").agg(F.count("*").alias("turns"), share(F.col("text").endswith(".")).alias("stopped"), share(F.length("text") < 200).alias("short"))


def round_robin(spark, d):
    """English and code drawn in batches of 16 so that the English share stays near 0.3: a fold over the batches' counts."""
    r = counted(records(spark, d)).select("ord", "tokens", (F.col("category") == "english").alias("eng"))
    w = Window.partitionBy("eng").orderBy("ord")
    b = r.withColumn("batch", F.floor((F.row_number().over(w) - 1) / 16)).groupBy("eng", "batch").agg(F.sum("tokens").alias("tokens"))

    def step(p: pd.DataFrame, s: dict) -> pd.DataFrame:
        for x in p.itertuples():
            s.setdefault(bool(x.eng), []).append(int(x.tokens))
        if p["last"].iloc[-1]:
            q, out, eng, total = {k: list(v) for k, v in s.items()}, [], 0, 0
            while q.get(True) or q.get(False):
                want = bool(q.get(True)) and (eng < 0.3 * max(1, total) or not q.get(False))
                n = q[want].pop(0)
                out.append((len(out), want, n))
                total, eng = total + n, eng + n * want
            return pd.DataFrame(out, columns=["place", "english", "tokens"])
        return pd.DataFrame({"place": [], "english": [], "tokens": []}).astype({"place": int, "english": bool, "tokens": int})

    n = b.withColumn("last", F.lead("batch").over(Window.orderBy("eng", "batch")).isNull())
    return S.ordered_fold(n, ["eng", "batch"], step, "place long, english boolean, tokens long")


def frame_budget(spark, d):
    """Documents with repository and file marks and what is left of a block of 512 for their text."""
    words = lambda c: F.size(F.split(T.squeeze(c), "[ /]"))
    fixed = words(F.col("repository")) + words(F.col("path"))
    return records(spark, d).select(F.col("ord").alias("doc_id"), (F.lit(513 - 3 - 4) - fixed).cast("long").alias("budget"), F.concat(F.lit("<|repo|>"), "repository", F.lit("<|file|>"), "path").alias("head"))


def synthetic_rows(spark, d):
    """Uniform ids by hash: row i and place j give the same id in every run."""
    at = F.sequence(F.lit(0), F.lit(15))
    ids = F.transform(at, lambda j: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), j.cast("string"))), 1, 8), 16, 10).cast("long") % 1000)
    return spark.range(100).select("id", F.array_join(ids, " ").alias("ids"))


def task_digest(spark, d):
    """A task's digest over its squeezed, lower-case parts."""
    b = table(spark, d, "benchmark")
    return b.select("item_id", T.sha(F.concat_ws("\n", F.lit("v1"), T.normal(F.col("text")), T.slug(F.col("text")))).alias("digest"))


_FUNCS = (replay_strip, name_fallback, suffix_stop, smoke_fractions, round_robin, frame_budget, synthetic_rows, task_digest)
QUERIES = {f.__name__: f for f in _FUNCS}
SQL = {
    "replay_strip": "SELECT repository, regexp_replace(repository, '/replay-[0-9]+$', '') AS base FROM (VALUES ('a/b/replay-3'), ('a/replay-x'), ('replay-1'), ('c/replay-12')) AS t(repository)",
    "name_fallback": f"SELECT w.name, coalesce(a.id, b.id, 0) AS id FROM ({WANTED}) w LEFT JOIN ({MODELS}) a ON w.name = a.name LEFT JOIN ({MODELS}) b ON split_part(w.name, ':', 1) = b.name",
    "suffix_stop": "SELECT doc_id, [x FOR x IN [trim(y, ' ') FOR y IN string_split(text, chr(10))] IF length(x) >= 4][1] AS stop FROM documents",
    "smoke_fractions": "SELECT role, count(*) AS turns, avg((text LIKE '%.')::INT) AS stopped, avg((length(text) < 200)::INT) AS short FROM conversations GROUP BY 1",
    "frame_budget": f"WITH {RECORDS} SELECT ord AS doc_id, 506 - len(string_split_regex(repository, '[ /]')) - len(string_split_regex(path, '[ /]')) AS budget, '<|repo|>' || repository || '<|file|>' || path AS head FROM rec",
    "synthetic_rows": "SELECT id, array_to_string([('0x' || substr(md5(id || ':' || j), 1, 8))::BIGINT % 1000 FOR j IN range(16)], ' ') AS ids FROM range(100) t(id)",
    "task_digest": rf"SELECT item_id, sha256(concat_ws(chr(10), 'v1', lower({squeeze_sql('text')}), substr(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80))) AS digest FROM benchmark",
}
