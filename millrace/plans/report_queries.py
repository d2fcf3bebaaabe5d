"""Reports: grouped totals, gates, evaluation metrics, set cover."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import report as R
from ..operators import select as S
from . import policy_queries as pq
from .fixtures import RECORDS, counted, records, squeeze_sql, table, values


def corpus_report(spark, d):
    """Bytes, documents and shortfall per category against targets; complete within a thousandth."""
    targets = values(spark, "SELECT * FROM (VALUES ('code', 800000L), ('documentation', 700000L), ('english', 900000L), ('tool', 1000L)) AS t(category, target)")
    a = counted(records(spark, d)).groupBy("category").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"), F.countDistinct("repository").alias("repositories"))
    j = targets.join(a, "category", "left").fillna(0, ["docs", "bytes", "repositories"])
    short = F.greatest(F.lit(0), F.col("target") - F.col("bytes"))
    return j.select("category", "target", "docs", "bytes", "repositories", short.cast("long").alias("shortfall"), (short == 0).alias("exact_complete"), (short <= F.col("target") * 0.001).alias("complete"))


def rejection_histogram(spark, d):
    """Counts by the part of a reason before its colon, with the first example's path."""
    r = records(spark, d).withColumn("reason", F.when(F.col("license") != "OWNED", F.concat(F.lit("license:"), "license")).when(F.octet_length("text") < 200, "too_small"))
    return r.where("reason IS NOT NULL").groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("docs"), F.min_by("path", "ord").alias("example"))


def grouping_sets_totals(spark, d):
    """Totals by source and by language in one pass."""
    sets = [[F.col("source")], [F.col("language")]]
    return counted(records(spark, d)).groupingSets(sets, "source", "language").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))


def fill_gate(spark, d):
    """Sources that miss their token target by more than a tenth."""
    a = counted(records(spark, d)).groupBy("source").agg(F.sum("tokens").alias("tokens"))
    short = (F.lit(20_000) - F.col("tokens")) / F.lit(20_000)
    return a.select("source", "tokens", short.alias("shortfall")).where("shortfall > 0.1")


def curriculum_audit(spark, d):
    """Duplicates apart from replays, unknown languages, planted secrets, and the share of replayed tokens."""
    r = counted(records(spark, d)).withColumns({"replay": F.col("source").isin("src5", "src6"), "h": T.sha(T.squeeze(F.col("text")))})
    native = F.when(~F.col("replay"), F.col("h"))
    return r.agg(
        F.count("*").alias("rows"),
        F.sum("tokens").alias("tokens"),
        (F.count(native) - F.count_distinct(native)).alias("duplicates"),
        F.count_if(~F.col("language").isin("en", "de")).alias("unknown"),
        F.count_if(F.col("text").rlike(pq.PLANTED)).alias("secrets"),
        (F.sum(F.when(F.col("replay"), F.col("tokens")).otherwise(0)) / F.sum("tokens")).alias("replay_fraction"),
    )


def tokenizer_efficiency(spark, d):
    """Bytes per token of two tokenizers by category, over a budget of bytes per category, and the change between them."""
    r = counted(records(spark, d)).withColumn("other", F.size(F.split(T.squeeze(F.col("text")), " ")).cast("long"))
    cut = S.with_before(r.drop("text"), F.col("bytes"), ["ord"], ["category"], "b").where("b < 300000")
    t, o = F.sum("tokens"), F.sum("other")
    return cut.groupBy("category").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"), t.alias("tokens"), o.alias("reference_tokens"), (F.sum("bytes") / t).alias("bytes_per_token"), ((t - o) / o).alias("token_change"))


def reason_shares(spark, d):
    """Rows and tokens per verdict and the share of all tokens."""
    r = counted(records(spark, d)).withColumn("verdict", F.when(F.col("tokens") < 100, "too small").when(F.col("license") != "OWNED", "license").otherwise("kept"))
    g = r.groupBy("verdict").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    return g.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))


def _outcomes(spark, d):
    """Labelled documents as samples of tasks: the source is the task, quality whether a sample is right."""
    l = table(spark, d, "labels").join(records(spark, d).select("ord", "source", "language"), F.col("doc_id") == F.col("ord"))
    return l.select("doc_id", F.col("source").alias("task"), F.col("language").alias("category"), (F.col("quality") == 1).alias("functional"), (F.col("toxic") == 0).alias("syntax"))


def pass_at_k(spark, d):
    """Unbiased pass@1, @5 and @10 per task."""
    t = _outcomes(spark, d).groupBy("task").agg(F.count("*").cast("int").alias("n"), F.count_if("functional").cast("int").alias("c"))
    return t.select("task", F.col("n").cast("long").alias("n"), F.col("c").cast("long").alias("c"), *(F.round(R.pass_at(F.col("n"), F.col("c"), k), 9).alias(f"pass_{k}") for k in (1, 5, 10)))


def suite_score(spark, d):
    """Mean pass@1 over tasks, tasks solved, syntax rate: overall and by category in one pass."""
    t = _outcomes(spark, d).groupBy("category", "task").agg(F.count("*").alias("n"), F.count_if("functional").alias("c"), F.count_if("syntax").alias("s"))
    return t.groupingSets([[], [F.col("category")]], "category").agg(F.count("*").alias("tasks"), F.round(F.avg(F.col("c") / F.col("n")), 9).alias("pass_1"), F.count_if(F.col("c") > 0).alias("solved"), (F.sum("s") / F.sum("n")).alias("syntax"))


def task_pass(spark, d):
    """Whether any sample of a task is right, and whether its first is."""
    return _outcomes(spark, d).groupBy("task").agg(F.bool_or("functional").alias("any_pass"), F.min_by("functional", "doc_id").alias("first_pass"))


def capability_summary(spark, d):
    """Rates by category with null where no row is eligible."""
    o = _outcomes(spark, d)
    rate = F.avg(F.when(F.col("syntax"), F.col("functional").cast("int")))
    return o.groupBy("category").agg(F.count("*").alias("samples"), F.avg(F.col("syntax").cast("int")).alias("syntax_rate"), rate.alias("functional_rate"))


BAKE = """SELECT * FROM (VALUES ('m1', 'pass', true, 10.5D), ('m1', 'fail', true, 9.5D), ('m1', 'toolchain_unavailable', false, CAST(NULL AS DOUBLE)), ('m2', 'toolchain_unavailable', true, CAST(NULL AS DOUBLE)), ('m3', 'pass', false, 4.0D), ('m3', 'timeout', true, 6.0D)) AS t(model, verdict, structured, tps)"""


def bakeoff_summary(spark, d):
    b = values(spark, BAKE)
    ok, n = F.count_if(F.col("verdict") == "pass"), F.count_if(F.col("verdict") != "toolchain_unavailable")
    return b.groupBy("model").agg(n.alias("eligible"), F.try_divide(ok, n).alias("pass_rate"), F.avg(F.col("structured").cast("int")).alias("structured_rate"), F.avg("tps").alias("mean_tps"))


def uniqueness(spark, d):
    """Ids that must be unique and are: pages by url, embeddings by id, conversation turns."""
    one = lambda df, what, *c: df.agg(F.lit(what).alias("what"), F.count("*").alias("rows"), F.count_distinct(*c).alias("keys"))
    return one(table(spark, d, "pages"), "pages", "url").unionByName(one(table(spark, d, "embeddings"), "embeddings", "vec_id")).unionByName(one(table(spark, d, "conversations"), "turns", "conv_id", "turn"))


def verdict_histogram(spark, d):
    o = _outcomes(spark, d)
    v = F.when(~F.col("syntax"), "syntax").when(F.col("functional"), "pass").otherwise("fail")
    return o.groupBy(v.alias("verdict")).agg(F.count("*").alias("samples"))


def bits_per_byte(spark, d):
    """Bits per byte from summed losses; the loss table here is two nats a token."""
    r = counted(records(spark, d)).groupBy("language").agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))
    return r.select("language", F.round(F.lit(2.0) * F.col("tokens") / (F.log(F.lit(2.0)) * F.col("bytes")), 9).alias("bpb"))


def plateau(spark, d):
    """Over daily mean event values: the best so far, and for how many days there was no gain of 0.5 (gaps and islands)."""
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return R.plateau(e, "day", "loss", 0.5)


def resume_counts(spark, d):
    """Samples still to be drawn per task, ten each: those that have a label are done."""
    done = _outcomes(spark, d).groupBy("task").agg(F.count("*").alias("done"))
    all_ = records(spark, d).select(F.col("source").alias("task")).distinct()
    return all_.join(done, "task", "left").select("task", F.greatest(F.lit(0), F.lit(10) - F.coalesce("done", F.lit(0))).cast("long").alias("todo"))


_FUNCS = (corpus_report, rejection_histogram, grouping_sets_totals, fill_gate, curriculum_audit, tokenizer_efficiency, reason_shares, pass_at_k, suite_score, task_pass, capability_summary, bakeoff_summary, uniqueness, verdict_histogram, bits_per_byte, plateau, resume_counts)
QUERIES = {f.__name__: f for f in _FUNCS}
_OUT = "o AS (SELECT l.doc_id, source AS task, lang AS category, quality = 1 AS functional, toxic = 0 AS syntax FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_pass = lambda k: f"round(CASE WHEN n < {k} THEN 'NaN'::DOUBLE WHEN n - c < {k} THEN 1.0 ELSE 1 - list_product([(1 - {k} / i::DOUBLE) FOR i IN range(n - c + 1, n + 1)]) END, 9) AS pass_{k}"
SQL = {
    "corpus_report": f"""WITH {RECORDS}, t AS (SELECT * FROM (VALUES ('code', 800000), ('documentation', 700000), ('english', 900000), ('tool', 1000)) AS t(category, target)),
 a AS (SELECT t.category, target::BIGINT AS target, count(ord) AS docs, coalesce(sum(bytes), 0)::BIGINT AS bytes, count(DISTINCT repository) AS repositories FROM t LEFT JOIN rec USING (category) GROUP BY ALL)
 SELECT *, greatest(0, target - bytes)::BIGINT AS shortfall, bytes >= target AS exact_complete, target - bytes <= target * 0.001 AS complete FROM a""",
    "rejection_histogram": f"WITH {RECORDS}, r AS (SELECT *, CASE WHEN license <> 'OWNED' THEN 'license:' || license WHEN bytes < 200 THEN 'too_small' END AS reason FROM rec) SELECT split_part(reason, ':', 1) AS reason, count(*) AS docs, arg_min(path, ord) AS example FROM r WHERE reason IS NOT NULL GROUP BY 1",
    "grouping_sets_totals": f"WITH {RECORDS} SELECT source, language, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM rec GROUP BY GROUPING SETS ((source), (language))",
    "fill_gate": f"WITH {RECORDS}, a AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM rec GROUP BY 1) SELECT *, (20000 - tokens) / 20000 AS shortfall FROM a WHERE (20000 - tokens) / 20000 > 0.1",
    "curriculum_audit": f"""WITH {RECORDS}, r AS (SELECT *, source IN ('src5', 'src6') AS replay FROM rec)
 SELECT count(*) AS rows, sum(tokens)::BIGINT AS tokens, count(*) FILTER (NOT replay) - count(DISTINCT sha256({squeeze_sql("text")})) FILTER (NOT replay) AS duplicates, count(*) FILTER (language NOT IN ('en', 'de')) AS unknown,
 count(*) FILTER (regexp_matches(text, '{pq.PLANTED}')) AS secrets, (sum(tokens) FILTER (replay))::BIGINT / sum(tokens)::BIGINT AS replay_fraction FROM r""",
    "tokenizer_efficiency": f"""WITH {RECORDS}, r AS (SELECT category, ord, bytes, tokens, len(string_split({squeeze_sql("text")}, ' '))::BIGINT AS other, coalesce(sum(bytes) OVER (PARTITION BY category ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM rec),
 g AS (SELECT category, count(*) AS docs, sum(bytes)::BIGINT AS bytes, sum(tokens)::BIGINT AS tokens, sum(other)::BIGINT AS reference_tokens FROM r WHERE b < 300000 GROUP BY 1) SELECT *, bytes / tokens AS bytes_per_token, (tokens - reference_tokens) / reference_tokens AS token_change FROM g""",
    "reason_shares": f"WITH {RECORDS}, g AS (SELECT CASE WHEN tokens < 100 THEN 'too small' WHEN license <> 'OWNED' THEN 'license' ELSE 'kept' END AS verdict, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM rec GROUP BY 1) SELECT *, tokens / (sum(tokens) OVER ())::BIGINT AS share FROM g",
    "pass_at_k": f"WITH {_OUT}, t AS (SELECT task, count(*) AS n, count(*) FILTER (functional) AS c FROM o GROUP BY 1) SELECT task, n, c, {_pass(1)}, {_pass(5)}, {_pass(10)} FROM t",
    "suite_score": f"WITH {_OUT}, t AS (SELECT category, task, count(*) AS n, count(*) FILTER (functional) AS c, count(*) FILTER (syntax) AS s FROM o GROUP BY ALL) SELECT category, count(*) AS tasks, round(avg(c / n), 9) AS pass_1, count(*) FILTER (c > 0) AS solved, sum(s)::BIGINT / sum(n)::BIGINT AS syntax FROM t GROUP BY GROUPING SETS ((), (category))",
    "task_pass": f"WITH {_OUT} SELECT task, bool_or(functional) AS any_pass, arg_min(functional, doc_id) AS first_pass FROM o GROUP BY 1",
    "capability_summary": f"WITH {_OUT} SELECT category, count(*) AS samples, avg(syntax::INT) AS syntax_rate, avg(functional::INT) FILTER (syntax) AS functional_rate FROM o GROUP BY 1",
    "bakeoff_summary": f"WITH t AS ({BAKE.replace('D)', '::DOUBLE)').replace('D,', '::DOUBLE,')}) SELECT model, count(*) FILTER (verdict <> 'toolchain_unavailable') AS eligible, CASE WHEN count(*) FILTER (verdict <> 'toolchain_unavailable') > 0 THEN count(*) FILTER (verdict = 'pass') / count(*) FILTER (verdict <> 'toolchain_unavailable') END AS pass_rate, avg(structured::INT) AS structured_rate, avg(tps) AS mean_tps FROM t GROUP BY 1",
    "uniqueness": "SELECT 'pages' AS what, count(*) AS rows, count(DISTINCT url) AS keys FROM pages UNION ALL SELECT 'embeddings', count(*), count(DISTINCT vec_id) FROM embeddings UNION ALL SELECT 'turns', count(*), count(DISTINCT (conv_id, turn)) FROM conversations",
    "verdict_histogram": f"WITH {_OUT} SELECT CASE WHEN NOT syntax THEN 'syntax' WHEN functional THEN 'pass' ELSE 'fail' END AS verdict, count(*) AS samples FROM o GROUP BY 1",
    "bits_per_byte": f"WITH {RECORDS}, r AS (SELECT language, sum(tokens)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes FROM rec GROUP BY 1) SELECT language, round(2.0::DOUBLE * tokens / (ln(2.0::DOUBLE) * bytes), 9) AS bpb FROM r",
    "plateau": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS loss FROM events GROUP BY 1), b AS (SELECT *, min(loss) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM e),
 g AS (SELECT *, sum((was IS NULL OR loss < was - 0.5)::INT) OVER (ORDER BY day) AS island FROM b) SELECT day, loss, least(loss, coalesce(was, loss)) AS best, (row_number() OVER (PARTITION BY island ORDER BY day) - 1)::BIGINT AS stale FROM g""",
    "resume_counts": f"WITH {_OUT}, x AS (SELECT task, count(*) AS done FROM o GROUP BY 1) SELECT DISTINCT source AS task, greatest(0, 10 - coalesce(done, 0))::BIGINT AS todo FROM documents LEFT JOIN x ON source = task",
}
