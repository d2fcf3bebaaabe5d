"""Training-example transforms and text tools."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import examples as X
from .fixtures import fraction_sql, records, squeeze_sql, table, values


def fim_line(spark, d):
    """Whole-line holes by hash draws; the parts always give the text again."""
    r = records(spark, d).select("ord", "text")
    h = X.line_hole(F.col("text"), X.draw(1, F.col("ord"), 0), X.draw(1, F.col("ord"), 1))
    q = r.select("ord", "text", h.alias("h")).where("h IS NOT NULL")
    return q.select(F.col("ord").alias("doc_id"), F.length("h.prefix").cast("long").alias("prefix"), F.length("h.middle").cast("long").alias("middle"), F.length("h.suffix").cast("long").alias("suffix"), (F.concat("h.prefix", "h.middle", "h.suffix") == F.col("text")).alias("whole"))


def fim_random(spark, d):
    r = records(spark, d).select("ord", "text")
    h = X.random_hole(F.col("text"), X.draw(2, F.col("ord"), 0), X.draw(2, F.col("ord"), 1))
    q = r.select("ord", "text", h.alias("h")).where("h IS NOT NULL")
    return q.select(F.col("ord").alias("doc_id"), T.sha(F.col("h.prefix")).alias("prefix"), T.sha(F.col("h.middle")).alias("middle"), T.sha(F.col("h.suffix")).alias("suffix"))


def fim_encode(spark, d):
    """Code documents, two in five, with a hole; half of them prefix first."""
    r = records(spark, d).where((F.col("category") == "code") & (X.draw(3, F.col("ord"), 0) < 0.4))
    h = X.random_hole(F.col("text"), X.draw(3, F.col("ord"), 1), X.draw(3, F.col("ord"), 2))
    q = r.select("ord", h.alias("h"), (X.draw(3, F.col("ord"), 3) < 0.5).alias("psm")).where("h IS NOT NULL")
    return q.select(F.col("ord").alias("doc_id"), "psm", T.sha(X.fim_text(F.col("h"), F.col("psm"))).alias("encoded"))


def _words_as_ids(c):
    """Word lengths stand for token ids."""
    return F.transform(F.split(T.squeeze(c), " "), lambda w: F.length(w))


def label_mask(spark, d):
    """Rows of 64 with shifted labels from conversations: the first word of a turn is its prompt."""
    c = table(spark, d, "conversations").select("conv_id", "turn", _words_as_ids(F.col("text")).alias("ids"))
    x, y = X.shifted_labels(F.col("ids"), F.lit(2), 64, 0)
    q = c.select("conv_id", "turn", x.alias("x"), y.alias("y"))
    return q.select("conv_id", "turn", F.array_join("x", ",").alias("inputs"), F.array_join("y", ",").alias("labels"), F.size(F.filter("y", lambda v: v != X.IGNORE)).cast("long").alias("valid"))


def packing_stats(spark, d):
    return label_mask(spark, d).agg(F.count("*").alias("rows"), F.sum("valid").alias("valid"), (F.sum("valid") / (F.count("*") * 64)).alias("fraction"))


def sft_build(spark, d):
    """User turns with the assistant's next: skip long prompts, cut at 200 words, count what is learnt."""
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = lambda x: F.size(F.split(T.squeeze(x), " ")).cast("long")
    pairs = c.withColumns({"answer": F.lead("text").over(w), "by": F.lead("role").over(w)}).where("role = 'user' AND by = 'assistant'")
    return pairs.select("conv_id", "turn", n(F.col("text")).alias("prompt"), F.least(F.lit(200), n(F.col("text")) + n(F.col("answer"))).alias("total")).where("prompt < 150")


def chat_render(spark, d):
    """Conversations as sentinel-delimited transcripts."""
    c = table(spark, d, "conversations").withColumn("line", F.concat(F.lit("<|"), "role", F.lit("|>"), "text", F.lit("<|end|>")))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("x"))
    return g.select("conv_id", T.sha(F.array_join(F.transform("x", lambda y: y["line"]), "\n")).alias("transcript"))


ASKS = "SELECT * FROM (VALUES (1, 'Sort it', ''), (2, 'Add', '1 2'), (3, ' Trim ', '  ')) AS t(id, instruction, given)"


def prompt_template(spark, d):
    a = values(spark, ASKS)
    body = F.when(F.trim("given") != "", F.concat(F.lit("\n### Input:\n"), "given")).otherwise("")
    return a.select("id", F.concat(F.lit("### Instruction:\n"), "instruction", body, F.lit("\n### Response:\n")).alias("prompt"))


def chunking(spark, d):
    """Chunks of 2,000 characters, one row each."""
    r = records(spark, d).select("ord", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / 2000).cast("int")))).alias("i"))
    return r.select(F.col("ord").alias("doc_id"), F.col("i").cast("long").alias("chunk"), F.md5(F.substring("text", F.col("i") * 2000 + 1, F.lit(2000))).alias("digest"))


def strip_boilerplate(spark, d):
    """Pages without what stands before the body and after it, and without tags."""
    p = table(spark, d, "pages")
    body = F.regexp_extract("html", r"(?is)<body[^>]*>(.*)</body>", 1)
    return p.select("page_id", F.length(body).cast("long").alias("body_chars"), F.length(F.regexp_replace(body, "<[^>]*>", "")).cast("long").alias("text_chars"))


def slugs(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.slug(F.col("text")).alias("slug"))


def repetition(spark, d):
    """The ratio of distinct word 4-grams per document, and whether a long one has collapsed."""
    ws = F.split(T.squeeze(F.col("text")), " ")
    r = records(spark, d).select("ord", T.distinct_ngram_ratio(ws, 4).alias("ratio"), F.size(ws).alias("n"))
    return r.select(F.col("ord").alias("doc_id"), "ratio", ((F.col("ratio") < 0.4) & (F.col("n") >= 32)).alias("collapsed"))


def lr_schedule(spark, d):
    return spark.range(0, 1000, 50).select(F.col("id").alias("step"), F.round(X.learning_rate(F.col("id"), 100, 300, 1000, 6e-4, 6e-5), 12).alias("rate"))


def window_sample(spark, d):
    """A window of 32 words at a hash-drawn place of each longer document; shorter ones whole."""
    ws = F.split(T.squeeze(F.col("text")), " ")
    start = lambda w: F.lit(1) + F.floor(X.draw(4, F.col("ord"), 0) * (F.size(w) - 31)).cast("int")
    cut = T.bind(ws, lambda w: F.when(F.size(w) <= 32, w).otherwise(F.slice(w, start(w), 32)))
    return records(spark, d).select(F.col("ord").alias("doc_id"), F.md5(F.array_join(cut, " ")).alias("digest"))


def event_props(spark, d):
    """JSON properties parsed by a fixed schema; bad ones null."""
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


_FUNCS = (fim_line, fim_random, fim_encode, label_mask, packing_stats, sft_build, chat_render, prompt_template, chunking, strip_boilerplate, slugs, repetition, lr_schedule, window_sample, event_props)
QUERIES = {f.__name__: f for f in _FUNCS}
_dr = lambda seed, k, key="doc_id": fraction_sql(f"sha256('{seed}:' || {key} || ':{k}')")
_hole = lambda seed, i, j: f"""h AS (SELECT *, 1 + floor({_dr(seed, i)} * (length(text) - 1))::INT AS x, 1 + floor({_dr(seed, j)} * (length(text) - 2))::INT AS y0 FROM documents WHERE length(text) >= 8),
 g AS (SELECT *, CASE WHEN y0 >= x THEN y0 + 1 ELSE y0 END AS y FROM h), c AS (SELECT *, substr(text, 1, least(x, y)) AS p, substr(text, least(x, y) + 1, abs(x - y)) AS m, substr(text, greatest(x, y) + 1) AS s FROM g)"""  # noqa: E731
_ws = f"string_split({squeeze_sql('text')}, ' ')"
_ids = f"[length(w) FOR w IN {_ws}]"
_label = f"""c AS (SELECT conv_id, turn, {_ids} AS ids FROM conversations), y AS (SELECT conv_id, turn, [CASE WHEN i < len(ids) THEN ids[i + 1] ELSE 0 END FOR i IN range(64)] AS x, [CASE WHEN i + 1 < len(ids) AND i + 1 >= 2 THEN ids[i + 2] ELSE -100 END FOR i IN range(64)] AS y FROM c),
 l AS (SELECT conv_id, turn, array_to_string(x, ',') AS inputs, array_to_string(y, ',') AS labels, len([v FOR v IN y IF v <> -100])::BIGINT AS valid FROM y)"""
SQL = {
    "fim_line": f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$') AS ls FROM documents), a AS (SELECT *, len(ls) AS n, 1 + floor({_dr(1, 0)} * (len(ls) - 2))::INT AS st FROM t WHERE len(ls) >= 3),
 b AS (SELECT *, 1 + floor({_dr(1, 1)} * greatest(1, least(n - st - 1, greatest(1, n // 3))))::INT AS k FROM a), j AS (SELECT doc_id, text, array_to_string(ls[1:st], '') AS p, array_to_string(ls[st + 1:st + k], '') AS m, array_to_string(ls[st + k + 1:n], '') AS s FROM b)
 SELECT doc_id, length(p) AS prefix, length(m) AS middle, length(s) AS suffix, p || m || s = text AS whole FROM j""",
    "fim_random": f"WITH {_hole(2, 0, 1)} SELECT doc_id, sha256(p) AS prefix, sha256(m) AS middle, sha256(s) AS suffix FROM c WHERE {squeeze_sql('m')} <> ''",
    "fim_encode": f"WITH {_hole(3, 1, 2)}, e AS (SELECT *, {_dr(3, 3)} < 0.5 AS psm FROM c WHERE doc_id % 3 = 0 AND {_dr(3, 0)} < 0.4 AND {squeeze_sql('m')} <> '') SELECT doc_id, psm, sha256(CASE WHEN psm THEN '<|prefix|>' || p || '<|suffix|>' || s || '<|middle|>' || m ELSE '<|prefix|><|suffix|>' || s || '<|middle|>' || p || m END) AS encoded FROM e",
    "label_mask": f"WITH {_label} SELECT * FROM l",
    "packing_stats": f"WITH {_label} SELECT count(*) AS rows, sum(valid)::BIGINT AS valid, sum(valid)::BIGINT / (count(*) * 64) AS fraction FROM l",
    "sft_build": f"WITH p AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS by_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), n AS (SELECT conv_id, turn, len({_ws})::BIGINT AS prompt, len({_ws.replace('text', 'answer')})::BIGINT AS a FROM p WHERE role = 'user' AND by_role = 'assistant') SELECT conv_id, turn, prompt, least(200, prompt + a) AS total FROM n WHERE prompt < 150",
    "chat_render": "SELECT conv_id, sha256(string_agg('<|' || role || '|>' || text || '<|end|>', chr(10) ORDER BY turn)) AS transcript FROM conversations GROUP BY 1",
    "prompt_template": f"SELECT id, '### Instruction:' || chr(10) || instruction || CASE WHEN trim(given) <> '' THEN chr(10) || '### Input:' || chr(10) || given ELSE '' END || chr(10) || '### Response:' || chr(10) AS prompt FROM ({ASKS})",
    "chunking": "WITH c AS (SELECT doc_id, text, unnest(range(greatest(0, (length(text) - 1) // 2000) + 1)) AS chunk FROM documents) SELECT doc_id, chunk, md5(substr(text, chunk * 2000 + 1, 2000)) AS digest FROM c",
    "strip_boilerplate": "WITH b AS (SELECT page_id, regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) AS b FROM pages) SELECT page_id, length(b) AS body_chars, length(regexp_replace(b, '<[^>]*>', '', 'g')) AS text_chars FROM b",
    "slugs": r"SELECT item_id, substr(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS slug FROM benchmark",
    "repetition": f"WITH t AS (SELECT doc_id, {_ws} AS w FROM documents), g AS (SELECT doc_id, len(w) AS n, [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] AS g FROM t), r AS (SELECT doc_id, n, CASE WHEN n < 5 THEN 1.0::DOUBLE ELSE len(list_distinct(g)) / len(g) END AS ratio FROM g) SELECT doc_id, ratio, ratio < 0.4 AND n >= 32 AS collapsed FROM r",
    "lr_schedule": "WITH s AS (SELECT unnest(range(0, 1000, 50)) AS step) SELECT step, round(CASE WHEN step < 100 THEN 6e-4 * (step + 1) / 100 WHEN step < 400 THEN 6e-4 ELSE 6e-5 + 0.5 * (6e-4 - 6e-5) * (1 + cos(pi() * least(1.0, (step - 400) / 600))) END, 12) AS rate FROM s",
    "window_sample": f"WITH t AS (SELECT doc_id, {_ws} AS w FROM documents), s AS (SELECT *, 1 + floor({_dr(4, 0)} * (len(w) - 31))::INT AS a FROM t) SELECT doc_id, md5(array_to_string(CASE WHEN len(w) <= 32 THEN w ELSE w[a:a + 31] END, ' ')) AS digest FROM s",
    "event_props": "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props))::BIGINT AS n_keys FROM events",
}
