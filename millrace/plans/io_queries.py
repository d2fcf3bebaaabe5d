"""Sources, sinks and gates on the tables: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import examples as X
from ..operators import gates
from ..operators import select as S
from ..sources import readers, sinks
from ..storage import new_dir
from .fixtures import RECORDS, fraction_sql, records, table
from .program_queries import PROGRAMS, programs


def jsonl_round_trip(spark, d):
    """Documents as JSON lines, read by a strict reader with a fixed schema; a second write to the same place is refused."""
    path = new_dir(spark, "jsonl")
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    sinks.jsonl(docs, path)
    got = readers.required(readers.jsonl(spark, path, "doc_id long, text string, source string"), "doc_id", "source")
    return got.select("doc_id", F.md5("text").alias("digest"), "source")


def jsonl_lenient(spark, d):
    """Lines of French documents are cut off in the middle: a lenient reader leaves them out."""
    path = new_dir(spark, "lines")
    line = F.to_json(F.struct("doc_id", "lang"))
    table(spark, d, "documents").select(F.when(F.col("lang") == "fr", F.concat(F.lit('{"doc_id": '), "doc_id")).otherwise(line).alias("value")).write.text(path)
    return readers.jsonl(spark, path, "doc_id long, lang string", strict=False).groupBy("lang").agg(F.count("*").alias("docs"))


def required_fields(spark, d):
    """Documents without a label lack a required field."""
    labels = table(spark, d, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"])
    j = gates.missing_fields(table(spark, d, "documents").join(labels, "doc_id", "left"), "text", "quality")
    return j.groupBy(F.coalesce("reason", F.lit("complete")).alias("reason")).agg(F.count("*").alias("docs"))


def repository_scan(spark, d):
    """A tree of files, one for each program, scanned in the seeded hash order of paths; skipped parts and unknown kinds go."""
    root = new_dir(spark, "tree")
    tree = programs(spark, d).select(F.concat_ws("/", F.when(F.col("form") == 5, "node_modules").otherwise("lib"), "id", "path").alias("path"), F.col("code").alias("text"))
    sinks.files(tree, root)
    r = readers.repository(spark, root, "tree", "OWNED", seed=3)
    return r.select("path", "category", "language", F.md5("text").alias("digest"), "ord")


def book_texts(spark, d):
    """Texts between markers, as books come, and the same without what stands around them."""
    t = table(spark, d, "documents").withColumn("text", F.concat(F.lit("by someone\n*** START OF THE BOOK ***\n"), "text", F.lit("\n*** END OF THE BOOK ***\nlicense")))
    return readers.book(t).select("doc_id", F.md5("text").alias("digest"))


def fallback_ids(spark, d):
    """Pages and documents under the first of several names that is filled."""
    pages = table(spark, d, "pages").select(F.lit("").alias("id"), "url", F.concat(F.lit("pages-"), "page_id").alias("place"))
    docs = table(spark, d, "documents").select(F.when(F.col("lang") == "en", F.col("source")).alias("id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("documents-"), "doc_id").alias("place"))
    return pages.unionByName(docs).select(readers.first_text("id", "url", "place").alias("repository")).groupBy("repository").agg(F.count("*").alias("rows"))


def language_stream(spark, d):
    """A source with a folder per language, of which two are read, each until it has 100,000 bytes."""
    root = new_dir(spark, "stack")
    r = records(spark, d).select("ord", "text", "language")
    r.write.partitionBy("language").parquet(root)
    got = readers.stack(spark, root, ["en", "de"], "ord long, text string, language string", 100_000)
    return got.where("origin IS NOT NULL AND written IS NOT NULL").select(F.col("ord").alias("doc_id"), "language")


def sample_writer(spark, d):
    """Documents in order until 500,000 characters are written, counted in what has been written."""
    path = new_dir(spark, "sample")
    r = table(spark, d, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n"))
    kept = S.quota_prefix(r.select("doc_id", "n"), "n", None, F.lit(500_000), ["doc_id"])
    sinks.jsonl(r.join(kept.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"), path)
    return readers.jsonl(spark, path, "doc_id long, text string").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"))


def token_stream(spark, d):
    """Turns' word lengths as a flat stream of 16-bit ids with an end id each, read back by its parts."""
    sinks.register(spark)
    path = new_dir(spark, "bin")
    ids = F.transform(F.split(T.squeeze(F.col("text")), " "), F.length)
    table(spark, d, "conversations").select(ids.alias("ids")).write.format("token_bin").mode("append").option("path", path).option("end", "60000").save()
    flat = readers.token_bin(spark, path).select(F.explode("ids").alias("id"))
    return flat.groupBy("id").agg(F.count("*").alias("n"))


def epoch_batches(spark, d):
    """Rows of the second epoch in its own order, in batches of 32; the last, partial one is left out. A cursor is a place."""
    key = T.sha(F.concat_ws(":", F.lit("11"), F.lit("2"), F.col("doc_id")))
    r = S.with_rank(table(spark, d, "documents").select("doc_id", key.alias("h")), ["h"], "place")
    n = r.agg((F.floor(F.count("*") / 32) * 32).alias("most"))  # one row
    return r.crossJoin(F.broadcast(n)).where(F.col("place") <= F.col("most")).select("doc_id", F.floor((F.col("place") - 1) / 32).alias("batch"), ((F.col("place") - 1) % 32).alias("slot"))


def generated_exercises(spark, d):
    """Ten exercises a document from templates, and how many of each template there are."""
    n = table(spark, d, "documents").count()
    return readers.generated_exercises(spark, 10 * n).groupBy("template").agg(F.count("*").alias("exercises"), F.count_distinct("solution").alias("solutions"))


def tool_transcripts(spark, d):
    """Synthetic tool calls, 768 for each language as a tool."""
    names = sorted(r[0] for r in table(spark, d, "documents").select("lang").distinct().collect())  # the tools
    return readers.generated_transcripts(spark, names).select("id", "tool", "text")


def rename_projection(spark, d):
    """The collector's own source and language in place of the upstream's, which stays under another name."""
    r = records(spark, d).withColumns({"upstream_source": F.col("source"), "source": F.concat(F.lit("curated/"), "category"), "language": F.upper("language")})
    return r.groupBy("source", "upstream_source", "language").agg(F.count("*").alias("docs"))


def scope_reasons(spark, d):
    """Reasons of rejection, parted into those that lie in the scope of a fix and those that don't."""
    r = records(spark, d)
    why = F.when(F.octet_length("text") < 200, "too_small").when(F.col("license") != "OWNED", "license").when(F.length("text") > 5000, "too_long")
    g = r.withColumn("reason", why).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("docs"))
    return g.withColumn("in_scope", F.col("reason").isin("too_long", "too_small"))


def suites_union(spark, d):
    """Two suites of tasks as one, each under its own name."""
    a = table(spark, d, "benchmark").select(F.lit("items").alias("suite"), F.col("item_id").cast("string").alias("task"), "text")
    b = table(spark, d, "conversations").where("role = 'user'").select(F.lit("turns").alias("suite"), F.concat_ws("-", "conv_id", "turn").alias("task"), "text")
    return a.unionByName(b).groupBy("suite").agg(F.count("*").alias("tasks"), F.count_distinct("text").alias("texts"))


def gate_values(spark, d):
    """The gates on the tables; each of them raises if it doesn't hold."""
    docs = table(spark, d, "documents")
    count = docs.count()
    by = {r[0]: r[1] / count for r in docs.groupBy("lang").count().collect()} if count else {"none": 1.0}
    gates.shares(by)
    gates.lineage({"output": d, "tasks": table(spark, d, "benchmark").count()}, d, 36)
    p = programs(spark, d)
    gates.disjoint(p.select("name"), table(spark, d, "benchmark").select(F.col("text").alias("name")), "name")
    joined = gates.required_join(table(spark, d, "labels"), docs.select("doc_id", "lang"), "doc_id")
    gates.canary(lambda x: x.select(T.squeeze(F.col("text"))), spark.createDataFrame([(" a \t b ",)], "text string"), [("a b",)])
    small = docs.where(F.octet_length("text") < 200).count()
    share = gates.drop_share(count, small, 0.25)
    return joined.agg(F.count("*").alias("labelled"), F.lit(float(share)).alias("small"), F.lit(float(sum(by.values()))).alias("shares"))


def stop_cut(spark, d):
    """Texts until the first of several stop strings, wherever it begins."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.until(F.col("text"), [". ", "\n\n", "<|end|>"])).alias("digest"))


def hole_select(spark, d):
    """A kind of hole by hash: half by lines, a quarter a block (prose has none), a quarter at random; what has no such hole gets a random one."""
    r = records(spark, d).select("ord", "text")
    h = X.any_hole(F.col("text"), 8, F.col("ord"))
    q = r.select("ord", h.alias("h")).where("h.hole IS NOT NULL")
    return q.select(F.col("ord").alias("doc_id"), F.col("h.kind").alias("kind"), T.sha(F.col("h.hole.prefix")).alias("prefix"), T.sha(F.col("h.hole.middle")).alias("middle"))


def character_fim(spark, d):
    """Character holes in texts of 40 characters or more that fit a block, an end mark after each; other texts stay as they are."""
    r = records(spark, d).select("ord", "text")
    h = X.random_hole(F.col("text"), X.draw(9, F.col("ord"), 1), X.draw(9, F.col("ord"), 2))
    fits = (F.length("text") >= 40) & (T.pretokens(F.col("text")) <= 1024 - 124)
    body = F.when(fits & F.col("h").isNotNull(), X.fim_text(F.col("h"), X.draw(9, F.col("ord"), 3) < 0.5)).otherwise(F.col("text"))
    return r.withColumn("h", h).select(F.col("ord").alias("doc_id"), F.md5(F.concat(body, F.lit("<|endoftext|>"))).alias("digest"))


def sft_batches(spark, d):
    """Inputs and labels of training rows, shifted by one, and a validation part by hash of the row."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split(T.squeeze(F.col("text")), " "), F.length).alias("ids"))
    val = X.draw(10, F.concat_ws("-", "conv_id", "turn"), 0) < 0.1
    x, y = F.slice("ids", 1, F.greatest(F.lit(0), F.size("ids") - 1)), F.slice("ids", 2, F.size("ids"))
    return c.select("conv_id", "turn", val.alias("validation"), F.array_join(x, " ").alias("x"), F.array_join(y, " ").alias("y"))


def packed_labels(spark, d):
    """Turns packed next-fit into rows of 129 ids, with inputs and labels of 128: padding and the last place are ignored."""
    c = table(spark, d, "conversations").select(F.lit("all").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.slice(F.transform(F.split(T.squeeze(F.col("text")), " "), F.length), 1, 129).alias("ids"))
    c = c.withColumns({"source": F.concat(F.lit("c"), F.floor(F.col("ord") / 1000) % 16), "n": F.size("ids").cast("long")})
    rows = S.next_fit(c, "source", "ord", "n", 129).withColumnRenamed("source", "s")
    j = c.join(rows, "ord").groupBy("source", "row").agg(F.array_sort(F.collect_list(F.struct("ord", "ids"))).alias("x"))  # a row holds at most 129 ids
    ids = F.flatten(F.transform("x", lambda v: v["ids"]))
    x, y = X.shifted_labels(ids, F.lit(1), 128, 0)
    return j.select("source", "row", F.md5(F.array_join(x, ",")).alias("inputs"), F.md5(F.array_join(y, ",")).alias("labels"))


_FUNCS = (jsonl_round_trip, jsonl_lenient, required_fields, repository_scan, book_texts, fallback_ids, language_stream, sample_writer, token_stream, epoch_batches, generated_exercises, tool_transcripts, rename_projection, scope_reasons, suites_union, gate_values, stop_cut, hole_select, character_fim, sft_batches, packed_labels)
QUERIES = {f.__name__: f for f in _FUNCS}

_SQ = r"trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
_IDS = f"[length(w) FOR w IN string_split({_SQ}, ' ')]"
_dr = lambda seed, k, key="doc_id": fraction_sql(f"sha256('{seed}:' || {key} || ':{k}')")
_before = lambda c, part, order: f"coalesce(sum({c}) OVER ({f'PARTITION BY {part} ' if part else ''}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_md = lambda what, n: f"('0x' || substr(md5('0{what}:' || id), 1, 8))::BIGINT % {n}"
_random = lambda seed, i, j: f"""x AS (SELECT *, 1 + floor({_dr(seed, i)} * (length(text) - 1))::INT AS x, 1 + floor({_dr(seed, j)} * (length(text) - 2))::INT AS y0 FROM documents),
 y AS (SELECT *, CASE WHEN y0 >= x THEN y0 + 1 ELSE y0 END AS y FROM x), c AS (SELECT *, substr(text, 1, least(x, y)) AS p, substr(text, least(x, y) + 1, abs(x - y)) AS m, substr(text, greatest(x, y) + 1) AS s FROM y),
 r AS (SELECT *, length(text) >= 8 AND {_SQ.replace("(text", "(m")} <> '' AS fine FROM c)"""  # noqa: E731
SQL = {
    "jsonl_round_trip": "SELECT doc_id, md5(text) AS digest, source FROM documents",
    "jsonl_lenient": "SELECT lang, count(*) AS docs FROM documents WHERE lang <> 'fr' GROUP BY 1",
    "required_fields": "SELECT CASE WHEN text IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL) THEN 'invalid_record' ELSE 'complete' END AS reason, count(*) AS docs FROM documents GROUP BY 1",
    "repository_scan": f"""WITH {PROGRAMS}, f AS (SELECT 'lib/' || id || '/' || path AS path, split_part(path, '.', -1) AS suffix, code FROM prog WHERE form <> 5)
 SELECT path, 'code' AS category, CASE suffix WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' ELSE 'c_cpp' END AS language, md5(code) AS digest, sha256('3:' || path) AS ord FROM f""",
    "book_texts": r"SELECT doc_id, md5(regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) AS digest FROM documents",
    "fallback_ids": "SELECT repository, count(*) AS rows FROM (SELECT url AS repository FROM pages UNION ALL SELECT CASE WHEN lang = 'en' THEN source ELSE 'documents-' || doc_id END FROM documents) GROUP BY 1",
    "language_stream": f"WITH q AS (SELECT doc_id, lang AS language, {_before('strlen(text)', 'lang', 'doc_id')} AS b FROM documents WHERE lang IN ('en', 'de')) SELECT doc_id, language FROM q WHERE b < 100000",
    "sample_writer": f"WITH q AS (SELECT text, {_before('length(text)', '', 'doc_id')} AS b FROM documents) SELECT count(*) AS docs, sum(length(text))::BIGINT AS chars FROM q WHERE b < 500000",
    "token_stream": f"SELECT id::INT AS id, count(*) AS n FROM (SELECT unnest(list_append({_IDS}, 60000)) AS id FROM conversations) GROUP BY 1",
    "epoch_batches": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('11:2:' || doc_id)) - 1 AS p, count(*) OVER () // 32 * 32 AS most FROM documents) SELECT doc_id, p // 32 AS batch, p % 32 AS slot FROM r WHERE p < most",
    "generated_exercises": f"""WITH i AS (SELECT unnest(range((SELECT 10 * count(*) FROM documents))) AS id), v AS (SELECT {_md("t", 3)} AS t, {_md("a", 50)} AS a, {_md("b", 50)} + 50 AS b FROM i),
 e AS (SELECT ['sum_of', 'repeat_word', 'in_range'][t + 1] AS template, t || ',' || a || ',' || b AS s FROM v) SELECT template, count(*) AS exercises, count(DISTINCT s) AS solutions FROM e GROUP BY 1""",
    "tool_transcripts": """SELECT id, tool, '<|user|>call ' || tool || ' for item ' || id || '<|tool_call|>{"x":' || (id * 37 % 101) || ',"y":' || (id * 53 % 97) || '}<|tool_result|>ok<|end|>' AS text FROM range(768) r(id), (SELECT DISTINCT lang AS tool FROM documents)""",
    "rename_projection": f"WITH {RECORDS} SELECT 'curated/' || category AS source, source AS upstream_source, upper(language) AS language, count(*) AS docs FROM rec GROUP BY ALL",
    "scope_reasons": f"WITH {RECORDS}, g AS (SELECT CASE WHEN bytes < 200 THEN 'too_small' WHEN license <> 'OWNED' THEN 'license' WHEN length(text) > 5000 THEN 'too_long' END AS reason, count(*) AS docs FROM rec GROUP BY 1) SELECT reason, docs, reason <> 'license' AS in_scope FROM g WHERE reason IS NOT NULL",
    "suites_union": "SELECT 'items' AS suite, count(*) AS tasks, count(DISTINCT text) AS texts FROM benchmark UNION ALL SELECT 'turns', count(*), count(DISTINCT text) FROM conversations WHERE role = 'user'",
    "gate_values": "SELECT (SELECT count(*) FROM labels) AS labelled, count(*) FILTER (strlen(text) < 200) / count(*) AS small, 1.0::DOUBLE AS shares FROM documents",
    "stop_cut": """WITH p AS (SELECT doc_id, text, least(CASE WHEN contains(text, '. ') THEN strpos(text, '. ') ELSE 1e9 END, CASE WHEN contains(text, chr(10) || chr(10)) THEN strpos(text, chr(10) || chr(10)) ELSE 1e9 END, CASE WHEN contains(text, '<|end|>') THEN strpos(text, '<|end|>') ELSE 1e9 END) AS stop FROM documents)
 SELECT doc_id, md5(CASE WHEN stop < 1e9 THEN left(text, stop::INT - 1) ELSE text END) AS digest FROM p""",
    "hole_select": f"""WITH {_random(8, 3, 4)}, l AS (SELECT *, {_dr(8, 0)} AS d, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+$') AS ls FROM r), a AS (SELECT *, len(ls) AS n, 1 + floor({_dr(8, 1)} * (len(ls) - 2))::INT AS st FROM l),
 b AS (SELECT *, d < 0.5 AND n >= 3 AS by_line, 1 + floor({_dr(8, 2)} * greatest(1, least(n - st - 1, greatest(1, n // 3))))::INT AS k FROM a)
 SELECT doc_id, CASE WHEN by_line THEN 'line' ELSE 'random' END AS kind, sha256(CASE WHEN by_line THEN array_to_string(ls[1:st], '') ELSE p END) AS prefix, sha256(CASE WHEN by_line THEN array_to_string(ls[st + 1:st + k], '') ELSE m END) AS middle FROM b WHERE by_line OR fine""",
    "character_fim": f"""WITH {_random(9, 1, 2)}, f AS (SELECT *, fine AND length(text) >= 40 AND len(regexp_extract_all(text, '[A-Za-z_]+|[0-9]+|[^\\sA-Za-z_0-9]')) <= 900 AS hole FROM r)
 SELECT doc_id, md5(CASE WHEN NOT hole THEN text WHEN {_dr(9, 3)} < 0.5 THEN '<|prefix|>' || p || '<|suffix|>' || s || '<|middle|>' || m ELSE '<|prefix|><|suffix|>' || s || '<|middle|>' || p || m END || '<|endoftext|>') AS digest FROM f""",
    "sft_batches": f"WITH c AS (SELECT conv_id, turn, {_IDS} AS ids FROM conversations) SELECT conv_id, turn, {fraction_sql("sha256('10:' || conv_id || '-' || turn || ':0')")} < 0.1 AS validation, array_to_string(ids[1:len(ids) - 1], ' ') AS x, array_to_string(ids[2:], ' ') AS y FROM c",
    "packed_labels": f"""WITH RECURSIVE c AS (SELECT 'c' || (conv_id % 16) AS source, conv_id * 1000 + turn AS ord, {_IDS}[1:129] AS ids FROM conversations), n AS (SELECT *, len(ids) AS n, row_number() OVER (PARTITION BY source ORDER BY ord) AS i FROM c),
 f AS (SELECT source, ord, ids, i, n AS used, 0::BIGINT AS row FROM n WHERE i = 1 UNION ALL SELECT n.source, n.ord, n.ids, n.i, CASE WHEN f.used + n.n > 129 THEN n.n ELSE f.used + n.n END, f.row + (f.used + n.n > 129)::INT FROM f JOIN n ON n.source = f.source AND n.i = f.i + 1),
 g AS (SELECT source, row, flatten(list(ids ORDER BY ord)) AS ids FROM f GROUP BY ALL)
 SELECT source, row, md5(array_to_string([CASE WHEN k <= len(ids) THEN ids[k] ELSE 0 END FOR k IN range(1, 129)], ',')) AS inputs, md5(array_to_string([CASE WHEN k < len(ids) THEN ids[k + 1] ELSE -100 END FOR k IN range(1, 129)], ',')) AS labels FROM g""",
}
