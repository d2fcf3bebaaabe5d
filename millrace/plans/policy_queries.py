"""Row-local policy, path, license and language rules, hash samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions import text as T
from ..storage import cut
from .fixtures import RECORDS, counted, fraction_sql, normal_sql, records, squeeze_sql, table, values

PLANTED = r'token = "[0-9a-f]{40}"'
LIM = P.LIMITS
_LINES = r"[strlen(x) FOR x IN regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')]"
_REASON = f"""CASE WHEN category NOT IN ('code','documentation','english','structured','tool') THEN 'unknown_category'
  WHEN bytes < {LIM["low"]} THEN 'too_small' WHEN bytes > {LIM["high"]} THEN 'too_large' WHEN contains(text, chr(0)) THEN 'binary'
  WHEN regexp_matches(lower(substr(text, 1, 4096)), '{P.MARKERS}') THEN 'generated'
  WHEN regexp_matches(text, '{"|".join(P.SECRETS)}|{PLANTED}') THEN 'secret'
  WHEN list_max({_LINES}) > 2000 THEN 'long_line'
  WHEN length(regexp_replace(text, '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}\\p{{Zl}}\\p{{Zp}}]', '', 'g')) + length(regexp_replace(text, '[^\\n\\r\\t]', '', 'g')) < {LIM["printable"]} * greatest(1, length(text)) THEN 'low_printable_fraction'
  WHEN license NOT IN ({", ".join(f"'{x}'" for x in P.ALLOWED)}) THEN 'license' END"""


def _reason():
    return P.row_reason(limits={"line": 2000}, extra_secrets=[PLANTED])


def policy_reasons(spark, d):
    return records(spark, d).select(F.col("ord").alias("doc_id"), _reason().alias("reason"))


def policy_report(spark, d):
    """Rows and bytes by language and first reject reason, dedup reasons last, over what the row-local rules leave."""
    fine = lambda x: F.when(F.col("reason").isNull(), x)
    r = records(spark, d).withColumn("reason", _reason()).select("ord", "language", "reason", F.octet_length("text").cast("long").alias("bytes"), fine(T.sha(F.col("text"))).alias("e"), fine(T.sha(T.normal(F.col("text")))).alias("n"))
    r = cut(r, "policy")  # the texts are read once, the rest runs on narrow rows
    left = r.where(F.col("reason").isNull())
    firsts = left.groupBy("e").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("fe"))
    firstn = left.groupBy("n").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("fn"))
    dup = F.when(F.col("fe").isNull(), "exact_duplicate").when(F.col("fn").isNull(), "normalized_duplicate").otherwise("accepted")
    kept = left.join(firsts, "ord", "left").join(firstn, "ord", "left").select("language", "bytes", dup.alias("reason"))
    both = kept.unionByName(r.where(F.col("reason").isNotNull()).select("language", "bytes", "reason"))
    return both.groupBy("language", "reason").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))


PATHS = """SELECT * FROM (VALUES ('src/a.py'), ('web/App.TSX'), ('README'), ('Docs/guide.MD'), ('changelog.2'), ('a/Dockerfile'), ('x/package.json'), ('lib/k.kts'),
  ('noext'), ('.gitignore'), ('node_modules/x.js'), ('a/.venv-3/b.py'), ('env-x/b.c'), ('go.sum'), ('sub/Cargo.lock'), ('s/run.sh'), ('a/b.rb'), ('t.sql'), ('x.go'), ('Data/y.rs'), ('z.tar.gz')) AS t(path)"""
_CODE_CASE = "CASE s " + " ".join(f"WHEN '{s}' THEN '{lang}'" for s, lang in P.SUFFIX.items()) + " END"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_LANG_CASE = lambda c: f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.ALIASES.items()) + " ELSE 'other' END"


def classify_path(spark, d):
    cat, lang = P.classify(F.col("path"))
    return values(spark, PATHS).select("path", cat.alias("category"), lang.alias("language"), P.skipped(F.col("path")).alias("skipped"))


NAMES = "SELECT * FROM (VALUES ('Python'), (' C++ '), ('golang'), ('TSX'), ('Java'), ('PowerShell'), ('Common Lisp'), (CAST(NULL AS STRING)), ('c-cpp'), ('Rust')) AS t(name)"


def language_names(spark, d):
    return values(spark, NAMES).select("name", P.language(F.col("name")).alias("language"))


LICENSES = """SELECT * FROM (VALUES (1, array('mit')), (2, array('MIT', 'apache-2')), (3, array('MIT', 'GPL-3.0')), (4, array()), (5, array('BSD-3-CLAUSE', 'cc0-1.0')), (6, array('', 'unlicense'))) AS t(id, names)"""


def license_aliases(spark, d):
    return values(spark, LICENSES).select("id", P.license_of(F.col("names")).alias("license"))


STACK = """SELECT * FROM (VALUES (1, 'h1', array('mit'), 'r/a', 'a.py', array('gpl-3.0'), 's/b', array('mit')), (2, 'h2', array('gpl-3.0'), 'r/b', 'b.py', array('apache-2.0'), 's/c', array('mit')),
  (3, 'h3', array('gpl-3.0'), 'r/c', 'c.py', array('gpl-2.0'), 's/d', array('mit')), (4, 'h4', array('gpl-3.0'), 'r/d', 'd.py', array('gpl-2.0'), 's/e', array('x'))) AS t(id, hexsha, direct, repo, path, stars, stars_repo, forks)"""


def provenance_fallback(spark, d):
    """The first licensed place of a file: its own, then that with most stars, then most forks."""
    r = values(spark, STACK)
    a, b, c = (P.license_of(F.col(x)) for x in ("direct", "stars", "forks"))
    name = F.when(a.isNotNull(), F.col("repo")).when(b.isNotNull(), F.col("stars_repo")).when(c.isNotNull(), F.col("hexsha"))
    return r.select("id", F.coalesce(a, b, c).alias("license"), name.alias("repository"))


TEST_PATH = r"(?i)((^|/)(tests?|specs?|__tests__)(/|_))|((_test|\.test|\.spec)\.[^/]+$)"
TEST_TEXT = r"\bdescribe\s*\(|\bit\s*\(|\btest\s*\(|\bassert(_eq)?[!(]|#\[test\]|\bfunc\s+Test[A-Z]|\bTEST(_F)?\s*\("


def hash_sample(spark, d):
    """A Bernoulli sample by hash, at a rate per source; the same rows whatever the order or the files."""
    r = records(spark, d).withColumn("priority", T.sha(F.concat_ws("\n", F.lit("7"), "repository", "path", T.sha(T.squeeze(F.col("text"))), F.lit("v1"))))
    rate = F.when(F.col("source").isin("src0", "src1"), 0.5).otherwise(0.1)
    return r.where(T.fraction(F.col("priority")) < rate).select(F.col("ord").alias("doc_id"), "source", "priority")


def repo_split(spark, d):
    r = counted(records(spark, d)).withColumn("validation", T.seeded(17, F.col("repository")) < 0.2)
    return r.groupBy("repository", "validation").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))


def content_split(spark, d):
    h = F.conv(F.substring(T.sha(F.col("text")), 1, 15), 16, 10).cast("long")
    return records(spark, d).select(F.col("ord").alias("doc_id"), (h % 10_000 < 500).alias("validation"))


def length_filters(spark, d):
    """Legacy junk: over a million characters, or a line of over 1,000."""
    r = records(spark, d)
    longest = F.coalesce(F.array_max(F.transform(F.split("text", "\n"), F.length)), F.lit(0))
    return r.select(F.col("ord").alias("doc_id"), ((F.length("text") > 1_000_000) | (longest > 1000)).alias("junk"))


QUERIES = {f.__name__: f for f in (policy_reasons, policy_report, classify_path, language_names, license_aliases, provenance_fallback, hash_sample, repo_split, content_split, length_filters, )}
_duck = lambda q: q.replace("AS STRING", "AS VARCHAR").replace("array(", "list_value(")
_LIC = f"""(SELECT CASE WHEN len(n) > 0 AND len([x FOR x IN n IF x NOT IN {_in(P.ALLOWED)}]) = 0 THEN list_min(n) END FROM (SELECT [CASE lower(v) {" ".join(f"WHEN '{x.lower()}' THEN '{x}'" for x in P.ALLOWED)} WHEN 'apache-2' THEN 'Apache-2.0' ELSE v END FOR v IN ARG IF v <> ''] AS n))"""
SQL = {
    "policy_reasons": f"WITH {RECORDS} SELECT ord AS doc_id, {_REASON} AS reason FROM rec",
    "policy_report": f"""WITH {RECORDS}, j AS (SELECT *, {_REASON} AS reason FROM rec),
 k AS (SELECT language, bytes, CASE WHEN row_number() OVER (PARTITION BY sha256(text) ORDER BY ord) > 1 THEN 'exact_duplicate' WHEN row_number() OVER (PARTITION BY sha256({normal_sql("text")}) ORDER BY ord) > 1 THEN 'normalized_duplicate' ELSE 'accepted' END AS reason FROM j WHERE reason IS NULL
 UNION ALL SELECT language, bytes, reason FROM j WHERE reason IS NOT NULL)
 SELECT language, reason, count(*) AS docs, sum(bytes)::BIGINT AS bytes FROM k GROUP BY ALL""",
    "classify_path": f"""WITH p AS ({PATHS}), n AS (SELECT path, lower(regexp_extract(path, '([^/]*)/*$', 1)) AS n FROM p), m AS (SELECT *, regexp_extract(n, '^.+\\.([^.]+)$', 1) AS s FROM n),
 c AS (SELECT *, n IN {_in(P.STRUCTURED_NAMES)} OR s IN {_in(P.STRUCTURED)} AS st, s IN {_in(P.PROSE)} OR n LIKE 'readme%' OR n LIKE 'changelog%' AS pr, {_CODE_CASE} AS co FROM m)
 SELECT path, CASE WHEN st THEN 'structured' WHEN pr THEN 'documentation' WHEN co IS NOT NULL THEN 'code' END AS category,
 CASE WHEN st THEN {_LANG_CASE("s")} WHEN pr THEN 'english' ELSE coalesce(co, 'other') END AS language,
 n IN {_in(P.LOCKS)} OR len([x FOR x IN string_split(lower(path), '/') IF x IN {_in(P.SKIPPED)} OR x LIKE '.venv%' OR x LIKE 'venv-%' OR x LIKE 'env-%']) > 0 AS skipped FROM c""",
    "language_names": _duck(f"SELECT name, {_LANG_CASE("replace(replace(lower(trim(coalesce(name, 'other'))), ' ', '_'), '-', '_')")} AS language FROM ({NAMES})"),
    "license_aliases": _duck(f"SELECT id, {_LIC.replace('ARG', 'names')} AS license FROM ({LICENSES})"),
    "provenance_fallback": _duck(f"SELECT id, coalesce(a, b, c) AS license, CASE WHEN a IS NOT NULL THEN repo WHEN b IS NOT NULL THEN stars_repo WHEN c IS NOT NULL THEN hexsha END AS repository FROM (SELECT *, {_LIC.replace('ARG', 'direct')} AS a, {_LIC.replace('ARG', 'stars')} AS b, {_LIC.replace('ARG', 'forks')} AS c FROM ({STACK}))"),
    "hash_sample": f"""WITH {RECORDS}, p AS (SELECT *, sha256(concat_ws(chr(10), '7', repository, path, sha256({squeeze_sql("text")}), 'v1')) AS priority FROM rec)
 SELECT ord AS doc_id, source, priority FROM p WHERE {fraction_sql("priority")} < CASE WHEN source IN ('src0', 'src1') THEN 0.5 ELSE 0.1 END""",
    "repo_split": f"WITH {RECORDS} SELECT repository, {fraction_sql("sha256('17:' || repository)")} < 0.2 AS validation, count(*) AS docs, sum(bytes)::BIGINT AS bytes FROM rec GROUP BY ALL",
    "content_split": "SELECT doc_id, ('0x' || substr(sha256(text), 1, 15))::BIGINT % 10000 < 500 AS validation FROM documents",
    "length_filters": "SELECT doc_id, length(text) > 1000000 OR coalesce(list_max([length(x) FOR x IN string_split(text, chr(10))]), 0) > 1000 AS junk FROM documents",
}
