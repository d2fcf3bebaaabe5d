"""Evaluation guards: signatures of held-out tasks, contaminated texts, structural fingerprints.

Two guards with alike names differ in their normal forms and stay apart: `reasons` (corpus texts) and `eval_reasons`
(task briefs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TASKS = r"""SELECT * FROM (VALUES
 ('t1', 'python', 'pick_pairs', '# Return every pair of neighbours whose sum is even.\ndef pick_pairs(xs):\n', array('assert pick_pairs([1, 3, 4, 6]) == [(1, 3), (4, 6)]', 'assert pick_pairs([]) == []')),
 ('t2', 'javascript', 'padLabel', '// Pad a label on both sides with dots up to a width.\nfunction padLabel(s, n) {\n', array('console.assert(padLabel(\"abc\", 7) === \"..abc..\")')),
 ('t3', 'python', 'tally', '# Count things\ndef tally(xs):\n', array('assert tally([\"aaa\", \"bbb\"]) == {\"aaa\": 1, \"bbb\": 1}'))) AS t(id, language, entry_point, prompt, tests)"""
REFERENCES = r"""SELECT * FROM (VALUES ('t1', '    return [(a, b) for a, b in zip(xs, xs[1:]) if (a + b) % 2 == 0]\n'), ('t2', '  return s.padStart(n, \".\");\n}\n')) AS t(id, body)"""
CANDIDATES = r"""SELECT * FROM (VALUES
 (1, 'plain text'), (2, '    return [(a, b) for a, b in zip(xs, xs[1:]) if (a + b) % 2 == 0]'), (3, 'x\nassert pick_pairs([1, 3, 4, 6]) == [(1, 3), (4, 6)]\n'),
 (4, 'See: Return every pair of neighbours whose sum is even. Fine.'), (5, 'function padLabel(s) {\n x = (padLabel(\"abc\", 7); y = \"..abc..\"; }'), (6, 'function padLabel(s) { x = \"abc\"; }'),
 (7, 'def tally(x):\n {\"aaa\": 1, \"bbb\": 1} \"aaa\" \"bbb\"'), (8, 'padLabel \"abc\" \"..abc..\"'), (9, '# return EVERY pair')) AS t(id, text)"""
BRIEFS = r"""SELECT * FROM (VALUES
 (1, ' pick_pairs ', 'a', 'something else'), (2, 'f', '  return s.padStart(n, \".\");\n}\n', 'x'), (3, 'g', 'x assert pick_pairs([1, 3, 4, 6]) == [(1, 3), (4, 6)] y', ''),
 (4, 'h', 'RETURN every  pair of neighbours whose SUM is even.', ''), (5, 'i', 'z', 'Clamp a value to the given bounds'), (6, 'j', 'z', 'Compute the factorials'), (7, 'k', 'z', 'cumulative sums of an array'),
 (8, 'l', 'z', 'Pad label both sides with dots width'), (9, 'm', 'z', 'Sort a queue of jobs by deadline'), (10, 'n', 'z', 'count each vowel'), (11, 'o', 'z', 'Keep only digits of a string')) AS t(id, entry_point, text, semantic)"""
SNIPPETS = r"""SELECT * FROM (VALUES
 (1, 'python', 'def add(a, b):\n    return a + b  # sum\n'), (2, 'python', 'def plus(x, y):\n    return x + y\n'), (3, 'python', 'def add(a, b):\n    return b + a\n'),
 (4, 'javascript', 'const q = \"s\"; // c\nlet n = 0x1F + 3.5;'), (5, 'javascript', '/* head */ const w = \"t\";\nlet m = 12 + 7;'), (6, 'c', 'int main() { return 0; }')) AS t(id, language, code)"""

#: Names so common that a definition alone says nothing.
GENERIC = "Account Counter Stack add average clamp count_vowels count_words factorial get_field greet is_even merge_dicts reverse_list tally".split()
LITERAL = r"""'[^']{3,}'|"[^"]{3,}"|\[[^\]]{4,}\]|\{[^}]{4,}\}|\([^)]{6,}\)"""
#: Held-out behaviours: all of a rule's patterns must occur.
BEHAVIOURS = {
    "clamp_value": [r"\bclamp", r"\b(bound|lower|max|min|range|upper)"],
    "unique_preserve_order": [r"\b(deduplicat|duplicate|unique)", r"\b(first[- ]seen|original|preserv)", r"\border"],
    "count_words": [r"\bword", r"\b(count|frequenc(y|ies))", r"\b(dict|map|object)"],
    "extract_digits": [r"\b((keep|filter|extract)\w*(\W+\w+){0,5}\W+digits?|(output|produce|return)\w*(\W+\w+){0,4}\W+only(\W+\w+){0,3}\W+digits?)\b", r"\b(character|input|string|text)"],
    "running_total": [r"\b(cumulative|running)", r"\b(sum|total)", r"\b(array|list|sequence|value)"],
    "count_vowels": [r"\bvowel", r"\bcount"],
    "parse_boolean": [r"\b(convert|parse)", r"\b(bool|false|true)"],
    "factorial": [r"\bfactorial"],
}
KEYWORDS = (
    "yield with while void vec var use unsigned uint typedef type try true throw this switch super struct str static sizeof signed short return range raise public pub "
    "private pass package or null not none nil new mut mod match map long let interface int include in import impl if go function func from for fn float finally false "
    "extends export enum else double do delete defer default def continue const class char catch case break bool await async assert as and"
).split()
TOKEN = r"""(?s)/\*.*?\*/|//[^\n]*|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|\b(?:0x[0-9A-Fa-f]+|[0-9]+(?:\.[0-9]+)?)\b|[A-Za-z_][0-9A-Za-z_]*|\S"""


def tasks(spark: SparkSession) -> DataFrame:
    return spark.sql(TASKS)


def references(spark: SparkSession) -> DataFrame:
    return spark.sql(REFERENCES)


def signatures(tasks: DataFrame, references: DataFrame) -> DataFrame:
    """(kind, value, name): text hashes, long assertions, comment sentences, and distinctive literals by entry point."""
    t = tasks.join(references, "id", "left").withColumn("body", F.coalesce("body", F.lit("")))
    variants = F.array("prompt", "body", F.concat("prompt", "body"))
    hashes = t.select(F.explode(F.filter(variants, lambda v: F.trim(T.squeeze(v)) != "")).alias("v")).select(F.explode(F.array(T.sha(F.col("v")), T.sha(T.normal(F.col("v"))))).alias("value"))
    tests = t.select(F.explode("tests").alias("value")).select(F.trim("value").alias("value")).where(F.length("value") >= 20)
    line = F.trim(F.col("l"))
    note = F.when(line.startswith("#"), F.trim(F.regexp_replace(line, "^#+", ""))).when(line.startswith("//"), F.trim(F.substring(line, 3, 1_000_000)))
    notes = t.select(F.explode(T.lines(F.col("prompt"))).alias("l")).select(note.alias("value")).where(F.length("value") >= 30)
    found = t.select(F.col("entry_point").alias("name"), F.explode(F.concat("tests", F.array("prompt"))).alias("x")).select("name", F.explode(F.regexp_extract_all("x", F.lit(LITERAL), 0)).alias("value"))
    literals = found.where(F.regexp_replace("value", r"""^['"()\[\]{} ]+|['"()\[\]{} ]+$""", "") != F.col("name"))
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "value", F.lit(None).cast("string").alias("name"))
    return named(hashes, "hash").unionByName(named(tests, "assertion")).unionByName(named(notes, "description")).unionByName(literals.select(F.lit("literal").alias("kind"), "value", "name")).distinct()


def _strings(sig: DataFrame, kind: str) -> list[str]:
    """The strings of a suite: a fixed, versioned set of some dozens of tasks, which the patterns below are made of."""
    return sorted({r[0] for r in sig.where(F.col("kind") == kind).select("value").collect()}, key=lambda v: (-len(v), v))


def _any_of(c: Column, strings: list[str]) -> Column:
    """One alternation, longest first, instead of a pass per string."""
    import re

    return c.rlike("|".join(re.escape(s) for s in strings)) if strings else F.lit(False)


def reasons(df: DataFrame, sig: DataFrame) -> DataFrame:
    """df (id, text) with the first reason that a text is contaminated for; null if there is none."""
    text = F.col("text")
    hashes = _strings(sig, "hash")
    lit = sig.where((F.col("kind") == "literal") & ~F.col("name").isin(GENERIC)).select("name", F.col("value").alias("literal"))
    names = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:def|class|function)\s+(\w+)"), 1)
    defined = df.select("id", "text", F.explode(F.array_distinct(names)).alias("name"))
    strong = defined.join(lit, "name").where(F.contains("text", "literal")).groupBy("id", "name").agg(F.countDistinct("literal").alias("hits")).where("hits >= 2").groupBy("id").agg(F.min("name").alias("name"))
    why = (
        F.when(T.sha(text).isin(hashes) | T.sha(T.normal(text)).isin(hashes), "document_hash")
        .when(_any_of(text, _strings(sig, "assertion")), "verbatim_assertion")
        .when(_any_of(text, _strings(sig, "description")), "verbatim_description")
        .when(F.col("name").isNotNull(), F.concat(F.lit("entry_point:"), "name"))
    )
    return df.join(strong, "id", "left").select(*df.columns, why.alias("reason"))


def eval_reasons(df: DataFrame) -> DataFrame:
    """The guard of task briefs (id, entry_point, text, semantic), against the suite of this module."""
    spark = df.sparkSession
    t = tasks(spark).join(references(spark), "id", "left").withColumn("body", F.coalesce("body", F.lit(""))).collect()  # the suite
    squash = lambda s: " ".join(s.lower().split())
    import hashlib
    import re

    hashes, asserts, notes, words = set(), set(), set(), []
    for r in t:
        for v in (r.prompt, r.body, r.prompt + r.body):
            hashes |= {hashlib.sha256(x.encode()).hexdigest() for x in (v, squash(v))}
        asserts |= {x.strip() for x in r.tests if len(x.strip()) >= 20}
        prose = [x for line in r.prompt.splitlines() if len(x := line.lstrip("#/").strip()) >= 30]
        notes |= {squash(x) for x in prose}
        words.append(sorted({w.lower() for w in re.findall(T.WORD, " ".join(prose)) if len(w) > 2}))
    text, low = F.col("text"), T.normal(F.col("text"))
    sem = T.normal(F.col("semantic"))
    own = T.word_set(F.col("semantic"))
    held = [F.array(*map(F.lit, w)) for w in words if w]
    why = (
        F.when(F.trim("entry_point").isin([r.entry_point for r in t]), "evaluation_entry_point")
        .when(T.sha(text).isin(list(hashes)) | T.sha(low).isin(list(hashes)), "evaluation_exact_text")
        .when(_any_of(text, sorted(asserts)), "evaluation_assertion")
        .when(_any_of(low, sorted(notes)), "evaluation_description")
    )
    for name, parts in BEHAVIOURS.items():
        rule = F.lit(True)
        for p in parts:
            rule = rule & sem.rlike(p)
        why = why.when(rule, f"evaluation_behavior_{name}")
    near = F.lit(False)
    for w in held:
        near = near | (T.jaccard(own, w) >= 0.82)
    return df.withColumn("reason", why.when((F.size(own) >= 6) & near, "evaluation_semantic_near_duplicate"))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(ord, item_id) of the documents that contain the whole text of an item.

    An item of eight words or more has six whole words inside, whatever its ends touch; they must occur in the document
    as a run, so hashes of six-word runs join and only these candidates are searched. Shorter items, few and part of a
    fixed suite, are searched in every text.
    """
    words = lambda c: F.filter(F.split(T.squeeze(c), " "), lambda w: w != "")
    i = items.select("item_id", F.col("text").alias("item"), words(F.col("text")).alias("w"))
    long = i.where(F.size("w") >= 8).select("item_id", "item", T.ngram_hash([F.get("w", F.lit(k)) for k in range(1, 7)]).alias("g"))
    grams = docs.select("ord", F.explode(F.array_distinct(T.ngram_hashes(words(F.col("text")), 6))).alias("g"))
    found = grams.join(long.select("g", "item_id"), "g").select("ord", "item_id").distinct()
    a = found.join(long.select("item_id", "item"), "item_id").join(docs.select("ord", "text"), "ord").where(F.contains("text", "item")).select("ord", "item_id")
    short = i.where(F.size("w") < 8).select("item_id", "item")
    if not short.head(1):
        return a
    return a.unionByName(docs.join(short, F.contains(docs["text"], short["item"])).select("ord", "item_id"))


def fingerprint(language: Column, code: Column) -> Column:
    """A hash of code's shape: comments gone, literals and chosen names replaced."""
    code = F.when(language == "python", F.regexp_replace(code, "(?m)#.*$", "")).otherwise(code)
    raw = F.filter(F.regexp_extract_all(code, F.lit(TOKEN), 0), lambda t: ~(t.startswith("//") | (t.startswith("/*") & (F.length(t) > 3))))

    def kind(t: Column) -> Column:
        return (
            F.when((t.startswith("'") | t.startswith('"')) & (F.length(t) > 1), "<str>")
            .when(t.rlike(r"^(0x[0-9A-Fa-f]+|[0-9]+(\.[0-9]+)?)$"), "<num>")
            .when(t.rlike("^[A-Za-z_]") & F.lower(t).isin(KEYWORDS), F.lower(t))
            .otherwise(t)
        )

    named = lambda ts: F.array_distinct(F.filter(ts, lambda t: t.rlike("^[A-Za-z_]") & ~t.isin(KEYWORDS)))
    rename = lambda ts, ns: F.transform(ts, lambda t: F.when(F.array_contains(ns, t), F.concat(F.lit("id"), F.array_position(ns, t) - 1)).otherwise(t))
    shape = T.bind(F.transform(raw, kind), lambda ts: T.bind(named(ts), lambda ns: rename(ts, ns)))
    return T.sha(F.concat(language, F.lit("\n"), F.array_join(shape, " ")))
