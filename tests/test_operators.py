"""What SQL doesn't express: folds, greedy passes, state machines, sources, sinks and streams."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import dedup, examples, gates, guard, select
from millrace.plans import catalog, dedup_queries, select_queries
from millrace.shipping import ship
from millrace.sources import readers, sinks
from millrace.streaming import collect


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_greedy_keeps_a_row_whose_partner_went(spark):
    ids = spark.range(6).withColumnRenamed("id", "ord")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "left long, right long")
    assert sorted(r[0] for r in dedup.greedy_survivors(ids, pairs).collect()) == [0, 2, 4]


def test_similar_pairs_are_those_of_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("ord"), "text", F.col("lang").alias("language"))
    import re

    sets = [(r.ord, r.language, {w.lower() for w in re.findall(T.WORD, r.text) if len(w) > 2}) for r in docs.collect()]
    want = {(a, b) for a, g, x in sets for b, h, y in sets if a < b and g == h and x and y and len(x & y) / len(x | y) >= 0.82}
    assert {(r["left"], r["right"]) for r in dedup.similar_pairs(docs).collect()} == want


def test_similar_pairs_carry_no_word_sets(spark, monkeypatch):
    """The sets' words are written once, and candidates are told apart and verified without them."""
    ship(spark)
    rng = np.random.default_rng(5)
    words = [f"w{i:05d}" for i in range(3000)]
    sets = [set(rng.choice(words, size=n)) for n in (3, 40, 130, 600, 2500) for _ in range(3)]
    sets += [s - {w for w in s if rng.random() < 0.06} | {f"own{k}"} for k, s in enumerate(sets) for _ in range(3)] + sets[:4]
    docs = [(i, " ".join(sorted(s)), ["a", "b", None][i % 7 // 3]) for i, s in enumerate(sets)]
    written = []
    monkeypatch.setattr(dedup, "cut", lambda df, name, *spent, f=dedup.cut: written.append((name, df.columns)) or f(df, name, *spent))
    got = {(r["left"], r["right"], r["jaccard"]) for r in dedup.similar_pairs(spark.createDataFrame(docs, "ord long, text string, language string")).collect()}
    same = [(i, j, sets[i], sets[j]) for i in range(len(sets)) for j in range(i) if docs[i][2] == docs[j][2] is not None]
    assert got == {(j, i, len(x & y) / len(x | y)) for i, j, x, y in same if len(x & y) / len(x | y) >= 0.82} != set()
    assert [name for name, columns in written if "w" in columns] == ["word-sets"]


def test_near_dup_greedy_is_the_loop(spark, small, monkeypatch):
    """A row goes if an earlier one that stays is its partner; copies are settled by their class, not pair by pair."""
    ship(spark)
    pairs = rows(dedup.similar_pairs(spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("ord"), "text", F.col("lang").alias("language"))))
    before, kept = {}, set()
    for left, right, _ in pairs:
        before.setdefault(right, set()).add(left)
    ids = sorted(r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect())
    for i in ids:
        if not before.get(i, set()) & kept:
            kept.add(i)
    seen = []
    monkeypatch.setattr(dedup, "greedy_survivors", lambda i, p, f=dedup.greedy_survivors: seen.append(p.where("jaccard = 1").count()) or f(i, p))
    assert {r[0] for r in dedup_queries.near_dup_greedy(spark, small).collect()} == kept and len(kept) < len(ids)
    assert seen == [0] and any(j == 1 for *_, j in pairs)


def test_collector_fold_is_the_loop(spark, small):
    ship(spark)
    got = dict(rows(select_queries.collector_fold(spark, small)))
    repo, cat, exact, norm, want = {}, {}, set(), set(), {}
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        n, c, squeezed = len(r.text.encode()), ("code", "documentation", "english")[r.doc_id % 3], " ".join(r.text.split()).lower()
        why = "repository_quota" if repo.get(r.source, 0) + n > 100_000 else "quota" if cat.get(c, 0) >= 500_000 else "exact_duplicate" if r.text in exact else "normalized_duplicate" if squeezed in norm else "accepted"
        if why == "accepted":
            exact.add(r.text), norm.add(squeezed)
            repo[r.source], cat[c] = repo.get(r.source, 0) + n, cat.get(c, 0) + n
        want[r.doc_id] = why
    assert got == want


def test_pool_select_has_no_text_twice(spark, small):
    ship(spark)
    got = select_queries.pool_select(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got.join(docs, "doc_id").select(T.squeeze(F.col("text"))).distinct().count() == got.count() > 0


def test_next_fit(spark):
    ship(spark)
    df = spark.createDataFrame([(g, i, n) for g in "ab" for i, n in enumerate([5, 4, 3, 8, 2, 9])], "g string, i long, n long")
    got = select.next_fit(df, "g", "i", "n", 10).orderBy("g", "i").collect()
    assert [r["row"] for r in got] == 2 * [0, 0, 1, 2, 2, 3]


def test_interleave_is_the_greedy_choice(spark):
    import random

    rng = random.Random(4)
    docs = [(i, rng.choice("abc"), rng.randint(1, 30)) for i in range(120)]
    weight = {"a": 3.0, "b": 1.0, "c": 2.0}
    df = spark.createDataFrame(docs, "ord long, source string, tokens long").withColumn("w", F.expr("CASE source WHEN 'a' THEN 3D WHEN 'b' THEN 1D ELSE 2D END"))
    got = [r[0] for r in select.interleave(df, "tokens", "source", "w", ["ord"]).orderBy("at", "source").select("ord").collect()]
    queues = {s: [d for d in docs if d[1] == s] for s in "abc"}
    emitted, want = dict.fromkeys("abc", 0.0), []
    while any(queues.values()):
        s = min((x for x in "abc" if queues[x]), key=lambda x: (emitted[x] / weight[x], x))
        d = queues[s].pop(0)
        emitted[s] += max(1, d[2])
        want.append(d[0])
    assert got == want


def test_guard_rules_fire_in_order(spark, small):
    got = dict(rows(dedup_queries.decontaminate(spark, small)))
    assert got == {1: None, 2: "document_hash", 3: "verbatim_assertion", 4: "verbatim_description", 5: "entry_point:padLabel", 6: None, 7: None, 8: None, 9: None}
    briefs = dict(rows(dedup_queries.eval_guard(spark, small)))
    assert briefs[1] == "evaluation_entry_point" and briefs[8] == "evaluation_semantic_near_duplicate" and briefs[9] is None


def test_fingerprint_sees_shape_not_names(spark):
    f = dict(rows(spark.sql(guard.SNIPPETS).select("id", guard.fingerprint(F.col("language"), F.col("code")))))
    assert f[1] == f[2] and f[4] == f[5] and len({f[1], f[3], f[4], f[6]}) == 4


@pytest.mark.parametrize(
    "code,at,middle",
    [
        ("import os\n\ndef f(x):\n    y = x\n\n    return y\n\nz = 1\n", 0.0, "def f(x):\n    y = x\n\n    return y\n\n"),
        ("const a = (b) => {\n  if (b) {\n    return 1;\n  }\n};\nlet c;\n", 0.0, "const a = (b) => {\n  if (b) {\n    return 1;\n  }\n};\n"),
        ("class A:\n  def m(self):\n    pass\n  x = 1\n", 0.9, "  def m(self):\n    pass\n"),
        ("function f()\n{\n  g();\n}\nfunction h() {\n}\n", 0.0, "function f()\n{\n  g();\n}\n"),
        ("function one() { return 1; }\nx\n", 0.0, "function one() { return 1; }\nx\n"),
        ("x = 1\n", 0.0, None),
        ("def alone(): pass", 0.0, None),
    ],
)
def test_blocks(code, at, middle):
    got = examples.cut_block(code, at)
    assert (got and got[1]) == middle and (got is None or "".join(got) == code)


def test_completions_end_where_their_body_does(spark):
    r = spark.createDataFrame([("  return 1\n\nprint(2)\n", " s = \"}\"; // }\n}z"), ("  a\n  b", " if (a) { b; } }x"), ("  y\ndef z():\n  w", " open {")], "a string, b string")
    got = r.select(examples.cut_at_column_zero(F.col("a")), examples.cut_at_brace(F.col("b")), examples.until(F.col("a"), ["print", "b", "()"])).collect()
    assert [tuple(x) for x in got] == [("  return 1\n", " s = \"}\"; // }\n}", "  return 1\n\n"), ("  a\n  b", " if (a) { b; } }", "  a\n  "), ("  y", " open {", "  y\ndef z")]


def test_gates_stop_a_run(spark):
    gates.shares({"a": 0.25, "b": 0.75}, ["a", "b"])
    gates.lineage({"output": "x", "tasks": 36}, "x", 36)
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2, "x")], "k int, v string")
    state = {"signature": gates.signature({"seed": 1, "rate": 0.5})}
    gates.same_run(state, {"rate": 0.5, "seed": 1})
    assert gates.required_join(a.where("k = 2"), b, "k").count() == 1 and gates.drop_share(100, 5, 0.05) == 0.05
    for bad in (
        lambda: gates.shares({"a": 0.25, "b": 0.7}),
        lambda: gates.shares({"a": 1.0}, ["a", "b"]),
        lambda: gates.lineage({"output": "y", "tasks": 36}, "x", 36),
        lambda: gates.lineage({"output": "x", "tasks": 35}, "x", 36),
        lambda: gates.disjoint(a, b, "k"),
        lambda: gates.required_join(a, b, "k"),
        lambda: gates.drop_share(100, 6, 0.05),
        lambda: gates.canary(lambda x: x, a, [(1,)]),
        lambda: gates.same_run(state, {"rate": 0.5, "seed": 2}),
    ):
        with pytest.raises(gates.GateError):
            bad()


def test_shifted_labels(spark):
    x, y = examples.shifted_labels(F.col("i"), F.lit(2), 5, 0)
    r = spark.createDataFrame([([7, 8, 9],)], "i array<int>").select(x.alias("x"), y.alias("y")).first()
    assert r.x == [7, 8, 9, 0, 0] and r.y == [-100, 9, -100, -100, -100]


@pytest.mark.parametrize("text", ["", "a\n", "a\r\nb\x0bc", "x y\n\n", "  a　b \x1c"])
def test_text_rules_are_those_of_python(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(T.lines(F.col("t")).alias("l"), T.squeeze(F.col("t")).alias("s")).first()
    assert r.l == text.splitlines() and r.s == " ".join(text.split())


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text": "x", "source": "s"}\n\nnot json\n')
    assert readers.jsonl(spark, str(p), "text string, source string", strict=False).where("text IS NOT NULL").count() == 1
    with pytest.raises(Exception):
        readers.jsonl(spark, str(p), "text string, source string").collect()
    with pytest.raises(Exception):
        readers.required(spark.createDataFrame([("a", None)], "a string, b string"), "a", "b").collect()
    out = str(tmp_path / "out")
    sinks.jsonl(spark.createDataFrame([("é",)], "text string"), out)
    with pytest.raises(Exception):
        sinks.jsonl(spark.createDataFrame([("b",)], "text string"), out)


def test_repository_scan(spark, tmp_path):
    for name, body in {"a.py": b"x = 1", "node_modules/b.js": b"y", "README.md": "ä".encode(), "bad.py": b"\xff\xfe", "n.bin": b"z"}.items():
        f = tmp_path / "tree" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(body)
    got = readers.repository(spark, str(tmp_path / "tree"), "local", "MIT").orderBy("ord").collect()
    assert {(r.path, r.category, r.text) for r in got} == {("a.py", "code", "x = 1"), ("README.md", "documentation", "ä")}


def test_repository_scan_lists_and_reads_in_tasks(spark, tmp_path, monkeypatch):
    """No list of files on the driver; odd names, deep folders, links that lead back and an empty tree."""
    tree = tmp_path / "a tree"
    want = {"x y%20.py": "1", "a/b/c/d/e/f.py": "ü", "a/__init__.py": "", "a/b/tree.md": "# t", **{f"lib/{i}/src/m.py": str(i) for i in range(300)}}
    for name, body in {**want, "a/b/node_modules/z.js": "z", "a/b/n.bin": "z"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(body)
    os.symlink(tree, tree / "a/b/back")
    os.symlink(tree / "gone.py", tree / "gone.py")
    planned = readers.repository(spark, str(tree), "local", "MIT", seed=3)
    assert "binaryFile" not in planned._jdf.queryExecution().toString()
    got = planned.collect()
    assert {r.path: r.text for r in got} == want and len(got) == len(want)
    (tmp_path / "none").mkdir()
    assert readers.repository(spark, str(tmp_path / "none"), "local", "MIT").count() == 0


def test_a_languages_texts_are_written_and_cut_without_a_shuffle(spark, tmp_path):
    docs = [(i, "é" * (i % 7 + 1), "en" if i % 3 else "de") for i in range(200)]
    root = str(tmp_path / "stack")
    spark.createDataFrame(docs, "ord long, text string, language string").repartition(4).write.partitionBy("language").parquet(root)
    df = readers.stack(spark, root, ["en", "de"], "ord long, text string, language string", 100)
    want, total = set(), {"en": 0, "de": 0}
    for i, text, language in docs:
        if total[language] < 100:
            want.add(i)
        total[language] += len(text.encode())
    assert {r.ord for r in df.collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(ord" in x]


def test_language_stream_writes_in_the_tasks_that_read(spark, small, monkeypatch):
    from millrace.plans import io_queries

    roots = []
    monkeypatch.setattr(io_queries, "new_dir", lambda s, name, f=io_queries.new_dir: roots.append(f(s, name)) or roots[-1])
    monkeypatch.setattr(io_queries, "records", lambda s, d, f=io_queries.records: f(s, d).repartition(5))
    io_queries.language_stream(spark, small)
    found = os.listdir(roots[0].removeprefix("file://") + "/language=en")
    assert len([x for x in found if x.endswith(".parquet")]) == 5


def test_block_holes_with_a_name_that_ends_in_def(spark, tmp_path):
    """The SQL takes a name's end in the comment for the definition's beginning; so does the query."""
    import hashlib

    import duckdb
    from conftest import same

    from millrace.plans import program_queries

    ship(spark)
    texts = [t for t in (f"text {i}" for i in range(60_000)) if hashlib.md5(t.encode()).hexdigest()[3:6] == "def"][:6]
    rows_ = [(8 * i + form, t, "en", "s", 40 + i) for i, t in enumerate(texts) for form in (0, 1, 4, 5)]
    spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = program_queries.block_holes(spark, str(tmp_path))
    same(got, c.sql(program_queries.SQL["block_holes"]))
    assert got.where("middle LIKE 'def adds%' AND whole").count() == len(texts) == 6


def test_books_and_generated_rows(spark):
    b = spark.createDataFrame([("junk\n*** START OF THE BOOK ***\n\nBody text\n*** END OF THE BOOK\nmore",)], "text string")
    assert readers.book(b).first()[0] == "Body text"
    assert readers.generated_transcripts(spark, ["a", "b"], 10).count() == 20
    got = readers.generated_exercises(spark, 40).collect()
    assert {r.template for r in got} == set(readers.TEMPLATES)
    for r in got:
        compile(r.solution, r.template, "exec")


def test_token_sinks(spark, tmp_path):
    ship(spark)
    sinks.register(spark)
    df = spark.createDataFrame([([1, 2, 3],), ([4, 65535, 6],)], "ids array<int>").repartition(1)
    df.write.format("token_bin").mode("append").option("path", str(tmp_path / "bin")).option("end", 9).save()
    meta = json.loads((tmp_path / "bin/meta.json").read_text())
    flat = np.concatenate([np.fromfile(tmp_path / "bin" / p, "<u2") for p in meta["parts"]])
    assert meta["tokens"] == 8 and sorted(flat.tolist()) == sorted([1, 2, 3, 9, 4, 65535, 6, 9])
    df.write.format("token_npz").mode("append").option("path", str(tmp_path / "npz")).save()
    part = json.loads((tmp_path / "npz/meta.json").read_text())["parts"]
    assert sum(len(np.load(tmp_path / "npz" / p)["input_ids"]) for p in part) == 2
    assert sorted(x for r in readers.token_bin(spark, str(tmp_path / "bin")).collect() for x in r.ids) == sorted(flat.tolist())
    both = spark.createDataFrame([([1, 2], [2, -100])], "ids array<int>, labels array<int>").coalesce(1)
    both.write.format("token_npz").mode("append").option("path", str(tmp_path / "sft")).save()
    part = json.loads((tmp_path / "sft/meta.json").read_text())["parts"]
    assert [np.load(tmp_path / "sft" / p)["labels"].tolist() for p in part if len(np.load(tmp_path / "sft" / p)["input_ids"])] == [[[2, -100]]]


def test_collection_resumes_and_stops(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    docs.where("doc_id < 60").coalesce(1).write.parquet(src)
    collect.collect(collect.source(spark, src, "doc_id long, text string"), out, ck, mismatches=str(tmp_path / "bad"))
    one = spark.read.parquet(out).count()
    docs.where("doc_id >= 40").coalesce(1).write.mode("append").parquet(src)
    collect.collect(collect.source(spark, src, "doc_id long, text string"), out, ck)
    got = spark.read.parquet(out)
    assert got.count() == got.select("id").distinct().count() == docs.withColumn("n", T.pretokens(F.col("text"))).where("n >= 12").select("text").distinct().count() > one
    collect.collect(collect.source(spark, src, "doc_id long, text string"), str(tmp_path / "few"), str(tmp_path / "ck2"), budget=1)
    assert 0 < spark.read.parquet(str(tmp_path / "few")).count() < got.count()


def test_rate_limit(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([("a", f"2024-01-01 00:00:0{i}") for i in range(8)] + [("b", "2024-01-01 00:00:00")], "k string, t string").select("k", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.parquet(src)
    out = collect.rate_limited(spark.readStream.schema("k string, t timestamp").parquet(src), "k", "t", burst=2, per_minute=12)
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    ok = [r.allowed for r in spark.sql("SELECT * FROM limited WHERE key = 'a' ORDER BY ts").collect()]
    assert ok == [True, True, False, False, False, True, False, False] or sum(ok) == 3


def test_queries_are_lazy_frames(spark, small):
    assert len(catalog.queries()) > 80 and os.path.isdir(small)
    assert guard.GENERIC
