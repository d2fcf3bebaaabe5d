"""Every query of this subpackage on a hard little set of tables, against SQL or brute force."""

import base64
import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from conftest import same
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import linededup, mixing, mpeg, packing, pfor, pii, queries, simhash, topk, toxicity, warc, work

Q, SQL = queries.queries(), queries.oracle_sql()
RUDE = ["blockhead", "nincompoop", "dunderhead"]


def _documents() -> pd.DataFrame:
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [line(60) for _ in range(3)]
    rows = []
    for i in range(150):
        ls = [line(rng.randint(3, 20)) for _ in range(rng.randint(1, 8))]
        if i % 5 == 0:
            ls.insert(1, shared[i % 3])
        if i % 9 == 0:
            ls.append(f"write to jo.{i % 27}@mail.example.com beside quixotic ab{i % 27}zz or +1 (555) 555-01{i % 27:02d}")
        if i % 7 == 0:
            ls.append(f"you {rng.choice(RUDE)} {line(4)}")
        rows.append((i, "\n".join(ls), "en", f"src{0 if i % 3 == 0 else i % 7}"))
    rows += [(150 + k, rows[2][1], "en", f"src{k % 6}") for k in range(12)]  # a group of copies
    rows += [(170 + k, rows[4][1] + " zz", "en", "src1") for k in range(3)]
    rows += [(180, None, None, None), (181, "", "en", "src2"), (182, " \n\t ", "en", None), (183, "long " * 40_000, "en", "src3"), (184, "é" * 5000, "fr", "src3"), (None, "no id here", "en", "src1")]
    rows += [(i, f"first {i}\r\n\t said on all sites \r\n\r\nlast {i} <|endoftext|> x\r\n\t\r\n", "en", f"src{i % 6}") for i in range(190, 197)]
    rows += [(197, "said on all sites", "en", "src9"), (198, "kept <|startoftext|>\n\r\n", "en", "src9")]
    rows += [rows[7], rows[7], (200, "a  b\n\n\x0bc \U0001f600 4111 1111 1111 1111 10.0.0.1", "en", "src4")]
    d = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])
    d["doc_id"] = d["doc_id"].astype("Int64")
    clashing = "_d _t _th _gone _pos _row _at _text _key _fp _root _src _n _mh _h _h2 _rows _times _below _score _blank _spans _k _w a.b".split()
    return d.assign(n_chars=d["text"].str.len().astype("Int64"), length=1, score="x", key="k", **dict.fromkeys(clashing, 2))


def _write(root, docs):
    t = pa.Table.from_pandas(docs, preserve_index=False)
    t = t.set_column(t.schema.get_field_index("doc_id"), "doc_id", t["doc_id"].cast(pa.int64()))
    for c in ("text", "lang", "source"):
        t = t.set_column(t.schema.get_field_index(c), c, t[c].cast(pa.string()))
    pq.write_table(t, f"{root}/documents.parquet")
    ids = [i for i in docs["doc_id"].dropna().unique() if i < 150]
    pq.write_table(pa.table({"doc_id": pa.array([*ids, 9999, None], pa.int64()), "quality": pa.array([1] * (len(ids) + 2), pa.int32()), "toxic": pa.array([*(int(i % 7 == 0) for i in ids), 1, 1], pa.int32())}), f"{root}/labels.parquet")
    n = len(docs)
    pages = pa.table({"page_id": pa.array([*range(40), 7, None, 50, 51][: n and 44], pa.int64()), "url": pa.array([f"http://h{i % 5}.org/{i}" if i % 6 else None for i in range(44)][: n and 44], pa.string()), "html": pa.array([*(["same"] * 14 + [None, ""] + [f"<p>{i}</p>" for i in range(24)]), "<p>0</p>", "same", "\r\n\r\n", None][: n and 44], pa.string()), "extra": pa.array([1] * (44 if n else 0))})
    pq.write_table(pages, f"{root}/pages.parquet")
    rng = np.random.default_rng(1)
    vec = [rng.normal(size=6).astype("float32").tolist() for _ in range(230)]
    vec[3], vec[4], vec[5], vec[60] = None, [float("nan")] * 6, [None] * 6, vec[61]
    vec[100][2] = float("inf")
    ids = [*range(230), 50, 50, 150, 7, None]  # two more rows of a query's id, one of these its copy; a candidate twice
    vec += [vec[50], [x + 1 for x in vec[50]], vec[9], vec[7], vec[8]]
    pq.write_table(pa.table({"vec_id": pa.array(ids if n else [], pa.int64()), "embedding": pa.array(vec if n else [], pa.list_(pa.float32())), "_row": pa.array([0] * (len(ids) if n else 0), pa.int32())}), f"{root}/embeddings.parquet")


@pytest.fixture(scope="session")
def hard(tmp_path_factory):
    root = tmp_path_factory.mktemp("hard")
    _write(root, _documents())
    return str(root)


@pytest.fixture(scope="session")
def nothing(tmp_path_factory):
    root = tmp_path_factory.mktemp("nothing")
    _write(root, _documents().iloc[:0])
    return str(root)


@pytest.fixture(scope="session")
def texts():
    d = _documents()
    return [(None if pd.isna(i) else int(i), None if pd.isna(t) else t, None if pd.isna(s) else s) for i, t, s in zip(d["doc_id"], d["text"], d["source"])]


def got(spark, name, root):
    q = next(n for n in Q if n.startswith(name))
    return [r.asDict() for r in Q[q](spark, root).collect()]


def by(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, hard):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{hard}/{t}.parquet'")
    same(Q[name](spark, hard), c.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(name, spark, nothing):
    assert Q[name](spark, nothing).count() == 0


def test_toxicity_learns_and_scores_all(spark, hard, texts):
    rows = got(spark, "op1_", hard)
    assert by(rows, "doc_id") == Counter((i,) for i, _, _ in texts)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    judged = [(r["predicted"], r["doc_id"] % 7 == 0) for r in rows if r["held_out"] and r["doc_id"] < 150]
    assert sum(p == bool(t) for p, t in judged) / len(judged) > 0.8 and any(p and t for p, t in judged)


def _scores_by_hand(texts, labels):
    """The query's scores by plain dictionaries: features of one text at a time, FTRL as it is written."""
    m64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m64
        return x ^ (x >> 31)

    def word(w):
        h = mix(len(w) + 0x9E3779B97F4A7C15 & m64)
        for i in range(0, len(w), 8):
            h = mix(h ^ int.from_bytes(w[i : i + 8], "little"))
        return h

    @lru_cache(None)
    def coordinates(text):
        ws = [word(w.encode()) for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
        out = {mix(h ^ int(toxicity._SALT[0])) >> 44 for h in ws}
        for gap in (1, 2, 3):
            out |= {mix(a * 0x9E3779B97F4A7C15 + mix(b + int(toxicity._SALT[gap]) & m64) & m64) >> 44 for a, b in zip(ws, ws[gap:])}
        return sorted(out)

    rows = {}
    for i, t, _ in texts:
        if i in labels and zlib.crc32(str(i).encode()) % 5:
            rows[i] = min(rows.get(i, coordinates(t or "")), coordinates(t or ""))
    z, n = {}, {}

    def weight(i):
        x, l1 = z.get(i, 0.0), 0.0 if i == "bias" else 4.0
        return 0.0 if abs(x) <= l1 else (math.copysign(l1, x) - x) / ((1 + math.sqrt(n.get(i, 0.0))) / 4.0 + 0.5)

    learnt = [([*rows[i], "bias"], labels[i]) for i in labels["order"] if i in rows]
    for epoch in range(5):
        for k in np.random.default_rng(epoch).permutation(len(learnt)):
            at, y = learnt[k]
            ws = [weight(i) for i in at]
            g = toxicity.sigmoid(sum(ws)) - y
            for i, w in zip(at, ws):
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / 4.0 * w
                n[i] = was + g * g
    return [toxicity.sigmoid(sum(weight(i) for i in coordinates(t or "")) + weight("bias")) for _, t, _ in texts]


def test_toxicity_is_the_model_by_hand(spark, hard, texts):
    labels = {i: int(i % 7 == 0) for i, _, _ in texts if i is not None and i < 150}
    ids = spark.createDataFrame([(i,) for i in labels], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    want = _scores_by_hand(texts, labels | {"order": [r.doc_id for r in ids]})
    key = lambda i, x: (-1 if i is None else i, round(x, 9))
    rows = got(spark, "op1_", hard)
    for (i, a), (j, b) in zip(sorted(key(r["doc_id"], r["score"]) for r in rows), sorted(key(t[0], x) for t, x in zip(texts, want))):
        assert i == j and abs(a - b) < 1e-6


def test_toxicity_bounds(spark):
    """Repeated rows count once, and the bound on coordinates keeps the first ids by hash."""
    docs = spark.createDataFrame([(i, f"{'rude' if i % 2 else 'kind'} {i}") for i in range(60)] + [(1, "rude 1")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once = toxicity.train(docs.distinct(), labels)
    again = toxicity.train(docs, labels)
    assert once[0].tolist() == again[0].tolist() and once[1].tolist() == again[1].tolist()
    assert toxicity.train(docs, labels, max_features=0)[2] == -math.inf


def test_toxicity_without_labels(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.s for r in toxicity.score(docs.select("doc_id", "text"), model, into="s").collect()} == {0.0}


def test_line_dedup_keeps_first(spark):
    docs = spark.createDataFrame([(i, f"only {i}\n  all sites say this \n\nend {i}", f"s{i}") for i in range(6)] + [(9, None, None), (10, "", "x")], "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in linededup.remove_lines(docs).collect()}
    rn = spark.createDataFrame([(i, f"only {i}\r\n  all sites say this{chr(13) if i % 2 else ''}\n\r\n\t\r\nend {i}\r\n", f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in linededup.remove_lines(rn).collect()}[5] == "only 5\r\n\r\n\t\r\nend 5\r\n"
    assert out[0] == "only 0\n  all sites say this \n\nend 0" and out[5] == "only 5\n\nend 5" and out[9] is None and out[10] == ""


def test_spread_estimate_settles_like_exact_counts(spark):
    rng = random.Random(3)
    rows = [(h, rng.getrandbits(62)) for h, n in enumerate([1, 2, 3, 4, 5, 6, 40, 300]) for _ in range(n)]
    lines = spark.createDataFrame([(h, s, p) for h, s in rows for p in range(3)], "_h long, _s long, _pos int")
    assert {r._h for r in linededup.spread(lines, 4).collect()} == {3, 4, 5, 6, 7}


def test_packing_covers_every_id(spark, hard, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x, _ in texts)
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    rows = packing.pack_words(docs, ids=True).collect()
    pieces, bins = {}, {}
    for r in rows:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(r.ids)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    for (i, ids), n in want.items():
        mine = pieces[i, len(ids)]
        assert sum(len(x) for xs in mine.values() for x in xs) == sum(m * len(y) for (j, y), m in want.items() if j == i and len(y) == len(ids))
        if n == 1 and sum(1 for j, y in want if (j, len(y)) == (i, len(ids))) == 1:
            assert sum((mine[s][0] for s in sorted(mine)), []) == list(ids)
    digest = got(spark, "op3_", hard)
    assert by(digest, "doc_id", "start", "length", "ids_crc32") == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)


def _pii_by_hand(texts):
    """(doc_id, counts, base digest, spans) of each row by plain patterns and dictionaries over all pairs of entity and term."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(x * (1 + i % 2) - 9 * (x * (1 + i % 2) > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True, str.lower),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split(".")), str),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)), digits),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15, digits),
    }
    base = lambda t: [(k, m.start(), m.end()) for k, (rx, ok, _) in rules.items() for m in re.finditer(rx, t) if ok(m[0])]
    found = lambda t, of: [(w, a, b) for w, a, b in of if not any(a < e and b > s for _, s, e in base(t))]
    words = lambda t: [(re.sub("[A-Z]", lambda x: x[0].lower(), m[0]), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", t) if len(m[0].encode()) >= pii.SHORTEST]
    distinct = {t for _, t, _ in texts if t is not None}
    of_entity, of_term, of_both = Counter(), Counter(), Counter()
    for t in distinct:
        own = {f"{k}:{rules[k][2](t[s:e])}" for k, s, e in base(t)}
        of_term.update({w for w, _, _ in words(t)})
        of_entity.update(own)
        of_both.update((e, w) for e in own for w in {w for w, _, _ in found(t, words(t))})
    told, total = {}, len(distinct)
    for (e, w), n in of_both.items():
        if n >= pii.SUPPORT and of_entity[e] < total:
            told[w] = max(told.get(w, 0), math.log(n * total / (of_entity[e] * of_term[w])) / math.log(total / of_entity[e]))
    out = []
    for i, t, _ in texts:
        t = t or ""
        spans = base(t)
        terms = sorted(("remove" if told[w] >= pii.REMOVE else "generalise", a, b) for w, a, b in found(t, words(t)) if told.get(w, 0) >= pii.GENERALISE)
        join = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
        n = Counter(k for k, _, _ in spans)
        out.append((i, *(n[k] for k in pii.KINDS), len(spans), hashlib.sha256(join(spans).encode()).hexdigest(), join([*spans, *terms])))
    return out


def test_pii_by_hand(spark, hard, texts, monkeypatch):
    monkeypatch.setattr(work, "MIN_HOT", 1)  # lookups take both ways
    want = _pii_by_hand(texts)
    rows = got(spark, "op4_", hard)
    assert by(rows, "doc_id", *(f"n_{k}" for k in pii.KINDS), "n_spans", "base_sha256", "spans") == Counter(want)
    # ab0zz stands beside jo.0@mail.example.com alone, quixotic beside all of them
    text = {i: t for i, t, _ in texts}
    terms = {text[r[0]][int(s) : int(e)] for r in want if r[-1] for k, s, e in (x.split(":") for x in r[-1].split(",")) if k in pii.TERMS}
    assert "ab0zz" in terms and "quixotic" not in terms


def test_filter_lets_all_its_terms_pass(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 5000)
    bloom = pii._bloom(spark.createDataFrame([(int(x),) for x in h[:500]], "_t long"), 500)
    ok = pii._passes(bloom, h)
    assert set(range(500)) <= set(ok.tolist()) and len(ok) < 600


def test_pii_terms_stand_anywhere_in_the_text(spark):
    rng = random.Random(4)
    fill = lambda n: " ".join(rng.choice("abcdefgh") * 4 for _ in range(n))
    # farther and mixed stand with one entity in all of its texts: always far away, and beside it in 3 of 10
    rows = [f"farther {fill(30)} {'' if i < 3 else 'mixed ' + fill(20)} {'mixed' if i < 3 else ''} jo@x.org {fill(9)} {i}" for i in range(10)]
    rows += [f"{fill(40)} {i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = [(r.doc_id, r._terms) for r in pii.find(docs).collect()]
    assert Counter(rows[i][s.start : s.end] for i, ts in found for s in ts) == {"farther": 10, "mixed": 10}


def test_sanitised_column(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet").where("doc_id < 150").dropDuplicates(["doc_id"])
    few = spark.createDataFrame([(1, None, 1), (1, "a jo@x.org", 2), (1, "b jo@x.org", 3), (None, "", 4), (1, "b jo@x.org", 3)], "doc_id long, text string, _k int")
    assert sorted(map(str, pii.sanitise(few).collect())) == sorted(map(str, [Row(doc_id=i, text=t and t.replace("jo@x.org", "[EMAIL]"), _k=k) for i, t, k in few.collect()]))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.where("text LIKE '%@mail.example.com%'").count() == 0 and out.where("text LIKE '%[EMAIL]%'").count() > 3


def test_warc_index_finds_records(spark, hard):
    pages = spark.read.parquet(f"{hard}/pages.parquet")
    parts = warc.build_index(warc.write(pages))
    top = warc.Index(warc.tops(parts))
    for r in pages.where("url IS NOT NULL").collect():
        found = warc.lookup(top, r.url)
        assert r.page_id in [x["page_id"] for x in found] and all(x["headers"]["WARC-Target-URI"] == r.url for x in found)
    assert warc.lookup(top, "http://nowhere.example/") == []
    asked = spark.createDataFrame([("", None), ("nothing", 3), ("", 0), ("", 0)], "surt string, page_id long")
    assert {r.page_id for r in warc.fetch(warc.locate(asked, parts)).collect()} == {0, None} - ({None} if pages.where("page_id IS NULL AND url IS NOT NULL").count() else set())
    assert base64.b32decode(warc.digest(b"x")) == hashlib.sha1(b"x").digest()


def test_warc_blocks_are_searched(spark, monkeypatch):
    """Captures of few keys over many blocks and parts: each is found by its key and id, and by its url."""
    rows = [(i, None if i % 3 == 0 else f"http://x.org/{i % 4}", f"p{i}") for i in range(1200)] + [(None, "http://x.org/1", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    captures = warc.write(pages)
    parts = warc.build_index(captures)
    assert sorted((r.page_id is not None, r.page_id or 0) for r in warc.fetch(warc.locate(captures, parts)).collect()) == [(False, 0), *((True, i) for i in range(1200))]
    assert len(warc.lookup(warc.Index(warc.tops(parts)), "http://x.org/1")) == sum(u == "http://x.org/1" for _, u, _ in rows)


def test_warc_limit_leaves_small_payloads(spark):
    p = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    got = {r.page_id: r._refers for r in warc.decide(p, least=5).collect()}
    assert got[1] is None and got[2] is None and got[3].id == 4 and got[4] is None


def test_media_give_the_texts_back(spark, hard, texts):
    rows = got(spark, "op6_", hard)
    want = Counter()
    for i, t, _ in texts:
        raw = (t or "").encode()
        pay = raw + bytes((-len(raw)) % 64 if raw else 64)
        want[(i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))] += 1
    assert by(rows, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    for r in rows:  # features from the payload and the layout alone
        t = next(t for i, t, _ in texts if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"] and (zlib.crc32(((t or "").encode() + bytes(r["payload_bytes"] - r["n_bytes"]))[-64:]) == r["tail_crc32"]))
        pay = (t or "").encode() + bytes(r["payload_bytes"] - r["n_bytes"])
        frames = -(-len(pay) // 937)
        share = [n / len(pay) for n in Counter(pay).values()]
        f = dict(x.split("=") for x in r["feature"].split(";"))
        seek = list(map(int, r["seek"].split(",")))
        assert (int(f["frames"]), int(f["samples"]), r["n_frames"], len(seek)) == (frames, 1152 * frames, frames, frames) and r["duration_s"] == 1152 * frames / 48000
        assert abs(float(f["mean"]) - sum(pay) / len(pay)) < 1e-5 and abs(float(f["entropy"]) + sum(x * math.log2(x) for x in share)) < 1e-5
        assert all(b - a == 960 for a, b in zip(seek, seek[1:])) and int(f["last"]) == seek[-1] and seek[-1] + 960 >= r["media_bytes"]
    assert len({(r["payload_sha256"], r["n_bytes"]) for r in rows}) == len({(r["media_sha256"], r["feature"]) for r in rows})
    info = mpeg.describe(spark.createDataFrame([(mpeg.store(b"x" * 3000, {}), 1), (None, 2), (b"zz", 3)], "media binary, info_id int")).collect()
    assert info[0].info.n_frames == 4 and info[0].info.duration_s == 4 * 1152 / 48000 and len(info[0].info.seek) == 4 and info[1].info.n_frames == info[2].info.n_frames == 0


def test_simhash_links_and_components(spark, hard, texts):
    fps = [(i, simhash.fingerprint(t)) for i, t, _ in texts]
    n = len(fps)
    near = [[j for j in range(n) if j != k and (fps[k][1] ^ fps[j][1]).bit_count() <= 3] for k in range(n)]
    comp = [-1] * n
    for k in range(n):
        if comp[k] == -1:
            stack, members = [k], []
            comp[k] = k
            while stack:
                x = stack.pop()
                members.append(x)
                for j in near[x]:
                    if comp[j] == -1:
                        comp[j] = k
                        stack.append(j)
            ids = [fps[m][0] for m in members if fps[m][0] is not None]
            for m in members:
                comp[m] = (k, min(ids) if ids else None)
    want = Counter((fps[k][0], f"{fps[k][1]:016x}", len(near[k]), comp[k][1]) for k in range(n))
    assert by(got(spark, "op7_", hard), "doc_id", "fingerprint", "n_near", "component_id") == want


def test_links_of_many_close_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(25)}
    signed = sorted(simhash._signed(x) for x in fps)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in signed], "_fp long")
    assert {(r.u, r.v) for r in simhash.links(df).collect()} == want
    monkeypatch.setattr(simhash, "CELL", 5)  # hot block keys in cells, with lookups both ways
    monkeypatch.setattr(work, "MIN_HOT", 3)
    assert {(r.u, r.v) for r in simhash.links(df).collect()} == want


@pytest.mark.parametrize("one_task", [simhash.ONE_TASK, 0])
def test_components_of_a_chain_and_a_hub(spark, monkeypatch, one_task):
    monkeypatch.setattr(work, "MIN_HOT", 5)
    order = list(range(60))
    random.Random(2).shuffle(order)
    e = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(100, 101)] + [(250, x) for x in range(200, 250)], "u long, v long").repartition(4)
    root = {r.u: r.root for r in simhash.components(e, one_task).collect()}
    assert all(root[x] == 0 for x in range(1, 60)) and root[101] == 100 and all(root[x] == 200 for x in range(201, 251))


def test_one_of_each_group_stays(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    kept = simhash.keep_one(docs)
    comp = simhash.near_duplicates(docs.select("doc_id", "text"))
    assert kept.columns == docs.columns and kept.count() == comp.select("component_id").distinct().count()


def test_one_of_each_group_stays_without_unique_ids(spark):
    line = lambda seed: " ".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=80))
    a, b, c, d, e, f, g = map(line, range(7))
    # ids of their own, none, one for two different texts (in a component with a smaller id, and not), and real copies
    rows = [(1, a), (None, b), (None, c), (None, c), (None, a), (5, d), (5, e), (2, e), (7, f), (7, g), (9, g)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, a), (None, b), (None, c), (5, d), (2, e), (7, f), (7, g)]
    assert by([r.asDict() for r in simhash.keep_one(docs).collect()], "doc_id", "text") == Counter(want)


def test_mix_holds_its_targets(spark, hard):
    rows = got(spark, "op8_", hard)
    per = {}
    for r in rows:
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        per.setdefault((r["target"], r["source_size"]), []).append(r)
    for (target, _), rs in per.items():
        assert abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs)
    docs = spark.read.parquet(f"{hard}/documents.parquet").where("doc_id IS NOT NULL")
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    words = mixed.select("doc_id", mixing.word_count(work.text_or_empty()).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r.doc_id: r.n for r in words if r.n} == {k: v for k, v in taken.items() if v}


def _mixed_by_hand(rows):
    """How often each row (doc_id, size, source) is taken: targets by raising the level, thresholds by sorting hashes."""
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, n, t in rows if t == s) for s in order}
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped, level = set(), Fraction(0)
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            break
        level = Fraction(sum(total.values()) - sum(3 * total[s] for s in capped), sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] >= 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: Fraction(3 * total[s]) if s in capped else level * weight[s] for s in order}
    h = lambda i: int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    out = []
    for s in order:
        times = target[s] // total[s] if total[s] else 0
        want, before, more = target[s] - times * total[s], 0, {}
        per = Counter()
        for i, n, t in rows:
            if t == s:
                per[h(i)] += n
        for x in sorted(per):  # taken once more while that comes nearer to the target
            more[x] = 2 * before + per[x] <= 2 * want
            before += per[x]
        out += [(i, n, s, int(times) + more[h(i)]) for i, n, t in rows if t == s]
    return out, target


def test_mix_by_hand(spark, hard, texts):
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in texts]
    want, target = _mixed_by_hand(rows)
    got_rows = got(spark, "op8_", hard)
    assert by(got_rows, "doc_id", "size", "taken") == Counter((i, n, k * n) for i, n, _, k in want)
    assert {round(r["target"], 6) for r in got_rows} == {round(float(x), 6) for x in target.values()}


def test_mix_of_ties(spark):
    """Rows of one id have one hash and go together; sources of equal size and weight have equal targets."""
    rows = [(1, "a b", s) for s in ("p", "q", "r") for _ in range(5)] + [(i, "a b c", "t") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, _ = _mixed_by_hand([(i, len(t.split()), s) for i, t, s in rows])
    assert by([r.asDict() for r in mixing.mix(docs).collect()], "doc_id", "size", "taken") == Counter((i, n, k * n) for i, n, _, k in want)


def test_mix_nests(spark, hard):
    """A larger budget takes all that a smaller one takes: thresholds are on one line."""
    docs = spark.read.parquet(f"{hard}/documents.parquet").select("doc_id", "text", "source")
    p = mixing.plan(docs.select(mixing.source_key(F.col("source")).alias("_src"), mixing.word_count(work.text_or_empty()).alias("_size"), mixing.doc_hash(F.col("doc_id")).alias("_h")))
    assert all(0 <= r._below <= 1 << 60 for r in p.collect())


def test_top_k_merges_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BYTES", 40)
    monkeypatch.setattr(topk, "TILE", 3)
    monkeypatch.setattr(topk, "FAN", 3)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 3, 2).astype(float).tolist()) for i in range(120)] + [(200, [1.0]), (201, [2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None]
    want = []
    for q, v in ints:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:4]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df, 10, 4).collect())) == sorted(want)


def test_token_files_read_back(spark, hard, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(got(spark, "op10_", hard), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])])[:-1].tolist()
    known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert known == sorted(known)
    want = Counter()
    for i, x, _ in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert by(rows, "doc_id", "n_tokens", "ids_crc32") == want


def _lines_by_hand(rows):
    """rows (doc_id, text, source) after line dedup; a document that loses its last word goes."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites, first = {}, {}
    for i, t, src in rows:
        for k, x in enumerate((t or "").split("\n")):
            if strip(x):
                sites.setdefault(strip(x), set()).add(src)
                at = (i is None, i or 0, k)
                first[strip(x)] = min(first.get(strip(x), at), at)
    bad = {x for x, v in sites.items() if len(v) >= linededup.MIN_SITES}
    out = []
    for i, t, src in rows:
        stays = lambda k, x: strip(x) not in bad or first[strip(x)] == (i is None, i or 0, k)  # noqa: E731, B023
        new = t and "\n".join(x for k, x in enumerate(t.split("\n")) if stays(k, x))
        if (new or "").split() or not (t or "").split():
            out.append((i, new, src))
    return out


def _kept_by_hand(rows):
    """One row of each component of near copies: the sizes of its groups of equal (doc_id, text) and the smallest id in each."""
    fps = [simhash.fingerprint(t) for _, t, _ in rows]
    left, out = set(range(len(rows))), []
    while left:
        stack, members = [left.pop()], []
        while stack:
            x = stack.pop()
            members.append(x)
            close = {j for j in left if (fps[x] ^ fps[j]).bit_count() <= 3}
            left -= close
            stack += close
        best = min((rows[m][0] is None, rows[m][0] or 0) for m in members)
        out.append([rows[m] for m in members if (rows[m][0] is None, rows[m][0] or 0) == best])
    return out


def test_pipeline_is_its_stages_by_hand(spark, hard, texts):
    """All five stages against plain loops; the model of the first is held against loops in its own test."""
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{hard}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    triple = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]

    def stage(name, docs):
        out = work.cut(stages[name](spark, docs, hard), f"test-{name}")
        assert out.columns == docs.columns and out.drop("doc_id", "text", "lang", "source", "n_chars").distinct().count() == 1  # clashing columns as they were
        return out

    tox = stage("toxicity", docs)
    dense = np.zeros(toxicity.DIMS)
    dense[model[0]] = model[1]
    s = toxicity.score_arrays(pa.array([t for _, t, _ in texts], pa.string()), dense, model[2])
    assert Counter(triple(tox)) == Counter(x for x, p in zip(texts, s) if p < 0.5)
    lined = stage("line_dedup", tox)
    assert Counter(triple(lined)) == Counter(_lines_by_hand(triple(tox)))
    assert all(r.n_chars == len(r.text) for r in lined.collect() if r.text is not None)
    kept = stage("simhash_near_dedup", lined)
    groups, rows = _kept_by_hand(triple(lined)), triple(kept)
    assert len(rows) == len(groups) and all(sum(r in g for r in rows) == 1 for g in groups)
    mixed = stage("mixing", kept)
    want, _ = _mixed_by_hand([(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows])
    assert Counter(i for i, _, _ in triple(mixed)) == Counter({i: k for i, _, _, k in want if k})
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = Counter()
    for i, x, _ in triple(mixed):
        tokens[i] += len(t.encode(x or "", add_special_tokens=False).ids) + 1
    packed, ran = Counter(), Counter()
    for r in stages["packing"](spark, mixed, hard).collect():
        packed[r.doc_id] += r.length
    for r in corpus_pipeline.run(spark, hard).collect():
        ran[r.doc_id] += r.length
    assert packed == ran == tokens


def test_blank_documents_stay(spark):
    rows = [(1, " \n\t ", "a", 4), (2, "\n\n", "b", 2), (3, "\t", "c", 1), (4, None, "d", None), (5, "", "e", 0), *((i, "one line", f"s{i}", 8) for i in range(6, 11))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert kept == {i: t for i, t, *_ in rows if i <= 6}


def test_shared_folder_comes_from_the_session(spark):
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert work.shared_dir(spark) == work.qualified(spark, said) if said else os.path.isdir(work.shared_dir(spark)[7:])
    assert json.dumps(list(Q)) and re.fullmatch(r"op\d+_\w+", next(iter(Q)))
    assert pfor.BLOCK == 256
