"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give protected entities away.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers by fixed patterns. Every base value is a
protected entity. The corpus then tells how strongly a term reveals an entity: with document counts over distinct
texts, PMI(e; t) = log(n(e,t) N / (n(e) n(t))), and the term's share of what there is to know about the entity is
PMI(e; t) / IC(e) with IC(e) = log(N / n(e)). A term that stands with an entity in at least SUPPORT distinct texts is
generalised wherever it occurs if that share reaches GENERALISE for some entity, and removed if it reaches REMOVE.

Terms are all words of a text that holds an entity, wherever they stand in it. Their document counts cover the whole
corpus. Two lower bounds of a term's count bound a pair's share from above and spare most look-ups: the count among the
texts that hold entities, and that among the texts whose hash is divisible by THINNED; only terms that may still qualify
are counted in full. What tasks are sent is a Bloom filter, sized by the number of terms up to MOST_BITS bits; what passes
it is settled by a join. Hot entities and terms are combined before the shuffle and looked up by `skew_lookup`.

Defined cases: a null text counts as empty and has no span; repeated rows get equal spans and copies count once in the
statistics; offsets are code points with the end exclusive; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .work import batched, column, cut, fresh, map_arrow, map_columns, skew_lookup, table

KINDS = ("email", "ip", "card", "phone")
TERMS = ("generalise", "remove")
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
#: Bits of a filter per term, hashes, and bits at most: 32 MB.
BITS_EACH = 16
HASHES = 4
MOST_BITS = 1 << 28
#: Terms are first counted in one of so many texts.
THINNED = 16
SHORTEST = 3

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits: it would have begun with the run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, in time linear in the text: each @ is looked at once, from the middle outwards."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """A protected entity's own form."""
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _NOT_DIGIT.sub('', value)}"


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, start, end) of the words of a text that may be terms, in code points."""
    data = np.frombuffer(text.encode(), np.uint8)
    folded, starts, ends, _ = tb.words(data, np.array([0, len(data)]))
    long = ends - starts >= SHORTEST
    starts, ends = starts[long], ends[long]
    chars = tb.char_offsets(data)
    return tb.hashes(folded, starts, ends).view(np.int64), chars[starts], chars[ends]


def contexts(text: str) -> tuple[list[str], list[int]]:
    """The distinct entities of a text, and if there are any its distinct terms outside of them."""
    spans = base_spans(text)
    if not spans:
        return [], []
    h, a, b = _words(text)
    edge = np.zeros(len(text) + 2, np.int64)
    for _, s, e in spans:
        edge[s] += 1
        edge[e] -= 1
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
    return sorted({entity(k, text[s:e]) for k, s, e in spans}), np.unique(h[covered[a] == covered[b]]).tolist()


def _places(h: np.ndarray | Column, i: int, mask: int) -> np.ndarray | Column:
    """The i-th bit of a term: double hashing by the two halves of its 64-bit hash."""
    if isinstance(h, Column):
        return (h.bitwiseAND(mask) + F.lit(i) * F.shiftrightunsigned(h, 32)).bitwiseAND(mask)
    return ((h & mask) + i * (h.view(np.uint64) >> np.uint64(32)).view(np.int64)) & mask


def _bloom(terms: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(mask, bytes) of a filter of n terms (_t); it comes in rows of 64 bits, at most MOST_BITS / 64 of them."""
    bits = min(MOST_BITS, max(1 << 10, 1 << (BITS_EACH * n).bit_length()))
    at = terms.select(F.explode(F.array(*(_places(F.col("_t"), i, bits - 1) for i in range(HASHES)))).alias("at"))
    got = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b")).toPandas()
    words = np.zeros(bits >> 6, np.int64)
    words[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return bits - 1, words.view(np.uint8)


def _passes(bloom: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    """The places in h of what the filter lets pass."""
    mask, bits = bloom
    live = np.arange(len(h))
    for i in range(HASHES):
        at = _places(h[live], i, mask)
        live = live[(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
    return live


def _counted(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(_t, _n) of each term in terms (_t, _w): in how many distinct texts (_text, _h) it stands; no row if in none."""
    sent = texts.sparkSession.sparkContext.broadcast(_bloom(terms.select("_t"), terms.count()))

    def occurring(b: pa.RecordBatch) -> pa.RecordBatch:
        bloom, hs = sent.value, np.asarray(b.column(1))
        all_t, all_h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, _, data, bounds in tb.chunks(b.column(0)):
            folded, starts, ends, rows = tb.words(data, bounds)
            long = ends - starts >= SHORTEST
            h = tb.hashes(folded, starts[long], ends[long]).view(np.int64)
            ok = _passes(bloom, h)
            pair = np.unique(np.stack([rows[long][ok], h[ok]]), axis=1) if len(ok) else np.zeros((2, 0), np.int64)
            all_t.append(pair[1])
            all_h.append(hs[i + pair[0]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(all_t)), pa.array(np.concatenate(all_h))], names=["_t", "_h"])

    count = map_arrow(texts, occurring, "_t long, _h long").distinct().groupBy("_t").agg(F.count("*").alias("_n"))
    return count.join(terms.select("_t"), "_t", "left_semi")


def disclosing(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_t, _n, _share): terms whose share of some entity's information reaches GENERALISE, with their document count."""
    words = column(text).cast("string")
    texts = docs.select(words.alias("_text"), F.xxhash64(words).alias("_h")).where(F.col("_text").isNotNull())

    def holding(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(h, e, t) for h, (e, t) in zip(b.column(1).to_pylist(), map(contexts, b.column(0).to_pylist())) if e]
        cols = list(zip(*rows)) or [()] * 3
        kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["_h", "_e", "_t"])

    total = texts.select("_h").distinct().count()
    held = map_arrow(texts, holding, "_h long, _e array<string>, _t array<long>").dropDuplicates(["_h"])
    held = cut(held.select(F.transform("_e", lambda e: F.xxhash64(e)).alias("_e"), "_t"), "pii-texts")
    own = held.select(F.explode("_e").alias("_e")).groupBy("_e").agg(F.count("*").alias("_ne"))
    own = cut(own.where((F.col("_ne") >= SUPPORT) & (F.col("_ne") < total)).withColumn("_w", F.col("_ne")), "pii-entities")
    beside = held.select(F.explode("_t").alias("_t")).groupBy("_t").agg(F.count("*").alias("_n")).where(F.col("_n") >= SUPPORT)
    beside = cut(beside.withColumn("_w", F.col("_n")), "pii-beside")
    both = skew_lookup(held.select(F.explode("_e").alias("_e"), "_t"), own, "_e", "_w", "inner").select("_e", "_ne", F.explode("_t").alias("_t"))
    both = both.groupBy("_e", "_ne", "_t").agg(F.count("*").alias("_both")).where(F.col("_both") >= SUPPORT)

    pmi = F.log(F.col("_both") * F.lit(float(total)) / (F.col("_ne") * F.col("_n")))
    share = pmi / F.log(F.lit(float(total)) / F.col("_ne"))
    # a count among some of the texts is at most that of the corpus: the share can only be lower
    may = share >= GENERALISE - 1e-9
    pairs = cut(skew_lookup(both, beside, "_t", "_w", "inner").where(may).select("_e", "_ne", "_t", "_both"), "pii-pairs", held, own, beside)
    of = lambda p: p.groupBy("_t").agg(F.count("*").alias("_w"))
    terms = cut(of(pairs), "pii-terms")
    some = cut(_counted(texts.where(F.pmod(F.col("_h"), F.lit(THINNED)) == 0), terms).join(terms, "_t"), "pii-thinned")
    seen = skew_lookup(pairs, some, "_t", "_w", "left")
    pairs = cut(seen.where(F.col("_n").isNull() | may).drop("_n"), "pii-pairs", pairs, terms, some)
    terms = cut(of(pairs), "pii-terms")
    count = cut(_counted(texts, terms).join(terms, "_t"), "pii-counts")
    found = skew_lookup(pairs, count, "_t", "_w", "inner").withColumn("_share", share).groupBy("_t").agg(F.max("_n").alias("_n"), F.max("_share").alias("_share"))
    return cut(found.where(F.col("_share") >= GENERALISE), "pii-disclosing", pairs, terms, count)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _base array<struct<kind,start,end>>, _terms likewise) for every row."""
    spark = docs.sparkSession
    batched(spark)
    told = disclosing(docs, text)
    sent = spark.sparkContext.broadcast(_bloom(told.select("_t"), told.count()))
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    hits = pa.list_(pa.struct([("t", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, row = sent.value, TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column(1).fill_null("")
            maybe: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for i, _, data, bounds in tb.chunks(texts):
                folded, starts, ends, rows = tb.words(data, bounds)
                long = np.flatnonzero(ends - starts >= SHORTEST)
                h = tb.hashes(folded, starts[long], ends[long]).view(np.int64)
                ok = _passes(bloom, h)
                if len(ok):
                    chars = tb.char_offsets(data)
                    w = long[ok]
                    zero = chars[bounds[rows[w]]]
                    for r, t, s, e in zip(rows[w].tolist(), h[ok].tolist(), (chars[starts[w]] - zero).tolist(), (chars[ends[w]] - zero).tolist()):
                        maybe[i + r].append({"t": t, "start": s, "end": e})
            base = []
            for j, t in enumerate(texts.to_pylist()):
                found = base_spans(t)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                if found and maybe[j]:  # what lies in a base span is its own
                    maybe[j] = [m for m in maybe[j] if not any(m["start"] < e and m["end"] > s for _, s, e in found)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), b.column(0), pa.array(base, span), pa.array(maybe, hits)], names=["_row", "_key", "_base", "_maybe"])
            row += b.num_rows

    schema = f"_row long, _key {kind}, _base array<struct<kind:string,start:long,end:long>>, _maybe array<struct<t:long,start:long,end:long>>"
    rows = cut(docs.select(column(key).alias("_key"), column(text).cast("string").alias("_text")).mapInArrow(run, schema), "pii-spans")
    each = rows.where(F.size("_maybe") > 0).select("_row", F.explode("_maybe").alias("_m")).select("_row", F.col("_m.t").alias("_t"), F.col("_m.start").alias("start"), F.col("_m.end").alias("end"))
    kinds = F.when(F.col("_share") >= REMOVE, F.lit(TERMS[1])).otherwise(F.lit(TERMS[0]))
    sure = skew_lookup(each, told, "_t", "_n", "inner").select("_row", F.struct(kinds.alias("kind"), "start", "end").alias("_s"))
    per_row = sure.groupBy("_row").agg(F.array_sort(F.collect_list("_s")).alias("_terms"))
    none = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    return rows.join(per_row, "_row", "left").select(F.col("_key").alias(key), "_base", F.coalesce("_terms", none).alias("_terms"))


def sanitise_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with base values as [EMAIL] and so on, generalised terms as [TERM] and removed terms gone."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < at:  # inside what has been replaced
            continue
        out += [text[at:s], "" if kind == "remove" else "[TERM]" if kind == "generalise" else f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with sanitised texts; rows of one key and one text get the same, so keys need not be unique. A null text stays."""
    k, h, spans = fresh(docs, "_k"), fresh(docs, "_h"), fresh(docs, "_spans")
    body = F.xxhash64(column(text).cast("string"))
    rows = docs.select(F.struct(column(key).alias("k"), body.alias("h")).alias("_key"), column(text).alias("_text"))
    found = find(rows, "_key", "_text").select(F.col("_key.k").alias(k), F.col("_key.h").alias(h), F.concat("_base", "_terms").alias(spans)).dropDuplicates([k, h])
    both = docs.join(found, column(key).eqNullSafe(F.col(k)) & (body == F.col(h))).drop(k, h)
    names = both.columns
    t, s = names.index(text), names.index(spans)

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        new = [None if x is None else sanitise_text(x, [(y["kind"], y["start"], y["end"]) for y in ys]) for x, ys in zip(columns[t].to_pylist(), columns[s].to_pylist())]
        return [pa.array(new, pa.string()) if i == t else c for i, c in enumerate(columns) if i != s]

    return map_columns(both, run, docs.schema.fields)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.size("_base").cast("long").alias("n_spans"), F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.concat("_base", "_terms")).alias("spans"))
