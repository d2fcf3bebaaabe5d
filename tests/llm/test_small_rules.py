"""The pipeline operators' rules on single texts, against plain Python written another way."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from millrace.llm import mpeg, packing, pfor, pii, public_vocab, simhash, textbytes, topk, toxicity, warc

ODD = ["", " ", "a", "a  b", "\n\na b\n", " x\ty's I'LL", "a\x00b c", "É é \xa0é 　x", "ǅa İx ſt ŉa ß.. x'll a1b 1a ẞa don't. Ab,\n\nc", "a\x1cb \x85c", "<|endoftext|> x", "word. " * 50, "x" * 3000, "a.b..c ...d, e", "naïve façade Ünïcode — “q”", "1,234.5 +1 (555) 555-0100", "Σίσυφος ΣΑΣ"]


@pytest.mark.parametrize("name,fn", [("word_bpe_49k.json", public_vocab.word_ids), ("byte_bpe_50k.json", public_vocab.byte_ids)])
def test_cached_ids_are_those_of_the_library(name, fn):
    path = public_tokenizers.path(name)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abz .,\n'1é \x0bß") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", " ", "\n", "hello", "É", "x1", "'s"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    library = Tokenizer.from_file(path)  # as it comes
    for t in texts:
        assert fn(t, path) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_word_bounds_and_hashes():
    texts = ["Ab, c", "", "é-x", "longer words of eightyyyyyyyy letters", "d"]
    seen = {}
    for i, j, data, bounds in textbytes.chunks(pa.array([*texts, None])):
        folded, s, e, rows = textbytes.words(data, bounds)
        h = textbytes.hashes(folded, s, e)
        got = [(r + i, bytes(folded[a:b]).decode()) for r, a, b in zip(rows.tolist(), s.tolist(), e.tolist())]
        for (_, w), x in zip(got, h.tolist()):
            assert seen.setdefault(w, x) == x
    assert got == [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())]
    assert len(set(seen.values())) == len(seen)


def test_ftrl_matches_the_written_rule():
    m = toxicity.Ftrl(alpha=0.5, beta=1.0, l1=0.3, l2=0.2)
    z, n = {}, {}
    rng = random.Random(1)
    for _ in range(60):
        at, y = [*sorted(rng.sample(range(9), 3)), toxicity.DIMS], rng.randint(0, 1)  # the last is the bias, without L1

        def w(i):
            zi, l1 = z.get(i, 0.0), 0.0 if i == toxicity.DIMS else 0.3
            return 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((1.0 + n.get(i, 0.0) ** 0.5) / 0.5 + 0.2)

        ws = {i: w(i) for i in at}
        g = toxicity.sigmoid(sum(ws.values())) - y
        for i in at:
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / 0.5
            z[i] = z.get(i, 0.0) + g - s * ws[i]
            n[i] = n.get(i, 0.0) + g * g
        m.learn(np.array(at[:-1]), y)
    assert all(abs(m.z[i] - z.get(i, 0.0)) < 1e-9 for i in (*range(9), toxicity.DIMS))
    ws = m.weights(np.array([*range(9), toxicity.DIMS]))
    assert all(abs(a - w(i)) < 1e-9 for a, i in zip(ws, (*range(9), toxicity.DIMS)))


@pytest.mark.parametrize("length", [1, 2, 31, 32, 33, 500, 1024, 1025, 1500, 2047, 2048, 2049, 5000, 100_001])
def test_pieces_add_up_and_fit_their_class(length):
    got = packing.split_lengths(length)
    assert sum(n for _, n in got) == length and all(0 < n <= 2048 // k for k, n in got)


def test_bins_hold_a_fixed_count_and_little_padding():
    rng = random.Random(5)
    p, full, seen = packing.Packer(0), {}, {}
    docs = [rng.choice([rng.randint(1, 40), rng.randint(1, 3000), rng.randint(1, 20_000)]) for _ in range(3000)]
    ids = lambda i, n: (np.arange(n, dtype="<u4") + i * 100_000).tobytes()
    events = [x for i, n in enumerate(docs) for x in p.put(i, n, ids(i, n))]
    assert all(len({packing.CAPACITY // n if n > packing.SMALL else n for _, _, n, *_ in pieces}) <= 2 for _, pieces in events)
    for seq, pieces in [*events, *p.end()]:
        at = 0
        for doc, start, n, offset, part in pieces:
            assert offset == at and part == ids(doc, docs[doc])[4 * start : 4 * (start + n)]
            at += n
            seen.setdefault(doc, []).append((start, n))
        assert 0 < at <= 2048
        full[seq] = at
    for i, n in enumerate(docs):
        got = sorted(seen[i])
        assert got[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(got, got[1:])) and sum(got[-1]) == n
    padded = sum(2048 if n & (n - 1) else n for n in full.values())
    assert 1 - sum(docs) / padded < 0.01


def test_base_spans_are_those_of_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d):
        t = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            t += x - 9 * (x > 9)
        return t % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (email, lambda s: True),
        "ip": (ip, lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (card, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (phone, lambda s: 9 <= len(digits(s)) <= 15),
    }
    rng = random.Random(7)
    parts = ["a@b.c", "@", "x.y@z", ".com", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-0100", "+44", " ", "..", "-", "é", "0001.2.3.4", "5", "a"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        want = [(k, m.start(), m.end()) for k, (rx, ok) in rules.items() for m in rx.finditer(t) if ok(m[0])]
        assert pii.base_spans(t) == want, t
    long = "a" * 200_000 + "1" * 200_000 + "@" * 1000
    assert pii.base_spans(long) == []


def test_sanitised_text():
    t = "mail bob@x.org or Bobby now"
    assert pii.sanitise_text(t, [("email", 5, 14), ("generalise", 18, 23), ("remove", 24, 27)]) == "mail [EMAIL] or [TERM] "


@pytest.mark.parametrize("text", ["", "one", "one two", "One TWO three", "a b c d e f g É", "w " * 700])
def test_fingerprint_is_the_majority(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    assert simhash.fingerprint(text) == want and simhash.fingerprint(None) == 0


@pytest.mark.parametrize("n", [1, 200_000, 10_000_000, 1 << 40])
def test_block_choices_miss_no_link(n):
    rng = random.Random(9)
    masks = [m & (1 << 64) - 1 for m in simhash.keys_of(n)]
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("seed", range(8))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    kinds = [rng.integers(0, 50_000, 3000), rng.integers(0, 2, 777), np.full(256, 7), np.arange(1000) * 4_000_000, np.where(rng.random(5000) < 0.05, 2**32 - 1, rng.integers(0, 9, 5000)), np.zeros(0, int), np.array([2**32 - 1])]
    for ids in kinds:
        blocks, sizes = pfor.encode_blocks(ids.astype(np.uint32))
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        assert np.array_equal(pfor.decode_blocks(np.frombuffer(blocks, np.uint8), start)[: len(ids)], ids)


def test_token_file_reads_by_document():
    import io

    out, rng = io.BytesIO(), random.Random(2)
    docs = [[rng.randint(0, 50_000) for _ in range(rng.choice([1, 5, 700]))] for _ in range(50)]
    pfor.write_file(out, [None, *range(1, 50)], [len(d) for d in docs], np.array([x for d in docs for x in d], np.uint32))
    r = pfor.Reader(out.getvalue())
    assert [r.document(i).tolist() for i in range(50)] == docs and r.keys[0] is None and r.all().tolist() == [x for d in docs for x in d]
    assert len(out.getvalue()) < 4 * sum(map(len, docs))


def test_warc_record_round_trip():
    r = warc.parse(warc.record(-5, "http://x.org/a b", b"p\r\n\r\nq", None))
    assert (r["page_id"], r["payload"], r["record_type"], r["refers_to"]) == (-5, b"p\r\n\r\nq", "response", None)
    v = warc.parse(warc.record(None, None, b"pq", (7,)))
    assert (v["page_id"], v["payload"], v["record_type"], v["refers_to"], v["payload_bytes"]) == (None, None, "revisit", 7, 2)
    assert v["payload_digest"] == warc.digest(b"pq")


def test_reversed_host_keys():
    assert warc.surt("HTTPS://user@www.Example.com:443/a?b=1#c") == "com,example)/a?b=1"
    assert warc.surt("example.org") == "org,example)/" and warc.surt(None) == "" and warc.surt("http://[bad") != ""
    assert warc.surt("http://x.org:81/") == "org,x:81)/"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 936, 937, 938, 5000, 100_000])
def test_media_round_trip(n):
    text = "".join(random.Random(n).choice("aé ÿ\n") for _ in range(n))
    payload, size = mpeg.to_payload(text)
    media = mpeg.store(payload, {"n_bytes": str(size)})
    p = mpeg.parse(media)
    assert mpeg.payload_of(media, p) == payload and len(payload) % 64 == 0 and payload
    assert p["resyncs"] == p["crc_bad"] == 0 and p["crc_good"] == len(p["places"]) == p["xing"]["frames"] and len(p["xing"]["toc"]) == 100
    assert p["samples"] == 1152 * len(p["places"]) and p["hertz"] == 48000


def test_media_resynchronises():
    payload = bytes(range(256)) * 40
    media = mpeg.store(payload, {})
    whole = mpeg.parse(media)
    cut = whole["places"][3]
    hurt = media[:cut] + b"\xff\xfagarbage\xff" + media[cut:] + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    p = mpeg.parse(hurt)
    assert p["resyncs"] >= 1 and p["skipped"] > 0 and len(p["places"]) >= len(whole["places"]) - 1 and p["tags"]["title"] == "Title"
    bad = bytearray(media)
    bad[whole["places"][2] + 10] ^= 1
    assert mpeg.parse(bytes(bad))["crc_bad"] == 1
    assert mpeg.parse(b"")["places"] == [] and mpeg.parse(b"no audio at all")["samples"] == 0


def test_cells_pick_the_best(monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 2)
    monkeypatch.setattr(topk, "STRIP", 300)
    rng = np.random.default_rng(0)
    q, c = rng.integers(-9, 9, (5, 4)).astype(float), rng.integers(-9, 9, (5000, 4)).astype(float)
    cid = np.arange(5000) // 2  # ids in pairs
    s, i = topk.cell_top(np.arange(5), q, cid, np.arange(5000), c, 7)
    for k in range(5):
        want = sorted((-int(x), int(cid[j])) for j, x in enumerate(c @ q[k]) if j != k)[:7]
        assert list(zip(-s[k], i[k])) == want
    few, _ = topk.cell_top(np.arange(2), q[:2], cid[:2], np.arange(2), c[:2], 7)
    assert (few != topk.NONE).sum() == 2
    big = topk._products(np.array([[2.0**40]]), np.array([[2.0**40], [-(2.0**10)]]))
    assert big.tolist() == [[2**63 - 1, -(2**50)]]


@pytest.mark.parametrize("v", [[], [1.0, -5.0], [40_000.0, 1.0], [2.0**40, -3.0]])
def test_packed_vectors(v):
    assert topk._dense([topk._packed(np.array(v))], len(v)).tolist() == [v]


def _frame(four: bytes, body: bytes, bits: int) -> bytes:
    """A protected frame of layer I or II: its CRC taken bit by bit over header and the first bits of its body."""
    word, x = "".join(f"{b:08b}" for b in four[2:] + body)[: 16 + bits], 0xFFFF
    for b in word:
        top = x >> 15 ^ int(b)
        x = (x << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return (four + x.to_bytes(2, "big") + body).ljust(mpeg.header(four)[0], b"\0")


def test_checksums_of_the_other_layers():
    rng = random.Random(4)
    # mono layer I at 44.1 kHz: 32 allocations of 4 bits; layer II at 192 kbit/s, joint stereo from subband 8
    one = _frame(b"\xff\xfe\x90\xc0", bytes(rng.randrange(256) for _ in range(60)), 128)
    body = bytes(rng.randrange(256) for _ in range(80))
    bits = "".join(f"{b:08b}" for b in body)
    at, chosen = 0, 0
    for sb in range(30):  # 96 kbit/s a channel: 30 subbands
        width = 4 if sb < 11 else 3 if sb < 23 else 2
        for _ in range(2 if sb < 8 else 1):
            chosen += (2 if sb >= 8 else 1) * (int(bits[at : at + width], 2) > 0)
            at += width
    two = _frame(b"\xff\xfc\xa0\x50", body, at + 2 * chosen)
    for frame in (one, two):
        p = mpeg.parse(frame * 3)
        assert (len(p["places"]), p["crc_good"], p["crc_bad"]) == (3, 3, 0)
        hurt = bytearray(frame)
        hurt[9] ^= 0x10
        assert mpeg.parse(bytes(hurt) + frame)["crc_bad"] == 1


def test_vbri_table_is_no_audio():
    four = b"\xff\xfb\x90\x00"
    size = mpeg.header(four)[0]
    table = b"VBRI" + b"\0\1\0\0\0\0" + (5 * size).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"\0\2\0\1\0\2\0\2" + (2 * size).to_bytes(2, "big") * 2
    stream = (four + bytes(32) + table).ljust(size, b"\0") + 4 * four.ljust(size, b"\0")
    p = mpeg.parse(stream)
    assert len(p["places"]) == 4 == p["xing"]["frames"] and p["samples"] == 4 * 1152 and p["xing"]["bytes"] == len(stream) and p["xing"]["steps"] == [2 * size] * 2


def test_crc_of_ids_is_unsigned():
    assert zlib.crc32((1).to_bytes(4, "little")) >= 0


def test_packed_coordinates_sort_like_lists():
    rng = random.Random(4)
    lists = [sorted(rng.sample(range(top), rng.randint(0, min(top, 30)))) for top in (3, 40, 1 << 15, (1 << 15) + 2, toxicity.DIMS) for _ in range(60)]
    lists += [[], [0], [toxicity.DIMS - 1], [0, 1 << 15], [0, (1 << 15) - 1], [1 << 15]]
    rows, cols = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array(sum(lists, []), np.int32)
    packed = toxicity.pack(rows, cols, len(lists))
    assert [toxicity.unpack(x).tolist() for x in packed] == lists
    assert [toxicity.coordinates(x) for x in packed] == [len(x) for x in lists]
    assert sorted(range(len(lists)), key=lambda k: (packed[k], k)) == sorted(range(len(lists)), key=lambda k: (lists[k], k))


@pytest.mark.parametrize("most", [0, 1, 7, 40, 1000])
def test_first_rows_in_any_order(most):
    rng = random.Random(most)
    rows = [(rng.choice([-(2**63), -5, 0, 9, 2**63 - 1]), k, k % 2, b"\0\1" * rng.randint(0, 6)) for k in range(60)]
    want, left = [], most
    for _, _, y, raw in sorted(rows):
        left -= len(raw) // 2
        if left >= 0:
            want.append((y, raw))
    for _ in range(5):
        rng.shuffle(rows)
        assert toxicity.first_rows(iter(rows), most) == want


def test_features_take_little_memory():
    """A batch's arrays are of a part of its text, as two workers, their vocabularies and the JVM share one executor."""
    rng = random.Random(5)
    texts = pa.array([" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(500)) for _ in range(1000)])
    tracemalloc.start()
    toxicity.score_arrays(texts, np.ones(toxicity.DIMS), 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


@pytest.mark.parametrize("name,fn,fold", [("word_bpe_49k.json", public_vocab.word_ids, True), ("byte_bpe_50k.json", public_vocab.byte_ids, False)])
def test_words_with_marks_take_no_whole_tokenizer(name, fn, fold, monkeypatch):
    """Latin words go to the merge model whatever punctuation follows; the whole tokenizer sees each run of marks once."""
    path, library = public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))
    monkeypatch.setattr(public_vocab, "_loaded", {})
    pieces, whole = public_vocab.load(path, fold), []
    monkeypatch.setattr(pieces, "encode", lambda p, as_was=pieces.encode: whole.append(p) or as_was(p))
    rng, marks = random.Random(6), [",###", "***", "...", '."', "-", "%%%", ")]", "/_"]
    texts = [" ".join("".join(rng.choices("aeiñéßİȺǅſK", k=rng.randint(1, 9))) + rng.choice([*marks, ""]) for _ in range(40)) for _ in range(40)]
    texts += [" ".join("".join(rng.choices("abcdeéñ", k=6)) + rng.choice(marks) for _ in range(40)) for _ in range(40)]
    for k, t in enumerate(texts):
        if k == 40:
            whole.clear()
        assert fn(t, path) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
    assert set(whole) <= {*marks, ""} and len(whole) <= len(marks) + 1
    for t in ["it's,", "x'll... y'", "a,'s b.'t", "a'###", "é#' d", "a?!b", "1,### a1,"]:
        assert fn(t, path) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)
