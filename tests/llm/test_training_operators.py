"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from pulsegrid.llm import fingerprints, mixing, mpeg, order_minhash, pieces, quality, separators, suffix_tree, topk, warc
from pulsegrid.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")
#: With extra columns whose names the operators use themselves.
DOCS = "doc_id long, text string, source string, node string, copies string, size string, h string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "n", "c", "s", "h") for i, t, s in rows], DOCS)


def words_of(text):
    return (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")


def split(text):
    return [w for w in words_of(text) if w]


AWKWARD = [
    (1, None, "a"), (2, "", None), (3, " \t\r\n ", "a"), (4, "one", "b"), (5, "▁ literal ▁▁marks", "b"), (6, "  two  spaces \n\n lines ", None),
    (7, "é😀  nbsp  sep \x00nul", "c"), (8, "word " * 3000, "a"), (8, "word " * 3000, "a"), (None, "no id", "c"), (9, "x" * 50_000, "a"),
]


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(300)]
    rows += [(40, rows[3][1]), (400, None), (401, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (402, [None] + [0.0] * 5), (420, [float("inf")] * 6), (None, [1.0] * 6), (440, [])]
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    queries = {}
    for i, v in good:
        if i % 20 == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:20]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(frame, shard_rows=50).collect()} == want
    assert topk.top_k(frame.limit(0)).count() == 0


def test_topk_stops_early():
    vectors = np.zeros((1000, 3), dtype=np.int64)
    vectors[:, 0] = np.arange(1000)
    shard = topk.Shard(np.arange(1000), vectors)
    at, ids, scores = shard.search(np.array([-1, 998]), np.array([[2, 0, 0], [3, 0, 0]]), 3)
    assert at.tolist() == [0, 0, 0, 1, 1, 1] and ids.tolist() == [999, 998, 997, 999, 997, 996] and scores.tolist()[:3] == [1998, 1996, 1994]
    assert shard.scored == 2 * 8
    # a bar above all of a shard's vectors: none is scored
    assert len(shard.search(np.array([-1]), np.array([[2, 0, 0]]), 3, np.array([2000]))[0]) == 0 and shard.scored == 2 * 8
    # no floats where products are too large for them
    huge = topk.Shard(np.arange(3), np.array([[2**40, 1], [2**40, 2], [2**40, 3]]))
    assert huge.search(np.array([-1]), np.array([[2**20, 1]]), 2)[1].tolist() == [2, 1]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_suffix_tree(spark):
    rng = random.Random(2)
    phrases = ["the quick brown fox jumps", "over the lazy dog", "A rare thing", "in the end there is"]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randrange(30))), "s") for i in range(200)] + AWKWARD
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter()
    for i, t, _ in rows:
        if not held(i):
            counts.update([*split(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    got = suffix_tree.scored(docs(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        tokens = [*split(lower(t)), None]
        want.append((str(i), held(i), len(tokens), sum(counts[x] > 0 for x in tokens), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens), 5)))
    assert sorted((str(r[0]), *r[1:5], round(r[5], 5)) for r in got) == sorted(want)
    # contexts help where text repeats
    some = [r for r in got if r["held_out"] and r["n_tokens"] > 10]
    assert sum(r["score"] for r in some) > 0.5 * sum(r["base_score"] for r in some)
    assert suffix_tree.scored(docs(spark, [])).count() == 0


def tree_brute(rows, depth, held):
    """The score of each text by a tree over tuples of words, without hashing."""
    texts = [(i, [*split(lower(t)), None]) for i, t, _ in rows]
    grams = [Counter() for _ in range(depth + 2)]  # by length; a gram may begin with the beginning of its text, 0
    for i, t in texts:
        if not held(i):
            s = [0, *t]
            for size in range(1, depth + 2):
                grams[size].update(tuple(s[k : k + size]) for k in range(len(s) - size + 1))
    words = {g[0]: n for g, n in grams[1].items() if g[0] != 0}
    n, v = sum(words.values()), len(words)
    kept = {}

    def p(context, word):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return (words.get(word, 0) + 0.1) / (n + 0.1 * (v + 1))
        edges, rest = kept[context]
        return edges.get(word, 0) + rest * p(context[1:], word)

    for size in range(1, depth + 1):
        following = {}
        for g, c in grams[size + 1].items():
            if c >= 2:
                following.setdefault(g[:-1], {})[g[-1]] = c
        found = {}
        for context, edges in following.items():
            total = grams[size][context]
            share = {w: (c - 0.75) / total for w, c in edges.items()}
            rest = min(max(1 - sum(share.values()), 1e-6), 1)
            above = {w: p(context[1:], w) for w in edges}
            own = {w: share[w] + rest * above[w] for w in edges}
            gap = sum(own[w] * math.log(own[w] / above[w]) for w in edges) + rest * max(1 - sum(above.values()), 1e-9) * math.log(rest)
            if gap >= 0.01 and gap * total >= 10:
                found[context] = (share, rest)
        kept.update(found)
    return [(str(i), round(sum(math.log10(p(tuple([0, *t][max(0, k + 1 - depth) : k + 1]), w)) for k, w in enumerate(t)), 4)) for i, t in texts]


@pytest.mark.parametrize("share", [2e-6, 1.0])
def test_suffix_tree_scores(spark, monkeypatch, share):
    """Equal to a brute-force tree, with all grams broadcast or all looked up."""
    monkeypatch.setattr(suffix_tree, "HEAD_SHARE", share)
    rng = random.Random(12)
    phrases = ["a b c d e", "x b c q", "over the b c dog", "A rare thing", "b c d", "c e a", *(f"u{k} v{k % 7}" for k in range(40))]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randrange(30))), "s") for i in range(120)] + AWKWARD
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    got = suffix_tree.scored(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got) == sorted(tree_brute(rows, suffix_tree.DEPTH, held))


def test_suffix_tree_keeps_what_repeats_at_any_size(spark):
    """A phrase that occurs 30 times in 1.3 million tokens, of which the common words have no context."""
    phrase = "zug zwang remis"
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(1300)) + (" " + phrase if i < 30 else ""), "s") for i in range(1000)]
    rows.append((5000, phrase, "s"))
    r = suffix_tree.scored(docs(spark, rows)).where("doc_id = 5000").first()
    # two of its four tokens follow from the one before
    assert r["score"] - r["base_score"] > 8


def kept_brute(rows, window=20):
    order = sorted((i, t) for i, t, _ in rows)
    seen, out = set(), {}
    for i, t in order:
        w = split(t)
        cover = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                cover[k : k + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, c in zip(w, cover, strict=True) if not c)
        out[i] = (len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_fingerprints(spark):
    rng = random.Random(3)
    passages = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(15, 45))] for _ in range(6)]
    rows = []
    for i in range(60):
        t = [x for _ in range(rng.randrange(4)) for x in (*rng.choice(passages), *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(9))))]
        rows.append((i, "\n".join(t), "s"))
    rows += [(100 + i, t, s) for i, (_, t, s) in enumerate(AWKWARD)]
    got = {r[0]: tuple(r)[1:] for r in fingerprints.deduplicated(docs(spark, rows)).collect()}
    assert got == kept_brute(rows)


def test_fingerprints_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(2, long, "a"), (1, long + " more", "b"), (None, long, None), (1, long, "c")]
    out = fingerprints.deduplicated(docs(spark, rows), texts=True)
    assert out.columns == docs(spark, rows).columns
    left = out.collect()
    assert len(left) == 4 and {r["node"] for r in left} == {"n"}
    assert sum(len(split(r["text"])) for r in left) in (51, 52)  # of two rows with one id either may be first
    assert [r["text"] for r in left if r["doc_id"] in (2, None)] == ["", ""]
    assert fingerprints.deduplicated(docs(spark, [])).count() == 0


def test_fingerprint_index_goes_on_in_another_session(spark, tmp_path):
    """Two batches, the second after the index is closed and opened, give what one build gives."""
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{shared} u{i}" if i % 3 else " ".join(f"x{i}y{k}" for k in range(50)), "s") for i in range(20)]
    prints = fingerprints.fingerprints(docs(spark, rows).withColumnRenamed("node", "n").withColumnRenamed("doc_id", "node"))
    first, second = prints.where("node < 9"), prints.where("node >= 9")
    index = fingerprints.FingerprintIndex(spark, f"file://{tmp_path}/index", buckets=3)
    found = {r["h"] for r in index.add(first).collect()}
    index.close()
    other = fingerprints.FingerprintIndex.open(spark.newSession(), f"file://{tmp_path}/index")
    found |= {r["h"] for r in other.add(second).collect()}
    assert [level for level, _ in other.runs] == [1] and other.buckets == 3
    total = Counter()
    for r in prints.collect():
        total[r["h"]] += r["n"]
    assert found == {h for h, n in total.items() if n > 1} and found
    other.close()


def thue_morse(k, a, b):
    """The sequence on which every polynomial hash modulo a power of two collides with its complement."""
    bits = [0]
    for _ in range(k):
        bits += [1 - x for x in bits]
    return [a if x else b for x in bits], [b if x else a for x in bits]


def test_words_and_texts_that_collide_in_polynomials(spark):
    one, two = ("".join(x) for x in thue_morse(11, "a", "b"))
    rows = [(i, t, "s") for i, t in enumerate([one, two, *(" ".join(x) for x in thue_morse(11, "yes", "no"))])]
    frame = docs(spark, rows)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, hashlib.sha256(",".join(map(str, model.encode(t))).encode()).hexdigest()) for i, t, _ in rows]
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in pieces.encoded(frame, MODEL).collect()) == want
    assert {r["doc_id"]: tuple(r)[1:] for r in fingerprints.deduplicated(frame).collect()} == kept_brute(rows)
    assert len({r["class_id"] for r in order_minhash.near_classes(frame).where("doc_id < 2").collect()}) == 2
    assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in suffix_tree.scored(frame).collect()) == sorted(tree_brute(rows, suffix_tree.DEPTH, lambda i: zlib.crc32(str(i).encode()) % 10 == 0))


def test_mpeg_round_trip(spark):
    got = mpeg.round_trip(docs(spark, AWKWARD)).collect()
    want = []
    for i, t, _ in AWKWARD:
        raw = (t or "").encode()
        pad = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        want.append((str(i), len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])))
    assert sorted((str(r[0]), *tuple(r)[1:5]) for r in got) == sorted(want)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}) == len({w[3] for w in want})
    assert mpeg.round_trip(docs(spark, [])).count() == 0


def plain_frames(data):
    """(offset, length) of the frames of a 32 kHz mono layer III stream between its tags, by a plain walk."""
    kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    at = 10 + (data[8] << 7 | data[9])
    out = []
    while data[at : at + 3] != b"TAG":
        assert data[at] == 0xFF and data[at + 1] == 0xFA
        size = 144 * 1000 * kbps[data[at + 2] >> 4] // 32000
        out.append((at, size))
        at += size
    assert len(data) == at + 128
    return out[1:]  # the first holds the table


def test_mpeg_columns_by_a_plain_walk(spark):
    """Frames, durations, seek offsets and the payload of the stored media, and the row's columns, from a parser of their own."""
    rows = [(i, t, s) for i, t, s in AWKWARD if i not in (8, None)]
    media = {r["doc_id"]: r["media"] for r in mpeg.stored(docs(spark, rows)).collect()}
    for r in mpeg.round_trip(docs(spark, rows)).collect():
        data = bytes(media[r["doc_id"]])
        frames = plain_frames(data)
        payload = b"".join(data[a + 23 : a + n] for a, n in frames)[: r["payload_bytes"]]
        assert hashlib.sha256(payload).hexdigest() == r["payload_sha256"]
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r["frames"], r["samples"], r["sample_rate"]) == (len(frames), 1152 * len(frames), 32000)
        assert [(x["sample"], x["offset"]) for x in r["seek"]] == [(1152 * k, a) for k, (a, _) in enumerate(frames) if k % 64 == 0]
        assert f"frames={len(frames)}; seconds={len(frames) * 0.036:.3f}" in r["feature"] and f"crc={len(frames) + 1}/{len(frames) + 1}" in r["feature"]


def crc_plain(bits):
    value = 0xFFFF
    for b in bits:
        value = (value << 1 & 0xFFFF) ^ (0x8005 if (value >> 15) ^ b else 0)
    return value


def frame_of_layer(layer, kbps_at, allocation, channels=1):
    """A protected MPEG-1 frame at 44.1 kHz whose allocation is given as (bits, code) for each subband and channel."""
    bits = [int(x) for n, code in allocation for x in f"{code:0{n}b}"]
    used = sum(code > 0 for _, code in allocation)
    bits += [1, 0] * used if layer == 2 else []
    four = bytes((0xFF, 0xF0 | 8 | (4 - layer) << 1, kbps_at << 4, (3 if channels == 1 else 0) << 6))
    h = mpeg.header(four)
    head = [int(x) for b in four[2:] for x in f"{b:08b}"]
    body = int("".join(map(str, bits)).ljust(8 * -(-len(bits) // 8), "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    return (four + crc_plain(head + bits).to_bytes(2, "big") + body).ljust(h.size, b"\x55")


@pytest.mark.parametrize("layer, kbps_at, widths, channels", [(1, 6, [4] * 32, 1), (1, 6, [4] * 64, 2), (2, 4, [4] * 11 + [3] * 12 + [2] * 4, 1), (2, 10, [4] * 22 + [3] * 24 + [2] * 14, 2), (2, 2, [4] * 2 + [3] * 6, 1)])
def test_mpeg_checksums_of_layers_one_and_two(layer, kbps_at, widths, channels):
    rng = random.Random(kbps_at)
    good = b"".join(frame_of_layer(layer, kbps_at, [(n, rng.randrange(2 ** n)) for n in widths], channels) for _ in range(4))
    s = mpeg.parse(good)
    assert (len(s.headers), s.crc_seen, s.crc_wrong, s.junk) == (4, 4, 0, 0)
    bad = bytearray(good)
    bad[s.offsets[2] + 8] ^= 0x10  # inside the allocation
    assert mpeg.parse(bytes(bad)).crc_wrong == 1
    other = bytearray(good)
    other[s.offsets[2] + s.headers[2].size - 1] ^= 1  # behind what the checksum covers
    assert mpeg.parse(bytes(other)).crc_wrong == 0


def test_mpeg_tags_and_tables():
    frame = mpeg.write(b"\0" * 64, 64)
    start = 10 + (frame[8] << 7 | frame[9])
    sound = frame[start:-128]
    size = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    # version 3: unsynchronised, with an extended header of 6 bytes
    text = b"TIT2" + (5).to_bytes(4, "big") + b"\0\0" + b"\0\xffabc"
    body = (6).to_bytes(4, "big") + bytes(6) + text.replace(b"\xff", b"\xff\0")
    s = mpeg.parse(b"ID3\3\0\xc0" + size(len(body)) + body + sound)
    assert s.tags["TIT2"] == "\xffabc" and s.junk == 0
    # version 4: an extended header that counts itself, and a footer
    text = b"TIT2" + size(4) + b"\0\0" + b"\3abc"
    body = size(6) + b"\1\0" + text
    s = mpeg.parse(b"ID3\4\0\x50" + size(len(body)) + body + b"3DI\4\0\x50" + size(len(body)) + sound)
    assert s.tags["TIT2"] == "abc" and s.junk == 0
    # a VBRI table in the first frame
    first = bytearray(sound[: mpeg.header(sound[:4]).size])
    first[36 : 36 + 26 + 4] = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + (5000).to_bytes(4, "big") + (7).to_bytes(4, "big") + (2).to_bytes(2, "big") + (3).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (10).to_bytes(2, "big") + (20).to_bytes(2, "big")
    first[23 : 27] = bytes(4)
    s = mpeg.parse(bytes(first) + sound[len(first) :])
    assert s.table == {"vbr": 1, "bytes": 5000, "frames": 7} and s.toc == [30, 90]


def test_mpeg_parses_damaged_streams(spark):
    whole = mpeg.write(bytes(range(256)) * 40, 10240)
    clean = mpeg.parse(whole)
    assert clean.junk == clean.crc_wrong == 0 and clean.table["frames"] == len(clean.headers)
    assert clean.seconds == pytest.approx(len(clean.headers) * 1152 / 32000)
    at = clean.offsets[1]
    junk = mpeg.parse(whole[:at] + b"\xff\xfbjunk" + whole[at:])
    assert junk.junk == 6 and len(junk.headers) == len(clean.headers)
    wrong = bytearray(whole)
    wrong[at + 4] ^= 1
    assert mpeg.parse(bytes(wrong)).crc_wrong == 1
    facts = mpeg.parsed(spark.createDataFrame([(1, bytes(whole)), (2, None), (3, b"no audio")], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert [r["frames"] for r in facts] == [len(clean.headers), 0, 0] and facts[0]["seek"][0]["offset"] == clean.offsets[0]
    with pytest.raises(ValueError):
        mpeg.payload_of(bytes(wrong), mpeg.parse(bytes(wrong)))


def test_warc(spark):
    pages = [(1, "u", "a"), (2, None, "a"), (3, "u\r\nx", None), (4, "u", ""), (5, "u", "é\r\n\r\n" * 9000), (6, "u", "é\r\n\r\n" * 9000), (7, "u", "z" * 70_000)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r["record_type"], r["refers_to"]) for r in got] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("revisit", 6), ("response", None), ("response", None)]
    for r, (_, _, html) in zip(got, pages, strict=True):
        raw = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), warc.digest(raw))
    assert [r["segments"] for r in got if r["page_id"] in (6, 7)] == [4, 5]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_of_repeated_and_null_ids(spark):
    pages = [(1, "u", "a"), (1, "v", "a"), (1, "w", "b"), (None, None, "a"), (None, None, "c"), (9, "x" * 20_000, "d" * 40_000)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    want = [(1, "response", None, "a"), (1, "response", None, "a"), (1, "response", None, "b"), (None, "revisit", 1, "a"), (None, "response", None, "c"), (9, "response", None, "d" * 40_000)]
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in got) == Counter((p, k, f, warc.digest(h.encode())) for p, k, f, h in want)


def test_warc_holds_revisits_against_responses(spark):
    facts = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int"
    response, revisit = (2, 1, "X", "response", None, 1), (1, 1, "X", "revisit", 2, 1)
    assert warc._held_against_responses(spark.createDataFrame([response, revisit], facts)).count() == 2
    for rows in ([revisit], [response, (1, 1, "Y", "revisit", 2, 1)], [response, (1, 7, "X", "revisit", 2, 1)]):
        with pytest.raises(Exception, match="revisit without its response"):
            warc._held_against_responses(spark.createDataFrame(rows, facts)).collect()


def test_warc_refuses_damage():
    with pytest.raises(ValueError):
        warc.assembled([{"segment": 1, "block": b"a"}, {"segment": 3, "block": b"b"}], 2)
    with pytest.raises(ValueError):
        warc.assembled([{"segment": 1, "block": b"a"}], 2)
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.6
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(20, 80))] if good else [rng.choice(["BUY", "$$$", "now!!", "77"]) for _ in range(rng.randrange(5, 80))]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(good), "x"))
    labels += [(3, None, "x"), (None, 1, "x"), (5, 7, "x")]
    frame, marks = docs(spark, rows + [(1000 + k, t, s) for k, (_, t, s) in enumerate(AWKWARD)]), spark.createDataFrame(labels, "doc_id long, quality int, source string")
    got = {r["doc_id"]: r for r in quality.scored(frame, marks).collect()}
    assert len(got) == len(rows) + len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    assert held == [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) > 0.95 * len(held)
    kept = quality.kept(frame, marks)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert {r["score"] for r in quality.scored(frame, marks.limit(0)).collect()} == {0.5}


def discriminant_brute(train, x, pooling=quality.POOLING, ridge=quality.RIDGE):
    """The probability of class 1 from densities written out: no moments, no Cholesky factors."""
    rows = np.array([v for v, _ in train])
    centre, scale = rows.mean(0), np.sqrt(np.maximum(rows.var(0), 1e-6))
    z, y = (rows - centre) / scale, np.array([c for _, c in train])
    at = np.clip((x - centre) / scale, -quality.LIMIT, quality.LIMIT)
    cov = lambda v: np.atleast_2d(np.cov(v.T, bias=True))
    logs = []
    for c in (0, 1):
        s = (1 - ridge) * ((1 - pooling) * cov(z[y == c]) + pooling * cov(z)) + ridge * np.eye(z.shape[1])
        d = at - z[y == c].mean(0)
        logs.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def test_quality_scores(spark):
    """Equal to densities by their formula, over labels with ties and repeated rows."""
    rng = random.Random(14)
    rows = [(i, " ".join("".join(rng.choices("abcdeXYZ.,12", k=rng.randrange(1, 12))) for _ in range(rng.randrange(3, 60))), "s") for i in range(200)]
    labels = [(i, i % 3 > 0) for i in range(0, 200, 2)] + [(4, 1), (4, 1), (6, 0), (8, 1), (8, 0)]
    frame = spark.createDataFrame([(i, int(y)) for i, y in labels], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs(spark, rows), frame).collect()}
    x = quality.statistics(pa.array([t for _, t, _ in rows]))
    train = [(x[i], int(y)) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    assert np.allclose([got[i] for i in range(200)], discriminant_brute(train, x), atol=1e-6)


def test_pieces(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    letters = ["a", "the", " ", "  ", "\n", "▁", "é", "漢字", "😀", "\t", "ing", " ", "0"]
    rows = AWKWARD + [(100 + i, "".join(rng.choices(letters, k=rng.randrange(12))), "s") for i in range(300)]
    want = []
    for i, t, _ in rows:
        ids = sp.encode(t or "")
        want.append((str(i), len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), sp.decode(ids)))))
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in pieces.encoded(docs(spark, rows), MODEL).collect()) == sorted(want)
    assert pieces.encoded(docs(spark, []), MODEL).count() == 0


def test_pieces_forget_and_collide(monkeypatch):
    """With a table of few chunks, and hashes of which all are equal, ids are still those of the library."""
    model = pieces.checked_model(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ["one two three two one", "two one  four", "", "three one two"]
    want = [(",".join(map(str, sp.encode(t))).encode(), sp.decode(sp.encode(t)).encode()) for t in texts]
    monkeypatch.setattr(pieces, "REMEMBERED", 4)
    chunks = pieces.Chunks(model)
    for _ in range(3):
        assert [(ids, text) for ids, _, text in chunks.encoded(pa.array(texts))] == want
    assert len(chunks.known) + len(chunks.older) <= 4
    real = pieces.hash_spans
    monkeypatch.setattr(pieces, "hash_spans", lambda d, a, b, seed=0: real(d, a, b, seed) if seed else np.zeros(len(a), np.uint64))
    assert [(ids, text) for ids, _, text in pieces.Chunks(model).encoded(pa.array(texts))] == want


def test_separators(spark, tmp_path):
    """Each document's count under its own doc_id, also where texts span blocks and blocks hold many; files are ids and nothing else."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = AWKWARD + [(100 + i, "some text " * (i % 7), "s") for i in range(40)]
    path = f"file://{tmp_path}/t"
    separators.write(docs(spark, rows).repartition(3), MODEL, 2, path, file_documents=9)
    files = separators.files(spark, f"{path}/kind=ids")
    ids = sorted(x for r in files.collect() for x in bytes(r["content"]).hex(" ", 2).split())
    assert ids == sorted(f"{x % 256:02x}{x // 256:02x}" for _, t, _ in rows for x in [*sp.encode(t or ""), 2])
    got = separators.counts(files, 2, block_ids=16, span=4).collect()
    # documents of a file follow each other, with one end id between
    for file in {r["file"] for r in got}:
        at = 0
        for k, r in enumerate(sorted((r for r in got if r["file"] == file), key=lambda r: r["document"])):
            assert (r["document"], r["start"]) == (k, at)
            at += r["n_tokens"] + 1
    named = {(r["file"], r["document"]): r["doc_id"] for r in separators.names(spark, f"{path}/kind=names", 2, "bigint").collect()}
    assert Counter((named[r["file"], r["document"]], r["n_tokens"]) for r in got) == Counter((i, len(sp.encode(t or ""))) for i, t, _ in rows)
    got = separators.token_counts(docs(spark, rows).repartition(5), MODEL, 2).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(sp.encode(t or ""))) for i, t, _ in rows)
    assert separators.token_counts(docs(spark, []), MODEL, 2).count() == 0


def test_separators_of_open_files(spark):
    ids = lambda *x: np.array(x, dtype="<u2").tobytes()
    rows = [(0, ids(5, 6, 7, 2, 2, 9)), (1, None), (2, ids(2)), (3, b"")]
    got = separators.counts(spark.createDataFrame(rows, "file long, content binary"), 2, block_ids=2, span=2).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, 3), (0, 1, 4, 0), (0, 2, 5, 1), (2, 0, 0, 0)]
    with pytest.raises(ValueError):
        separators.separator(200)


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(30), rng.choices(["a", "b", "c", "d", None], [300, 3, 20, 5, 10])[0]) for i in range(1500)] + AWKWARD
    frame = docs(spark, rows)
    got = mixing.mixed(frame).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(split(t))
    want = targets(sizes)
    by_size = {(sizes[s], round(want[s], 4)) for s in sizes}
    assert {(r["source_size"], round(r["target"], 4)) for r in got} == by_size and len(got) == len(rows)
    for source_size, target in by_size:
        own = [r for r in got if r["source_size"] == source_size]
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 for r in got)
    again = mixing.mixed(frame.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mix = mixing.taken_documents(frame)
    assert mix.columns == frame.columns
    assert sum(len(split(r["text"])) for r in mix.collect()) == sum(r["taken"] for r in got)
    assert mixing.mixed(docs(spark, [])).count() == 0


def test_mix_of_rows_equal_in_doc_id_source_and_size(spark):
    """The texts that the mix takes are those that it counts, also where only the text tells rows apart, and on every run."""
    rows = [(1, f"{c} {c}{c}", "a") for c in "abcdefgh"] + [(1, "a aa", "a")] * 3 + [(None, f"n{k} x", None) for k in range(20)]
    frame = docs(spark, rows)
    facts = mixing.mixed(frame).collect()
    assert len(facts) == len(rows) and len({(r["row"], r["turn"]) for r in facts}) == len(rows)
    taken = [Counter(r["text"] for r in mixing.taken_documents(frame.repartition(n)).collect()) for n in (1, 5)]
    assert taken[0] == taken[1] and sum(taken[0].values()) == sum(r["copies"] for r in facts)


def mix_brute(rows):
    """Copies of each row by the pairs of one block: from the largest to the smallest the open row meets the next."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(split(t))
    want, out = targets(sizes), {}
    for s in sizes:
        ratio = want[s] / sizes[s] if sizes[s] else 0.0
        out[s] = ratio
    return out


def test_mix_copies_are_roundings(spark):
    """Each row is taken the whole part of its source's ratio of times, or once more; the sum is the target but for one row."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice("abcd")) for i in range(400)]
    ratios = mix_brute(rows)
    for r, (_, t, s) in zip(sorted(mixing.mixed(docs(spark, rows)).collect(), key=lambda r: r["doc_id"]), rows, strict=True):
        low = math.floor(ratios[s] + 1e-9)
        assert r["copies"] in ((low,) if abs(ratios[s] - low) < 1e-9 else (low, low + 1)) and r["size"] == len(split(t))


def test_settling_keeps_the_sum():
    rng = np.random.default_rng(7)
    sizes, p = rng.integers(1, 50, 500).astype(float), rng.random(500)
    out = mixing.settle(np.arange(500), sizes, p, 3)
    assert ((out > 0) & (out < 1)).sum() <= 1
    assert (out * sizes).sum() == pytest.approx((p * sizes).sum())
