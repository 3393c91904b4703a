"""The pipeline's stages, each held against a brute-force version on its own input."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import sentencepiece
from conftest import SF
from test_order_minhash import brute as near_brute
from test_training_operators import MODEL, discriminant_brute, split, targets

from pulsegrid.llm import fingerprints, order_minhash, quality
from pulsegrid.llm.storage import saved

#: With columns whose names the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, node string, x double, _row string, h long, kind string"


def passages_removed(rows, window=20):
    """(doc_id, what is left of the text) in the order of doc_id, null last."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = split(text)
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out.append((doc_id, " ".join(w for w, g in zip(words, gone, strict=True) if not g) if any(gone) else text))
    return out


def corpus(rng):
    """Good and bad texts, copies, near copies, shared passages, nulls, empty and long texts."""
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    passage = [word() for _ in range(30)]
    texts = []
    for i in range(90):
        words = [word() for _ in range(rng.randrange(25, 70))] if i % 3 else [rng.choice(["BUY", "$$$", "now!!", "77"]) for _ in range(rng.randrange(5, 80))]
        texts.append(" ".join(words + passage if i % 10 == 1 else words))
    texts += [texts[4] + " tail", texts[4], texts[7].upper(), texts[8] + " one more", " ".join(word() for _ in range(3000)), "", None, None]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "c", None]), i) for i, t in enumerate(texts)]
    rows.append((None, texts[10] + " x y z", None, None, None))
    return [(*r, i, "n", 0.5, "r", 7, None) for i, r in enumerate(rows)]


def test_stages_by_brute_force(spark, tmp_path):
    rows = corpus(random.Random(3))
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 3 > 0)) for i in range(0, 90, 2)] + [(3, None), (None, 1), (4, 1)]
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = saved(stage(spark, docs, d), "stage")
        seen[name] = before, docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    others = lambda r: tuple(r[c] for c in ("doc_id", "lang", "source", "row", "node", "x", "_row", "h", "kind"))

    before, after = seen["quality classifier"]
    stats = quality.statistics(pa.array([r["text"] for r in before], pa.string()))
    of = {r["doc_id"]: x for r, x in zip(before, stats, strict=True)}
    train = [(of[i], q) for i, q in labels if i is not None and q is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    good = discriminant_brute(train, stats) >= 0.7
    assert Counter(map(str, after)) == Counter(str(r) for r, ok in zip(before, good, strict=True) if ok) and 0 < len(after) < len(before)

    before, after = seen["MinHash near-dedup"]
    numbered = sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    classes = near_brute([(k, r["text"]) for k, r in enumerate(numbered)])
    assert Counter(map(str, after)) == Counter(str(numbered[k]) for k, first in classes if k == first) and len(after) < len(before)

    before, after = seen["substring dedup"]
    want = passages_removed([(r["doc_id"], r["text"]) for r in before])
    assert Counter((r["doc_id"], r["text"]) for r in after) == Counter(want) and Counter(map(others, after)) == Counter(map(others, before))
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
    assert sum(len(split(t)) for _, t in want) < sum(len(split(r["text"])) for r in before)

    before, after = seen["mixing sources to target weights"]
    sizes = Counter()
    for r in before:
        sizes[r["source"]] += len(split(r["text"]))
    goal, taken = targets(sizes), Counter(map(str, after))
    for r in before:
        low = math.floor(goal[r["source"]] / sizes[r["source"]] + 1e-9)
        assert taken[str(r)] in ((low, low + 1) if split(r["text"]) else (0,))
    assert set(taken) <= set(map(str, before))
    for s in sizes:
        words = sum(len(split(r["text"])) for r in after if r["source"] == s)
        assert abs(words - goal[s]) <= max(len(split(r["text"])) for r in before if r["source"] == s)

    before, after = seen["SentencePiece encoding and decoding"]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    ids = [(r["doc_id"], model.encode(r["text"] or "")) for r in before]
    assert Counter(map(tuple, after)) == Counter((i, len(x), digest(",".join(map(str, x))), digest(model.decode(x))) for i, x in ids)


def test_of_empty_tables(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_stages_of_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = saved(stage(spark, before, SF), "stage")
        ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        seen[name] = (before, docs, ids)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    (before, docs, ids) = seen["quality classifier"]
    want = quality.scored(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()
    assert set(ids) == {r["doc_id"] for r in want} and 0 < len(ids) < before.count()
    (before, docs, ids) = seen["MinHash near-dedup"]
    classes = {r["class_id"] for r in order_minhash.near_classes(before).collect()}
    assert set(ids) == classes and max(ids.values()) == 1
    (before, docs, ids) = seen["substring dedup"]
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.collect()}
    facts = {r["doc_id"]: r["n_words"] - r["n_removed"] for r in fingerprints.deduplicated(before).collect()}
    assert words == facts
    (before, docs, ids) = seen["mixing sources to target weights"]
    assert max(ids.values()) <= 3 and docs.distinct().count() == len(ids)
    (before, docs, ids) = seen["SentencePiece encoding and decoding"]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    tokens = Counter((r["doc_id"], len(model.encode(r["text"] or ""))) for r in before.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in docs.collect()) == tokens


