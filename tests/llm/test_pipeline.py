"""The pipeline against the plain versions of its stages, each over its own input."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
import plain
from skein.llm import bpe, decontaminate, neardup, packing, perplexity
from test_operators import DOCS, prose

STOP = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r, root = random.Random(21), tmp_path_factory.mktemp("sf")
    shared = "\n".join(prose(r, 12) for _ in range(4))
    items = [prose(r, 20) for _ in range(4)]
    texts = ["\n".join(prose(r, 14) for _ in range(r.randrange(3, 9))) for _ in range(50)]
    texts += [texts[0], texts[1].replace(" ", " ", 1) + " end", f"{shared}\n{prose(r, 40)}", f"{prose(r, 40)}\n{shared}", shared, None, "", "zq" * 300, "q x " * 400]
    texts += [f"{prose(r, 30)} {items[0]} {prose(r, 30)}", f"{prose(r, 30)} {items[1]}"]
    once = prose(r, 120)
    texts += [once, f"{once} {prose(r, 2)}", once]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(r, 90), None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def key(x):
    return (x[0] is not None, x[0] or 0)


def brute(name, docs, items):
    """Rows (doc_id, text, lang) that the stage keeps."""
    if name == "quality rules":
        out = []
        for lang in {x[2] for x in docs}:
            of = [x for x in docs if x[2] == lang]
            clean = [" ".join((x[1] or "").lower().split()).encode() for x in of]
            m = plain.KneserNey({t for t in clean if t}, perplexity.ORDER)
            scores = {t: (round(m.score(t), 9), round(m.held(t), 9)) for t in set(clean) if t}
            if not scores:
                continue
            bands = []
            for k in (0, 1):
                bins = sorted(round(v[k] / perplexity.STEP) for v in scores.values())
                mid = bins[(len(bins) - 1) // 2]
                bands.append((mid * perplexity.STEP, sorted(abs(b - mid) for b in bins)[(len(bins) - 1) // 2]))
            for x, t in zip(of, clean):
                if t:
                    wide = [perplexity.BANDS[k] * ((dev * perplexity.STEP * 1.4826) ** 2 + perplexity.NOISE**2 / len(t)) ** 0.5 for k, (_, dev) in enumerate(bands)]
                    if scores[t][0] >= bands[0][0] - wide[0] and scores[t][1] <= bands[1][0] + wide[1]:
                        out.append(x)
        return out
    if name == "line dedup":
        return [(x[0], t, x[2]) for x, t in zip(docs, plain.dedup_lines([(key(x), x[1]) for x in docs])) if t is not None]
    if name == "SimHash near-dedup":
        fp = neardup.fingerprints_of(pa.array([x[1] for x in docs], pa.string()))
        label = list(range(len(docs)))
        order = sorted(range(len(docs)), key=lambda i: key(docs[i]))
        m = [np.frombuffer(f or b"\0" * 32, np.uint64) for f in fp]
        for _ in docs:
            for a in order:
                for b in order:
                    if fp[a] and fp[b] and np.bitwise_count(m[a] ^ m[b]).sum() <= neardup.RADIUS:
                        label[a] = label[b] = min(label[a], label[b], key=order.index)
            break
        return [x for i, x in enumerate(docs) if label[i] == i]
    bad = set()
    for i, x in enumerate(docs):
        for item in items:
            w = plain.norm_words(item)
            if sum(t[2] for t in plain.tiles(w, plain.norm_words(x[1]), decontaminate.MIN_MATCH)) >= decontaminate.COVERAGE * len(w):
                bad.add(i)
    return [x for i, x in enumerate(docs) if i not in bad]


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert STOP == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        rows = out.collect()
        assert all(r.n_chars is None or r.n_chars == len(r.text) for r in rows)
        got = sorted(((r.doc_id, r.text, r.lang) for r in rows), key=key)
        assert got == sorted(brute(name, before, items), key=key), name
        assert len(got) < len(before) or name == "line dedup" and got != sorted(before, key=key)
        docs = spark.createDataFrame(rows, DOCS)
    with open(bpe.VOCABULARY, "rb") as f:
        encoder = bpe.encoder(f.read())
    want = {r.doc_id: len(encoder.encode(r.text)) for r in docs.collect()}
    tokens, packs = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        tokens[r.doc_id] += r.n_tokens
        packs[r.pack_id] += r.n_tokens
    assert tokens == want and max(packs.values()) <= packing.MAX_TOKENS


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_registered():
    import __spark_entry__ as entry

    q = entry.queries()
    assert "pipeline" in q and all(sum(x.startswith(f"op{n}_") for x in q) == 1 for n in range(1, 11))
