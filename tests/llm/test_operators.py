"""Each operator against a plain version, a round trip, and the cases its docstring defines."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import plain
from skein.llm import bpe, decontaminate, licenses, linededup, neardup, packing, pagediff, perplexity, tokencounts, tokenids, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = DOCS + ", sk_d string, sk_k int, nd_n string, d string, k string, qr_g string, fp string, bag map<string,int>"
WORDS = "the of and in a to river stone lamp green walk seven under bright fold market singer paper window cloud orchard".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "er", "ing", "ly"]) for _ in range(n))


def frame(spark, texts, ids=None, langs=None):
    return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in zip(ids or range(len(texts)), texts, langs or ["en"] * len(texts))], DOCS)


def clashing(docs):
    for c in ("sk_d", "sk_k", "nd_n", "d", "k", "qr_g", "fp", "bd_d"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs.withColumn("bag", F.create_map(F.lit("a"), F.lit(1)))


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.encoder(f.read())


# token ids and counts


def test_bpe_chunks(encoder):
    r = random.Random(3)
    pieces = [" ", "\n", "\t", "a", "é", "'s", "9", ".", "  ", "<|endoftext|>", "\x1c", "\r\n", "日本", "　", "\xa0"]
    for _ in range(300):
        texts = [None if r.random() < 0.1 else "".join(r.choices(pieces, k=r.randrange(12))) for _ in range(5)]
        a = pa.array(texts, pa.string()).slice(r.randrange(3))
        ids, n = encoder.ids(a)
        want = [encoder.encode(t).tolist() for t in a.to_pylist()]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want] == encoder.counts(a).tolist()


def brute_lengths(weights, limit):
    """Least cost over all complete choices of lengths."""
    best = None

    def go(rest, room, lengths):
        nonlocal best
        if not rest:
            cost = sum(w * n for w, n in zip(weights, lengths))
            best = cost if best is None else min(best, cost)
            return
        for n in range(1, limit + 1):
            if room >= 2.0**-n:
                go(rest[1:], room - 2.0**-n, [*lengths, n])

    go(weights, 1.0, [])
    return best


@pytest.mark.parametrize("seed", range(6))
def test_code_lengths(seed):
    r = random.Random(seed)
    w, limit = [r.choice([0, 1, 1, 5, 40, 300]) for _ in range(6)], 3 + seed % 2
    n = tokenids.code_lengths(np.array(w), limit)
    used = [(c, int(x)) for c, x in zip(w, n) if c]
    assert all((c > 0) == (x > 0) for c, x in zip(w, n))
    if len(used) > 1:
        assert sum(2.0**-x for _, x in used) == 1 and max(x for _, x in used) <= limit
        assert sum(c * x for c, x in used) == brute_lengths([c for c, _ in used], limit)


def test_token_ids_round_trip(spark, encoder):
    r = random.Random(1)
    texts = ["", None, "a", prose(r, 3000), *(prose(r, r.randrange(60)) for _ in range(40)), prose(r, 5), prose(r, 5)]
    ids = [None, 0, *range(1, len(texts) - 1)]
    docs = clashing(frame(spark, texts, ids))
    blocks = tokenids.encoded(docs, block=500, checkpoint=64)
    rows = blocks.collect()
    got = defaultdict(list)
    for p in sorted(tokenids.decoded(blocks).collect(), key=lambda p: p.first_id):
        got[p.doc_id].append((p.ids, p.is_null))
    for i, t in zip(ids, texts):
        assert sum((x for x, _ in got[i]), []) == encoder.encode(t).tolist() and all(n == (t is None) for _, n in got[i])
    import zlib

    (book,) = [x.code_lengths for x in rows if x.code_lengths]
    rows = [x for x in rows if x.block != "book"]
    b = max(rows, key=lambda x: x.n_ids)
    table = tokenids.decoding_table(np.frombuffer(zlib.decompress(book), np.uint8))
    whole = tokenids.decode(b.payload, b.n_ids, b.every, b.checkpoints, table)
    for first, n in ((0, 1), (63, 3), (64, 64), (200, 250), (b.n_ids - 1, 1)):
        assert tokenids.decode(b.payload, b.n_ids, b.every, b.checkpoints, table, first, n).tolist() == whole[first : first + n].tolist()
    assert all(len(x.payload) * 8 < 20 * x.n_ids + 8 for x in rows)
    assert tokenids.encoded(docs.limit(0)).count() == 0
    one = tokenids.encoded(frame(spark, ["a", "a"]))
    assert [p.ids for p in tokenids.decoded(one).collect()] == [encoder.encode("a").tolist()] * 2


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_separator_scan(spark, encoder, block):
    r = random.Random(2)
    texts = ["", None, prose(r, 200), "", "<|endoftext|>", *(prose(r, r.randrange(9)) for _ in range(12)), ""]
    got = tokencounts.count_tokens(clashing(frame(spark, texts)).repartition(3), block=block).collect()
    assert Counter(x.n_tokens for x in got) == Counter(len(encoder.encode(t)) for t in texts) and all(x.terminated for x in got)
    files = defaultdict(list)
    for x in got:
        files[x.file].append(x)
    for rows in files.values():
        rows.sort(key=lambda x: x.doc_ordinal)
        assert [x.doc_ordinal for x in rows] == list(range(len(rows)))
        assert [x.start_token for x in rows] == np.cumsum([0, *(x.n_tokens + 1 for x in rows[:-1])]).tolist()
    assert tokencounts.count_tokens(frame(spark, ["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 50])
def test_foreign_file(spark, tmp_path, block):
    ids = [5, 9, 5, 5, 1, 2, 3, 5, 4, 4]
    np.array(ids, "<u2").tofile(tmp_path / "x.bin")
    (tmp_path / "empty.bin").write_bytes(b"")
    f = tokencounts.existing(spark, [f"file://{tmp_path}/x.bin", f"{tmp_path}/empty.bin"])
    got = tokencounts.scan(f, separator=5, block=block).orderBy("doc_ordinal").collect()
    assert [(x.start_token, x.n_tokens, x.terminated) for x in got] == [(0, 0, True), (1, 1, True), (3, 0, True), (4, 3, True), (8, 2, False)]


# near duplicates


def test_fingerprints():
    import xxhash

    def mixed(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * by % 2**64
        return x ^ x >> 31

    r, gold = random.Random(2), 0x9E3779B97F4A7C15
    for text in (None, "", "...", "One.", "one", prose(r, 2), prose(r, 70), "a b " * 50):
        w = [xxhash.xxh64_intdigest(x) for x in plain.norm_words(text)]
        features = {mixed((a * gold + b) % 2**64) for a, b in zip(w, w[1:])} or set(w)
        want = None
        if features:
            bits = [[mixed((f + gold * j) % 2**64).to_bytes(8, "little") for j in range(1, 5)] for f in features]
            wide = [np.unpackbits(np.frombuffer(b"".join(b), np.uint8)).tolist() for b in bits]
            want = np.packbits([2 * sum(x[i] for x in wide) > len(wide) for i in range(256)]).tobytes()
        assert neardup.fingerprints_of(pa.array([text], pa.string())) == [want]


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(5)
    texts = []
    for _ in range(160):
        base = prose(r, r.randrange(60, 200)).split()
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w = list(base)
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts.append(" ".join(w))
    texts += [texts[0]] * 3 + ["", None, "...", "one", "one"]
    docs = frame(spark, texts)
    fp = neardup.fingerprints_of(pa.array(texts, pa.string()))
    x = np.frombuffer(b"".join(f or bytes(32) for f in fp), np.uint64).reshape(-1, 4)
    near = neardup.distances(x, x) <= neardup.RADIUS
    label = list(range(len(texts)))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if near[a, b] and fp[a] and fp[b]]
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {g.doc_id: g.kept_doc_id for g in neardup.near_duplicates(docs, leaf=24).collect()}
    found = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
    assert len(pairs) > 200 and found >= 0.97 * len(pairs)
    assert all(label[a] == label[b] for a, b in got.items())
    assert {a: b for a, b in got.items() if a >= len(texts) - 8} == {len(texts) - 8: 0, len(texts) - 7: 0, len(texts) - 6: 0, len(texts) - 1: len(texts) - 2}
    exact = {g.doc_id: g.kept_doc_id for g in neardup.near_duplicates(docs, leaf=1 << 20).collect()}
    assert exact == {i: n for i, n in enumerate(label) if i != n}


@pytest.mark.parametrize("seed", range(4))
def test_large_lists(seed):
    """Groups of copies taken out first give the components of all pairs."""
    r = np.random.default_rng(seed)
    centres = r.integers(0, 256, (5, 32), dtype=np.uint8)
    rows = [c ^ np.packbits(r.random(256) < 0.07) for c, n in zip(centres, (400, 250, 3, 2, 1)) for _ in range(n)]
    x = np.array(rows + list(r.integers(0, 256, (60, 32), dtype=np.uint8)))[r.permutation(716)].view(np.uint64)
    parts = []
    for large in (50, 10_000):
        label = list(range(len(x)))

        def top(i):
            while label[i] != i:
                i = label[i]
            return i

        for i, j in neardup.linked(x, neardup.RADIUS, large):
            label[top(i)] = top(j)
        groups = defaultdict(set)
        for i in range(len(x)):
            groups[top(i)].add(i)
        parts.append(sorted(map(sorted, groups.values())))
    near = neardup.distances(x, x) <= neardup.RADIUS
    assert parts[0] == parts[1] and max(map(len, parts[0])) >= 300
    where = {i: n for n, g in enumerate(parts[0]) for i in g}
    assert all(where[i] == where[j] for i, j in zip(*np.nonzero(near)))


def test_plan_keeps_its_promise():
    r = np.random.default_rng(1)
    for n in (2000, 60_000):
        strip, depth, h, centres, times = neardup.plan(n)
        a = r.integers(0, 256, (150, 32), dtype=np.uint8)
        flip = np.zeros((150, 256), np.uint8)
        for row in flip:
            row[r.permutation(256)[: neardup.RADIUS]] = 1
        b = a ^ np.packbits(flip, axis=1)
        found = np.zeros(150, bool)
        for row, node in neardup.lists_of(np.concatenate([a, b]), strip, depth, h, centres, times):
            for i in range(150):
                found[i] |= bool(set(node[row == i].tolist()) & set(node[row == i + 150].tolist()))
        assert found.mean() > 0.8


def test_near_duplicate_removal(spark):
    r = random.Random(6)
    t = prose(r, 80)
    docs = frame(spark, [t, t, t, None, None, "", prose(r, 80), prose(r, 80)], [3, 3, None, 4, 4, 5, 6, 7])
    out = neardup.drop_near_duplicates(clashing(docs)).collect()
    assert sorted((x.doc_id is not None, x.doc_id or 0) for x in out) == [(False, 0), (True, 4), (True, 4), (True, 5), (True, 6), (True, 7)]
    same = frame(spark, [t, t], [3, 3])
    assert neardup.drop_near_duplicates(same).count() == 1 and neardup.near_duplicates(same).collect() == [(3, 3)]
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0 and neardup.near_duplicates(docs.limit(0)).count() == 0
    assert neardup.drop_near_duplicates(clashing(docs)).columns == clashing(docs).columns


# decontamination


@pytest.mark.parametrize("seed", range(60))
def test_tiles(seed):
    r = random.Random(seed)
    v = r.choice([2, 3, 6])
    a, b = ([r.randrange(v) for _ in range(r.randrange(3, n))] for n in (14, 25))
    assert decontaminate.tiles(np.array(a, np.uint64) + np.uint64(1), np.array(b, np.uint64) + np.uint64(1), 3) == plain.tiles(a, b, 3)


def test_contamination(spark):
    r = random.Random(8)
    items = [prose(r, r.randrange(12, 30)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(items)] + [(6, None), (7, "two words"), (None, items[0]), (0, items[0])]
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    texts = [prose(r, 60) for _ in range(10)] + [None, "", "word"]
    for it in items:
        w = it.split()
        h = len(w) // 2
        texts += [f"{prose(r, 20)} {it.upper()}, {prose(r, 20)}", f"{' '.join(w[h:])} {prose(r, 9)} {' '.join(w[:h])}", f"{' '.join(w[: len(w) // 3])} {prose(r, 30)}"]
    docs = clashing(frame(spark, texts))
    want = Counter()
    for d, t in enumerate(texts):
        for i, item in rows:
            w = plain.norm_words(item)
            got = plain.tiles(w, plain.norm_words(t), decontaminate.MIN_MATCH)
            n = sum(x[2] for x in got)
            if w and n >= decontaminate.COVERAGE * len(w):
                want[d, i, round(n / len(w), 9), len(got), got[0][2]] += 1
    assert len(want) > 12
    for part in (decontaminate.PART, 40):
        got = Counter((x.doc_id, x.item_id, round(x.coverage, 9), x.n_tiles, x.longest) for x in decontaminate.contaminated(docs, bench, part=part).collect())
        assert got == want
    kept = {x.doc_id for x in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {k[0] for k in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


# line dedup


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(spark, seed):
    r = random.Random(seed)
    lines = ["a", "b", " b", "c", "", "  ", "d e"]
    texts = ["\n".join(r.choices(lines, k=r.randrange(12))) for _ in range(25)] + [None, "", "a\nb"]
    got = {x.doc_id: x.text for x in linededup.dedup_lines(clashing(frame(spark, texts))).collect()}
    want = plain.dedup_lines(list(enumerate(texts)))
    assert got == {i: t for i, t in enumerate(want) if t is not None or texts[i] is None}
    assert linededup.dedup_lines(frame(spark, texts).limit(0)).count() == 0


def test_line_dedup_of_long_and_repeated(spark):
    """Nulls and repeated ids, rows listed twice (one document), and a text of many lines in time that follows its lines."""
    import time

    long = "\n".join(f"line {i}" for i in range(16_000))
    rows = [(1, "a\nb\nc\nd", "x"), (1, "a\nb\nc\nd", "y"), (None, "p\na\nb\nc\nq", "z"), (None, "only one", "z"), (2, "only one ", "z"), (1, "b\nc\nd", "z"), (3, long, "z"), (4, "\n".join(long.split("\n")[:8000] + ["new"]), "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    t = time.time()
    got = Counter((x.doc_id, x.text, x.source) for x in linededup.dedup_lines(docs).collect())
    assert time.time() - t < 30
    # the least document, (null, ...), holds the first a b c; what's left of b c d is the first by the hash of the text
    order = sorted({(i, t) for i, t, _ in rows}, key=lambda x: (x[0] is not None, x[0] or 0, spark.range(1).select(F.xxhash64(F.lit(x[1]))).first()[0]))
    kept = dict(zip(order, plain.dedup_lines([(n, t) for n, (_, t) in enumerate(order)])))
    assert got == Counter((i, kept[i, t], s) for i, t, s in rows if kept[i, t] is not None)


# quality


def test_perplexity(spark):
    r = random.Random(4)
    texts = [prose(r, r.randrange(1, 40)) for _ in range(30)] + ["", None, "  \n ", "É x", "zz", "zz", "qjxw vkz " * 3]
    langs = [r.choice(["en", "fr", None]) for _ in texts]
    docs = clashing(frame(spark, texts, langs=langs))
    want, held = {}, {}
    for lang in set(langs):
        of = [i for i, g in enumerate(langs) if g == lang]
        clean = {i: " ".join((texts[i] or "").lower().split()).encode() for i in of}
        m = plain.KneserNey(set(clean.values()), 4)
        want |= {i: m.score(t) if t else None for i, t in clean.items()}
        held |= {i: m.held(t) if t else None for i, t in clean.items()}
    for rows in (perplexity.MODEL_ROWS, 0):
        got = {x.d: x for x in perplexity.scores(docs, order=4, model_rows=rows).collect()}
        assert got.keys() == want.keys()
        for i, x in got.items():
            assert (x.score is None) == (x.held is None) == (want[i] is None)
            assert want[i] is None or (x.score, x.held) == (pytest.approx(want[i], abs=1e-7), pytest.approx(held[i], abs=1e-7))
    j = {x.d: x for x in perplexity.judged(docs, order=4).collect()}
    assert all(x.keep == (x.score is not None and x.lower <= x.score and x.held <= x.upper) for x in j.values())
    for lang in ("en", "fr", ""):
        x = next(x for x in j.values() if x.lang == lang and x.score is not None)
        of = {(texts[i] or "").lower().strip(): i for i, g in enumerate(langs) if (g or "") == lang and want[i] is not None}.values()
        for of_all, band, by in ((want, x.lower, -perplexity.BANDS[0]), (held, x.upper, perplexity.BANDS[1])):
            s = sorted(round(of_all[i] / perplexity.STEP) for i in of)
            mid = s[(len(s) - 1) // 2]
            dev = sorted(abs(v - mid) for v in s)[(len(s) - 1) // 2]
            width = math.sqrt((dev * perplexity.STEP * 1.4826) ** 2 + perplexity.NOISE**2 / x.n_bytes)
            assert band == pytest.approx(mid * perplexity.STEP + by * width, abs=1e-3)
    kept = {x.doc_id for x in perplexity.drop_rejected(docs, order=4).collect()}
    assert kept == {i for i, x in j.items() if x.keep} == {x.doc_id for x in perplexity.accepted(docs, order=4).collect()}
    assert perplexity.drop_rejected(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_long_text_in_pieces(size):
    a = pa.array(["x", "é bcd" * 9]).slice(1)
    g, n = perplexity.grams(a)
    p = list(perplexity.parts(a, size=size))
    assert np.concatenate([x for x, _ in p]).tolist() == g.tolist() and sum(int(m[0]) for _, m in p) == n[0]


@pytest.mark.parametrize("rows", [perplexity.MODEL_ROWS, 0])
def test_long_and_null_ids(spark, rows):
    """A text beyond a slice is scored as it is in one piece; null and repeated ids keep their own rows."""
    r = random.Random(6)
    long = prose(r, 9000)
    docs = spark.createDataFrame([(None, long, "en"), (None, long, "en"), (1, prose(r, 30), "en"), (1, prose(r, 30), "en")], "doc_id bigint, text string, lang string")
    want = sorted((x.n_bytes, x.score, x.held) for x in perplexity.scores(docs, model_rows=rows).collect())
    a = pa.array([" ".join(long.lower().split())])
    row, gram, own, n = perplexity.pairs(a, 6, 1000)
    g, size = perplexity.grams(a)
    assert (gram.tolist(), own.tolist()) == tuple(x.tolist() for x in np.unique(g, return_counts=True)) and n.tolist() == size.tolist()
    assert len(want) == 4 and want[2] == want[3] and want[3][0] == n[0]


def test_bands_reject_both_ends(spark):
    r = random.Random(9)
    texts = [prose(r, r.randrange(150, 300)) for _ in range(120)]
    texts += ["the the the the " * 120, *("".join(r.choice("abc") for _ in range(3000)) for _ in range(6))]
    texts += ["".join(r.choice("bcdfghjkqxz 0123456789!?") for _ in range(80)) for _ in range(6)]
    j = {x.d: x for x in perplexity.judged(frame(spark, texts)).collect()}
    assert {i for i, x in j.items() if x.keep} == set(range(120))
    assert j[120].score < j[120].lower and all(j[i].held > j[i].upper for i in range(121, 133))


def test_verdict_of_copies(spark):
    r = random.Random(11)
    texts = [prose(r, r.randrange(60, 120)) for _ in range(150)]
    alone = {x.d: x for x in perplexity.judged(frame(spark, texts)).collect()}
    assert alone[7].keep
    for copies in (100, 1000):
        rows = [*texts, *(texts[7].upper() + " " * (i % 3) for i in range(copies))]
        for n in (perplexity.MODEL_ROWS, 0):
            j = {x.d: x for x in perplexity.judged(frame(spark, rows), model_rows=n).collect()}
            for i, x in alone.items():
                assert (j[i].score, j[i].held, j[i].lower, j[i].upper, j[i].keep) == (*(pytest.approx(v, abs=1e-8) for v in (x.score, x.held, x.lower, x.upper)), x.keep)
            assert all(j[i].keep for i in range(len(texts), len(rows)))


# pages


def test_page_differencing(spark):
    r = random.Random(11)
    rows = []
    for i in range(60):
        host = r.choice(["a.com", "A.com", "b.org", "solo.net"][: 3 + (i == 0)]) if i else "solo.net"
        path = "/".join(r.choice(["x", "y", "zz"]) for _ in range(r.randrange(0, 4)))
        body = "".join(f"<p>{r.choice('abcdef')} &amp; {r.choice('xy')}</p>" for _ in range(r.randrange(0, 9)))
        rows.append((i, f"http{r.choice(['', 's'])}://{host}/{path}{r.choice(['', '/', '?q=1', '#t'])}", f"<ul><li>home</li></ul><!-- x --><script>v='<p>'</script>{body}<div>foot</div>"))
    rows += [(60, None, "<p>n</p>"), (61, "http://a.com/x", None), (62, "no url", "<p>m</p>"), (62, "no url", "<p>m</p>"), (None, "https://b.org/x", "")]
    for i in range(100, 130):
        query = r.choice(["", "?", "?id=1", "?id=2", "?id=12&p=/x", "?id=3#t", "#t"])
        rows.append((i, f"http://{r.choice(['one.org', 'One.org'])}/index.php{query}", f"<p>menu</p><p>{r.choice('abc')}</p><p>{i}</p><p>foot</p>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("full", F.lit("f")).withColumn("k", F.lit(1)).withColumn("text", F.lit("t"))
    got = pagediff.main_text(pages.repartition(3)).collect()
    assert len(got) == len(rows)

    def split(url):
        if not url or "://" not in url:
            return None, None, None
        place, _, query = url.split("://", 1)[1].split("#")[0].partition("?")
        host, _, path = place.partition("/")
        path = ("/" + path).rstrip("/")
        return host.lower(), path, path + ("?" + query if query else "")

    lines = dict(zip([(a, b, c) for a, b, c in rows], pagediff.lines_of(pa.array([x[2] for x in rows], pa.string()))))
    plain_paths, paths = defaultdict(set), defaultdict(dict)
    for row in rows:
        plain_paths[split(row[1])[0]].add(split(row[1])[1])

    def place_of(url):
        host, path, full = split(url)
        return host, full if len(plain_paths[host]) == 1 else path

    for row in rows:
        h, p = place_of(row[1])
        if h and (p not in paths[h] or (row[0] is not None, row[0] or 0) < (paths[h][p][0] is not None, paths[h][p][0] or 0)):
            paths[h][p] = row
    by_key = defaultdict(list)
    for x in got:
        by_key[x.page_id, x.url].append(x)

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for row in rows:
        h, p = place_of(row[1])
        own = lines[row]
        x = by_key[row[0], row[1]][0]
        assert x.n_lines == len(own)
        others = sorted(q for q in paths.get(h, {}) if q != p)
        if not others:
            assert x.partner is None and x.n_removed == 0 and x.text == "\n".join(own)
            continue
        best = max(common(p, q) for q in others)
        assert x.partner in others and common(p, x.partner) == best
        other = lines[paths[h][x.partner]]
        assert x.n_removed == plain.lcs(own, other) == len(own) - len(x.text.split("\n") if x.text else [])
    assert len({x.partner for x in got if x.url and "one.org" in x.url.lower()}) > 1
    assert pagediff.main_text(pages.limit(0)).count() == 0


def plain_lines(html):
    """The lines of a page, character by character."""
    import html as entities
    import re

    hidden, block, out, i, s = ("script", "style", "template", "noscript"), set("p div br li ul ol h1 h2 h3 table tr td th section nav header footer title body html form pre".split()), "", 0, html or ""
    while i < len(s):
        if s.startswith("<!--", i) and "-->" in s[i:]:
            i, out = s.index("-->", i) + 3, out + " "
        elif s[i] == "<" and (m := re.match(r"</?([a-z0-9]+)", s[i:])) and ">" in s[i:]:
            j, quote = i, ""
            while s[j] != ">" or quote:
                quote = ("" if s[j] == quote else quote) if quote else s[j] if s[j] in "\"'" else ""
                j += 1
            name = m[1]
            if name in hidden and s[i + 1] != "/":
                i, out = s.index(">", s.index(f"</{name}", j)) + 1, out + " "
                continue
            i, out = j + 1, out + ("\n" if name in block else "")
        else:
            out, i = out + (" " if s[i].isspace() else s[i]), i + 1
    return [" ".join(t.split()) for t in map(str, entities.unescape(out).split("\n")) if t.split()]


def test_lines_of_pages():
    r = random.Random(3)
    parts = ["<p>", "</p>", "<br/>", "<b>", "</b>", "<div class='a > b'>", '<td title="x">', " ", "\n", "word", "&amp;", "&lt;b&gt;", "é", "<!-- <p>no</p> -->", "<script>if (a<b) x='<p>'</script>", "<style>p{}</style>", "two words", "<li>", "<h2 >", "<span\nid=q>"]
    for _ in range(400):
        html = "".join(r.choices(parts, k=r.randrange(14)))
        assert pagediff.lines_of(pa.array([html, None])) == [plain_lines(html), []], html


@pytest.mark.parametrize("bits", [1 << 28, 20])
def test_alignment(bits):
    for seed in range(400):
        r = random.Random(seed)
        a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in "ab")
        g = pagediff.aligned(a, b, bits)
        rest = iter(b)
        assert len(g) == plain.lcs(a, b) and g == sorted(set(g)) and all(a[i] in rest for i in g)


# bundles


def test_bundles(spark):
    import zstandard

    r = random.Random(12)
    rows = [(i, f"http://h/{i}", "<p>" + prose(r, r.randrange(200)) + "</p>") for i in range(50)] + [(None, None, None), (None, None, None), (7, "http://h/é\r\n x", ""), (3, "http://h/3", "x" * 5000), (3, "http://h/3", "x" * 5000), (2**60 + 1, "u", "v" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("frame", F.lit(1)).withColumn("date", F.lit("d"))
    made = warc.bundles(pages.coalesce(2), frame=2000, bundle=9000, when="2020-01-02T03:04:05Z")
    assert Counter(warc.fetch(made, [3, 7, 49, 2**60 + 1]).toArrow().to_pylist() and [tuple(x) for x in warc.fetch(made, [3, 7, 49, 2**60 + 1]).collect()]) == Counter(x for x in rows if x[0] in (3, 7, 49, 2**60 + 1))
    back, names = [], []
    for b in made.collect():
        table = warc.read_seek_table(b.payload)
        assert len(table) == b.n_frames and b.n_records == len(b.records)
        whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(b.payload)
        frames = [zstandard.ZstdDecompressor().decompress(b.payload[s : s + n], max_output_size=raw) for s, n, raw, _ in table]
        assert b"".join(frames) == whole[: b.raw_bytes]
        back += [warc.parse(frames[x.frame][x.record_offset : x.record_offset + x.length]) for x in b.records]
        assert all(x.frame_start == table[x.frame][0] for x in b.records)
        # the plain way: records one after another by their Content-Length, a new frame where the next doesn't fit
        at, want, number, offset = 0, [], 0, 0
        while at < b.raw_bytes:
            head = whole[at:].partition(b"\r\n\r\n")[0].decode()
            fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
            assert head.startswith("WARC/1.1\r\n") and fields["WARC-Date"] == "2020-01-02T03:04:05Z"
            names.append(fields["WARC-Record-ID"])
            size = len(head.encode()) + 4 + int(fields["Content-Length"]) + 4
            if offset and offset + size > 2000:
                number, offset = number + 1, 0
            want.append((number, offset, size))
            at, offset = at + size, offset + size
        assert [(x.frame, x.record_offset, x.length) for x in b.records] == want
        sizes = [n for _, n, _, _ in table]
        assert sum(sizes[:-1]) - (sizes[-2] if len(sizes) > 1 else 0) < 9000
    assert Counter(back) == Counter(rows) and warc.index(made).count() == len(rows) == len(set(names))
    assert warc.bundles(pages.limit(0)).count() == 0
    dated = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.timestamp_seconds(F.lit(86399)).alias("at"))
    other = warc.bundles(dated, date="at").collect()
    assert all(b"WARC-Date: 1970-01-01T23:59:59Z" in zstandard.ZstdDecompressor().decompressobj().decompress(b.payload) for b in other) and {x.page_id for b in other for x in b.records} == {None if i is None else str(i) for i, _, _ in rows}


# licences


@pytest.mark.parametrize("expression,rating,names", [("MIT", 0, ["mit"]), ("mit OR gpl-3.0-only", 0, ["mit", "gpl-3.0-only"]), ("MIT and (GPL-2.0-only with Classpath-exception-2.0)", 1, ["gpl-2.0-only", "mit"]), ("mit or apache-2.0 and gpl-3.0-only", 0, None), ("(mit or apache-2.0) and gpl-3.0-only", 2, None), ("made-up-1.0", 4, ["made-up-1.0"]), ("gpl-2.0+", 2, None)])
def test_expressions(expression, rating, names):
    got = licenses.evaluate(expression.lower())
    assert got[0] == rating and (names is None or sorted(got[1]) == sorted(names))


@pytest.mark.parametrize("bad", ["", "mit or", "or mit", "mit apache-2.0", "(mit", "mit)", "mit with (x or y)", "a,b"])
def test_bad_expressions(bad):
    with pytest.raises(ValueError):
        licenses.evaluate(bad)


GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version. See the GNU General
 * Public License for more details. */"""


@pytest.mark.parametrize("text,names,rating,n", [
    ("Copyright X.  All Rights\n\tReserved.", ["licenseref-all-rights-reserved"], 4, 1),
    ("# All rights reserved.\n# Redistribution and use in source and\n# binary forms, with or without", ["bsd-2-clause", "licenseref-all-rights-reserved"], 0, 2),
    ("Redistribution and use in source and binary forms, with\n * or without. 3. Neither the\n * name of X nor", ["bsd-3-clause"], 0, 1),
    ("Redistribution and use in source and binary forms. All advertising\nmaterials mentioning features. Neither the name of X", ["bsd-4-clause"], 0, 1),
    ("under the GNU Lesser General Public License version 2.1", ["lgpl-2.1-only"], 1, 1),
    ("Licensed under the Apache License,\n * Version 2.0", ["apache-2.0"], 0, 1),
    ("GNU General Public License as published by the Free Software Foundation; either version 2 of", ["gpl-2.0-or-later"], 2, 1),
    ("Proprietary and confidential", ["licenseref-proprietary"], 4, 1),
    (GPL_HEADER, ["gpl-3.0-or-later"], 2, 1),
    (GPL_HEADER.replace("GNU General", "GNU Lesser General").replace("Foundation, either version 3", "Foundation; either version 2.1"), ["lgpl-2.1-or-later"], 1, 2),
    (GPL_HEADER.replace("GNU General", "GNU Affero General"), ["agpl-3.0-or-later"], 2, 2),
    ("        GNU GENERAL PUBLIC LICENSE\n           Version 2, June 1991", ["gpl-2.0-only"], 2, 1),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007", ["agpl-3.0-only"], 2, 1),
    ("// Licensed under the Apache License, **\n// Version 2.0\n// SPDX-License-Identifier: MIT\n// or later", ["apache-2.0", "mit"], 0, 2),
])
def test_notices_over_lines(text, names, rating, n):
    got = licenses.scan(text)
    assert (got[0], got[2], got[4]) == (names, rating, n)


def plain_notices(text):
    """(names, findings) by looking for every phrase at every place of the text in one line."""
    out = []
    for line in text.lower().split("\n"):
        line = " ".join(line.split())
        while True:
            for mark in ("<!--", "/*", "*/", "//", "#", ";", "--", "%", "!", ">", "|", "*", "rem ", "dnl "):
                if line.startswith(mark):
                    line = line[len(mark) :].strip()
                    break
            else:
                break
        if line.endswith("*") and not line.endswith("**") or line.endswith("*/"):
            line = line.rstrip("/").rstrip("*").strip()
        out.append(line)
    flat = " ".join(" ".join(out).split())
    at, n, hit = 0, 0, set()
    while at < len(flat):
        here = [p for p in licenses.NOTICES if flat.startswith(p, at)]
        if here:
            hit.add(max(here, key=len))
            n, at = n + 1, at + len(max(here, key=len))
        else:
            at += 1
    names = set()
    for p in hit - licenses.BARE.keys():
        names.add(next((x for c, x in licenses.CLAUSES.get(licenses.NOTICES[p], ()) if c in flat), licenses.NOTICES[p]).lower())
    for p in hit & licenses.BARE.keys():
        if not any(x.startswith(licenses.BARE[p]) for x in names):
            names.add(licenses.NOTICES[p].lower())
    return sorted(names), n


def test_notices_against_brute_force():
    r = random.Random(7)
    phrases = [*licenses.NOTICES, *(c for cs in licenses.CLAUSES.values() for c, _ in cs)]
    for _ in range(500):
        words = []
        for _ in range(r.randrange(1, 5)):
            p = r.choice(phrases).split(" ")
            words += [w.upper() if r.random() < 0.3 else w for w in (p if r.random() < 0.8 else p[: r.randrange(1, len(p) + 1)])] + prose(r, r.randrange(3)).split()
        lead = r.choice(["", "# ", " * ", "// ", ";; ", "> "])
        text = lead
        for w in words:
            text += w + r.choice([" ", " ", "  ", "\t", "\n" + lead])
        names, n = plain_notices(text)
        got = licenses.scan(text)
        assert (got[0], got[4]) == (names, n) if got else not n, text


def plain_rating(expression):
    """The least rating over all choices that "or" leaves, of what holds together."""
    e = expression.strip()
    while e.startswith("(") and all(e[:i].count("(") > e[:i].count(")") for i in range(1, len(e))):
        e = e[1:-1].strip()
    for word, pick in (("or", min), ("and", max)):
        cuts = [m.start() for m in __import__("re").finditer(rf" {word} ", e) if e[: m.start()].count("(") == e[: m.start()].count(")")]
        if cuts:
            return pick(plain_rating(e[: cuts[-1]]), plain_rating(e[cuts[-1] + len(word) + 2 :]))
    if " with " in e:
        a, x = e.split(" with ")
        rating = plain_rating(a)
        return (1 if rating == 2 else rating) if x in licenses.EXCEPTIONS else 4
    return licenses.RATING.get(e, 4)


def test_expressions_against_brute_force():
    r = random.Random(8)

    def make(depth):
        if not depth or r.random() < 0.2:
            name = r.choice(["mit", "gpl-2.0-only", "lgpl-2.1-or-later", "cc-by-nc-4.0", "odd-1.0", "isc"])
            return f"{name} with {r.choice(['classpath-exception-2.0', 'none-such'])}" if r.random() < 0.15 else name
        return r.choice(["{} or {}", "{} and {}", "({} or {})", "({} and {})", "(({}) and {})"]).format(make(depth - 1), make(depth - 1))

    for _ in range(500):
        e = make(4)
        assert licenses.evaluate(e)[0] == plain_rating(e), e


def test_license_scan(spark):
    long = "word " * 300_000
    texts = [None, "", "nothing", long + "SPDX-License-Identifier: MIT", "// spdx-license-identifier: GPL-2.0-only OR */ x", "licensed under CC BY-SA 4.0 and more", "Released under the MIT License. released under the mit license"]
    got = {x.doc_id: x for x in licenses.scan_licenses(clashing(frame(spark, texts))).collect()}
    assert {i: (x.licenses, x.rating, x.malformed, x.n_findings) for i, x in got.items()} == {3: (["mit"], 0, False, 1), 4: ([], 4, True, 1), 5: (["cc-by-sa-4.0"], 2, False, 1), 6: (["mit"], 0, False, 2)}
    assert licenses.scan_licenses(frame(spark, texts).limit(0)).count() == 0


# packing


def greedy(items, limits):
    """(tokens, loss) in order; pack and slot of each, by the heuristic as it's defined."""
    demand = np.array([(t, 1, l) for t, l in items], float)
    weight = (demand / limits).mean(0)
    out, left, room, p, s = {}, list(range(len(items))), np.array(limits, float), 0, 0
    while left:
        fit = [i for i in left if (demand[i] <= room).all()]
        if not fit:
            room, p, s = np.array(limits, float), p + 1, 0
            continue
        score = [float((demand[i] / limits * weight) @ (room / limits)) for i in fit]
        best = max(score)
        i = next(i for i, x in zip(fit, score) if x > best - 1e-12)
        out[i] = p, s
        room, s = room - demand[i], s + 1
        left.remove(i)
    return [out[i] for i in range(len(items))]


def test_packing_heuristic():
    r = random.Random(13)
    for _ in range(30):
        items = sorted(((t := r.randrange(1, 50), r.randrange(0, min(t, 40) + 1)) for _ in range(r.randrange(1, 40))), reverse=True)
        p, s = packing.place(np.array([t for t, _ in items]), np.array([x for _, x in items]), (60, 4, 40))
        assert list(zip(p.tolist(), s.tolist())) == greedy(items, (60, 4, 40))


def test_pack_conversations(spark, encoder):
    r = random.Random(14)
    rows = [(c, t, r.choice(["user", "assistant", None]), prose(r, r.randrange(0, 60))) for c in range(40) for t in range(r.randrange(1, 5))]
    rows += [(None, 0, "assistant", "a b"), (None, 1, "user", None), (50, 0, "user", None), (51, 0, "user", ""), (3, 0, "user", "again"), (3, 0, "user", "again"), (60, None, "assistant", prose(r, 400))]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("n_tokens", F.lit("x")).withColumn("sub", F.lit(1))
    out = packing.pack_conversations(turns, 128, 5, 90, shard=16).collect()
    want = Counter()
    for c, _, _, t in rows:
        want[c] += len(encoder.encode(t))
    got, packs = Counter(), defaultdict(list)
    for x in out:
        got[x.conv_id] += x.n_tokens
        if x.pack_id is None:
            assert x.n_tokens == 0
        else:
            packs[x.pack_id].append(x)
    assert got == want and {x.conv_id for x in out} == {x[0] for x in rows}
    for p in packs.values():
        assert sum(x.n_tokens for x in p) <= 128 and len(p) <= 5 and sum(x.loss_tokens for x in p) <= 90
        assert sorted(x.slot for x in p) == list(range(len(p)))
    for c in want:
        mine = sorted((x for x in out if x.conv_id == c), key=lambda x: x.piece)
        assert [x.start_token for x in mine] == np.cumsum([0, *(x.n_tokens for x in mine[:-1])]).tolist()
    assert packing.pack_conversations(turns.limit(0)).count() == 0
    got = packing.pack_conversations(turns, 128, 5, 90, shard=16, chapter=64).collect()
    for c in want:
        mine = sorted((x for x in got if x.conv_id == c), key=lambda x: x.piece)
        assert [x.start_token for x in mine] == np.cumsum([0, *(x.n_tokens for x in mine[:-1])]).tolist() and sum(x.n_tokens for x in mine) == want[c]


# ids

LARGE = [2**60 + 1, None, 2**60 + 3]
UUIDS = ["3f2b-a", None, "3f2b-c"]


@pytest.mark.parametrize("ids,kind", [(LARGE, "bigint"), (UUIDS, "string")])
def test_ids_are_exact(spark, encoder, ids, kind):
    """Every operator carries ids as they are: large ones beside nulls, and strings."""
    r = random.Random(15)
    text = [prose(r, 60) + f"\n{prose(r, 9)}\nspdx-license-identifier: mit" for _ in ids]
    docs = spark.createDataFrame(list(zip(ids, text, ["en"] * 3)), f"doc_id {kind}, text string, lang string")
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h/"), F.length("text").cast("string")).alias("url"), F.col("text").alias("html"))
    bench = docs.select(F.col("doc_id").alias("item_id"), "text")
    want = Counter(ids)
    assert Counter(x.doc_id for x in packing.pack_documents(docs).collect()) == want == Counter(x.conv_id for x in packing.pack_conversations(turns).collect())
    assert Counter(x.page_id for x in warc.index(warc.bundles(pages)).collect()) == want == Counter(x.page_id for x in pagediff.main_text(pages).collect())
    for part in (decontaminate.PART, 1):
        assert Counter((x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, bench, part=part).collect()) == Counter((i, i) for i in ids)
    assert decontaminate.drop_contaminated(docs, bench).count() == 0 and neardup.drop_near_duplicates(docs).count() == 3
    twice = neardup.near_duplicates(docs.union(docs)).collect()
    assert Counter((x.doc_id, x.kept_doc_id) for x in twice) == Counter((i, i) for i in ids) and neardup.drop_near_duplicates(docs.union(docs)).count() == 3
    assert Counter(x.doc_id for x in linededup.dedup_lines(docs).collect()) == want == Counter(x.doc_id for x in licenses.scan_licenses(docs).collect())
    assert Counter(x.doc_id for x in tokenids.decoded(tokenids.encoded(docs)).collect()) == want
    assert Counter(x.d for x in perplexity.judged(docs).collect()) == want and perplexity.drop_rejected(docs).count() == perplexity.accepted(docs).count()


def test_session_is_left_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for rows in (before, "77", "0"):
        spark.conf.set(name, rows)
        licenses.scan_licenses(frame(spark, ["x"])).collect()
        neardup.near_duplicates(frame(spark, ["x"])).collect()
        assert spark.conf.get(name) == rows
    spark.conf.set(name, before)
