"""Notes in folders: source, parsing, resolution, proposals."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import lexer, series
from skein.functions.frontmatter import entries
from skein.operators import proposals, stack
from skein.operators.notes import Corpus
from skein.sources import shared, sinks, vault


def folder(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


@pytest.fixture(scope="module")
def notes(spark, tmp_path_factory):
    root = folder(tmp_path_factory.mktemp("vault"), {
        "index.md": "[[Alpha]] [[beta#part|b]] [[gamma]] ![[gamma]] [[ ]] [[index]]",
        "alpha.md": "[[beta]] [[delta]]\r\n- [ ] first\r\n  * [X] second\r\n+ [ ] no\r\n1. [x] no\r\n",
        "beta.md": "[[gamma]]",
        "gamma.md": "",
        "delta.md": "see [the index](index.md) and ![not](beta.md) and [gone](missing.md) and [up](../x.md)",
        "comb.md": "---\naliases: [honey, hex]\ntags:\n  - structure\n  - \"#lattice\"\nauthor: 'Ann' \nauthor: Bea\n---\n[[alpha]] #real_tag/x é#no #1no a#no",
        "caller.md": "[[honey]] [[HEX]] [[nowhere]] [[daily/x]] [[comb.md]]",
        "daily/day.md": "#deep",
        "archive/day.md": b"bad \xff byte",
        "_moc.md": "[[day]]", ".dot.md": "x", "C.MD": "x", "node_modules/n.md": "x", ".hidden/h.md": "x", "empty.md": "",
    })
    return Corpus(vault.read_vaults(spark, root)), root


def names(c, df, col):
    return {r.relpath for r in df.join(c.notes, F.col(col) == c.notes["note_id"]).collect()}


def test_source(spark, notes):
    c, root = notes
    assert {r.relpath for r in c.notes.collect()} == {"index.md", "alpha.md", "beta.md", "gamma.md", "delta.md", "comb.md", "caller.md", "daily/day.md", "archive/day.md", "_moc.md", ".dot.md", "empty.md"}
    assert c.notes.filter("relpath = 'alpha.md'").first().content.count("\r") == 0
    assert "�" in c.read("archive/day.md").first().content
    assert {r.relpath for r in vault.read_vaults(spark, root, content=False, prefix="daily/").collect()} == {"daily/day.md"}
    assert c.notes.count() == vault.read_vaults(spark, root, root + "/daily").count()
    uri = vault.read_vaults(spark, f"file://{root}/")
    assert {(r.relpath, r.size, r.content) for r in uri.collect()} == {(r.relpath, r.size, r.content) for r in c.notes.collect()}
    assert {r.relpath for r in vault.read_vaults(spark, f"file://{root}", prefix="daily/d").collect()} == {"daily/day.md"} == {x for x, _, _ in vault.walk(root, "da")}
    assert Corpus(uri).links().count() == c.links().count()
    r = c.vault_info().first()
    assert r.files == 12


def test_links(notes):
    c, _ = notes
    n = {r.relpath: r.note_id for r in c.notes.collect()}
    inv = {v: k for k, v in n.items()}
    links = sorted((inv[r.src], inv[r.dst], r.raw_key, r.kind) for r in c.links().collect())
    assert links == sorted([
        ("index.md", "alpha.md", "alpha", "wiki"), ("index.md", "beta.md", "beta", "wiki"), ("index.md", "gamma.md", "gamma", "wiki"),
        ("alpha.md", "beta.md", "beta", "wiki"), ("alpha.md", "delta.md", "delta", "wiki"), ("beta.md", "gamma.md", "gamma", "wiki"),
        ("delta.md", "index.md", "index", "md"), ("comb.md", "alpha.md", "alpha", "wiki"), ("caller.md", "comb.md", "honey", "wiki"),
        ("caller.md", "comb.md", "hex", "wiki"), ("_moc.md", "archive/day.md", "day", "wiki"),
    ])
    assert {(r.key, inv[r.src]) for r in c.unresolved().collect()} == {("nowhere", "caller.md"), ("daily/x", "caller.md"), ("comb.md", "caller.md")}
    assert {r.relpath for r in c.orphans().collect()} == {"caller.md", "daily/day.md", "_moc.md", ".dot.md", "empty.md"}
    assert c.backlinks().filter(F.col("dst") == n["comb.md"]).first().n == 2
    assert inv[c.resolve_file("day.md").first().note_id] == "archive/day.md"
    out = [r.target for r in c.outgoing(c.notes.filter("relpath = 'index.md'").select("note_id")).orderBy("pos").collect()]
    assert out == ["Alpha", "beta", "gamma", "", "index"]


def test_parsing(notes):
    c, _ = notes
    assert {(r.key, r.scalar, tuple(r["items"] or ())) for r in c.properties.collect()} == {("aliases", None, ("honey", "hex")), ("tags", None, ("structure", "#lattice")), ("author", "Bea", ())}
    assert {(r.tag, r.origin) for r in c.tag_rows.collect()} == {("structure", "frontmatter"), ("lattice", "frontmatter"), ("real_tag/x", "body"), ("deep", "body")}
    assert [(r.line, r.done, r.text) for r in c.tasks.orderBy("line").collect()] == [(2, False, "first"), (3, True, "second")]
    assert {r.relpath for r in c.tagged("#deep").collect()} == {"daily/day.md"}
    assert c.search("GAMMA").count() == 2 and c.search("GAMMA", case=True).count() == 0 and c.search("e", limit=2).count() == 2
    assert c.search("second", context=True).first().matches[0].line == 3


def test_stack(spark, tmp_path):
    a = folder(tmp_path / "A", {"alpha.md": "[[beta]] [[shared]]", "beta.md": "[[alpha]]", "shared.md": "[[alpha]]", "bridge.md": "[[only-in-b]]"})
    b = folder(tmp_path / "B", {"alpha.md": "[[beta]] [[shared]]", "beta.md": "[[alpha]]", "shared.md": "[[alpha]]", "only-in-b.md": ""})
    c = Corpus(vault.read_vaults(spark, a, b))
    m = stack.moire(c.notes).first()
    assert (m.shared, m.total, m.jaccard) == (3, 5, 0.6)
    h = {r.vault_ord: r for r in stack.stack_health(c).collect()}
    assert (h[None].cross_sheet, h[None].unresolved, h[0].unresolved, h[0].edges, h[1].edges) == (1, 0, 1, 2, 2)
    x = stack.layered(c.notes.select(F.col("note_id").alias("id"), "vault_ord"), c.links().select("src", "dst"))
    n = stack.layer_counts(x).first()
    assert (n.n, n.intra, n.inter) == (8, 4, 1)
    s = stack.sublattice_counts(x, stack.colors(x)).first()
    assert (s.aa, s.bb, s.ab) == (1, 0, 0)
    one = stack.health(c).first()
    assert (one.notes, one.edges, one.bipartite) == (8, 5, True)


def test_proposals(spark, tmp_path):
    root = folder(tmp_path / "v", {
        "alpha.md": "---\ntags: [astro, journal]\nstatus: open\n---\n[[ghost]]", "beta.md": "---\ntags: [astro]\nstatus: open\n---\n[[ghost]] [[alpha]]",
        "gamma.md": "---\ntags: [astro]\n---\n", "delta.md": "---\ntags: [astro]\n---\n[[alpha]]", "noise.md": '[[ "$x" == "y" ]]',
    })
    c = Corpus(vault.read_vaults(spark, root))
    s = proposals.stubs(c).collect()
    assert [(r.target, r.path, r.n_sources) for r in s] == [("ghost", "ghost.md", 2)] and "[[alpha]]" in s[0].body
    inv = {r.note_id: r.stem for r in c.notes.collect()}
    b = {}
    for r in proposals.bonds(c, 2).orderBy("rank").collect():
        b.setdefault(r.link_to, []).append(inv[r.note_id])
    assert b == {"beta": ["gamma", "delta"], "gamma": ["delta", "beta"], "delta": ["gamma", "beta"]}
    k = {inv[r.note_id]: r["keys"] for r in proposals.missing_keys(c, 0.4).collect()}
    assert k == {"delta": ["status"], "gamma": ["status"], "noise": ["status", "tags"]}
    assert proposals.apply_stubs(proposals.stubs(c), root) == 1 and proposals.apply_stubs(proposals.stubs(c), root) == 0
    assert proposals.apply_bonds(proposals.bonds(c, 1), [root]) == 3
    assert proposals.apply_keys(proposals.missing_keys(c, 0.4), c.notes, [root]) == 3
    assert (tmp_path / "v/noise.md").read_text().startswith("---\nstatus: TODO\ntags: TODO\n---\n")
    with pytest.raises(ValueError):
        proposals.inside(tmp_path / "v", "../v-x/a.md")


def test_names(spark):
    good = ["plain", "two-words", "daily/2026-04-28", "_lead"]
    bad = ['("$x" == "y")', "a->b", "a|b", "<x>", "{x}", "../x", "/abs", "11", "", "  ", "x" * 121, "a...b"]
    df = spark.createDataFrame([(x,) for x in good + bad], "t string").select("t", lexer.plausible_name(F.col("t")).alias("ok"))
    assert {r.t: r.ok for r in df.collect()} == {x: x in good for x in good + bad}
    s = spark.createDataFrame([("a/b:c",), ("x//y",)], "t string").select(lexer.slug(F.col("t")).alias("s")).collect()
    assert [r.s for r in s] == ["a/b_c", "x/untitled/y"]
    f = spark.createDataFrame([("/a/../b.md",), ("/../b.md",), ("/./c//d.md",)], "t string").select(lexer.folded(F.col("t")).alias("s")).collect()
    assert [r.s for r in f] == ["b.md", "b.md", "c/d.md"]


def test_series(spark):
    assert series.parse_sweep("0,2,5") == [0, 0.5, 1, 1.5, 2] and series.parse_sweep("0.5,1.5,1") == [0.5]
    with pytest.raises(ValueError):
        series.parse_sweep("0,1")
    g = [r.g for r in series.jackson(spark, 50).orderBy("k").collect()]
    assert g[0] == pytest.approx(1) and min(g) >= 0 and g == sorted(g, reverse=True)
    d = spark.createDataFrame(list(enumerate([0.1, 0.1, 0.1, 0.2, 0.5, 1.5, 0.5, 0.2, 0.1, 0.1])), "bin int, rho double")
    p = series.peaks(d, 1.0).first()
    assert (p["bin"], p.rho) == (5, 1.5) and series.peaks(d.limit(2)).count() == 0
    for v, want in (([0.5] * 4, 0.25), ([1.0, 0, 0, 0], 1.0), ([0.0] * 4, 0.0)):
        assert spark.createDataFrame([(float(x),) for x in v], "x double").agg(series.ipr(F.col("x")).alias("i")).first().i == want


def test_registry_and_sinks(spark, tmp_path):
    for n in ("one", "one/inner", "two"):
        (tmp_path / n).mkdir()
    reg = tmp_path / "r.json"
    reg.write_text(json.dumps({"vaults": {"ab1": {"path": str(tmp_path / "one")}, "cd2": {"path": str(tmp_path / "one/inner")}, "ef3": {"path": str(tmp_path / "two")}}}))
    r = str(reg)
    assert vault.resolve_vault("TWO", r) == str(tmp_path / "two") and vault.resolve_vault("cd", r) == str(tmp_path / "one/inner")
    assert vault.resolve_vault(None, r) == str(tmp_path / "one") and vault.resolve_vault("none", r) is None
    assert vault.resolve_targets("stack", r) == [str(tmp_path / "one/inner"), str(tmp_path / "two")] and len(vault.resolve_targets("every", r)) == 3
    assert vault.registry(str(tmp_path / "missing.json")) == {}
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    for f in ("json", "csv", "tsv", "parquet"):
        sinks.save(df, str(tmp_path / f), f)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).first().y == "a"
    assert list(sinks.text_rows(df, "tsv")) == ["1\ta"] and json.loads(next(iter(sinks.text_rows(df, "json")))) == {"x": 1, "y": "a"}
    with pytest.raises(ValueError):
        sinks.save(df, str(tmp_path / "z"), "xml")


def plain_entries(raw):
    """The frontmatter format line by line."""
    out, i = {}, 0
    lines = (raw or "").splitlines()

    def bare(v):
        return v.strip().strip('"').strip("'")

    while i < len(lines):
        line, i = lines[i], i + 1
        key, colon, value = line.partition(":")
        if not line.strip() or line.lstrip().startswith("#") or not colon:
            continue
        key, value = key.strip(), value.strip()
        if len(value) > 1 and value[0] + value[-1] == "[]":
            out[key] = [bare(v) for v in value[1:-1].split(",") if v.strip()]
        elif value:
            out[key] = bare(value)
        else:
            items = []
            while i < len(lines) and lines[i][:1] in (" ", "\t"):
                items += [bare(lines[i].strip()[1:])] if lines[i].strip().startswith("-") else []
                i += 1
            out[key] = items or ""
    return list(out.items())


def test_entries(spark):
    r = random.Random(5)
    parts = ["a: New York", "b:", "- lost", "c:", "  x: y", "d: [1, 2]", "# no", "plain", "  - one", "\t- 'two'", " -", "e: []", 'f: "q: r"', "a: again", "", "  ", "b: ['x', , \"y\"]", " g : [", "h:   ", "  # - z", "i: [[k]]", "  - [x]", ": v"]
    raws = [None, "", *("\n".join(r.choices(parts, k=r.randrange(1, 9))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", entries(F.col("raw")).alias("e"))
    for x in df.collect():
        got = [(e.key, e["items"] if e.is_list else e.scalar) for e in x.e]
        assert got == plain_entries(raws[x.i]) and all((e["items"] is None) != e.is_list for e in x.e), raws[x.i]


def test_links_between_vaults(spark, tmp_path):
    a = folder(tmp_path / "A", {"one.md": "[x](../B/two.md) [y]( sub/c.md) [z](../B/none.md) [[two]]", "sub/c.md": "[up](../../B/deep/d.md#p) [own](../one.md)", "two.md": ""})
    b = folder(tmp_path / "B", {"two.md": "[back](../A/one.md)", "deep/d.md": "[out](../../../../../../../../../../x.md)"})
    c = Corpus(vault.read_vaults(spark, a, b))
    inv = {r.note_id: f"{r.vault}/{r.relpath}" for r in c.notes.collect()}
    assert {(inv[r.src], inv[r.dst], r.kind) for r in c.links().collect()} == {("A/one.md", "A/two.md", "wiki"), ("A/one.md", "A/sub/c.md", "md"), ("A/sub/c.md", "B/deep/d.md", "md"), ("A/sub/c.md", "A/one.md", "md"), ("B/two.md", "A/one.md", "md")}
    assert {(inv[r.src], inv[r.dst]) for r in c.links(True).collect()} == {("A/one.md", "A/two.md"), ("A/one.md", "A/sub/c.md"), ("A/sub/c.md", "A/one.md")}
    assert {inv[r.note_id] for r in c.orphans().collect()} == {"B/two.md"}
    side = Corpus(spark.createDataFrame([(1, 0, "A", "one.md", "one", "[x](../B/two.md)"), (2, 1, "B", "two.md", "two", "")], "note_id bigint, vault_ord int, vault string, relpath string, stem string, content string"))
    assert [(r.src, r.dst) for r in side.links().collect()] == [(1, 2)]


def test_one_scan_of_texts(spark, tmp_path):
    """Links, orphans, proposals and health read the texts once, to write what they need."""
    spark.createDataFrame([(1, 0, "A", "one.md", "one", "---\ntags: [x]\n---\n[[two]]"), (2, 0, "A", "two.md", "two", "---\ntags: [x]\n---\n")], "note_id bigint, vault_ord int, vault string, relpath string, stem string, content string").write.parquet(str(tmp_path / "texts"))
    c = Corpus(spark.read.parquet(str(tmp_path / "texts")))
    for df in (c.links(), c.orphans(), proposals.bonds(c), stack.stack_health(c), stack.health(c), c.tag_rows):
        plan = df._jdf.queryExecution().toString()
        assert "content#" not in plan.partition("== Physical Plan ==")[2], plan


def test_machine_local_folder(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


@pytest.mark.parametrize("heavy", [0, 2, 5, 1000])
def test_bonds_against_brute_force(spark, heavy):
    r = random.Random(heavy)
    rows = []
    for i in range(40):
        tags = sorted({t for t in ("all", "most", "some", "few", f"t{i % 7}", f"s{i % 3}") if r.random() < {"all": 1, "most": 0.7, "some": 0.3, "few": 0.1}.get(t, 0.5)})
        links = " ".join(f"[[n{r.randrange(40)}]]" for _ in range(r.randrange(2)))
        rows.append((i, i % 2, "AB"[i % 2], f"n{i}.md", f"n{i}", f"---\ntags: [{', '.join(tags)}]\n---\n{links}", tags))
    c = Corpus(spark.createDataFrame([x[:6] for x in rows], "note_id bigint, vault_ord int, vault string, relpath string, stem string, content string"))
    orphans = {x.note_id for x in c.orphans().collect()}
    want = []
    for o in orphans:
        near = [(len(set(x[6]) & set(rows[o][6])), x[1], x[3], x[0]) for x in rows if x[0] != o and set(x[6]) & set(rows[o][6])]
        want += [(o, q, n, tuple(sorted(set(rows[q][6]) & set(rows[o][6]))), k) for k, (n, _, _, q) in enumerate(sorted(near, reverse=True)[:3], 1)]
    got = [(x.orphan, x.note_id, x.score, tuple(x.shared_tags), x["rank"]) for x in proposals.bonds(c, 3, heavy).collect()]
    assert sorted(got) == sorted(want) and len(want) > 30


def test_sinks_over_vaults(spark, tmp_path):
    a = folder(tmp_path / "A", {"x.md": "---\ntags: [t]\n---\nhere", "same.md": "---\ntags: [t]\n---\nA"})
    b = folder(tmp_path / "B", {"y.md": "---\ntags: [t, u]\n---\n", "same.md": "plain"})
    c = Corpus(vault.read_vaults(spark, a, b))
    assert proposals.apply_bonds(proposals.bonds(c, 1), [a, b]) == 3
    assert "[[y]]" in (tmp_path / "A/x.md").read_text() and "[[x]]" in (tmp_path / "B/y.md").read_text() and "[[" not in (tmp_path / "B/same.md").read_text()
    assert proposals.apply_keys(proposals.missing_keys(c, 0.5), c.notes, [a, b]) == 1
    assert (tmp_path / "B/same.md").read_text().startswith("---\ntags: TODO\n") and (tmp_path / "A/same.md").read_text().endswith("A")
    (share,) = [x.shares for x in proposals.missing_keys(Corpus(c.notes), 0.5).collect()] or [[0.75]]
    assert share == [0.75]


def test_patterns_look_no_further_than_they_must(spark):
    """Patterns that start with a literal, and trims without a pattern, find what look-behinds and white space patterns find."""
    import re

    texts = ["a#b #c/d ##e _#f ü#g (#h-1) #", "![x](a.md) [x](b.md#t) [[w]](c.md) !\n[y](d.md)", "[[ a ]] [[b|c]] [[　d#e\x1c]]", "---\nk: v\n---\nbody #t", " ---\nk: v\n---\n", "---\nk", "a\r\nb\rc", "\x85  x y \x0b", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = F.col("t")
    rows = df.select("i", lexer.tags(c).alias("tags"), lexer.mdlinks(c).alias("md"), lexer.wikilinks(c).alias("wiki"), lexer.stripped(c).alias("s"), lexer.newlines(c).alias("n"), lexer.body(c).alias("b"), lexer.raw_frontmatter(c).alias("fm")).orderBy("i").collect()
    for t, r in zip(texts, rows):
        if t is None:
            assert r[1:] == (None,) * 7
            continue
        assert r.tags == re.findall(r"(?<![\w/])#([A-Za-z][\w/\-]*)", t)
        assert r.md == re.findall(r"(?<!!)\[[^\]]+\]\(([^)]+\.md)(?:#[^)]*)?\)", t)
        assert r.wiki == re.findall(r"\[\[([^\]|#^]+)(?:[#^][^\]|]*)?(?:\|[^\]]*)?\]\]", t)
        assert r.s == t.strip() and r.n == re.sub(r"\r\n?", "\n", t)
        m = re.match(r"(?s)---\n(.*?)\n---\n", t)
        assert (r.b, r.fm) == ((t[m.end() :], m.group(1)) if m else (t, None))
    plan = df.select(lexer.tags(c), lexer.mdlinks(c), lexer.stripped(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "Contains(t" in plan.replace("contains(t", "Contains(t")
