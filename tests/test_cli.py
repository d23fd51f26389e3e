"""Each command runs over two small folders."""

import pytest

from skein import cli
from skein.sources import vault


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    out = []
    for name, files in (("A", {"alpha": "---\ntags: [x]\n---\n[[beta]] [[shared]] #t\n- [ ] do", "beta": "[[alpha]] [[lost]]", "shared": "[[alpha]]", "bridge": "[[only]]"}), ("B", {"alpha": "[[beta]]", "beta": "[[alpha]]", "only": ""})):
        d = tmp_path_factory.mktemp(name)
        for k, t in files.items():
            (d / f"{k}.md").write_text(t)
        out.append(str(d))
    return out


def test_parse():
    assert cli.parse(["graph", "degree", "top=3", "--total"]) == ("graph:degree", {"top": "3"}, {"total"})


@pytest.mark.parametrize("line,want", [
    ("orphans", "bridge.md"), ("tasks todo", "do"), ("tags counts", "t  1"), ("unresolved verbose", "lost"), ("search query=LOST", "beta.md"),
    ("links file=alpha", "beta"), ("backlinks file=alpha counts", "beta.md"), ("properties file=alpha", "[x]"), ("property:get file=alpha name=tags", "x"),
    ("graph degree", "4"), ("graph degree top=1", "alpha.md"), ("graph bipartite", "True"), ("vault info=files", "4"), ("vault info=size", "84"), ("tasks daily date=alpha", "do"), ("graph components", "2"), ("health format=json", '"notes": 4'), ("stub total", "2"), ("read path=shared.md", "[[alpha]]"), ("graph spectrum", "2.99"), ("graph spectrum iters=400", "disconnected"),
])
def test_single(spark, roots, capsys, line, want):
    assert cli.main([*line.split(), f"vault={roots[0]}"], spark) == 0
    assert want in capsys.readouterr().out


@pytest.mark.parametrize("line,want", [("graph layered iters=40", "bridge.md"), ("graph layered sweep=0,1,2 iters=5 verbose", "peak ipr="), ("graph sublattice t_aa=2 t_bb=0.5 iters=40", "only.md"), ("vault info=name", "A")])
def test_peaks_and_places(spark, roots, capsys, line, want):
    assert cli.main([*line.split(), f"vaults={','.join(roots)}"], spark) == 0
    assert want in capsys.readouterr().out


def test_apply(spark, tmp_path, capsys):
    for v, files in (("A", {"x": "---\ntags: [t]\nstate: on\n---\n[[ghost]]", "y": "---\ntags: [t]\n---\n"}), ("B", {"y": "---\ntags: [t]\nstate: on\n---\n"})):
        (tmp_path / v).mkdir()
        for k, t in files.items():
            (tmp_path / v / f"{k}.md").write_text(t)
    at = f"vaults={tmp_path / 'A'},{tmp_path / 'B'}"
    for line, want in (("stub --apply", "1 written"), ("bond apply k=1", "2 written"), ("propagate apply min_share=0.5", "2 written")):
        assert cli.main([*line.split(), at], spark) == 0
        assert want in capsys.readouterr().out
    assert (tmp_path / "A/ghost.md").exists() and "state: TODO" in (tmp_path / "A/y.md").read_text() and "[[" in (tmp_path / "B/y.md").read_text()


def test_names_of_vaults(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "V").mkdir()
    reg = tmp_path / "r.json"
    reg.write_text('{"vaults": {"a1": {"path": "%s"}, "b2": {"path": "%s"}}}' % (tmp_path / "V", tmp_path / "V"))
    assert cli.main(["vaults", "verbose", f"registry={reg}"]) == 0 and f"V\t{tmp_path / 'V'}\ta1" in capsys.readouterr().out
    assert cli.main(["--version"]) == 0 and cli.main(["orphans", "vaults=/no/such"], spark) == 2
    monkeypatch.setenv("HOME", str(tmp_path))
    monkeypatch.setenv("SKEIN_VAULT", "~/V")
    assert vault.resolve_vault(None, str(reg)) == str(tmp_path / "V") == vault.resolve_targets(None, str(reg))[0]
    assert vault.resolve_targets("every", str(reg)) == [str(tmp_path / "V")]


@pytest.mark.parametrize("line", ["moire", "health", "graph layered sweep=0,1,2 iters=5", "graph sublattice iters=5", "graph dos moments=6 samples=1 bins=8", "graph dirac"])
def test_stacked(spark, roots, capsys, line):
    assert cli.main([*line.split(), f"vaults={','.join(roots)}"], spark) == 0


def test_errors(spark, roots, capsys):
    assert cli.main(["nonsense"], spark) == 2 and cli.main(["orphans", "vault=/no/such"], spark) == 2 and cli.main([], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["graph", "layered", f"vault={roots[0]}"], spark)
    with pytest.raises(SystemExit):
        cli.main(["graph", "hubs", "top=x", f"vault={roots[0]}"], spark)
