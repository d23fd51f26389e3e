"""A thin front end: python -m skein.cli COMMAND [key=value ...] [flag ...]

vault=NAME is a registered folder, a path, or stack (default: $SKEIN_VAULT, $OBSIDIAN_VAULT, the first registered);
vaults=A,B are several paths. format=text, json, csv or tsv. stub, bond and propagate write with the flag apply alone.
"""

from __future__ import annotations

import os
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions import series
from .functions.frontmatter import as_list
from .operators import graph as G
from .operators import proposals, spectral, stack
from .operators.notes import Corpus
from .sources import sinks, vault
from .sources.shared import written as kept


class Call:
    """Arguments of one command, and what they refer to."""

    def __init__(self, spark: SparkSession, args: dict[str, str], flags: set[str], roots: list[str]):
        self.spark, self.args, self.flags, self.roots = spark, args, flags, roots
        self.corpus = Corpus(vault.read_vaults(spark, *roots))

    def number(self, key: str, default, kind=int):
        try:
            return kind(self.args.get(key, default))
        except ValueError:
            raise SystemExit(f"{key}= takes a number, not {self.args[key]!r}") from None

    def note(self) -> DataFrame:
        if "path" in self.args:
            return self.corpus.notes.filter(F.col("relpath") == self.args["path"]).orderBy("vault_ord").limit(1).select("note_id")
        if "file" in self.args:
            return self.corpus.resolve_file(self.args["file"])
        raise SystemExit("file= or path= is needed")

    def of_note(self, df: DataFrame, column: str = "note_id") -> DataFrame:
        return df.join(self.note().withColumnRenamed("note_id", column), column, "left_semi") if {"file", "path"} & self.args.keys() else df

    def named(self, df: DataFrame, column: str = "note_id") -> DataFrame:
        """df with the path of a note in place of its id."""
        place = F.concat_ws(":", "vault", "relpath") if len(self.roots) > 1 else F.col("relpath")
        return df.join(self.corpus.notes.select(F.col("note_id").alias(column), place.alias("file")), column).drop(column, "vault_ord", "relpath")

    def graph(self) -> G.Graph:
        return G.undirected(self.corpus.links().select("src", "dst"), self.corpus.facts.select(F.col("note_id").alias("id")), closed=True)

    def layers(self) -> stack.Layers:
        if len(self.roots) < 2:
            raise SystemExit("two vaults are needed")
        return stack.layered(self.corpus.facts.select(F.col("note_id").alias("id"), "vault_ord"), self.corpus.links().select("src", "dst"))

    def couplings(self, key: str) -> list[float]:
        return series.parse_sweep(self.args["sweep"]) if "sweep" in self.args else [self.number(key, 1.0, float)]


def tasks(c: Call) -> DataFrame:
    t = c.corpus.tasks
    if "daily" in c.flags:
        t = t.join(c.corpus.resolve_file(c.args.get("date", date.today().isoformat())), "note_id", "left_semi")
    for flag, done in (("todo", False), ("done", True)):
        if flag in c.flags:
            t = t.filter(F.col("done") == done)
    return c.named(c.of_note(t)).orderBy("file", "line")


def properties(c: Call) -> DataFrame:
    p = c.of_note(c.corpus.properties)
    if "name" in c.args:
        each = F.when(F.col("is_list"), as_list(F.struct("is_list", "scalar", "items"))).otherwise(F.array("scalar"))
        return p.filter(F.col("key") == c.args["name"]).select(F.explode(each).alias("value"))
    return p.orderBy("pos").select("key", F.when(F.col("is_list"), F.concat(F.lit("["), F.array_join("items", ", "), F.lit("]"))).otherwise(F.col("scalar")).alias("value"))


def tags(c: Call) -> DataFrame:
    t = c.of_note(c.corpus.tag_rows).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    t = t.orderBy(F.desc("n"), "tag") if c.args.get("sort") == "count" else t.orderBy("tag")
    return t if "counts" in c.flags else t.select("tag")


def backlinks(c: Call) -> DataFrame:
    b = c.named(c.of_note(c.corpus.backlinks(), "dst").select("src", "n"), "src").orderBy("file")
    return b.select("file", "n") if "counts" in c.flags else b.select("file")


def unresolved(c: Call) -> DataFrame:
    u = c.named(c.corpus.unresolved().select("key", "src"), "src").groupBy("key").agg(F.sort_array(F.collect_set("file")).alias("files"))
    return (u if "verbose" in c.flags else u.select("key")).orderBy("key")


def search(c: Call, context: bool = False) -> DataFrame:
    if "query" not in c.args:
        raise SystemExit("query= is needed")
    return c.named(c.corpus.search(c.args["query"], c.args.get("path", ""), "case" in c.flags, c.number("limit", 0), context))


def vault_command(c: Call):
    info = c.args.get("info", "name")
    if info == "name":
        return [os.path.basename(c.roots[0].rstrip("/"))]
    if info == "path":
        return [c.roots[0]]
    if info in ("files", "size"):
        of = vault.read_vaults(c.spark, *c.roots, content=False)
        return of.agg((F.count(F.lit(1)) if info == "files" else F.coalesce(F.sum("size"), F.lit(0))).alias(info))
    if info == "all":
        return c.corpus.vault_info()
    raise SystemExit(f"unknown info={info}")


def degree(c: Call):
    g, top = c.graph(), c.number("top", 10)
    hubs = [c.named(G.hubs(g, top), "id").orderBy(F.desc("degree"), "file")] if top else []
    return [G.degree_stats(g), *hubs]


def bipartite(c: Call):
    g = c.graph()
    colors = G.parity(g)
    odd = c.named(c.named(G.odd_edge(g, colors), "src").withColumnRenamed("file", "odd_a"), "dst").withColumnRenamed("file", "odd_b")
    return [G.bipartite(g, colors), odd]


def connectivity(low: float, tol: float) -> str:
    """What a second eigenvalue says of a graph."""
    if low < -tol:
        return "negative second eigenvalue: the largest one isn't converged; raise iters="
    if low < 1e-4:
        return "near zero: the graph is as good as disconnected"
    return "small: two regions are joined by a narrow bridge" if low < 0.05 else "well connected"


def localization(n_ipr: float) -> str:
    return "extended over the graph" if n_ipr < 2 else "moderately localised" if n_ipr < 10 else "strongly localised"


def spectrum(c: Call):
    g, tol = c.graph(), c.number("tol", 1e-6, float)
    rows = spectral.spectrum(g.vertices, g.edges, iters=c.number("iters", 120), tol=tol)
    said = [connectivity(r.lambda_2, tol) for r in rows.take(1)]
    return [rows, *said]


def swept(c: Call, x: stack.Layers, edges: DataFrame, values: list[float], rows: DataFrame, weights, name: str):
    """The sweep, its peak and, for a single value or with the flag verbose, the notes where the vector at the peak is largest."""
    found = rows.orderBy("step").collect()  # one row a value
    if not found:
        return ["the stack is too small, or its layers aren't joined"]
    peak = max(found, key=lambda r: (r.ipr, -r.step))
    out = [rows.withColumn(name, F.element_at(F.array(*map(F.lit, values)), F.col("step") + 1)).orderBy("step"), f"peak ipr={peak.ipr:.4f} at {name}={values[peak.step]:.3f}, n_ipr={peak.n_ipr:.2f}: {localization(peak.n_ipr)}"]
    if edges.filter("class <> 'intra'").isEmpty():
        out.append("no edges between the layers: the coupling changes nothing")
    if len(values) == 1 or "verbose" in c.flags:
        vec = spectral.fiedler(x.vertices.select("id"), edges, weights(values[peak.step]), c.number("iters", 200), c.number("tol", 1e-6, float))
        out.append(c.named(spectral.localized(vec, c.number("top", 10)), "id").orderBy(F.desc(F.abs("x")), "file"))
    return out


def layered(c: Call):
    x, values = c.layers(), c.couplings("tperp")
    rows = stack.layered_spectrum(x, values, c.number("iters", 200), c.number("tol", 1e-6, float))
    return [stack.layer_counts(x), *swept(c, x, x.edges, values, rows, lambda t: {"intra": 1.0, "inter": t}, "tperp")]


def sublattice(c: Call):
    x, values = c.layers(), c.couplings("t_aa")
    colors = stack.colors(x)
    t_ab = 1.0 if "sweep" in c.args else c.number("t_ab", 1.0, float)
    t_bb = c.number("t_bb", 1.0, float) if "t_bb" in c.args and "sweep" not in c.args else None
    rows = stack.sublattice_spectrum(x, values, t_ab, colors, c.number("iters", 200), c.number("tol", 1e-6, float), t_bb)
    edges = stack.sublattice_edges(x, colors)
    return [stack.sublattice_counts(x, colors), stack.quality(x, colors), *swept(c, x, edges, values, rows, lambda t: stack.sublattice_weights(t, t_ab, t_bb), "t_aa")]


def dos(c: Call) -> DataFrame:
    x = c.layers() if len(c.roots) > 1 else None
    g = c.graph() if x is None else x
    params = {"intra": 1.0} if x is None else {"intra": 1.0, "inter": c.number("tperp", 1.0, float)}
    out = spectral.density_of_states(g.vertices.select("id"), g.edges, params, c.number("moments", 200), c.number("samples", 8), c.number("bins", 100), c.args.get("kernel", "jackson"))
    return series.peaks(out, top=c.number("peaks", 5)) if "peaks" in c.args else out


def dirac(c: Call) -> DataFrame:
    g, top = c.graph(), c.number("top", 15)
    if len(c.roots) > 1:
        return c.named(G.dirac_stack(g, c.corpus.notes.select(F.col("note_id").alias("id"), "vault_ord"), top=top), "id")
    return c.named(G.dirac_single(g, top=top), "id")


COMMANDS = {
    "vault": vault_command,
    "read": lambda c: c.of_note(c.corpus.parsed).select("content"),
    "files": lambda c: c.named(c.corpus.notes.select("note_id")).orderBy("file"),
    "links": lambda c: c.corpus.outgoing(c.note()).orderBy("pos").select("target"),
    "backlinks": backlinks,
    "unresolved": unresolved,
    "orphans": lambda c: c.named(c.corpus.orphans()).orderBy("file"),
    "aliases": lambda c: c.named(c.of_note(c.corpus.aliases)).orderBy("file"),
    "tags": tags,
    "tag": lambda c: c.named(c.corpus.tagged(c.args.get("name", ""))).orderBy("file"),
    "search": search,
    "search:context": lambda c: search(c, True),
    "tasks": tasks,
    "properties": properties,
    "property:get": properties,
    "graph:degree": degree,
    "graph:hubs": lambda c: c.named(G.hubs(c.graph(), c.number("top", 20)), "id").orderBy(F.desc("degree"), "file"),
    "graph:density": lambda c: G.density(c.graph()),
    "graph:triangles": lambda c: G.triangles(c.graph()),
    "graph:clustering": lambda c: G.clustering(c.graph()),
    "graph:girth": lambda c: G.girth(c.graph()),
    "graph:bipartite": bipartite,
    "graph:components": lambda c: G.component_sizes(c.graph()).orderBy(F.desc("size"), "label").limit(20) if "verbose" in c.flags else G.component_stats(c.graph()),
    "graph:dirac": dirac,
    "graph:spectrum": spectrum,
    "graph:layered": layered,
    "graph:sublattice": sublattice,
    "graph:dos": dos,
    "moire": lambda c: stack.shared_names(c.corpus.notes).orderBy("name").limit(60) if "verbose" in c.flags else stack.moire(c.corpus.notes).orderBy(F.desc("jaccard"), "a", "b"),
    "health": lambda c: stack.stack_health(c.corpus) if len(c.roots) > 1 else stack.health(c.corpus),
    "stub": lambda c: proposals.stubs(c.corpus, c.number("limit", 0)),
    "bond": lambda c: proposals.bonds(c.corpus, c.number("k", 3)),
    "propagate": lambda c: c.named(proposals.missing_keys(c.corpus, c.number("min_share", 0.5, float))),
    "legendre": lambda c: proposals.correspondence(c.spark),
}


#: What the flag apply does; proposals are fetched before the first note is changed.
APPLIED = {
    "stub": lambda c: proposals.apply_stubs(kept(proposals.stubs(c.corpus, c.number("limit", 0)), "stubs"), c.roots[0]),
    "bond": lambda c: proposals.apply_bonds(kept(proposals.bonds(c.corpus, c.number("k", 3)), "bonds"), c.roots),
    "propagate": lambda c: proposals.apply_keys(kept(proposals.missing_keys(c.corpus, c.number("min_share", 0.5, float)), "keys"), c.corpus.facts, c.roots),
}


def parse(argv: list[str]) -> tuple[str, dict[str, str], set[str]]:
    """Command, key=value arguments and flags; "graph x" is one command."""
    words = [a for a in argv if "=" not in a]
    command, used = (words[0], 1) if words else ("", 0)
    if command == "graph" and len(words) > 1:
        command, used = f"graph:{words[1]}", 2
    return command, dict(a.split("=", 1) for a in argv if "=" in a), {w.lstrip("-") for w in words[used:]}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    command, args, flags = parse(argv)
    if command in ("", "help"):
        print(__doc__, "Commands: " + ", ".join(["vaults", *COMMANDS]), sep="\n")
        return 0
    if command in ("version", "--version"):
        print(__version__)
        return 0
    if command == "vaults":
        for k, p in (known := vault.registry(args.get("registry"))).items():
            name = os.path.basename(p.rstrip("/"))
            print(f"{name}\t{p}\t{k}" if "verbose" in flags else name)
        return 0 if known else 1
    if command not in COMMANDS:
        print(f"unknown command {command}", file=sys.stderr)
        return 2
    if missing := [p for p in args.get("vaults", "").split(",") if p and not os.path.isdir(os.path.expanduser(p))]:
        print(f"no such folder: {', '.join(missing)}", file=sys.stderr)
        return 2
    roots = [os.path.expanduser(p) for p in args["vaults"].split(",") if p] if "vaults" in args else vault.resolve_targets(args.get("vault"), args.get("registry"))
    if not roots:
        print("no vault", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("skein").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    c = Call(spark, args, flags, roots)
    if command in APPLIED and "apply" in flags:
        print(APPLIED[command](c), "written")
        return 0
    made = COMMANDS[command](c)
    for part in made if isinstance(made, list) else [made]:
        if isinstance(part, str):
            print(part)
        elif "total" in flags:
            print(part.count())
        else:
            for line in sinks.text_rows(part, args.get("format", "text")):
                print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
