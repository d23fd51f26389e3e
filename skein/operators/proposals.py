"""Proposed notes, links and metadata as tables, and an explicit sink that carries them out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexer
from ..sources.shared import written
from .notes import Corpus

#: Notes that may have a tag before it counts as heavy.
HEAVY = 1000


def stubs(c: Corpus, limit: int = 0) -> DataFrame:
    """target, path, n_sources, body: a note for each link target that is missing and reads like a name."""
    lost = c.unresolved().filter(lexer.plausible_name(F.col("key")))
    lost = lost.join(c.facts.select(F.col("note_id").alias("src"), "vault_ord", "relpath", "stem"), ["src", "vault_ord"])
    per = lost.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("vault_ord", "relpath", "stem"))).alias("s"))
    links = F.array_join(F.transform("s", lambda x: F.concat(F.lit("* [["), x["stem"], F.lit("]]"))), "\n")
    head = F.concat(F.lit("---\nstatus: stub\n---\n\n# "), "key", F.lit("\n\nMissing note, named by "), F.col("n").cast("string"), F.when(F.col("n") == 1, " note.").otherwise(" notes."), F.lit("\n\n"), links, F.lit("\n"))
    out = per.select(F.col("key").alias("target"), F.concat(lexer.slug(F.col("key")), F.lit(".md")).alias("path"), F.col("n").alias("n_sources"), head.alias("body"))
    return out.orderBy("target").limit(limit) if limit else out


def bonds(c: Corpus, k: int = 3, heavy: int = HEAVY) -> DataFrame:
    """orphan, note_id, vault_ord, path, link_to, score, shared_tags, rank: for each orphan the k notes that share most frontmatter tags with it.

    Only notes that share a light tag (of at most `heavy` notes) are paired one by one. Of the notes that share nothing but
    heavy tags, those with the same heavy tags differ in their place alone, so the first k + 1 of each such set are enough.
    Tags are attached to the pairs that are left.
    """
    tags = written(c.listed("tags", "tag").select("note_id", F.ltrim("item", F.lit("#")).alias("tag")).filter("tag <> ''").distinct(), "tags")
    many = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > heavy).select("tag")
    light = tags.join(many, "tag", "left_anti")
    sets = written(tags.join(many, "tag", "left_semi").groupBy("note_id").agg(F.sort_array(F.collect_list("tag")).alias("set")), "sets")
    orphans, place = written(c.orphans().select(F.col("note_id").alias("orphan")), "orphans"), c.facts.select("note_id", "vault_ord", "relpath")
    own = sets.join(orphans, F.col("note_id") == F.col("orphan")).select("orphan", F.col("set").alias("own"))
    some = light.join(orphans, F.col("note_id") == F.col("orphan")).select("orphan", "tag")
    near = some.join(light, "tag").filter("orphan <> note_id").groupBy("orphan", "note_id").agg(F.count(F.lit(1)).alias("score"))
    near = near.join(own, "orphan", "left").join(sets, "note_id", "left")
    near = near.select("orphan", "note_id", (F.col("score") + F.coalesce(F.size(F.array_intersect("own", "set")), F.lit(0))).alias("score"))

    def first(df: DataFrame, by: str, n: int, *before) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*before, F.desc("vault_ord"), F.desc("relpath")))).filter(F.col("rank") <= n)

    best = first(sets.join(place, "note_id"), "set", k + 1).drop("rank")
    a = own.select("own").distinct().withColumn("tag", F.explode("own"))
    b = sets.select("set").distinct().withColumn("tag", F.explode("set"))
    alike = a.join(b, "tag").groupBy("own", "set").agg(F.count(F.lit(1)).alias("score"))
    far = own.join(first(alike.join(best, "set"), "own", k + 1, F.desc("score")).select("own", "note_id", "score"), "own").filter("orphan <> note_id")
    pairs = near.union(far.select("orphan", "note_id", "score")).groupBy("orphan", "note_id").agg(F.max("score").alias("score"))
    best = written(first(pairs.join(place, "note_id"), "orphan", k, F.desc("score")), "bonds")
    shared = best.select("orphan", "note_id").join(tags, "note_id").join(tags.select(F.col("note_id").alias("orphan"), "tag"), ["orphan", "tag"])
    shared = shared.groupBy("orphan", "note_id").agg(F.sort_array(F.collect_list("tag")).alias("shared_tags"))
    link = c.facts.select(F.col("note_id").alias("orphan"), F.col("stem").alias("link_to"))
    return best.join(shared, ["orphan", "note_id"]).join(link, "orphan").select("orphan", "note_id", "vault_ord", F.col("relpath").alias("path"), "link_to", "score", "shared_tags", "rank")


def missing_keys(c: Corpus, min_share: float = 0.5) -> DataFrame:
    """note_id, keys, shares (to three places, halves to even): frontmatter keys that at least min_share of all notes have, where they're missing."""
    own = c.facts.select("note_id", F.transform("fm", lambda e: e["key"]).alias("own"))
    n = own.agg(F.count(F.lit(1)).alias("n"))
    share = own.select(F.explode("own").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).crossJoin(n).select("key", (F.col("c") / F.col("n")).alias("share"))
    # one row: there are at most 1 / min_share times as many such keys as a note has on average
    common = share.filter(F.col("share") >= min_share).agg(F.sort_array(F.collect_list(F.struct("key", F.bround("share", 3).alias("share")))).alias("common"))
    per = own.crossJoin(common).select("note_id", F.filter("common", lambda x: ~F.array_contains("own", x["key"])).alias("m")).filter(F.size("m") > 0)
    return per.select("note_id", F.col("m.key").alias("keys"), F.col("m.share").alias("shares"))


def correspondence(spark: SparkSession) -> DataFrame:
    """Which reading each proposal answers."""
    rows = [(1, "missing targets", "unresolved", "stub"), (2, "notes without links to them", "orphans", "bond"), (3, "uneven metadata", "properties", "propagate")]
    return spark.createDataFrame(rows, "position int, finding string, reading string, proposal string")


def inside(root: Path, path: str) -> Path:
    """The path below root; an error where it leaves it."""
    at = (root / path).resolve()
    if not at.is_relative_to(root.resolve()):
        raise ValueError(f"{path} leads out of {root}")
    return at


def apply_stubs(proposals: DataFrame, root: str) -> int:
    """Creates the notes that don't exist yet, below root only; one at a time, on the driver. Returns how many."""
    done = 0
    for r in proposals.select("path", "body").toLocalIterator():
        at = inside(Path(root), r.path)
        if not at.exists():
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(r.body, encoding="utf-8")
            done += 1
    return done


def apply_bonds(proposals: DataFrame, roots: list[str]) -> int:
    """Appends the links that notes don't have yet; roots by vault_ord. Notes that are gone are passed over."""
    done = 0
    for r in proposals.select("vault_ord", "path", "link_to").toLocalIterator():
        at = inside(Path(roots[r.vault_ord]), r.path)
        if not at.exists():
            continue
        text, link = at.read_text(encoding="utf-8"), f"[[{r.link_to}]]"
        if link not in text:
            head = "" if "## See also" in text else "\n## See also\n"
            at.write_text(f"{text.rstrip()}\n{head}\n* {link}\n" if head else f"{text.rstrip()}\n* {link}\n", encoding="utf-8")
            done += 1
    return done


def apply_keys(proposals: DataFrame, notes: DataFrame, roots: list[str]) -> int:
    """Adds missing frontmatter keys with a TODO; roots by vault_ord. Notes that are gone are passed over."""
    done = 0
    for r in proposals.join(notes.select("note_id", "vault_ord", "relpath"), "note_id").toLocalIterator():
        at = inside(Path(roots[r.vault_ord]), r.relpath)
        if not at.exists():
            continue
        text, added = at.read_text(encoding="utf-8"), "".join(f"{k}: TODO\n" for k in r["keys"])
        fenced = text.startswith("---\n") and "\n---\n" in text[3:]
        at.write_text(text[:4] + added + text[4:] if fenced else f"---\n{added}---\n{text}", encoding="utf-8")
        done += 1
    return done
