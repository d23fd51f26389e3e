"""Linked notes: parsing, tags, tasks, properties, search, link resolution.

Notes are a table: note_id, vault_ord, vault, relpath, stem, content, and root, the absolute path of the vault (without
that column vaults are taken as folders side by side). Where an order decides (the first of several notes of one name, a
search with a limit), it is (vault_ord, relpath), by code points.

Texts are read once: what follows from one note alone is written as a narrow table (facts), and so are the name index
and the links it resolves to. Search, tasks and reading go to the texts themselves, once each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexer
from ..functions.frontmatter import as_list, entries
from ..sources.shared import written

PLACE = ("vault_ord", "relpath")


@dataclass
class Corpus:
    """A collection of notes and what follows from it; each part is computed when asked for."""

    notes: DataFrame

    @cached_property
    def parsed(self) -> DataFrame:
        """notes with content in plain newlines, body and fm, the frontmatter's entries."""
        n = self.notes.withColumn("content", lexer.newlines(F.coalesce("content", F.lit(""))))
        return n.withColumn("body", lexer.body(F.col("content"))).withColumn("raw", lexer.raw_frontmatter(F.col("content")))

    @cached_property
    def facts(self) -> DataFrame:
        """note_id, vault_ord, relpath, stem, at (the note's own path below /), wiki and md (targets as written), tags, fm; written once."""
        root = F.col("root") if "root" in self.notes.columns else F.concat(F.lit("/"), F.coalesce(F.col("vault"), F.lit("")))
        body = F.col("body")
        n = self.parsed.select(
            "note_id", *PLACE, "stem", lexer.folded(F.concat(root, F.lit("/"), "relpath")).alias("at"), F.transform(lexer.wikilinks(body), lexer.stripped).alias("wiki"),
            F.transform(lexer.mdlinks(body), lexer.stripped).alias("md"), lexer.tags(body).alias("tags"), entries(F.col("raw")).alias("fm"),
        )
        return written(n, "facts")

    @cached_property
    def properties(self) -> DataFrame:
        """note_id, vault_ord, relpath, pos, key, is_list, scalar, items: one row a frontmatter key."""
        return self.facts.select("note_id", *PLACE, F.posexplode("fm").alias("pos", "e")).select("note_id", *PLACE, "pos", "e.*")

    def listed(self, *keys: str) -> DataFrame:
        """note_id, vault_ord, relpath, item of list-like values, in no order."""
        e = F.struct("is_list", "scalar", "items")
        return self.properties.filter(F.col("key").isin(*keys)).select("note_id", *PLACE, F.explode(as_list(e)).alias("item"))

    @cached_property
    def aliases(self) -> DataFrame:
        """Every alias of every note, not distinct."""
        return self.listed("aliases", "alias").withColumnRenamed("item", "alias")

    @cached_property
    def tag_rows(self) -> DataFrame:
        """note_id, tag, origin for each occurrence, in the body or in the frontmatter."""
        inbody = self.facts.select("note_id", F.explode("tags").alias("tag"), F.lit("body").alias("origin"))
        infm = self.listed("tags").select("note_id", F.ltrim("item", F.lit("#")).alias("tag"), F.lit("frontmatter").alias("origin")).filter("tag <> ''")
        return inbody.union(infm)

    def tag_counts(self) -> DataFrame:
        return self.tag_rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("note_id").alias("n_notes"))

    def tagged(self, name: str) -> DataFrame:
        """Notes with exactly this tag, by path."""
        hit = self.tag_rows.filter(F.col("tag") == name.lstrip("#")).select("note_id").distinct()
        return self.facts.join(hit, "note_id", "left_semi").select("note_id", *PLACE).orderBy("relpath", "vault_ord")

    @cached_property
    def tasks(self) -> DataFrame:
        """note_id, vault_ord, relpath, line (from 1), done, text."""
        each = self.parsed.select("note_id", *PLACE, F.posexplode(lexer.lines(F.col("content"))).alias("at", "t")).filter(F.col("t").rlike(lexer.TASK))
        return each.select("note_id", *PLACE, (F.col("at") + 1).alias("line"), (F.regexp_extract("t", lexer.TASK, 1) != " ").alias("done"), F.regexp_extract("t", lexer.TASK, 2).alias("text"))

    def search(self, query: str, path: str = "", case: bool = False, limit: int = 0, context: bool = False) -> DataFrame:
        """Notes whose text holds the query, in order; with context, the lines that do."""
        def hit(t: Column) -> Column:
            return t.contains(query) if case else F.lower(t).contains(query.lower())

        found = self.parsed.filter(F.col("relpath").startswith(path)).filter(hit(F.col("content")))
        columns = [F.col("note_id"), *map(F.col, PLACE)]
        if context:
            numbered = F.transform(lexer.lines(F.col("content")), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
            columns.append(F.filter(numbered, lambda m: hit(m["text"])).alias("matches"))
        found = found.select(*columns)
        return found.orderBy(*PLACE).limit(limit) if limit else found

    def read(self, relpath: str) -> DataFrame:
        return self.parsed.filter(F.col("relpath") == relpath).orderBy("vault_ord").limit(1).select("note_id", "content")

    def resolve_file(self, name: str) -> DataFrame:
        """The note that a name or alias stands for: the first of the index."""
        key = name[:-3] if name.lower().endswith(".md") else name
        return self.name_index.filter(F.col("key") == key.lower()).orderBy(*PLACE).limit(1).select("note_id")

    def outgoing(self, note_ids: DataFrame | None = None) -> DataFrame:
        """note_id, pos, target: distinct targets as first written, unresolved; those in wiki links come first."""
        n = self.facts if note_ids is None else self.facts.join(note_ids, "note_id", "left_semi")
        each = n.select("note_id", F.posexplode(F.concat("wiki", F.transform("md", lexer.stem))).alias("pos", "target"))
        first = each.groupBy("note_id", F.lower("target").alias("key")).agg(F.min(F.struct("pos", "target")).alias("f"))
        return first.select("note_id", "f.*")

    @cached_property
    def name_index(self) -> DataFrame:
        """key, note_id, vault_ord, relpath: every name that a note answers to."""
        stems = self.facts.select(F.lower("stem").alias("key"), "note_id", *PLACE)
        others = self.aliases.select(F.lower("alias").alias("key"), "note_id", *PLACE)
        return written(stems.union(others).distinct(), "names")

    @cached_property
    def wiki_keys(self) -> DataFrame:
        """note_id, vault_ord, key: distinct keys of wiki links in the body."""
        keys = F.array_distinct(F.transform("wiki", F.lower))
        return self.facts.select("note_id", "vault_ord", F.explode(F.filter(keys, lambda k: k != "")).alias("key"))

    @cached_property
    def looked_up(self) -> DataFrame:
        """wiki_keys with near, the first note of that name in the same vault, and far, the first of all; written once.

        Two lookups of one row a key (and vault) rather than a ranking of all candidates.
        """
        i = self.name_index
        place = F.struct("vault_ord", "relpath", "note_id")
        here = i.groupBy("key", "vault_ord").agg(F.min(place).alias("p"))
        anywhere = here.groupBy("key").agg(F.min("p").alias("p")).select("key", F.col("p.note_id").alias("far"))
        keys = self.wiki_keys.join(here.select("key", "vault_ord", F.col("p.note_id").alias("near")), ["key", "vault_ord"], "left")
        return written(keys.join(anywhere, "key", "left").select("note_id", "vault_ord", "key", "near", "far"), "keys")

    def resolved_keys(self, isolated: bool = False) -> DataFrame:
        """wiki_keys with dst: the first of the same vault, else the first of all; null where there is none. isolated: each vault alone."""
        return self.looked_up.select("note_id", "vault_ord", "key", (F.col("near") if isolated else F.coalesce("near", "far")).alias("dst"))

    @cached_property
    def md_hits(self) -> DataFrame:
        """src, dst, pos, key (the target's stem), within (source and target lie in one vault) of links to files of any vault; written once."""
        folder = F.regexp_replace("at", "[^/]*$", "")
        each = self.facts.filter(F.size("md") > 0).select(F.col("note_id").alias("src"), F.col("vault_ord").alias("own"), F.posexplode(F.transform("md", lambda h: F.when(h.startswith("/"), h).otherwise(F.concat(folder, h)))).alias("pos", "href"))
        each = each.withColumn("at", lexer.folded(F.col("href"))).drop("href")
        targets = self.facts.select(F.col("note_id").alias("dst"), "vault_ord", "at", F.lower("stem").alias("key"))
        hit = each.join(targets, "at").filter("src <> dst")
        return written(hit.select("src", "dst", "pos", "key", (F.col("own") == F.col("vault_ord")).alias("within")), "hrefs")

    def md_links(self, isolated: bool = False) -> DataFrame:
        """src, dst, key of links to files that exist; the first of each stem, none to a wiki key. isolated: within one vault."""
        hit = self.md_hits.filter("within") if isolated else self.md_hits
        first = hit.groupBy("src", "key").agg(F.min_by("dst", "pos").alias("dst"))
        seen = self.looked_up.select(F.col("note_id").alias("src"), "key")
        return first.join(seen, ["src", "key"], "left_anti").select("src", "dst", "key")

    def links(self, isolated: bool = False) -> DataFrame:
        """src, dst, raw_key, kind: one row a key, so two names of one note give two rows."""
        wiki = self.resolved_keys(isolated).filter("dst is not null and dst <> note_id").select(F.col("note_id").alias("src"), "dst", F.col("key").alias("raw_key"), F.lit("wiki").alias("kind"))
        return wiki.union(self.md_links(isolated).select("src", "dst", F.col("key").alias("raw_key"), F.lit("md").alias("kind")))

    def unresolved(self, isolated: bool = False) -> DataFrame:
        """key, src, vault_ord of links that lead nowhere."""
        return self.resolved_keys(isolated).filter("dst is null").select("key", F.col("note_id").alias("src"), "vault_ord")

    def orphans(self, isolated: bool = False) -> DataFrame:
        """Notes that no other note links to."""
        return self.facts.join(self.links(isolated), F.col("note_id") == F.col("dst"), "left_anti").select("note_id", *PLACE)

    def backlinks(self) -> DataFrame:
        """dst, src, n: how many keys lead from src to dst."""
        return self.links().groupBy("dst", "src").agg(F.count(F.lit(1)).alias("n"))

    def vault_info(self) -> DataFrame:
        return self.notes.groupBy("vault_ord", "vault").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("size"))
