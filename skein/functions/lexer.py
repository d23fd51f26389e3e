"""Lexical expressions over note text: links, tags, tasks, lines, names. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIKILINK = r"\[\[([^\]|#^]+)(?:[#^][^\]|]*)?(?:\|[^\]]*)?\]\]"
MDLINK = r"\[(?<!!\[)[^\]]+\]\(([^)]+\.md)(?:#[^)]*)?\)"
TAG = r"#(?<![\p{L}\p{N}_/]#)([A-Za-z][\p{L}\p{N}_/\-]*)"
TASK = r"^\s*[-*]\s+\[([ xX])\]\s+(.*)$"
FRONTMATTER = r"(?s)^---\n(.*?)\n---\n"
#: Java's \s, and what else Python takes for white space.
SPACE = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def newlines(text: Column) -> Column:
    """Any line end as a single line feed."""
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def stripped(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(text, F.lit(SPACE))


def raw_frontmatter(text: Column) -> Column:
    """What stands between the fences at the very start; null where there are none."""
    return F.when(text.startswith("---\n") & text.rlike(FRONTMATTER), F.regexp_extract(text, FRONTMATTER, 1))


def body(text: Column) -> Column:
    return F.when(text.startswith("---\n"), F.regexp_replace(text, FRONTMATTER, "")).otherwise(text)


def _all(text: Column, pattern: str, part: str) -> Column:
    """The first groups of all matches, which there are none of without `part`: most texts aren't searched for the pattern at all."""
    return F.when(text.isNotNull() & ~text.contains(part), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(pattern), 1))


def wikilinks(text: Column) -> Column:
    """Targets in order of the text, as written."""
    return _all(text, WIKILINK, "[[")


def mdlinks(text: Column) -> Column:
    """Hrefs of links to .md files, in order."""
    return _all(text, MDLINK, ".md")


def tags(text: Column) -> Column:
    return _all(text, TAG, "#")


def lines(text: Column) -> Column:
    """Lines without their ends; no empty one after the last end."""
    parts = F.split(text, r"\R|[\x{1c}-\x{1e}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stem(path: Column) -> Column:
    """The last segment of a path without its last suffix."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).otherwise(name)


def folded(path: Column) -> Column:
    """An absolute path with . and .. segments worked out; above the top there is nothing, so .. stays there."""
    def step(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when((s == "") | (s == "."), acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def plausible_name(target: Column) -> Column:
    """Whether a link target reads like a name rather than a piece of code or a template."""
    t = stripped(target)
    code = t.rlike(r'[()=!,*$"<>{}|]') | t.contains("...") | t.contains("->")
    return (t != "") & (F.length(t) <= 120) & ~code & ~t.startswith(".") & ~t.startswith("/") & ~t.rlike(r"^\p{Nd}+$")


def slug(name: Column) -> Column:
    """A path that file systems accept, each segment on its own."""
    def clean(seg: Column) -> Column:
        s = stripped(F.regexp_replace(seg, r'[\\:*?"<>|]', "_"))
        return F.when(s == "", "untitled").otherwise(s)

    return F.array_join(F.transform(F.split(name, "/"), clean), "/")
