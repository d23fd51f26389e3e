"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates
the tags' and/or/with expressions. Identifiers and their ratings are data (spdx.py).

The rating of a licence is 0 (permissive), 1 (weak copyleft), 2 (strong copyleft), 3 (no commercial use) or 4
(unknown). "or" leaves the choice, so it takes the lower rating; "and" takes the higher; "with" a known exception makes
a strong copyleft weak. Several findings in one document hold together, as under "and".

Defined results. Whole texts are searched, without regard to case; phrases of notices also without regard to line ends,
comment leaders and the width of white space. A grant that several licences share is of the one whose clause stands in
the text, too. "All rights reserved" beside another finding doesn't change the rating. A document without any finding, an empty or null
text among them, has no row. An expression that can't be parsed is kept as it stands, with rating 4 and malformed true.
A null doc_id is returned as it is, repeated rows each; ids of whole numbers as bigint, others in their own type. Other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key, key_type
from .spdx import EXCEPTIONS, PERMISSIVE, RESTRICTED, STRONG, WEAK

TAG = "spdx-license-identifier:"
#: Phrases of notices, and the identifier each stands for. Of overlapping phrases the longest counts.
NOTICES = {
    "apache license, version 2.0": "Apache-2.0",
    "apache.org/licenses/license-2.0": "Apache-2.0",
    "apache license version 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "apache 2.0 license": "Apache-2.0",
    "mit license (mit)": "MIT",
    "permission to use, copy, modify, and/or distribute this software for any purpose": "ISC",
    "permission to use, copy, modify, and distribute this software for any purpose": "ISC",
    "this software is provided 'as-is', without any express or implied warranty": "Zlib",
    "boost software license - version 1.0": "BSL-1.0",
    "boost software license, version 1.0": "BSL-1.0",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "eclipse public license - v 2.0": "EPL-2.0",
    "eclipse public license 2.0": "EPL-2.0",
    "eclipse public license v2.0": "EPL-2.0",
    "eclipse public license v1.0": "EPL-1.0",
    "eclipse public license - v 1.0": "EPL-1.0",
    "common development and distribution license (cddl) version 1.0": "CDDL-1.0",
    "european union public licence v. 1.2": "EUPL-1.2",
    "creative commons zero v1.0 universal": "CC0-1.0",
    "cc0 1.0 universal": "CC0-1.0",
    "sil open font license, version 1.1": "OFL-1.1",
    "business source license 1.1": "BUSL-1.1",
    "server side public license": "SSPL-1.0",
    "released under the mit license": "MIT",
    "licensed under the mit license": "MIT",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "redistribution and use in source and binary forms": "BSD-2-Clause",
    "gnu general public license, version 3": "GPL-3.0-only",
    "gnu general public license, version 2": "GPL-2.0-only",
    "gnu lesser general public license": "LGPL-3.0-only",
    "gnu affero general public license": "AGPL-3.0-only",
    "mozilla public license, version 2.0": "MPL-2.0",
    "mozilla public license, v. 2.0": "MPL-2.0",
    "mozilla public license 2.0": "MPL-2.0",
    "mozilla public license, version 1.1": "MPL-1.1",
    "licensed under cc by 4.0": "CC-BY-4.0",
    "licensed under cc by-sa 4.0": "CC-BY-SA-4.0",
    "licensed under cc by-nc 4.0": "CC-BY-NC-4.0",
    "licensed under cc by-nd 4.0": "CC-BY-ND-4.0",
    "creative commons attribution-noncommercial 4.0": "CC-BY-NC-4.0",
    "creative commons attribution-sharealike 4.0": "CC-BY-SA-4.0",
    "creative commons attribution 4.0": "CC-BY-4.0",
    "all rights reserved": "LicenseRef-All-Rights-Reserved",
    "proprietary and confidential": "LicenseRef-Proprietary",
    "confidential and proprietary": "LicenseRef-Proprietary",
}
#: Titles and file headers of the GNU licences, by version.
for _name, _short, _versions in (("general", "GPL", ("2", "3")), ("lesser general", "LGPL", ("2.1", "3")), ("library general", "LGPL", ("2",)), ("affero general", "AGPL", ("3",))):
    for _v in _versions:
        _id, _gnu = f"{_short}-{_v if '.' in _v else _v + '.0'}", f"gnu {_name} public license"
        NOTICES |= {f"{_gnu}{x}{_v}": f"{_id}-only" for x in (" version ", ", version ", " v", " (version ")}
        for _mark in ",;":
            NOTICES |= {f"{_gnu} as published by the free software foundation{_mark} either version {_v}": f"{_id}-or-later", f"{_gnu} as published by the free software foundation{_mark} version {_v}": f"{_id}-only"}
#: Clauses that tell licences of one grant apart: where one stands beside the grant, the grant is of that licence.
CLAUSES = {
    "BSD-2-Clause": (("all advertising materials mentioning features", "BSD-4-Clause"), ("neither the name of", "BSD-3-Clause"), ("neither the names of", "BSD-3-Clause"), ("be used to endorse or promote products derived from", "BSD-3-Clause")),
}
#: Phrases without a version: they name their licence where no other of its family is found.
BARE = {"gnu lesser general public license": "lgpl-", "gnu affero general public license": "agpl-"}
#: Reserves what no other finding grants.
RESERVED = "all rights reserved"
RATING = {x.lower(): r for r, xs in enumerate((PERMISSIVE, WEAK, STRONG, RESTRICTED)) for x in xs.split()}
UNKNOWN = 4
#: What starts and ends lines of a comment, once spaces are single.
_LEADER = re.compile(r"(?m)^(?: ?(?:<!--|/\*+|\*+/?|//+|#+|;+|--+|%+|!+|>+|\|+|rem\b|dnl\b))+")
_TRAILER = re.compile(r"(?m)(?<!\*)\*+/? ?$")
#: Stronger binding first in the language: with, and, or.
BINDING = {"with": 3, "and": 2, "or": 1}
FIELDS = "licenses array<string>, expressions array<string>, rating int, malformed boolean, n_findings int"


def postfix(expression: str) -> list[str]:
    """Shunting-yard. Raises ValueError where the expression is malformed."""
    out, ops, value = [], [], False  # value: an operand has just ended
    for t in re.findall(r"[()]|[^\s()]+", expression):
        low = t.lower()
        if low in BINDING:
            if not value:
                raise ValueError(expression)
            while ops and ops[-1] != "(" and BINDING[ops[-1]] >= BINDING[low]:
                out.append(ops.pop())
            ops.append(low)
            value = False
        elif t == ")":
            if not value:
                raise ValueError(expression)
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise ValueError(expression)
            ops.pop()
        elif value:
            raise ValueError(expression)
        elif t == "(":
            ops.append(t)
        else:
            if not re.fullmatch(r"[a-z0-9.:\-]+\+?", low):
                raise ValueError(expression)
            out.append(low)
            value = True
    if not value or "(" in ops:
        raise ValueError(expression)
    return out + ops[::-1]


def evaluate(expression: str) -> tuple[int, list[str]]:
    """The expression's rating, and the licences it names."""
    stack: list[tuple[int, str | None]] = []
    names = []
    for t in postfix(expression):
        if t not in BINDING:
            stack.append((RATING.get(t, RATING.get(t.rstrip("+"), UNKNOWN)), t))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if t == "with":
            if left is None or right is None:
                raise ValueError(expression)
            names.append(left)
            stack.append(((1 if a == 2 else a) if right in EXCEPTIONS else max(a, UNKNOWN), None))
        else:
            names += [x for x in (left, right) if x]
            stack.append((max(a, b) if t == "and" else min(a, b), None))
    ((rating, name),) = stack
    return rating, names + ([name] if name else [])


_AUTOMATON = None


def automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for phrase in [*NOTICES, *(c for cs in CLAUSES.values() for c, _ in cs)]:
            _AUTOMATON.add_word(phrase, phrase)
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def tagged(text: str, at: int) -> str:
    """The expression behind a tag: up to the end of its line or comment."""
    end = text.find("\n", at)
    line = text[at:] if end < 0 else text[at:end]
    return re.split(r"\*/|-->|#}", line)[0].strip().rstrip(".,;").strip()


def flat(low: str) -> str:
    """A text in one line: comment leaders go, and white space is single spaces."""
    low = re.sub(r"[^\S\n]+", " ", low)
    if "\n" in low:
        low = re.sub(r"\s+", " ", _TRAILER.sub(" ", _LEADER.sub(" ", low)))
    return low


def scan(text: str | None):
    """(licences, expressions, rating, malformed, findings) of a text, or None where it has none."""
    low = (text or "").lower()
    every = [(end - len(p) + 1, end + 1, p) for end, p in automaton().iter(flat(low))]
    found, clauses = [x for x in every if x[2] in NOTICES], {p for _, _, p in every if p not in NOTICES}
    tags = [m.end() for m in re.finditer(re.escape(TAG), low)]
    if not found and not tags:
        return None
    longest, last = [], -1
    for start, end, p in sorted(found, key=lambda x: (x[0], -x[1])):
        if end > last:
            longest.append((start, end, p))
            last = end
    names, expressions, rating, malformed = set(), [], 0, False
    for at in tags:
        expression = tagged(low, at)
        expressions.append(expression)
        try:
            r, xs = evaluate(expression)
            names |= set(xs)
        except ValueError:
            r, malformed = UNKNOWN, True
        rating = max(rating, r)
    phrases = {p for _, _, p in longest}
    of = {p: next((x for c, x in CLAUSES.get(NOTICES[p], ()) if c in clauses), NOTICES[p]).lower() for p in phrases}
    names |= {of[p] for p in phrases - BARE.keys()}
    names |= {of[p] for p in phrases & BARE.keys() if not any(x.startswith(BARE[p]) for x in names)}
    alone = not tags and phrases == {RESERVED}
    rating = max([rating, *(RATING.get(of[p], UNKNOWN) for p in phrases if p != RESERVED or alone)])
    return sorted(names), sorted(set(expressions)), rating, malformed, len(longest) + len(tags)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a document with findings."""
    found = pa.struct([("licenses", pa.list_(pa.string())), ("expressions", pa.list_(pa.string())), ("rating", pa.int32()), ("malformed", pa.bool_()), ("n_findings", pa.int32())])

    def run(batches):
        for b in batches:
            each = [scan(t) for t in b.column("text").to_pylist()]
            hit = pa.array([i for i, r in enumerate(each) if r], pa.int64())
            rows = pa.array([dict(zip((f.name for f in found), r)) for r in each if r], found)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(hit), *rows.flatten()], ["doc_id", *(f.name for f in found)])

    return docs.select(key(docs, "doc_id", "doc_id"), "text").mapInArrow(run, f"doc_id {key_type(docs, 'doc_id')}, {FIELDS}")
