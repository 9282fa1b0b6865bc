"""Licence scan: TF-IDF cosine of lines, sentences, windows and licence files to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from threatloom.functions.skew import salted_join
from threatloom.llm.common import stage


class Wording(NamedTuple):
    """One notice of a licence.  A bar separates phrases of which one will do; phrases are compared term by term."""
    text: str
    needs: tuple[str, ...]  # the telling terms: one phrase of each must stand among the matched terms
    elsewhere: str = ""  # one of these must stand anywhere in the file
    unless: str = ""  # none of these may stand anywhere in the file


# Names of public licences, the phrases that tell them from their relatives, and their SPDX identifiers.
_GPL, _LGPL, _AGPL = "gnu general public license|gnu gpl", "gnu lesser general public license|gnu library general public license|gnu lgpl", \
    "gnu affero general public license|gnu agpl"
_V2, _V21, _V3 = "version 2|version 2.0|v2|v2.0|v 2|2.0", "version 2.1|v2.1|v 2.1|2.1", "version 3|version 3.0|v3|v3.0|v 3|3.0"
NAMED = {
    "0bsd": ("the Zero-Clause BSD License", ("zero-clause bsd|0-clause bsd|bsd zero clause|bsd 0-clause",), ("0BSD",)),
    "agpl-3.0": ("the GNU Affero General Public License, version 3", (_AGPL, _V3), ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    "apache-1.1": ("the Apache Software License, Version 1.1", ("apache software license|apache license", "version 1.1|1.1"), ("Apache-1.1",)),
    "apache-2.0": ("the Apache License, Version 2.0", ("apache license|apache software license", "version 2|version 2.0|2.0"), ("Apache-2.0",)),
    "bsd-2-clause": ("the BSD 2-Clause License", ("bsd 2-clause|2-clause bsd|two-clause bsd|simplified bsd",), ("BSD-2-Clause",)),
    "bsd-3-clause": ("the BSD 3-Clause License", ("bsd 3-clause|3-clause bsd|three-clause bsd|new bsd|modified bsd",), ("BSD-3-Clause",)),
    "bsl-1.0": ("the Boost Software License, Version 1.0", ("boost software license",), ("BSL-1.0",)),
    "cc-by-4.0": ("CC BY 4.0", ("cc by 4.0|cc-by 4.0|cc-by-4.0",), ("CC-BY-4.0",)),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", ("cc by-nc 4.0|cc-by-nc 4.0|cc-by-nc-4.0",), ("CC-BY-NC-4.0",)),
    "cc-by-nc-nd-4.0": ("CC BY-NC-ND 4.0", ("cc by-nc-nd 4.0|cc-by-nc-nd 4.0|cc-by-nc-nd-4.0",), ("CC-BY-NC-ND-4.0",)),
    "cc-by-nc-sa-4.0": ("CC BY-NC-SA 4.0", ("cc by-nc-sa 4.0|cc-by-nc-sa 4.0|cc-by-nc-sa-4.0",), ("CC-BY-NC-SA-4.0",)),
    "cc-by-nd-4.0": ("CC BY-ND 4.0", ("cc by-nd 4.0|cc-by-nd 4.0|cc-by-nd-4.0",), ("CC-BY-ND-4.0",)),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", ("cc by-sa 4.0|cc-by-sa 4.0|cc-by-sa-4.0",), ("CC-BY-SA-4.0",)),
    "cc0-1.0": ("CC0 1.0 Universal", ("cc0 1.0|cc0-1.0",), ("CC0-1.0",)),
    "epl-1.0": ("the Eclipse Public License, Version 1.0", ("eclipse public license", "version 1.0|1.0|v1.0"), ("EPL-1.0",)),
    "epl-2.0": ("the Eclipse Public License, Version 2.0", ("eclipse public license", "version 2|2.0|v2.0"), ("EPL-2.0",)),
    "gpl-2.0": ("the GNU General Public License, version 2", (_GPL, _V2), ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later")),
    "gpl-3.0": ("the GNU General Public License, version 3", (_GPL, _V3), ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")),
    "isc": ("the ISC License", ("isc license|isc licence",), ("ISC",)),
    "lgpl-2.1": ("the GNU Lesser General Public License, version 2.1", (_LGPL, _V21), ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later")),
    "lgpl-3.0": ("the GNU Lesser General Public License, version 3", (_LGPL, _V3), ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    "mit": ("the MIT License", ("mit license|mit licence",), ("MIT",)),
    "mpl-2.0": ("the Mozilla Public License, v. 2.0", ("mozilla public license", "version 2|version 2.0|2.0|v2.0"), ("MPL-2.0",)),
    "unlicense": ("the Unlicense", ("the unlicense",), ("Unlicense",)),
    "zlib": ("the zlib License", ("zlib license|zlib/libpng license",), ("Zlib",)),
}
# Abbreviated names.
ABBREVIATED = {
    "agpl-3.0": ("AGPLv3", "AGPL-3.0", "AGPL 3.0"), "epl-1.0": ("EPL-1.0", "EPL 1.0"), "epl-2.0": ("EPL-2.0", "EPL 2.0"),
    "gpl-2.0": ("GPLv2", "GPL-2.0", "GPL 2.0"), "gpl-3.0": ("GPLv3", "GPL-3.0", "GPL 3.0"), "lgpl-2.1": ("LGPLv2.1", "LGPL-2.1", "LGPL 2.1"),
    "lgpl-3.0": ("LGPLv3", "LGPL-3.0", "LGPL 3.0"), "mpl-2.0": ("MPLv2", "MPL-2.0", "MPL 2.0"),
}
# Wording of public licence notices.
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.")
_ENDORSE = "endorse or promote products|neither the name"
_GNU = ("This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        "Foundation{stop} either version {version} of the License, or (at your option) any later version.")
_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def _gnu(what: str, name: str, version: str, family: str, versions: str) -> Wording:
    mark, stop = (":", ",") if version == "3" else (";", ";")
    return Wording(_GNU.format(what=what, mark=mark, name=name, stop=stop, version=version), (family, versions))


def _attribution(more: str) -> Wording:
    """A Creative Commons notice written out; its parts are joined by hyphens."""
    name = f"Attribution{more}"
    return Wording(f"This work is licensed under the Creative Commons {name} 4.0 International License.", (f"creative commons {name} 4.0",))


NOTICES = {
    "0bsd": [Wording(_PERMIT + ".", ("purpose with or without fee",), unless="above copyright notice")],
    "agpl-3.0": [_gnu("program", "GNU Affero General Public License", "3", _AGPL, _V3)],
    "apache-2.0": [Wording(
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        ("apache license version 2|apache license version 2.0",))],
    "bsd-2-clause": [Wording(_BSD, ("redistribution and use in source",), unless=_ENDORSE)],
    "bsd-3-clause": [Wording(_BSD, ("redistribution and use in source",), elsewhere=_ENDORSE, unless="all advertising materials")],
    "bsd-4-clause": [Wording(_BSD, ("redistribution and use in source",), elsewhere="all advertising materials")],
    "cc-by-4.0": [_attribution("")], "cc-by-nc-4.0": [_attribution("-NonCommercial")], "cc-by-nc-nd-4.0": [_attribution("-NonCommercial-NoDerivatives")],
    "cc-by-nc-sa-4.0": [_attribution("-NonCommercial-ShareAlike")], "cc-by-nd-4.0": [_attribution("-NoDerivatives")],
    "cc-by-sa-4.0": [_attribution("-ShareAlike")],
    "epl-2.0": [Wording("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
                        ("eclipse public license 2.0|eclipse public license v 2.0|eclipse public license version 2.0",))],
    "gpl-2.0": [_gnu("program", "GNU General Public License", "2", _GPL, _V2)],
    "gpl-3.0": [_gnu("program", "GNU General Public License", "3", _GPL, _V3)],
    "isc": [Wording(_PERMIT + ", provided that the above copyright notice and this permission notice appear in all copies.",
                    ("purpose with or without fee", "above copyright notice"))],
    "lgpl-2.1": [_gnu("library", "GNU Lesser General Public License", "2.1", _LGPL, _V21)],
    "lgpl-3.0": [_gnu("library", "GNU Lesser General Public License", "3", _LGPL, _V3)],
    "mit": [Wording(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", ("permission is hereby granted",))],
    "mpl-2.0": [Wording("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license", "2.0"))],
    "unlicense": [Wording("This is free and unencumbered software released into the public domain.", ("unencumbered software",))],
    "zlib": [Wording("The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
                     ("origin of this software must not be misrepresented",))],
    "all-rights-reserved": [Wording("All rights reserved.", ("all rights reserved",))],
}


def _catalogue() -> dict[str, list[Wording]]:
    """Each named licence as a short notice, as its SPDX tags and in its own wording."""
    out = {name: list(found) for name, found in NOTICES.items()}
    for name, (title, needs, tags) in NAMED.items():
        short = [Wording(text.format(title), needs) for text in ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.")]
        spdx = [Wording(f"SPDX-License-Identifier: {tag}", (f"SPDX-License-Identifier {tag}",)) for tag in tags]
        brief = [Wording(f"Licensed under {form}.", (form,)) for form in ABBREVIATED.get(name, ())]
        out[name] = short + spdx + brief + out.get(name, [])
    return out


TEMPLATES = _catalogue()
# Notices about rights: any other licence in the same file comes before them.
UNNAMED = ("all-rights-reserved",)
LEAST = 0.7
# Shortest and longest window, times the length of a wording.
WINDOW = (0.75, 1.5)
# Terms that deny what follows them in the same sentence, and how far they reach.
DENIALS = frozenset(("not", "never", "isn", "wasn", "aren", "nor", "neither", "longer"))
REACH = 5
_SENTENCE_END = re.compile(r"[.!?]+[\"')]*(?=\s)|\n[^a-z0-9\n]*(?=\n)")
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_OUT = StructType([StructField("license", StringType()), StructField("score", DoubleType())])
_ARROW = pa.struct([("license", pa.string()), ("score", pa.float64())])


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def _phrases(text: str) -> list[tuple[str, ...]]:
    return [tuple(terms(p)) for p in text.split("|") if p]


class _Text:
    """Terms of one text, with their places, lines and sentences."""

    def __init__(self, lowered: str) -> None:
        self.lowered = lowered
        self.terms, self.starts, self.places = [], [], {}
        for i, found in enumerate(_TERM.finditer(lowered)):
            self.terms.append(found.group())
            self.starts.append(found.start())
            self.places.setdefault(found.group(), []).append(i)
        self.ends = [m.end() for m in _SENTENCE_END.finditer(lowered)]
        self.found: dict = {}

    def holds(self, phrases) -> bool:
        return any(self._at(p, i) for p in phrases for i in self.places.get(p[0], ()))

    def _at(self, phrase: tuple[str, ...], i: int) -> bool:
        return tuple(self.terms[i : i + len(phrase)]) == phrase

    def occurrences(self, phrases: tuple) -> tuple[list[int], list[int]]:
        """Places where one of the phrases stands and is not denied, and the nearest end of one from each of them on."""
        if phrases not in self.found:
            spans = sorted({(i, i + len(p)) for p in phrases for i in self.places.get(p[0], ()) if self._at(p, i) and not self._denied(i)})
            ends, least = [], math.inf
            for _, end in reversed(spans):
                least = min(least, end)
                ends.append(least)
            self.found[phrases] = [a for a, _ in spans], ends[::-1]
        return self.found[phrases]

    def _denied(self, i: int) -> bool:
        inside = bisect_right(self.ends, self.starts[i])
        return any(self.terms[j] in DENIALS and bisect_right(self.ends, self.starts[j]) == inside for j in range(max(0, i - REACH), i))

    def least_end(self, needs: tuple, start: int) -> float:
        """End of the shortest span from ``start`` on that holds a phrase of every need."""
        end = start
        for phrases in needs:
            starts, ends = self.occurrences(phrases)
            at = bisect_left(starts, start)
            if at == len(starts):
                return math.inf
            end = max(end, ends[at])
        return end

    def _span(self, start: int, end: int) -> tuple[int, int]:
        return bisect_left(self.starts, start), bisect_left(self.starts, end)

    def units(self, place: int) -> list[tuple[int, int]]:
        """The line and the sentence that a term stands in."""
        char = self.starts[place]
        after = self.lowered.find("\n", char)
        number = bisect_right(self.ends, char)
        return [self._span(self.lowered.rfind("\n", 0, char) + 1, len(self.lowered) if after < 0 else after),
                self._span(self.ends[number - 1] if number else 0, self.ends[number] if number < len(self.ends) else len(self.lowered))]


class Matcher:
    """Cosine of lines, sentences and windows to every template wording.

    Term weights are counts times ``log((1 + n) / (1 + df)) + 1`` over the ``n`` template wordings; a term that no template has
    weighs as much as the rarest.  A span matches a wording only if it holds the wording's telling phrases, none of them
    denied ("not under the ..."), so only spans around such phrases are compared, and a text without the longest term of any first need
    cannot match at all.
    """

    def __init__(self, templates: Mapping[str, list[Wording]], least: float) -> None:
        self.least = least
        told = [(name, w) for name in sorted(templates, key=lambda n: (n in UNNAMED, n)) for w in templates[name]]
        counted = [Counter(terms(w.text)) for _, w in told]
        seen = Counter(term for counts in counted for term in counts)
        self.idf = {term: math.log((1 + len(told)) / (1 + n)) + 1 for term, n in seen.items()}
        self.rarest = math.log(1 + len(told)) + 1
        self.wordings, gates = [], set()
        for (name, w), counts in zip(told, counted, strict=True):
            size = sum(counts.values())
            needs = tuple(tuple(_phrases(n)) for n in w.needs)
            gates.update(max(phrase, key=len) for phrase in needs[0])
            self.wordings.append((name, self._weighed(counts), needs, _phrases(w.elsewhere), _phrases(w.unless),
                                  math.ceil(WINDOW[0] * size), math.ceil(WINDOW[1] * size)))
        # A gate that holds another one needs no test of its own.
        self.gates = sorted(g for g in gates if not any(o != g and o in g for o in gates))

    def _weighed(self, counts: Counter) -> dict[str, float]:
        vector = {term: n * self.idf.get(term, self.rarest) for term, n in counts.items()}
        norm = math.sqrt(math.fsum(w * w for w in vector.values()))
        return {term: w / norm for term, w in vector.items()} if norm else {}

    def of_file(self, text: str, whole: bool) -> tuple[float, str] | None:
        """Best ``(score, license)`` of any line, sentence or window, and of the text as a whole if it is a licence file.

        A named licence comes before a notice about rights, then the higher score (to 12 digits), then the earlier name.
        """
        lowered = text.lower()
        if not any(gate in lowered for gate in self.gates):
            return None
        found, best = _Text(lowered), None
        for name, wording, needs, elsewhere, unless, shortest, longest in self.wordings:
            if best and (name in UNNAMED and best[1] not in UNNAMED or best[0] == 1.0):
                continue
            if not all(found.occurrences(n)[0] for n in needs) or elsewhere and not found.holds(elsewhere) or unless and found.holds(unless):
                continue
            score = max(self._best_unit(found, wording, needs, whole), self._best_window(found, wording, needs, shortest, longest))
            score = round(score, 12)
            if score >= self.least and (best is None or score > best[0]):
                best = (score, name)
        return best

    def _best_unit(self, found: _Text, wording: dict[str, float], needs: tuple, whole: bool) -> float:
        spans = {span for place in found.occurrences(needs[0])[0] for span in found.units(place)}
        if whole:
            spans.add((0, len(found.terms)))
        best = 0.0
        for start, end in spans:
            if found.least_end(needs, start) <= end:
                vector = self._weighed(Counter(found.terms[start:end]))
                best = max(best, math.fsum(w * vector.get(term, 0.0) for term, w in wording.items()))
        return best

    def _best_window(self, found: _Text, wording: dict[str, float], needs: tuple, shortest: int, longest: int) -> float:
        """Best cosine of the windows that start with a term of the wording; shorter ones only at the end of the text."""
        best = 0.0
        near = sorted({i for place in found.occurrences(needs[0])[0] for i in range(max(0, place - longest + 1), place + 1)})
        for start in near:
            if found.terms[start] not in wording or (least_end := found.least_end(needs, start)) > start + longest:
                continue
            counts: dict[str, int] = {}
            dot = square = 0.0
            for end in range(start, min(len(found.terms), start + longest)):
                term = found.terms[end]
                weight, before = self.idf.get(term, self.rarest), counts.get(term, 0)
                counts[term] = before + 1
                square += weight * weight * (2 * before + 1)
                dot += weight * wording.get(term, 0.0)
                if end + 1 >= least_end and (end - start + 1 >= shortest or end + 1 == len(found.terms)):
                    best = max(best, dot / math.sqrt(square))
            if round(best, 12) == 1.0:
                break
        return best


def is_licence_file(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0).rlike(r"(?i)^(licen[cs]e|copying|notice|unlicense)")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", key_col: str = "doc_id", templates: Mapping[str, list[Wording]] | None = None,
         least: float = LEAST) -> DataFrame:
    """One row per file: ``key, path, own_license, own_score, license, found_in``.

    Every line and sentence of the whole text, and every window about as long as a wording (``WINDOW``), across line breaks and
    comment marks, is compared with every template wording whose telling phrases it holds, a licence file (by its name) also as a whole; the
    best cosine of at least ``least`` gives the file's own licence, a named one before a notice about rights.  A file without one takes the licence of the nearest
    directory above it (its own first) that holds a licence file with one; of several there the best score, then the name,
    then the path decides.  ``found_in`` is ``text``, the directory, or null.  Null texts and paths count as empty; a file without
    directory lies in the root ``""``.  Repeated rows come out as they came in; other columns are ignored.
    """
    templates = dict(templates or TEMPLATES)

    @F.arrow_udf(_OUT)
    def matched(texts: pa.Array, whole: pa.Array) -> pa.Array:
        matcher = _matcher(templates, least)
        found = [matcher.of_file(t or "", bool(w)) for t, w in zip(texts.to_pylist(), whole.to_pylist(), strict=True)]
        return pa.array([{"license": m[1], "score": m[0]} if m else None for m in found], _ARROW)

    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    rows = files.select(
        F.col(key_col).alias("key"), path.alias("path"), is_licence_file(path).alias("names_licence"),
        matched(F.col(text_col), is_licence_file(path)).alias("m"))
    rows = stage(rows.select("key", "path", "names_licence", F.col("m.license").alias("own_license"), F.round("m.score", 9).alias("own_score")))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    best = F.min_by(F.col("own_license"), F.struct(-F.col("own_score"), F.col("own_license"), F.col("path")))
    folders = stage(rows.where("names_licence AND own_license IS NOT NULL").groupBy(folder.alias("folder")).agg(best.alias("folder_license")))
    # Distinct directories climb to the root; files, which may be many in one directory, only meet the row of their directory.
    own = rows.where("own_license IS NULL").select(folder.alias("start")).distinct()
    steps = F.filter(F.split("start", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(n.alias("depth"), F.concat_ws("/", F.slice(steps, 1, n)).alias("folder")))
    climbed = own.select("start", F.explode(above).alias("a")).select("start", "a.depth", "a.folder")
    nearest = salted_join(climbed, folders, ["folder"], ["start"]).groupBy("start").agg(
        F.max_by(F.struct("folder", "folder_license"), "depth").alias("near"))
    nearest = stage(nearest.select("start", F.col("near.folder").alias("near_folder"), F.col("near.folder_license").alias("near_license")))
    missing = salted_join(rows.where("own_license IS NULL").withColumn("start", folder), nearest, ["start"], ["key", "path"], "left")
    out = missing.select("key", "path", "own_license", "own_score", F.col("near_license").alias("license"), F.col("near_folder").alias("found_in"))
    return rows.where("own_license IS NOT NULL").select(
        "key", "path", "own_license", "own_score", F.col("own_license").alias("license"), F.lit("text").alias("found_in")).union(out)


_MATCHERS: dict = {}


def _matcher(templates: Mapping[str, list[Wording]], least: float) -> Matcher:
    key = (repr(sorted(templates.items())), least)
    if key not in _MATCHERS:
        _MATCHERS[key] = Matcher(templates, least)
    return _MATCHERS[key]
