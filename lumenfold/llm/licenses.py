"""License scan by sentence rules.

A text is cut into sentences, these are normalised (A-Z lower-cased, runs of other than letters, digits, dots and pluses
made one space, outer dots dropped) and looked up among known licence sentences. The identifiers found, in the order of
the text, are matched against licence rules: sequences of identifiers, of which the rule listed first wins where
several begin at the same place, and whose matches don't overlap. A sentence begins and ends at ends of sentences or
lines, and may run over lines, all in one scan of the text. A known sentence that itself holds ends of sentences (SPDX
lines, GPL grants) is recognised where all its parts follow each other.

The SQL is kept as given. It takes the longest part of such a sentence for the whole, and the first sentence that has
it; and it cuts a text at ends of sentences and lines or at ends of sentences only, whichever recognises more, where
the scan finds what either does. So the two differ on texts that hold such parts, or both wrapped sentences and titles.

A null text is empty and has no sentence. Rows that repeat get a row each. A null doc_id is scanned like any other.
Texts of any length are scanned whole, each within its row, so that no key can be hot. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_rows, table

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit_ref": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License (MIT)", "MIT License", "SPDX-License-Identifier: MIT"],
    "mit_grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'
    ],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as_is_software": [
        'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement'
    ],
    "apache_ref": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")', "Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache_comply": ["you may not use this file except in compliance with the License", "You may obtain a copy of the License at"],
    "apache_basis": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'
    ],
    "gpl3_ref": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2_ref": ["Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl3_grant": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2_grant": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl_hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd3_ref": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "bsd2_ref": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc_ref": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "mpl2_ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "ccby_ref": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "ccbysa_ref": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "ccbync_ref": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0_ref": ["Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
}
# Rules, in order of precedence.
RULES = [
    ("MIT", ["mit_ref", "mit_grant", "mit_notice", "as_is_software"]),
    ("MIT", ["mit_grant", "mit_notice", "as_is_software"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_ref"]),
    ("Apache-2.0", ["apache_ref", "apache_comply", "apache_comply", "apache_basis"]),
    ("Apache-2.0", ["apache_ref", "apache_comply"]),
    ("Apache-2.0", ["apache_ref"]),
    ("GPL-3.0", ["gpl3_grant", "gpl_hope", "gpl_hope"]),
    ("GPL-3.0", ["gpl3_grant"]),
    ("GPL-3.0", ["gpl3_ref"]),
    ("GPL-2.0", ["gpl2_grant", "gpl_hope", "gpl_hope"]),
    ("GPL-2.0", ["gpl2_grant"]),
    ("GPL-2.0", ["gpl2_ref"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-3-Clause", ["bsd3_ref"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("BSD-2-Clause", ["bsd2_ref"]),
    ("ISC", ["isc_grant"]),
    ("ISC", ["isc_ref"]),
    ("MPL-2.0", ["mpl2_ref"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-4.0", ["ccby_ref"]),
    ("CC-BY-SA-4.0", ["ccbysa_ref"]),
    ("CC-BY-NC-4.0", ["ccbync_ref"]),
    ("CC0-1.0", ["cc0_ref"]),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
JUNK, EDGE = r"[^a-z0-9.+]+", r"^[ .]+|[ .]+$"
#: Ends of sentences; the first, which only the SQL uses, also ends one at a line's end.
CUTS = r"[.!?;:]+[ \t\r\n]+|[\r\n]+", r"[.!?;:]+[ \t\r\n]+"
#: Only texts that hold one of these are looked at further: every known sentence has one.
HINT = r"(?i)licen|permission|notice|warrant|redistribut|software|law|hope"


def _normal(text: str) -> str:
    return re.sub(EDGE, "", re.sub(JUNK, " ", text.translate(str.maketrans(UPPER, LOWER))))


def _parts(sentence: str) -> list[str]:
    return [p for p in map(_normal, re.split(CUTS[1], sentence)) if p]


def sentences() -> dict[str, str]:
    """Identifier by sentence, all parts of it, normalised and joined by a space."""
    return {" ".join(_parts(s)): ident for ident, known in SENTENCES.items() for s in known}


def sentence_pattern() -> str:
    """All sentences as one pattern over a marked text, longer ones first."""
    found = {" ".join(p): "[ EL]".join(map(re.escape, p)).replace("\\ ", "[ L]") for known in SENTENCES.values() for p in map(_parts, known)}
    return "(?<=[EL])(?:" + "|".join(found[s] for s in sorted(found, key=len, reverse=True)) + ")(?=[EL])"


def known() -> dict[str, str]:
    """What the SQL looks up: identifier by the longest part of a sentence."""
    out: dict[str, str] = {}
    for ident, sentences in SENTENCES.items():
        for s in sentences:
            out.setdefault(max(_parts(s), key=len), ident)
    return out


def rule_pattern() -> str:
    """All rules as one pattern over ';id;id;...;': alternatives are tried in order."""
    return "|".join("".join(f";{i}" for i in ids) + "(?=;)" for _, ids in RULES)


def _marked(text: Column) -> Column:
    """The normalised text with an E for each end of a sentence and at either end, and an L for each other end of a line."""
    text = F.regexp_replace(F.regexp_replace(F.translate(text, UPPER, LOWER), CUTS[1], "E"), r"[\r\n]+", "L")
    text = F.regexp_replace(F.concat(F.lit("E"), text, F.lit("E")), "[^a-z0-9.+EL]+", " ")
    return F.regexp_replace(F.regexp_replace(text, "(?<![ .L])[ .L]*+E[ .LE]*+", "E"), "(?<![ .])[ .]*+L[ .L]*+", "L")


def _identified(text: Column) -> Column:
    ids = F.create_map(*(F.lit(x) for pair in sentences().items() for x in pair))
    return F.transform(F.regexp_extract_all(_marked(text), F.lit(sentence_pattern()), F.lit(0)), lambda s: F.try_element_at(ids, F.translate(s, "EL", "  ")))


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), n_matches, licenses (sorted, distinct, joined by a comma), rules (matched identifiers, in order)."""
    rows = doc_rows(docs)
    text = F.col("text")
    ids = F.when(text.rlike(HINT), _identified(text)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", ids.alias("ids")).withColumn("line", F.concat(F.lit(";"), F.array_join("ids", ";"), F.lit(";")))
    rows = rows.withColumn("found", F.regexp_extract_all("line", F.lit(rule_pattern()), F.lit(0)))
    names = F.create_map(*(F.lit(x) for pair in {"".join(f";{i}" for i in ids): name for name, ids in RULES}.items() for x in pair))
    licenses = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda r: F.try_element_at(names, r)))), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.size("found").cast("long").alias("n_matches"), licenses.alias("licenses"), F.array_join("found", "").alias("rules"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The scan in DuckDB. Its pattern language has no look-ahead: each identifier is closed by a ';' of its own there."""
    ids = "MAP {" + ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in known().items()) + "}"
    names = "MAP {" + ", ".join(f"{_quoted(''.join(f';{i}' for i in x))}: {_quoted(n)}" for n, x in RULES) + "}"
    found = lambda cut: f"list_filter(list_transform(string_split_regex(text, {_quoted(cut)}), lambda s: ids[regexp_replace(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '{JUNK}', ' ', 'g'), '{EDGE}', '', 'g')]), lambda i: i IS NOT NULL)"
    closed = "|".join("".join(f"<{i}>" for i in x) for _, x in RULES)
    return f"""
WITH m AS (SELECT {ids} AS ids, {names} AS names),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, CAST([] AS VARCHAR[]) AS none, {found(CUTS[0])} AS a, {found(CUTS[1])} AS b, names FROM d, m),
i AS (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS ids, names FROM b),
f AS (SELECT doc_id, ids, names, list_transform(regexp_extract_all(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '{closed}'), lambda r: replace(replace(r, '<', ';'), '>', '')) AS found FROM i)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, CAST(len(found) AS BIGINT) AS n_matches,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda r: names[r]))), ','), '') AS licenses, coalesce(array_to_string(found, ''), '') AS rules FROM f
"""
