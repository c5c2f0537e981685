"""Licence recognition by sentences: known sentences become identifiers, sequences of identifiers match ordered rules.

A text is cut into sentences (at line ends and behind sentence marks; hard-wrapped lines are joined first), each sentence
is normalised to lower-case words, and known ones are replaced by their identifier. A rule is an ordered list of
identifiers; it matches where they follow one another among the known sentences of a text. All of it is an expression
over one row: no shuffle, no join, no Python.

Defined results: null and empty texts have no sentences and no licence; every input row gives one output row; texts of
any length are read whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence sentences, as their texts and usual notices have them.
SENTENCES = {
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-2.0-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-licensed-you": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-2.0-use": "you may not use this file except in compliance with the License",
    "apache-2.0-copy": "You may obtain a copy of the License at http",
    "apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-2.0-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl-3.0-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-only": "Licensed under the GNU General Public License, version 3",
    "gpl-2.0-only": "Licensed under the GNU General Public License, version 2",
    "lgpl-3.0-only": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl-3.0-only": "Licensed under the GNU Affero General Public License, version 3",
    "gpl-3.0-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "bsd-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2.0-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "cc0-1.0": "Licensed under CC0 1.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

# Fixed values: (licence, kind, identifiers in order).
RULES = (
    ("MIT", "notice", ("mit-released",)),
    ("MIT", "notice", ("mit-licensed",)),
    ("MIT", "text", ("mit-grant", "mit-notice", "mit-warranty")),
    ("Apache-2.0", "notice", ("apache-2.0-licensed",)),
    ("Apache-2.0", "header", ("apache-2.0-licensed-you", "apache-2.0-use")),
    ("Apache-2.0", "header", ("apache-2.0-warranty", "apache-2.0-see")),
    ("GPL-3.0", "notice", ("gpl-3.0-work",)),
    ("GPL-3.0", "notice", ("gpl-3.0-only",)),
    ("GPL-2.0", "notice", ("gpl-2.0-only",)),
    ("LGPL-3.0", "notice", ("lgpl-3.0-only",)),
    ("AGPL-3.0", "notice", ("agpl-3.0-only",)),
    ("GPL-3.0-or-later", "header", ("gpl-3.0-redistribute", "gpl-hope")),
    ("BSD-3-Clause", "text", ("bsd-head", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause-or-more", "text", ("bsd-head", "bsd-source", "bsd-binary")),
    ("ISC", "text", ("isc-grant",)),
    ("MPL-2.0", "notice", ("mpl-2.0-subject",)),
    ("Unlicense", "text", ("unlicense-free",)),
    ("CC0-1.0", "notice", ("cc0-1.0",)),
    ("CC-BY-4.0", "notice", ("cc-by-4.0",)),
    ("CC-BY-4.0", "notice", ("cc-by-4.0-work",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa-4.0",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc-4.0",)),
    ("CC-BY-ND-4.0", "notice", ("cc-by-nd-4.0",)),
    ("CC-BY-NC-SA-4.0", "notice", ("cc-by-nc-sa-4.0",)),
)

#: Line ends inside a hard-wrapped sentence, and sentence ends; written so that Java and RE2 read them alike.
WRAP_LOWER = r"([a-z,])[ \t\r]*\n[ \t]*([a-z])"
WRAP_UPPER = r"([A-Z],?)[ \t\r]*\n[ \t]*([A-Z][A-Z])"
ENDS = r"[.!?;:]+[ \t\r\n]|\n"


def normal(sentence: str) -> str:
    """A sentence as the lookup knows it: lower-case letters and digits, single spaces."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def sentence_list(text: Column) -> Column:
    """The normalised, non-empty sentences of a text, in order."""
    joined = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WRAP_LOWER, "$1 $2"), WRAP_UPPER, "$1 $2")
    marked = F.regexp_replace(F.lower(F.regexp_replace(joined, ENDS, "\u0001")), "[^a-z0-9\u0001]+", " ")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def identifiers(sentences: Column, known: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences, in order."""
    by_text = {normal(s): name for name, s in known.items()}
    table = F.create_map(*[F.lit(x) for pair in by_text.items() for x in pair])
    return F.transform(F.filter(sentences, lambda s: s.isin(*by_text)), lambda s: F.element_at(table, s))


def matched(ids: Column, rules: tuple = RULES) -> Column:
    """Licences whose rules match, each once, sorted."""
    chain = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    hits = [F.when(chain.contains(f",{','.join(r[2])},"), F.lit(r[0])) for r in rules]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """Per document the number of sentences, the identifiers met, and the licences recognised."""
    cut = docs.select(F.col(key), sentence_list(F.col(text).cast("string")).alias("sentences"))
    seen = cut.select(key, F.size("sentences").cast("long").alias("n_sentences"), identifiers(F.col("sentences"), known).alias("sentence_ids"))
    return seen.select("*", matched(F.col("sentence_ids"), rules).alias("licences"))


def scan_sql(known: dict[str, str] = SENTENCES, rules: tuple = RULES) -> str:
    """The DuckDB form of ``flat(scan(documents))``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    by_text = {normal(s): name for name, s in known.items()}
    table = "MAP {" + ", ".join(f"{quote(s)}: {quote(n)}" for s, n in by_text.items()) + "}"
    hits = ", ".join(f"CASE WHEN contains(chain, ',{','.join(r[2])},') THEN {quote(r[0])} END" for r in rules)
    return f"""
WITH joined AS (
    SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{WRAP_LOWER}', '\\1 \\2', 'g'), '{WRAP_UPPER}', '\\1 \\2', 'g') AS t
    FROM documents),
cut AS (
    SELECT doc_id, list_filter(list_transform(
        string_split(regexp_replace(lower(regexp_replace(t, '{ENDS}', chr(1), 'g')), '[^a-z0-9\\x01]+', ' ', 'g'), chr(1)),
        lambda s: trim(s)), lambda s: s <> '') AS s
    FROM joined),
seen AS (
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences,
           array_to_string(list_filter(list_transform(s, lambda x: ({table})[x]), lambda x: x IS NOT NULL), ',') AS sentence_ids
    FROM cut),
chained AS (SELECT *, ',' || sentence_ids || ',' AS chain FROM seen)
SELECT doc_id, n_sentences, sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))), ','), '') AS licences
FROM chained"""


def flat(found: DataFrame) -> DataFrame:
    """Lists as comma-joined text."""
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))
