"""Licence recognition by sentence rules (operator 1). Native SQL only.

Method: German, Manabe and Inoue, "A sentence-matching method for automatic license identification" (2010). Texts are
cut into sentences, sentences normalised, and known ones mapped to identifiers. Rules, sequences of identifiers, are
then applied in order to each text's identifier sequence; a rule that matches consumes its identifiers, so longer and
more specific rules come first. Identifiers that no rule consumes are reported as such, and so is the number of
sentences that speak of licences without being known.

A sentence goes on over line breaks: comment marks at the start of a line are dropped, and only an empty line or a
mark of its end with a blank behind it cuts. A known sentence is found wherever it stands in one, on word boundaries,
longer ones first ("this file is licensed under the mit license").

Everything is a row's own expression: no shuffle, no Python, whatever the text's length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (identifier, sentence as normalise() leaves it)
SENTENCES: tuple[tuple[str, str], ...] = (
    ("ApacheLic2", "licensed under the apache license version 2.0"),
    ("ApacheLic2", "licensed under the apache license version 2.0 the license"),
    ("ApacheMayNot", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MITRef", "released under the mit license"),
    ("MITRef", "licensed under the mit license"),
    ("MITRef", "this software is released under the mit license"),
    ("MITTitle", "the mit license"),
    ("MITTitle", "mit license"),
    ("MITRef", "under the terms of the mit license"),
    ("MITRef", "distributed under the mit license"),
    ("ApacheLic2", "released under the apache license version 2.0"),
    ("GPL3Ref", "under the terms of the gnu general public license version 3"),
    ("BSDNoWarranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("MITPerm", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MITNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MITAsIs", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("GPL3Work", "this work is licensed under the gnu general public license version 3"),
    ("GPL3Ref", "licensed under the gnu general public license version 3"),
    ("GPLv3Short", "licensed under the gpl v3"),
    ("GPL2Ref", "licensed under the gnu general public license version 2"),
    ("GPLFree", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL2Free", "this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPLNoWarranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPLSee", "see the gnu general public license for more details"),
    ("LGPLRef", "licensed under the gnu lesser general public license version 3"),
    ("AGPLRef", "licensed under the gnu affero general public license version 3"),
    ("MPL2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("MPL2Ref", "licensed under the mozilla public license version 2.0"),
    ("BSDPerm", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDRef3", "licensed under the bsd 3-clause license"),
    ("BSDRef2", "licensed under the bsd 2-clause license"),
    ("CCBYNC4", "licensed under cc by-nc 4.0"),
    ("CCBYSA4", "licensed under cc by-sa 4.0"),
    ("CCBY4", "licensed under cc by 4.0"),
    ("CCBY4", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC0", "licensed under cc0 1.0"),
    ("AllRights", "all rights reserved"),
    ("SpdxMIT", "spdx-license-identifier mit"),
    ("SpdxApache2", "spdx-license-identifier apache-2.0"),
    ("SpdxGPL3", "spdx-license-identifier gpl-3.0-only"),
)
#: (licence, identifiers), in the order of application.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("ApacheLic2", "ApacheMayNot", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("MIT", ("MITTitle", "Copyright", "MITPerm", "MITNotice", "MITAsIs")),
    ("MIT", ("MITPerm", "MITNotice", "MITAsIs")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLNoWarranty", "GPLSee")),
    ("GPL-2.0-or-later", ("GPL2Free", "GPLNoWarranty", "GPLSee")),
    ("GPL-3.0-or-later", ("GPLFree",)),
    ("GPL-2.0-or-later", ("GPL2Free",)),
    ("Apache-2.0", ("ApacheLic2", "ApacheMayNot")),
    ("Apache-2.0", ("ApacheLic2",)),
    ("Apache-2.0", ("SpdxApache2",)),
    ("MIT", ("MITRef",)),
    ("MIT", ("MITPerm",)),
    ("MIT", ("MITTitle",)),
    ("MIT", ("SpdxMIT",)),
    ("AGPL-3.0-only", ("AGPLRef",)),
    ("LGPL-3.0-only", ("LGPLRef",)),
    ("GPL-3.0-only", ("GPL3Work",)),
    ("GPL-3.0-only", ("GPL3Ref",)),
    ("GPL-3.0-only", ("GPLv3Short",)),
    ("GPL-3.0-only", ("SpdxGPL3",)),
    ("GPL-2.0-only", ("GPL2Ref",)),
    ("MPL-2.0", ("MPL2",)),
    ("MPL-2.0", ("MPL2Ref",)),
    ("BSD-3-Clause", ("BSDRef3",)),
    ("BSD-2-Clause", ("BSDRef2",)),
    ("BSD", ("BSDPerm", "BSDNoWarranty")),
    ("BSD", ("BSDPerm",)),
    ("CC-BY-NC-4.0", ("CCBYNC4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)),
    ("CC-BY-4.0", ("CCBY4",)),
    ("CC0-1.0", ("CC0",)),
    ("Proprietary", ("Copyright", "AllRights")),
    ("Proprietary", ("AllRights",)),
)
#: Every known sentence has one of these; other sentences aren't normalised. Those with one of ``SPEAKING`` are about a
#: licence even if they aren't known.
MARKS = ("licen", "copyright", "permission", "warrant", "redistribut", "rights reserved", "distributed", "compliance", "gpl", "provided as is", 'provided "as is')
SPEAKING = ("licen", "copyright", "rights reserved", "warrant")
#: (pattern, replacement) over a whole text: comment marks at the start of a line, and the dot of "v. 2".
LINES = ((r"\r\n?", "\n"), (r"\n[ \t]*([#*;%>]+|//+|--+)?[ \t]*", "\n"), (r"\bv\. ?([0-9])", "v {1}"))
CUT = r"\n\n+|[.!?]+[ \t\n]+"
INNER = r"[^a-z0-9.+/-]+"
EDGE = r"^[^a-z0-9]+|[^a-z0-9+]+$"
#: Copyright lines: at the start of a sentence, or with a year. Applied to what known sentences have left.
HOLDER = r"^ copyright( c)? | copyright( c)? (?:[0-9]{4})"
#: Longer sentences first, so that none hides in another.
BY_LENGTH = sorted(SENTENCES, key=lambda x: (-len(x[1]), x))


def _marked(s: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(s, F.lit(m)) for m in marks))


def _sentences(text: Column) -> Column:
    """The sentences with a mark, normalised and with a blank at each end, known ones as ``{identifier}``."""
    low = F.lower(text)
    joined = reduce(lambda t, line: F.regexp_replace(t, line[0], line[1].replace("{1}", "$1")), LINES, low)

    def clean(s: Column) -> Column:
        s = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(s, INNER, " "), EDGE, ""), F.lit(" "))
        for name, sentence in BY_LENGTH:
            s = F.replace(s, F.lit(f" {sentence} "), F.lit(f" {{{name}}} "))
        return F.regexp_replace(s, HOLDER, " {Copyright} ")

    marked = F.filter(F.split(joined, CUT), lambda s: _marked(s, MARKS))
    return F.when(F.coalesce(_marked(low, MARKS), F.lit(False)), F.transform(marked, clean)).otherwise(F.expr("cast(array() as array<string>)"))


def apply_rules(ids: Column) -> Column:
    """The sequence as text, ``{id}`` for what is left and ``<licence>`` for each rule's match."""
    text = F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("{"), x, F.lit("}"))))
    for name, sequence in RULES:
        text = F.replace(text, F.lit("".join(f"{{{i}}}" for i in sequence)), F.lit(f"<{name}>"))
    return text


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_sentences (known ones), n_unknown (sentences that speak of licences but hold no
    known one), sentence_ids, licenses (distinct, sorted), unmatched.

    The last three are comma-separated strings, empty where there is nothing; null and empty texts have none. Rows are
    judged alone, so repeated rows and ids give repeated results. An empty table gives an empty result. Other columns
    are neither read nor returned.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), _sentences(docs[text_col]).alias("found"))
    every = F.flatten(F.transform("found", lambda s: F.regexp_extract_all(s, F.lit(r"\{([^}]*)\}"), 1)))
    unknown = F.filter("found", lambda s: ~F.contains(s, F.lit("{")) & _marked(s, SPEAKING))
    rows = rows.select("doc_id", F.size(unknown).cast("long").alias("n_unknown"), every.alias("ids")).withColumn("parsed", apply_rules(F.col("ids")))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        "n_unknown",
        F.concat_ws(",", "ids").alias("sentence_ids"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.regexp_extract_all("parsed", F.lit("<([^>]*)>"), 1)))).alias("licenses"),
        F.concat_ws(",", F.regexp_extract_all("parsed", F.lit(r"\{([^}]*)\}"), 1)).alias("unmatched"),
    )


def oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parsed = "coalesce(list_aggregate(list_transform(ids, lambda x: '{' || x || '}'), 'string_agg', ''), '')"
    for name, sequence in RULES:
        parsed = f"replace({parsed}, {quote(''.join(f'{{{i}}}' for i in sequence))}, {quote(f'<{name}>')})"
    marks = lambda own: " OR ".join(f"contains(s, {quote(m)})" for m in own)
    joined = "lower(text)"
    for pattern, to in LINES:
        joined = f"regexp_replace({joined}, {quote(pattern)}, {quote(to.replace('{1}', chr(92) + '1'))}, 'g')"
    clean = f"' ' || regexp_replace(regexp_replace(s, {quote(INNER)}, ' ', 'g'), {quote(EDGE)}, '', 'g') || ' '"
    for name, sentence in BY_LENGTH:
        clean = f"replace({clean}, {quote(f' {sentence} ')}, {quote(f' {{{name}}} ')})"
    clean = f"regexp_replace({clean}, {quote(HOLDER)}, ' {{Copyright}} ', 'g')"
    return f"""
WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array({joined}, {quote(CUT)}), lambda s: {marks(MARKS)}) AS parts FROM documents),
f AS (SELECT doc_id, coalesce(list_transform(parts, lambda s: {clean}), []) AS found FROM p),
i AS (SELECT doc_id, len(list_filter(found, lambda s: NOT contains(s, '{{') AND ({marks(SPEAKING)}))) AS unknown, flatten(list_transform(found, lambda s: regexp_extract_all(s, '\\{{([^}}]*)\\}}', 1))) AS ids FROM f),
r AS (SELECT doc_id, unknown, ids, {parsed} AS parsed FROM i)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, CAST(unknown AS BIGINT) AS n_unknown, coalesce(list_aggregate(ids, 'string_agg', ','), '') AS sentence_ids,
  coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(parsed, '<([^>]*)>', 1))), 'string_agg', ','), '') AS licenses,
  coalesce(list_aggregate(regexp_extract_all(parsed, '\\{{([^}}]*)\\}}', 1), 'string_agg', ','), '') AS unmatched
FROM r"""
