"""License scans by template-markup matching.

A template is the wording of a license notice with marked regions: `[[words]]` is optional, `{{a-b}}` is
replaceable by a to b words of any kind. Each is compiled into an automaton over tokens, written as a regular
expression over the text's words separated by single spaces; a text is accepted if it holds a stretch whose mandatory
words stand exactly as they are in the template. Three fixed phrases are located besides, and their labels stay
whatever the templates say.

Words are counted in every text in one pass; the words themselves are listed only for texts that mention a
license at all. There is no shuffle.

Edge cases: a null or empty text has no words, no labels and score 0; only A-Z are lower-cased; very long texts
are taken whole; repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Label and wording of the templates, notices first, then whole texts; fixed values.
TEMPLATES = (
    ("mit-notice", "[[released]] [[licensed]] under the [[terms of the]] mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction"),
    ("apache-notice", "licensed under the apache license version {{1-2}}"),
    ("gpl-notice", "licensed under the [[gnu]] [[lesser]] [[affero]] general public license [[as published by {{1-6}}]] version {{1-1}} [[or any later version]]"),
    ("gpl-text", "you can redistribute it and or modify it under the terms of the [[gnu]] [[lesser]] [[affero]] general public license"),
    ("cc-by-nc", "licensed under [[a]] [[the]] cc by nc {{0-2}}"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-notice", "subject to the terms of the mozilla public license {{0-1}} 2 0"),
    ("rights-reserved", "[[copyright {{0-8}}]] all rights reserved"),
    (
        "mit-whole",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute [[distribute with modifications]] sublicense and or sell copies of the software"
        " and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall [[the]] {{1-8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc-whole",
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and {{1-6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall {{1-6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
        " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd-whole",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
        " [[3]] [[neither the name of {{1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]]"
        " this software is provided by {{1-8}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
        " in no event shall {{1-10}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"
        " loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise"
        " arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "apache-header",
        "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at {{1-12}}"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-header",
        "{{1-4}} is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation"
        " either version {{1-2}} of the license or [[at your option]] any later version"
        " {{1-4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
        " see the gnu [[lesser]] [[affero]] general public license for more details",
    ),
    (
        "zlib-whole",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
        " [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software"
        " if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"
        " [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software"
        " [[3]] this notice may not be removed or altered from any source distribution",
    ),
)
#: A word of the contract, upper case still in the text.
TOKEN = rf"[^{common.NOT_WORD}]+"
#: What every phrase and template has at least one of; texts without any are not looked at further.
MENTION = r"(?i)license|permission|redistribution|redistribute|reserved"


def compile_template(wording: str) -> tuple[str, int]:
    """The automaton of a template over " w1 w2 ... ", and the number of its mandatory words."""

    def words(part: str) -> str:
        out = ""
        for w in part.split():
            m = re.fullmatch(r"\{\{(\d+)-(\d+)\}\}", w)
            out += f"(?: [^ ]+){{{m[1]},{m[2]}}}" if m else f" {re.escape(w)}"
        return out

    pattern, mandatory = "", 0
    for part in re.split(r"(\[\[.*?\]\])", wording):
        if part.startswith("[["):
            pattern += f"(?:{words(part[2:-2])})?"
        else:
            pattern += words(part)
            mandatory += sum(not w.startswith("{{") for w in part.split())
    return pattern + "(?: |$)", mandatory


AUTOMATA = tuple((label, *compile_template(wording)) for label, wording in TEMPLATES)


def places(words: Column, phrase: str) -> Column:
    """Indexes at which the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        fits = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            fits = fits & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return fits

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 0 without a label, one half for a phrase alone, m / (m + 1) for the accepted template with the most
    mandatory words m.
    """
    text = common.whole("text")
    docs = docs.select("doc_id", text.alias("text"), F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("n_words"))
    words = F.transform(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), common.ascii_lower)
    docs = docs.select("doc_id", "n_words", F.when(F.col("text").rlike(MENTION), words).otherwise(F.array().cast("array<string>")).alias("words"))
    stream = F.concat(F.lit(" "), F.array_join("words", " "))
    docs = docs.select("doc_id", "n_words", *(places(F.col("words"), p).alias(f"at_{k}") for k, p in PHRASES.items()), F.when(F.size("words") > 0, stream).otherwise("").alias("stream"))
    base = F.array_compact(F.array(*(F.when(F.size(f"at_{k}") > 0, k) for k in PHRASES)))
    accepted = F.filter(F.array(*(F.struct(F.when(F.col("stream").rlike(p), label).alias("label"), F.lit(m).alias("m")) for label, p, m in AUTOMATA)), lambda x: x["label"].isNotNull())
    docs = docs.select("doc_id", "n_words", F.flatten(F.array(*(F.col(f"at_{k}") for k in PHRASES))).alias("starts"), base.alias("base"), F.when(F.col("stream") != "", accepted).otherwise(F.array().cast("array<struct<label:string,m:int>>")).alias("accepted"))
    most = F.array_max(F.transform("accepted", lambda x: x["m"])).cast("double")
    score = F.coalesce(most / (most + 1), F.when(F.size("base") > 0, 0.5), F.lit(0.0))
    labels = F.concat("base", F.transform("accepted", lambda x: x["label"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return docs.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"), joined("base").alias("base_labels"), joined(labels).alias("labels"), score.alias("score")
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    spots = " UNION ALL ".join(
        f"SELECT row, '{k}' AS label, i FROM (SELECT row, words, unnest(range(0, len(words))) AS i FROM w WHERE list_contains(words, '{p.split()[0]}')) WHERE " + " AND ".join(f"words[i + {j + 1}] = '{x}'" for j, x in enumerate(p.split())) for k, p in PHRASES.items()
    )
    runs = " UNION ALL ".join(f"SELECT row, '{label}' AS label, {m} AS m FROM w WHERE regexp_matches(' ' || array_to_string(words, ' '), '{p}')" for label, p, m in AUTOMATA)
    return rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{TOKEN}') AS words FROM documents),
s AS ({spots}),
r AS ({runs}),
b AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM s GROUP BY row),
a AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM s UNION ALL SELECT row, label FROM r) GROUP BY row),
m AS (SELECT row, CAST(max(m) AS DOUBLE) AS m FROM r GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(m / (m + 1), CASE WHEN n_base > 0 THEN 0.5 END, 0.0) AS score
FROM w LEFT JOIN b USING (row) LEFT JOIN a USING (row) LEFT JOIN m USING (row)"""
