"""Licences in texts, by their sentences (operator 2).

Only DataFrame functions run here. A text is split into sentences, each is normalised to its
lower-case words and searched for known licence sentences; the identifiers found, in their
order, are then matched against rules, each an ordered run of identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: known licence sentences, normalised, with their identifiers
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache-ref",
    "licensed under the apache license version 2 0 the license": "apache-ref",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms",
    "either version 2 of the license or at your option any later version": "gpl2-later",
    "either version 3 of the license or at your option any later version": "gpl3-later",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "licensed under cc by 4 0": "cc-by-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-ref",
}

# fixed values: rules, tried in this order; what a rule matches is used up
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("Apache-2.0", ["apache-ref", "apache-comply", "apache-copy", "apache-asis", "apache-see"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "gpl3-later"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-ref"]),
    ("Apache-2.0", ["apache-ref"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("MPL-2.0", ["mpl2-ref"]),
]

#: Every known sentence has one of these; a text without any is not split.
CUES = ["licens", "permission", "copyright", "warrant", "liable", "redistribut", "free software"]
SENTENCE_END = r"[.!?;:]+[ \t\r\n]+"
#: A unit of the scan ends there or at a blank line, but not in "v. 2.0".
UNIT_END = r"(?<![ \t\n][vV])[.!?;:]+[ \t\r\n]+|\n[ \t\r]*\n\s*"
NOT_WORD = r"[^\p{L}\p{N}]+"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), NOT_WORD, " "))


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in their order.

    A known sentence is found as a run of whole words inside a unit, so words before or after
    it, such as a title or a line without full stop, and line breaks within it do not hide it.
    Of known sentences that start together the longest counts; a unit that repeats one counts
    it once.
    """
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    run = "(?<![^ ])(?:" + "|".join(sorted(sentences, key=len, reverse=True)) + ")(?![^ ])"

    def of(unit: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(normalised(unit), F.lit(run), F.lit(0)))

    found = F.flatten(F.transform(F.split(text, UNIT_END, -1), of))
    cues = F.lower(text).rlike("|".join(CUES))
    return F.when(cues, F.transform(found, lambda s: F.element_at(known, s))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """Licences of documents (operator 2), one row per row of ``docs`` with a known sentence.

    ``doc_id, n_sentences, sentence_ids, licences, n_unmatched``: the identifiers in order,
    the licences of the rules that match (each once, by name), and how many identifiers no
    rule used. A null or empty text has none; a null ``doc_id`` is scanned like any other;
    repeated rows give a row each; no documents, no rows. Other columns are not read.
    """
    found = docs.select("doc_id", sentence_ids(F.coalesce(F.col("text"), F.lit("")), sentences).alias("ids")).filter(F.size("ids") > 0)
    # every identifier stands as "<id>", so that a run of them is one string
    rows = found.select("doc_id", "ids", F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("rest0"))
    hits = []
    for k, (name, run) in enumerate(rules):
        wanted = "".join(f"<{i}>" for i in run)
        hits.append(F.when(F.contains(F.col(f"rest{k}"), F.lit(wanted)), F.lit(name)))
        rows = rows.withColumn(f"rest{k + 1}", F.replace(F.col(f"rest{k}"), F.lit(wanted), F.lit("|")))
    left = F.col(f"rest{len(rules)}")
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(names, ",").alias("licences"),
        (F.length(left) - F.length(F.replace(left, F.lit("<"), F.lit("")))).cast("bigint").alias("n_unmatched"),
    )
