"""Licence scans: known licence sentences are recognised, then their order is matched against rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_HOPE = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"


def _statements(*names: str) -> list[str]:
    return [f"{start}{name}" for name in names for start in ("licensed under ", "this work is licensed under ", "this project is licensed under ", "this file is licensed under ", "released under ")]


def _notices(license_name: str, version: str) -> list[str]:
    """The sentence that begins a GNU notice, with and without later versions."""
    grant = _GNU.format(license_name)
    return [f"this {what} is free software {grant} {end}" for what in ("program", "library", "file") for end in (_LATER.format(version), f"version {version} of the license", f"either version {version} of the license")]


#: Sentences of licences and notices, normalised (lower case, words only), by identifier.
#: An identifier is one letter, so that a text's sequence of them is a word that rules match.
SENTENCES = {
    "A": [*_statements("the apache license version 2 0"), "licensed under the apache license version 2 0 the license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "B": ["you may not use this file except in compliance with the license"],
    "C": ["you may obtain a copy of the license at"],
    "D": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "E": _statements("the mit license"),
    "F": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "G": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "H": _statements("the gnu general public license version 3"),
    "I": _notices("general public license", "3"),
    "J": [f"this {what} {_HOPE}" for what in ("program", "library", "file")],
    "K": _statements("cc by nc 4 0"),
    "L": _statements("cc by 4 0"),
    "M": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "N": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "O": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "P": ["all rights reserved"],
    "Q": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "R": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "S": [f"permission to use copy modify and {o}distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for o in ("or ", "")],
    "T": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "U": [f"see the gnu {kind}general public license for more details" for kind in ("", "lesser ", "affero ")],
    "V": _notices("lesser general public license", "2 1"),
    "W": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "X": ["this source code form is subject to the terms of the mozilla public license v"],
    "Y": [f"if a copy of the mpl was not distributed with this file you can obtain one at {scheme} mozilla org mpl 2 0" for scheme in ("http", "https")],
    "Z": _notices("lesser general public license", "3"),
    "a": _notices("affero general public license", "3"),
    "b": _notices("general public license", "2"),
    "c": _statements("the gnu general public license version 2"),
    "d": _statements("the gnu lesser general public license version 3"),
    "e": _statements("the gnu affero general public license version 3"),
    "f": _statements("the mozilla public license version 2 0", "the mozilla public license 2 0"),
    "g": _statements("the bsd 3 clause license"),
    "h": _statements("the bsd 2 clause license"),
    "i": _statements("the isc license"),
    "j": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
}
#: Rules in order: a licence, and the sequence of sentences that grants it; .* skips others.
RULES = [
    ("apache-2.0", "A|B.*C.*D"),
    ("mit", "E|F"),
    ("isc", "S.*T|i"),
    ("gpl-3.0", "H|I"),
    ("gpl-2.0", "b|c"),
    ("lgpl-3.0", "Z|d"),
    ("lgpl-2.1", "V"),
    ("agpl-3.0", "a|e"),
    ("mpl-2.0", "X.*Y|f"),
    ("cc-by-nc-4.0", "K"),
    ("cc-by-4.0", "L"),
    ("bsd-3-clause", "M.*N.*O.*W|g"),
    ("bsd-2-clause", "M.*N.*O[^W]*$|h"),
    ("proprietary", "^P+$"),
]
#: Every known sentence has one of these, so that texts without any need no further look.
HINTS = "licen|permission|distribut|warrant|reserved|released|liable"
#: A number or letter that begins an item of a list, and what ends a sentence: a stop before a blank. The stop of "2.0" is none.
ITEM, STOP = r"^[^a-z0-9]*(?:[0-9]{1,2}[.)]|[a-z][)])[\x20\t]+", r"[.!?]+(?:[\x20\x09-\x0D]|$)"
#: The holder's name in the third clause.
HOLDER = "neither the name of .{1,100} nor the names"
NOT_WORD = r"[^a-z0-9]+"
_END = "\x01"


def _known() -> list[str]:
    return [s for own in SENTENCES.values() for s in own]


def _start() -> str:
    """A line that begins as a known sentence does."""
    starts = dict.fromkeys("[^a-z0-9]+".join(s.split()[:4]) for s in _known())
    return f"^[^a-z0-9]*(?:{'|'.join(starts)})"


def normal(part: Column) -> Column:
    """The words of a sentence in lower case, joined by blanks. Marks of comments are no words."""
    words = F.trim(F.regexp_replace(part, NOT_WORD, " "))
    return F.regexp_replace(words, HOLDER, "neither the name of the copyright holder nor the names")


def sentences(text: Column) -> Column:
    """The normalised sentences of a text. Wrapped lines are joined first.

    A sentence ends at a stop, at an empty line (one without words, such as a bare mark of
    a comment), before an item of a list or a line that begins as a known sentence does, behind a colon at the
    end of a line, and behind a line that is a known sentence by itself.
    """
    lines = F.split(F.regexp_replace(F.lower(text), _END, " "), "\r\n|\r|\n", -1)

    def marked(line: Column) -> Column:
        item = F.regexp_replace(line, ITEM, _END)
        ended = F.when(F.rtrim(item).endswith(":"), F.concat(item, F.lit(_END))).otherwise(item)
        begun = F.when(line.rlike(_start()), F.concat(F.lit(_END), ended)).otherwise(ended)
        return F.when(~line.rlike("[a-z0-9]"), F.lit(_END)).when(normal(line).isin(_known()), F.concat(F.lit(_END), line, F.lit(_END))).otherwise(begun)

    joined = F.regexp_replace(F.array_join(F.transform(lines, marked), " "), STOP, _END)
    return F.transform(F.split(joined, _END, -1), normal)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, license_marks (identifiers of known sentences, in order) and licenses (comma-joined).

    Sentences are looked up in the row against the fixed table, so nothing is shuffled
    and a document's sentences never leave it. A licence is found where the sequence of
    identifiers satisfies its rule. A null or empty text has no marks; both strings are
    then empty. Repeated rows are scanned alike, very long texts whole; other columns, whatever their names, are
    left out. An empty table gives no rows.
    """
    mark_of = F.create_map(*(F.lit(x) for mark, own in SENTENCES.items() for s in own for x in (s, mark)))
    matched = F.filter(sentences(F.col("text")), lambda x: x.isin(_known()))
    marks = F.when(F.lower("text").rlike(HINTS), F.array_join(F.transform(matched, lambda x: F.element_at(mark_of, x)), ""))
    found = F.array_compact(F.array(*(F.when(F.col("license_marks").rlike(rule), F.lit(name)) for name, rule in RULES)))
    return docs.select("doc_id", F.coalesce(marks, F.lit("")).alias("license_marks")).withColumn("licenses", F.array_join(found, ","))


def oracle_sql() -> str:
    """The query's rows in DuckDB's SQL: lines and sentences as rows, joined with the known ones."""
    known = ", ".join(f"('{s}', '{mark}')" for mark, own in SENTENCES.items() for s in own)
    rules = ", ".join(f"CASE WHEN regexp_matches(marks, '{rule}') THEN '{name}' END" for name, rule in RULES)
    norm = lambda x: f"regexp_replace(trim(regexp_replace({x}, '{NOT_WORD}', ' ', 'g'), ' '), '{HOLDER}', 'neither the name of the copyright holder nor the names', 'g')"
    return rf"""
WITH known(sentence, mark) AS (VALUES {known}
), numbered AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS t FROM documents
), lines AS (
  SELECT r, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM (SELECT r, regexp_split_to_array(replace(t, chr(1), ' '), '\r\n|\r|\n') AS l FROM numbered)
), marked AS (
  SELECT r, string_agg(CASE WHEN NOT regexp_matches(line, '[a-z0-9]') THEN chr(1) WHEN sentence IS NOT NULL THEN chr(1) || line || chr(1)
    ELSE CASE WHEN regexp_matches(line, '{_start()}') THEN chr(1) ELSE '' END || regexp_replace(line, '{ITEM}', chr(1)) || CASE WHEN regexp_matches(line, ': *$') THEN chr(1) ELSE '' END END, ' ' ORDER BY place) AS t
  FROM lines LEFT JOIN known ON {norm("line")} = sentence GROUP BY r
), parts AS (
  SELECT r, unnest(p) AS part, generate_subscripts(p, 1) AS place FROM (SELECT r, string_split(regexp_replace(t, '{STOP}', chr(1), 'g'), chr(1)) AS p FROM marked)
), found AS (SELECT r, string_agg(mark, '' ORDER BY place) AS marks FROM parts JOIN known ON {norm("part")} = sentence GROUP BY r
), all_docs AS (SELECT d.doc_id, coalesce(marks, '') AS marks FROM numbered d LEFT JOIN found f ON d.r = f.r)
SELECT doc_id, marks AS license_marks, array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ',') AS licenses FROM all_docs"""
