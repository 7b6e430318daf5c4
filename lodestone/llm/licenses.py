"""License scans by sentences.

Texts are cut into sentences (and, where a sentence runs over several lines, its lines as well); a sentence in normal
form that is a known licence sentence gives its identifier. A document's identifiers in text order make a sequence,
and ordered licence rules (the first that fits a place wins; longer rules stand first) are matched against it.

Edge cases: null or empty texts and texts without a known sentence give no row; repeated sentences are repeated in the
sequence; rows with a repeated or null doc_id are scanned each on its own; other columns are ignored.
Of full licence texts, the title and its date are known, not every clause. A sentence may name any owner where OWNED
says so. Short tags (`SPDX-License-Identifier: MIT`) are no sentences and give no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known sentences in normal form, as `fragments` cuts them: lower case, runs of anything but letters and digits as one space.
SENTENCES: dict[str, str] = {
    "mit.notice": "released under the mit license",
    "mit.notice2": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2.notice": "licensed under the apache license version 2 0",
    "apache2.may": "you may not use this file except in compliance with the license",
    "apache2.copy": "you may obtain a copy of the license at",
    "gpl3.notice": "this work is licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "ccbync4.notice": "licensed under cc by nc 4 0",
    "ccby4.notice": "licensed under cc by 4 0",
    "ccbysa4.notice": "licensed under cc by sa 4 0",
    "bsd.head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2.notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc0.notice": "this work is dedicated to the public domain under cc0 1 0",
    "cc0.mark": "this work is marked with cc0 1 0",
    "cc0.mark2": "this work is marked with cc0 1 0 universal",
    "apache2.head": "licensed under the apache license version 2 0 the license",
    "apache2.asf": "the asf licenses this file to you under the apache license version 2 0 the license",
    "mpl2.head": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2.copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2.copy2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl11.notice": "the contents of this file are subject to the mozilla public license version 1 1 the license",
    "gnu.program": "this program is free software",
    "gnu.library": "this library is free software",
    "gnu.hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gnu.hope2": "this library is distributed in the hope that it will be useful but without any warranty",
    "gnu.warranty": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.grant2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsl1.notice": "distributed under the boost software license version 1 0",
    "zlib.grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense.notice": "this is free and unencumbered software released into the public domain",
    "epl2.notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl2.notice2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at http www eclipse org legal epl 2 0",
    "epl2.notice3": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0 spdx license identifier",
}
#: Of the GNU licences: their names and versions. Headers set a comma or a semicolon, which cuts, before the version.
_GNU = {
    "gpl": ("general", ("1", "2", "3")),
    "lgpl": ("lesser general", ("2.1", "3")),
    "lgpl-library": ("library general", ("2",)),
    "agpl": ("affero general", ("3",)),
}
_gnu_rules: list[tuple[str, tuple[str, ...]]] = []
for _family, (_name, _versions) in _GNU.items():
    _terms = f"you can redistribute it and or modify it under the terms of the gnu {_name} public license"
    _by = "as published by the free software foundation"
    SENTENCES[f"{_family}.terms"] = f"{_terms} {_by}"
    for _v in _versions:
        _n = _v.replace(".", " ")
        _licence = f"{_family.removesuffix('-library')}-{_v if '.' in _v else _v + '.0'}"
        SENTENCES |= {f"gnu.later{_v}": f"either version {_n} of the license or at your option any later version", f"gnu.only{_v}": f"version {_n} of the license"}
        SENTENCES |= {f"{_family}.later{_v}": f"{_terms} {_by} either version {_n} of the license or at your option any later version"}
        SENTENCES |= {f"{_family}.only{_v}": f"{_terms} {_by} version {_n} of the license", f"{_family}.only{_v}a": f"{_terms} {_by} version {_n}", f"{_family}.only{_v}b": f"{_terms} version {_n} {_by}"}
        _gnu_rules += [(f"{_licence}-or-later", (f"{_family}.terms", f"gnu.later{_v}")), (f"{_licence}-only", (f"{_family}.terms", f"gnu.only{_v}")), (f"{_licence}-or-later", (f"{_family}.later{_v}",))]
        _gnu_rules += [(f"{_licence}-only", (f"{_family}.only{_v}{x}",)) for x in ("", "a", "b")]
#: Of the Creative Commons licences 4.0: the short and the long name.
_CC = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
_cc_rules: list[tuple[str, tuple[str, ...]]] = []
for _short, _name in _CC.items():
    _forms = {f"licensed under cc {_short.replace('-', ' ')} 4 0", f"this work is licensed under cc {_short.replace('-', ' ')} 4 0"}
    _forms |= {f"this work is licensed under {_a}creative commons {_name} 4 0 international{_z}" for _a in ("", "a ", "the ") for _z in ("", " license", " public license")}
    for _k, _form in enumerate(sorted(_forms - set(SENTENCES.values()))):
        SENTENCES[f"cc{_short.replace('-', '')}4.form{_k}"] = _form
        _cc_rules.append((f"cc-{_short}-4.0", (f"cc{_short.replace('-', '')}4.form{_k}",)))
SENTENCES |= {
    "bsd.advert": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "apache.title": "apache license",
    "apache2.dated": "version 2 0 january 2004",
    "gpl.title": "gnu general public license",
    "lgpl.title": "gnu lesser general public license",
    "agpl.title": "gnu affero general public license",
    "gpl2.dated": "version 2 june 1991",
    "lgpl21.dated": "version 2 1 february 1999",
    "gpl3.dated": "version 3 29 june 2007",
    "agpl3.dated": "version 3 19 november 2007",
    "mpl2.title": "mozilla public license version 2 0",
}
#: Sentences that name an owner: what fits the pattern in normal form is the sentence of that identifier.
OWNED: tuple[tuple[str, str], ...] = (
    ("^neither the names? .{1,200} may be used to endorse or promote products derived from this software.{0,80}$", "bsd.endorse"),
    ("^nor the names? .{1,100} may be used to endorse or promote products derived from this software.{0,80}$", "bsd.endorse"),  # of `Example Inc. nor the names`, which is cut
)
#: Characters of a sentence that names an owner at most.
LONGEST_OWNED = 400
#: Licences by their sentence sequences, in the order in which they are tried; {} stands for sentences in a row.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("bsd-4-clause", ("bsd.head", "bsd.source", "bsd.binary", "bsd.advert", "bsd.endorse")),
    ("bsd-3-clause", ("bsd.head", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("bsd-2-clause", ("bsd.head", "bsd.source", "bsd.binary")),
    ("mit", ("mit.grant", "mit.keep", "mit.asis")),
    ("apache-2.0", ("apache2.notice", "apache2.may", "apache2.copy")),
    ("apache-2.0", ("apache2.head", "apache2.may", "apache2.copy")),
    ("apache-2.0", ("apache2.asf", "apache2.may", "apache2.copy")),
    ("mpl-1.1", ("mpl11.notice", "apache2.may", "apache2.copy")),
    ("gpl-3.0-or-later", ("gpl.free", "gpl.warranty")),
    ("mpl-2.0", ("mpl2.head", "mpl2.copy")),
    ("mpl-2.0", ("mpl2.head", "mpl2.copy2")),
    *(x for x in _gnu_rules if len(x[1]) > 1),
    ("apache-2.0", ("apache.title", "apache2.dated")),
    ("gpl-2.0", ("gpl.title", "gpl2.dated")),
    ("gpl-3.0", ("gpl.title", "gpl3.dated")),
    ("lgpl-2.1", ("lgpl.title", "lgpl21.dated")),
    ("lgpl-3.0", ("lgpl.title", "gpl3.dated")),
    ("agpl-3.0", ("agpl.title", "agpl3.dated")),
    ("mit", ("mit.notice",)),
    ("mit", ("mit.notice2",)),
    ("apache-2.0", ("apache2.notice",)),
    ("gpl-3.0", ("gpl3.notice",)),
    ("cc-by-nc-4.0", ("ccbync4.notice",)),
    ("cc-by-4.0", ("ccby4.notice",)),
    ("cc-by-sa-4.0", ("ccbysa4.notice",)),
    ("mpl-2.0", ("mpl2.notice",)),
    ("cc0-1.0", ("cc0.notice",)),
    ("cc0-1.0", ("cc0.mark",)),
    ("cc0-1.0", ("cc0.mark2",)),
    ("apache-2.0", ("apache2.head",)),
    ("apache-2.0", ("apache2.asf",)),
    ("gpl-3.0-or-later", ("gpl.free",)),
    ("mpl-2.0", ("mpl2.head",)),
    ("mpl-1.1", ("mpl11.notice",)),
    ("mpl-2.0", ("mpl2.title",)),
    *(x for x in _gnu_rules if len(x[1]) == 1),
    *_cc_rules,
    ("isc", ("isc.grant",)),
    ("isc", ("isc.grant2",)),
    ("0bsd", ("0bsd.grant",)),
    ("bsl-1.0", ("bsl1.notice",)),
    ("zlib", ("zlib.grant",)),
    ("unlicense", ("unlicense.notice",)),
    ("epl-2.0", ("epl2.notice",)),
    ("epl-2.0", ("epl2.notice2",)),
    ("epl-2.0", ("epl2.notice3",)),
)


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def owned(c: Column, sentences: Mapping[str, str] = SENTENCES) -> Column:
    """A sentence in normal form, with known wording for those that name an owner."""
    for pattern, known in OWNED:
        if known in sentences:
            c = F.when(c.rlike(pattern), F.lit(sentences[known])).otherwise(c)
    return c


def fragments(text: Column) -> Column:
    """Sentences: text up to `.`, `!`, `?`, `:` or `;` before white space, or an empty line."""
    marked = F.regexp_replace(text, r"([.!?:;])[ \t\r\n]+|\n[ \t\r]*\n", "$1\x01")
    return F.split(marked, "\x01")


def sentence_table(spark: SparkSession, sentences: Mapping[str, str]) -> DataFrame:
    rows = [F.struct(F.lit(s).alias("sentence"), F.lit(k).alias("sentence_id")) for k, s in sentences.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def sentence_hits(docs: DataFrame, sentences: Mapping[str, str] = SENTENCES) -> DataFrame:
    """row (a number of the row), doc_id, at, line, sentence_id; line -1: the whole sentence, else one of its lines, where that isn't the sentence itself."""
    longest, shortest = max(*map(len, sentences.values()), LONGEST_OWNED), min(map(len, sentences.values()))
    numbered = docs.filter("text IS NOT NULL").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    cut = numbered.select("doc_id", "row", F.posexplode(fragments(F.col("text"))).alias("at", "part"))
    lines = F.when(F.instr("part", "\n") > 0, F.concat(F.array("part"), F.split("part", "\n"))).otherwise(F.array("part"))
    sized = lambda c: F.length(c) >= shortest
    normed = F.transform(lines, lambda x: F.when(sized(x), normal(x)).otherwise(""))
    split = cut.filter(sized("part")).select("row", "doc_id", "at", normed.alias("all")).select("row", "doc_id", "at", F.col("all")[0].alias("whole"), F.posexplode("all").alias("line", "sentence"))
    near = split.filter(((F.col("line") == 0) | (F.col("sentence") != F.col("whole"))) & F.length("sentence").between(shortest, longest)).withColumn("sentence", owned(F.col("sentence"), sentences))
    return near.join(F.broadcast(sentence_table(docs.sparkSession, sentences)), "sentence").select("row", "doc_id", "at", (F.col("line") - 1).alias("line"), "sentence_id")


def matched(sequence: Column, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> Column:
    """Licences of a `,a,,b,`-like sequence, in rule order; what a rule has matched is gone for later ones."""
    state = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("found"))
    table = F.array(*(F.struct(F.lit(name).alias("licence"), F.lit("".join(f",{x}," for x in ids)).alias("ids")) for name, ids in rules))

    def step(acc: Column, rule: Column) -> Column:
        rest = F.replace(acc.rest, rule.ids, F.lit("|"))
        return F.struct(rest.alias("rest"), F.when(rest != acc.rest, F.array_union(acc.found, F.array(rule.licence))).otherwise(acc.found).alias("found"))

    return F.aggregate(table, state, step)["found"]


def scan(docs: DataFrame, sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """doc_id, n_sentences, sentence_ids (array in text order), licences (array in rule order), for documents with a known sentence."""
    hits = sentence_hits(docs, sentences).groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "line", "sentence_id"))).alias("hits"))
    ids = hits.select("doc_id", F.transform("hits", lambda h: h.sentence_id).alias("sentence_ids"))
    sequence = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit(","), x, F.lit(","))), "")
    return ids.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), "sentence_ids", matched(sequence, rules).alias("licences"))
