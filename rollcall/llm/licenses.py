"""License scans with a positional rare-token index, by DataFrame functions only.

The index is a table: a row (word, notice, place, key) for every word of a notice that matters. A file's licence words are found once, with their
positions. Their document frequencies give the IDF by which each notice is looked up under its own rarest words alone: one more place than a notice that aligns may
miss. The postings of the notices that a file's rarest words lead to meet the file's words by word, and are intersected by relative position: a position less a
place is where the notice would start. A start at which enough places align is verified: every word of the mandatory key phrases must stand at
its place from there. Notices are rows, so that their number doesn't change the plan.

Nulls and edges: a null or empty text has no words, no labels and score 0; null and repeated ids are
kept row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm.frames import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases, each with its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Openings and other passages of public licence notices; label, text, key phrases that must stand in it word by word.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("hereby granted free", "software without restriction")),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", ("without warranty of any kind", "purpose and noninfringement")),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", ("apache license version 2 0",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("binary forms with or without modification", "permitted provided")),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED", ("copyright holders and contributors as is",)),
    ("bsd", "All advertising materials mentioning features or use of this software must display the following acknowledgement", ("advertising materials mentioning features",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file", ("mozilla public license",)),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software", ("person or organization obtaining", "execute and transmit")),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", ("boost software license version 1 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("free and unencumbered software",)),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", ("as long as the name is changed",)),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain",)),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License", ("common development and distribution license",)),
    ("artistic", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package", ("semblance of artistic control",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("authors be held liable",)),
    ("afl", "Licensed under the Academic Free License version 3.0", ("academic free license",)),
    ("osl", "Licensed under the Open Software License version 3.0", ("open software license",)),
    ("python", "This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\"), and the Individual or Organization (\"Licensee\") accessing and otherwise using this software", ("python software foundation",)),
    ("eupl", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL", ("under the eupl",)),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("sil open font license",)),
    ("ms-pl", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software", ("governs use of the accompanying software",)),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", ("without a written agreement",)),
    ("openssl", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit", ("openssl project",)),
    ("cecill", "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software", ("cecill license under french law",)),
    ("beerware", "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return", ("buy me a beer in return",)),
    ("hpnd", "Permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee, provided that the above copyright notice appear in all copies", ("hereby granted without fee provided",)),
    ("json", "The Software shall be used for Good, not Evil", ("used for good not evil",)),
    ("ruby", "You may make and give away verbatim copies of the source form of the software without restriction, provided that you duplicate all of the original copyright notices and associated disclaimers", ("give away verbatim copies",)),
    ("unicode", "Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files and any associated documentation", ("unicode data files",)),
    ("upl", "Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data (collectively the \"Software\"), free of charge and under any and all copyright rights in the Software", ("any and all copyright rights",)),
)
#: Identifiers of the public list of licences, each with its label; a file names them in a line of its own.
SPDX = {
    "MIT": "mit", "Apache-2.0": "apache", "GPL-2.0": "gpl", "GPL-3.0": "gpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "0BSD": "bsd", "ISC": "isc", "MPL-2.0": "mpl",
    "BSL-1.0": "boost", "Unlicense": "unlicense", "WTFPL": "wtfpl", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "EPL-1.0": "epl", "EPL-2.0": "epl", "CDDL-1.0": "cddl", "Artistic-2.0": "artistic", "Zlib": "zlib",
    "AFL-3.0": "afl", "OSL-3.0": "osl", "PSF-2.0": "python", "EUPL-1.2": "eupl", "OFL-1.1": "ofl", "MS-PL": "ms-pl", "PostgreSQL": "postgresql", "OpenSSL": "openssl", "CECILL-2.1": "cecill", "Beerware": "beerware", "HPND": "hpnd", "JSON": "json",
    "Ruby": "ruby", "Unicode-3.0": "unicode", "UPL-1.0": "upl", "NCSA": "ncsa", "X11": "x11",
}


def notices() -> list[tuple[str, str, tuple[str, ...]]]:
    """All notices: passages, and for each identifier its line, all of which must stand there."""
    lines = [f"SPDX-License-Identifier: {ident}" for ident in SPDX]
    return [*NOTICES, *((label, line, (line,)) for line, label in zip(lines, SPDX.values(), strict=True))]


#: Words too common to be posted, unless a phrase needs them.
COMMON = frozenset("a an and any are as at be by can for if in is it may of on or that the this to was with you not".split())
#: Share of a notice's posted words that must align.
ALIGNED = 0.7


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def postings(notice: str, keys: tuple[str, ...]) -> list[tuple[str, int, bool]]:
    """The posted words of a notice with their places, and whether they stand in a key phrase; words that are too common are posted in key phrases only."""
    told, keyed = words(notice), set()
    for phrase in map(words, keys):
        at = next((i for i in range(len(told)) if told[i : i + len(phrase)] == phrase), None)
        if at is None:
            raise ValueError(f"{' '.join(phrase)} doesn't stand in the notice")
        if COMMON.issuperset(phrase):
            raise ValueError(f"{' '.join(phrase)} has only common words")
        keyed.update(range(at, at + len(phrase)))
    return [(w, i, i in keyed) for i, w in enumerate(told) if i in keyed or w not in COMMON]


def aligned_from(n: int) -> int:
    """How many of a notice's n posted words must align at least."""
    return math.ceil(ALIGNED * n)


def vocabulary() -> list[str]:
    found = {w for p in PHRASES for w in words(p)}
    return sorted(found.union(*({w for w, _, _ in postings(t, k)} for _, t, k in notices())))


def index(spark: SparkSession) -> DataFrame:
    """The postings as a table of fixed size: notice, label, size, need, n_keys, and word, place, key."""
    rows = []
    for n, (label, text, keys) in enumerate(notices()):
        posted = postings(text, keys)
        rows += [{"notice": n, "label": label, "size": len(posted), "need": aligned_from(len(posted)), "n_keys": sum(k for _, _, k in posted), "word": w, "place": i, "key": k} for w, i, k in posted]
    schema = "array<struct<notice:int,label:string,size:int,need:int,n_keys:int,word:string,place:bigint,key:boolean>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("p")).select("p.*")


def licence_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: a number of its own, id, n_words and hits, the licence words of the whole text with their positions."""
    every = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), every.alias("every"))
    known = vocabulary()
    # a file without one of these holds no key phrase
    any_of = F.arrays_overlap("every", F.array(*(F.lit(w) for w in known if w not in COMMON)))
    placed = F.filter(F.transform("every", lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda h: h["w"].isin(known))
    none = F.filter(F.array(F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("i"))), lambda h: F.lit(False))
    return split.select("row", "doc_id", F.size("every").cast("long").alias("n_words"), F.when(any_of, placed).otherwise(none).alias("hits"))


def postings_of(word: str, place: int) -> Column:
    """Where a phrase or notice starts that has this word at this place."""
    return F.transform(F.filter("hits", lambda h: h["w"] == word), lambda h: h["i"] - place)


def places(phrase: str) -> Column:
    """Start positions of a phrase: the postings of its words, each less the word's place, intersected."""
    return reduce(F.array_intersect, (postings_of(w, k) for k, w in enumerate(words(phrase))))


def labelled_starts(k: int, label: str) -> Column:
    return F.transform(f"at_{k}", lambda i: F.struct(F.lit(label).alias("label"), i.alias("start")))


def verified(held: DataFrame, posted: DataFrame) -> DataFrame:
    """(row, label, start, share) of every notice that stands in a file. ``held``: row, hits; ``posted``: the index.

    The index has a fixed size, and so have the document frequencies of its words, so that both are broadcast; files are shuffled by their own number
    alone, and only those to whom a notice's rarest words lead.
    """
    own = held.where(F.size("hits") > 0)
    often = own.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("word")).groupBy("word").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("notice").orderBy("often", "word", "place"))
    known = posted.join(often, "word", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    leads = known.withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.col("need") + 1).groupBy("word").agg(F.collect_set("notice").alias("lead_to"))
    words_of = own.select("row", F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("word"))
    asked = words_of.join(F.broadcast(leads), "word").select("row", F.explode("lead_to").alias("notice")).groupBy("row").agg(F.collect_set("notice").alias("notices"))
    placed = own.join(asked, "row").select("row", "notices", F.explode("hits").alias("h")).select("row", F.explode("notices").alias("notice"), F.col("h.w").alias("word"), F.col("h.i").alias("i"))
    met = placed.join(F.broadcast(posted), ["notice", "word"])
    starts = met.groupBy("row", "notice", "label", "size", "need", "n_keys", (F.col("i") - F.col("place")).alias("start")).agg(F.count("*").alias("n"), F.count_if("key").alias("keys"))
    return starts.where((F.col("n") >= F.col("need")) & (F.col("keys") == F.col("n_keys"))).select("row", "label", "start", (F.col("n") / F.col("size")).alias("share"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans
    (label and start word of every place of a phrase and of every verified notice).

    The score is 1 for a file with a base phrase, else the aligned share of its best verified notice, else 0.
    """
    held = written(licence_words(docs, id_col, text_col))
    found = verified(held.select("row", "hits"), index(docs.sparkSession))
    noticed = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "start"))).alias("noticed"), F.max("share").alias("share"))
    scanned = held.withColumns({f"at_{k}": places(p) for k, p in enumerate(PHRASES)}).drop("hits").join(noticed, "row", "left")
    all_at = F.flatten(F.array(*(F.col(f"at_{k}") for k in range(len(PHRASES)))))
    base_labels = F.filter(F.array(*(F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())
    told = F.coalesce("noticed", F.array().cast("array<struct<label:string,start:bigint>>"))
    spans = F.concat(*(labelled_starts(k, label) for k, label in enumerate(PHRASES.values())), told)
    return scanned.select(
        F.col("doc_id").alias(id_col), "n_words", F.size(all_at).cast("long").alias("n_base"), F.array_min(all_at).alias("first_word"), F.array_max(all_at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(told, lambda x: x["label"])))), ",").alias("labels"),
        F.when(F.size(all_at) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), spans.alias("spans"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    from rollcall.llm.frames import table

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
