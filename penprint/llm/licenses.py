"""License scans by diagonal voting.

Every rolling word k-gram of every text is hashed and joined to the k-grams of the license templates. A hit at
word i of the text and word j of a template is a vote for the diagonal i - j. Votes are counted per document,
template and diagonal; a span is made of neighbouring diagonals, at most ``slack`` beyond its first, so that inserted or
lost words do not break it and it can't grow wider than the template and the slack. It is verified by the share of the
template's k-grams that it holds, each counted once. Of the spans of a run of diagonals the best is kept.

The templates are fixed texts in this file (a few hundred k-grams, whatever the input). A text's hashes are looked up among
theirs inside one array expression, so that only hits become rows, with the words they matched on; these are joined to the
template positions and compared with the template's words, so a hash collision can't vote.

Defined results: null and empty texts have no words and no labels; of equally good spans the first of the text is kept;
repeated rows and rows of a null key are judged each by itself;
very long texts cost in proportion to their length; empty tables give empty results; other columns aren't passed on, so
none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.llm.common import ascii_lower, let, written

WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
K, SLACK, LEAST_SHARE = 4, 8, 0.7

# The phrases of the base rule with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices and usual one-line declarations, with their labels.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so"""),
    ("mit", "Released under the MIT License"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at"""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License"""),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation"""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation"""),
    ("gfdl", """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free
        Documentation License"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software"""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at"""),
    ("epl", """This program and the accompanying materials are made available under the terms of the Eclipse Public
        License"""),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("eupl", "Licensed under the European Union Public Licence"),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
        software and accompanying documentation covered by this license"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software"""),
    ("ofl", "This Font Software is licensed under the SIL Open Font License"),
    ("cc0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights
        to this work"""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
]


def license_words(text: Column) -> Column:
    """Words of letters, digits and everything beyond ASCII, with A-Z in lower case."""
    spaced = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _gram_hashes(words: Column, k: int) -> Column:
    """Hashes of the k-grams: each word is hashed once, a gram is the hash of its words' hashes."""
    grams = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    return let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """Template k-grams: template (number), label, template_pos, gram (the words), template_grams (how many it has), gram_hash."""
    texts = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(TEMPLATES)])
    each = spark.range(1).select(F.explode(texts).alias("t")).select("t.template", "t.label", license_words(F.col("t.text")).alias("w"))
    grams = F.transform(_gram_hashes(F.col("w"), k), lambda h, i: F.struct(i.alias("template_pos"), F.concat_ws(" ", F.slice("w", i + 1, k)).alias("gram"), h.alias("gram_hash")))
    return each.select("template", "label", (F.size("w") - k + 1).alias("template_grams"), F.explode(grams).alias("g")).select("template", "label", "template_grams", "g.*")


def base_places(words: Column) -> Column:
    """(start, label) of every place where a phrase's words stand consecutively, by start."""
    found = F.array().cast("array<struct<start:int,label:string>>")

    def at(w: Column, i: Column, phrase: str) -> Column:
        first, *rest = phrase.split(" ")
        ok = F.get(w, i) == first
        for j, x in enumerate(rest, 1):
            ok = ok & F.coalesce(F.get(w, i + j) == x, F.lit(False))
        return ok

    def of_phrase(w: Column, phrase: str, label: str) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: at(w, i, phrase))
        return F.when(F.array_contains(w, phrase.split(" ")[0]), F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))).otherwise(found)

    def places(w: Column) -> Column:
        return F.sort_array(F.concat(*[of_phrase(w, phrase, label) for phrase, label in PHRASES.items()]))

    return F.when(F.size(words) == 0, found).otherwise(let(words, places))


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """A row a document: _row (a number), _key, n_words, places (of the base rule) and hits (pos, hash, words of k-grams that a
    template may have). Numbers hold once the rows are written to a table."""
    hashes = [r[0] for r in template_grams(docs.sparkSession, k).select("gram_hash").distinct().collect()]  # as many as the fixed templates have
    none = F.array().cast("array<struct<pos:int,hash:bigint,words:string>>")

    def hits(w: Column) -> Column:
        known = F.transform(_gram_hashes(w, k), lambda h, i: F.when(h.isin(hashes), F.struct(i.alias("pos"), h.alias("hash"))))
        return F.transform(F.filter(known, lambda x: x.isNotNull()), lambda x: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), F.concat_ws(" ", F.slice(w, x["pos"] + 1, k)).alias("words")))

    def one(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), base_places(w).alias("places"), F.when(F.size(w) >= k, hits(w)).otherwise(none).alias("hits"))

    return docs.select(F.col(key).alias("_key"), let(license_words(F.col(text)), one).alias("m")).select(F.monotonically_increasing_id().alias("_row"), "_key", "m.*")


def spans(rows: DataFrame, k: int = K, slack: int = SLACK, least: float = LEAST_SHARE) -> DataFrame:
    """Verified spans of a table of rows from marked(): _row, label, first_word, last_word, share of the template's k-grams found."""
    grams = template_grams(rows.sparkSession, k)
    rolled = rows.select("_row", F.explode("hits").alias("h")).select("_row", "h.*")
    voted = rolled.join(F.broadcast(grams), (F.col("hash") == F.col("gram_hash")) & (F.col("words") == F.col("gram")))
    votes = voted.groupBy("_row", "template", "label", "template_grams", (F.col("pos") - F.col("template_pos")).alias("diagonal")).agg(
        F.collect_set("template_pos").alias("_hit"), F.min("pos").alias("_first"), F.max("pos").alias("_last")
    )
    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    near = along.rangeBetween(0, slack)
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > slack), F.lit(True))
    share = F.size(F.array_distinct(F.flatten(F.collect_list("_hit").over(near)))) / F.col("template_grams")
    merged = votes.select(
        "_row", "template", "label", "diagonal", F.min("_first").over(near).alias("first_word"), (F.max("_last").over(near) + k - 1).alias("last_word"), share.alias("share"), new.cast("int").alias("_new")
    ).withColumn("_run", F.sum("_new").over(along))
    best = merged.filter(F.col("share") >= least).groupBy("_row", "template", "label", "_run").agg(F.min(F.struct((-F.col("share")).alias("s"), "diagonal", "first_word", "last_word")).alias("b"))
    return best.select("_row", "label", "b.first_word", "b.last_word", (-F.col("b.s")).alias("share"))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: key, n_words, base places, method_labels, method_share. Texts are read once."""
    rows = written(marked(docs, key, text), "licenses")
    found = spans(rows).groupBy(F.col("_row").alias("_found")).agg(F.sort_array(F.collect_set("label")).alias("method_labels"), F.max("share").alias("method_share"))
    return rows.join(found, F.col("_row") == F.col("_found"), "left").select(F.col("_key").alias(key), "n_words", "places", "method_labels", "method_share")
