"""Licence scan by sentence rules.

A text is cut into sentences, these are normalised, and those that are known licence sentences become
identifiers. The identifiers of a text, in order, are matched against rules: ordered sequences of
identifiers. Text between two known sentences does not break a sequence, an unknown order does. The
rules are fixed and small; nothing else is broadcast. Sentences that no rule knows never leave the
task, so only identifiers are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences (lower case, one space for all that is no letter or digit).
SENTENCES = {
    "apache-grant": "licensed under the apache license version 2 0",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is "
                    "distributed on an as is basis",
    "mit-release": "released under the mit license",
    "mit-name": "the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies",
    "as-is": "the software is provided as is without warranty of any kind",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                "general public license as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-source": "redistributions of source code must retain the above copyright notice",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc0": "licensed under cc0 1 0",
    "all-rights": "all rights reserved",
}
# Licence, rule name, and the sentence identifiers that must follow each other.
RULES = (
    ("Apache-2.0", "apache-short", ("apache-grant",)),
    ("Apache-2.0", "apache-header", ("apache-grant", "apache-may-not", "apache-obtain", "apache-as-is")),
    ("MIT", "mit-short", ("mit-release",)),
    ("MIT", "mit-text", ("mit-permission", "mit-notice", "as-is")),
    ("GPL-3.0", "gpl-short", ("gpl3-work",)),
    ("GPL", "gpl-header", ("gpl-free", "gpl-hope")),
    ("BSD-2-Clause", "bsd-2", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", "bsd-3", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")),
    ("CC-BY-NC-4.0", "cc-by-nc", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", "cc-by-sa", ("cc-by-sa",)),
    ("CC-BY-4.0", "cc-by", ("cc-by",)),
    ("CC0-1.0", "cc0", ("cc0",)),
    ("LicenseRef-all-rights-reserved", "all-rights", ("all-rights",)),
)
# A sentence ends at a line break, or at closing punctuation before white space or the end of the text.
SENTENCE_END = r"\n|[.!?]+(?:[\x20\x09-\x0D]+|\z)"
NOT_PLAIN = r"[^a-z0-9]+"


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), NOT_PLAIN, " "))


def scan(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """``keep``, ``sentence_ids`` (in text order), ``licences`` and ``rules`` (sorted), one row per row of ``docs``.

    Null and empty texts, and texts without a known sentence, have empty arrays. A sentence that comes
    several times is listed each time. Rows with the same id are scanned each on its own text. Columns
    in ``keep`` must not be named like the new ones.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list(SENTENCES.items()), "sentence_id string, _plain string")
    parts = (
        docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.split("text", SENTENCE_END).alias("_parts"))
        .select(*keep, "_row", F.posexplode_outer("_parts").alias("_at", "_s"))
        .withColumn("_plain", normalised(F.col("_s")))
        .join(F.broadcast(known), "_plain", "left")
        .where(F.col("sentence_id").isNotNull() | F.coalesce(F.col("_at") == 0, F.lit(True)))
        .groupBy("_row", *keep)
        .agg(F.array_sort(F.collect_list(
            F.when(F.col("sentence_id").isNotNull(), F.struct("_at", "sentence_id")))).alias("_ids"))
    )
    ids = F.transform("_ids", lambda x: x["sentence_id"])
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    hit = lambda i, value: F.when(F.contains(line, F.lit(f" {' '.join(RULES[i][2])} ")), F.lit(value))
    present = lambda at: F.array_sort(F.array_distinct(F.array_compact(F.array(
        *[hit(i, r[at]) for i, r in enumerate(RULES)]))))
    return (
        parts.withColumn("sentence_ids", ids)
        .select(*keep, "sentence_ids", present(0).alias("licences"), present(1).alias("rules"))
    )
