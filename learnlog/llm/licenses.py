"""Licence scans: MinHash bands over overlapping word windows find candidate notices, exact shingle
containment confirms them. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlog.sources.tables import read_table

#: Words per shingle, shingles per window, hash functions (bands of one row each).
SHINGLE, WINDOW, BANDS = 3, 3, 4
#: Share of a notice's shingles that must be there, and words of play on both sides.
LEAST, SLACK = 0.8, 2
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_GNU = ("This {} is free software{} you can redistribute it and/or modify it under the terms of the {} as published "
        "by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.")
_GPL, _LGPL, _AGPL = ("GNU General Public License", "GNU Lesser General Public License",
                      "GNU Affero General Public License")
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
       ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))

# Short mentions of a licence, then notices, titles and tags as their publishers word them.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-2.0", _GNU.format("program", ";", _GPL, ";", "2")),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software "
                "Foundation."),
    ("GPL-3.0", _GNU.format("program", ":", _GPL, ",", "3")),
    ("LGPL-2.1", _GNU.format("library", ";", _LGPL, ";", "2.1")),
    ("LGPL-3.0", _GNU.format("library", ":", _LGPL, ",", "3")),
    ("AGPL-3.0", _GNU.format("program", ":", _AGPL, ",", "3")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all "
                "copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "creativecommons.org/publicdomain/zero/1.0"),
    *((f"CC-{short}-4.0", text) for short, name in _CC for text in (
        f"licensed under a Creative Commons {name} 4.0 International License.",
        f"Creative Commons {name} 4.0 International Public License",
        f"creativecommons.org/licenses/{short.lower()}/4.0")),
    *((name, f"Licensed under CC {short} 4.0.") for name, short in (
        ("CC-BY-NC-SA-4.0", "BY-NC-SA"), ("CC-BY-NC-ND-4.0", "BY-NC-ND"))),
    *((name, f"SPDX-License-Identifier: {name}") for name in (
        "MIT", "MIT-0", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "ISC",
        "Unlicense", "CC0-1.0", *(f"CC-{short}-4.0" for short, _ in _CC))),
    *(("BSD", f"SPDX-License-Identifier: BSD-{n}-Clause") for n in (2, 3)),
)


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def shingle_hashes(text: Column) -> list[dict[str, Column]]:
    """Successive projections that end in ``h``: a 64-bit hash per run of three words (ASCII
    letters, digits and all other characters above 127; lower case)."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), "")
    w = F.col("w")
    pair = F.zip_with(w, _shifted(w, 1), lambda a, b: F.xxhash64(a, b))
    triple = F.zip_with(F.col("pair"), _shifted(w, 2), lambda a, b: F.xxhash64(a, b))
    return [{"w": F.transform(words, lambda x: F.xxhash64(x))}, {"pair": pair, "w": w},
            {"h": F.slice(triple, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0)))}]


def _hash_function(band: int):
    return lambda x: F.xxhash64(x, F.lit(band))


def _windows(band: int) -> Column:
    """Smallest hash, under the band's hash function, of each run of ``WINDOW`` shingles (of fewer at the end)."""
    p = F.col(f"p{band}")
    return reduce(lambda acc, by: F.zip_with(acc, _shifted(p, by), lambda a, b: F.least(a, b)),
                  range(1, WINDOW), p)


def _sketched(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """keep, h (shingles) and m0, m1, ... (window minima per band)."""
    for step in shingle_hashes(F.col(text_col)):
        df = df.select(*keep, *[c.alias(n) for n, c in step.items()])
    df = df.select(*keep, "h", *[F.transform("h", _hash_function(b)).alias(f"p{b}") for b in range(BANDS)])
    # the one-row explode keeps a later filter on the sketch from being pushed below (and so
    # repeating) the steps that compute it
    sketch = F.struct("h", *[_windows(b).alias(f"m{b}") for b in range(BANDS)])
    return df.select(*keep, F.explode(F.array(sketch)).alias("s")).select(*keep, "s.*")


def _keys() -> Column:
    """Arrays of (kind, value) per position: kind -1 is the shingle, 0.. the bands."""
    return F.arrays_zip("h", *[f"m{b}" for b in range(BANDS)])


def _kinds(df: DataFrame, keep: list[str]) -> DataFrame:
    wide = df.select(*keep, F.posexplode(_keys()).alias("at", "k"))
    names = ["h", *[f"m{b}" for b in range(BANDS)]]
    return wide.select(*keep, "at", F.explode(F.array(*[
        F.struct(F.lit(i - 1).alias("kind"), F.col(f"k.{n}").alias("value")) for i, n in enumerate(names)])).alias("x")
    ).select(*keep, "at", "x.kind", "x.value")


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, id_col: str = "doc_id",
         text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Licence notices inside documents: one row per (id, licence).

    A window of three shingles (five words) lies at every word of a text and of every notice;
    a notice is a candidate where a window's minimum agrees with one of its own under any of
    the four hash functions. Five words in a row as in the notice always agree; a window that
    shares half of its shingles does with probability 1 - (1/2)^4 = 94 %. Notices of fewer than
    three shingles are found by their shingles. A candidate is confirmed if, from two words before its
    place to two words after it, the text has ``least`` of the notice's distinct shingles. Of
    overlapping notices the fuller (then the longer, then the first listed) counts. Columns: id,
    license, containment (best), first_word (place of the first such). Documents without a notice
    give no row; null and empty texts hold none; rows with equal ids count as one document;
    other columns are ignored. The work is in proportion to the hits of a text, however often a notice
    stands in it. ``notices`` is a constant list, of three words or more each."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(notices)],
                                  "t int, license string, text string")
    sketch = _sketched(known, ["t", "license"], "text").withColumn("n", F.size(F.array_distinct("h")))
    rows = _kinds(sketch, ["t", "license", "n"]).where(
        (F.col("kind") < 0) | ((F.col("n") >= WINDOW) & (F.col("at") <= F.col("n") - WINDOW))).collect()
    if {r["t"] for r in rows} != set(range(len(notices))):
        raise ValueError("every notice needs three words or more")
    first = {}  # first place of each of a notice's distinct keys
    for r in sorted(rows, key=lambda r: r["at"]):
        first.setdefault((r["t"], r["kind"], r["value"]), r)
    schema = "kind int, value long, t int, o int, n int, short boolean"
    table = spark.createDataFrame([(r["kind"], r["value"], r["t"], r["at"], r["n"], r["n"] < WINDOW)
                                   for r in first.values()], schema)
    lists = {k: F.array(*[F.lit(v) for v in sorted({r["value"] for r in first.values() if r["kind"] == k and (
        k >= 0 or r["n"] < WINDOW)})]).cast("array<bigint>") for k in range(-1, BANDS)}
    found = _sketched(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], "text").where(
        reduce(lambda a, b: a | b, [F.arrays_overlap("h" if k < 0 else f"m{k}", v) for k, v in lists.items()]))
    # the table of notices is a constant of this call, a few hundred rows
    hits = (_kinds(found, ["id"]).join(F.broadcast(table), ["kind", "value"])
            .groupBy("id", "t", "n").agg(
                F.max((F.col("kind") >= 0) | F.col("short")).alias("candidate"),
                F.array_sort(F.collect_set(F.when(F.col("kind") < 0, F.struct("at", "o")))).alias("hits"))
            .where("candidate"))
    # A place holds one shingle, or as many as rows have the id (``same``): the hits around a start are at most that
    # many a place before and after the hit that gave it, and only these are looked at.
    run = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), F.lit(1).alias("most"))
    count = lambda acc, x: F.when(acc["at"] == x["at"], acc["n"] + 1).otherwise(F.lit(1))
    same = F.aggregate("hits", run, lambda acc, x: F.struct(
        x["at"].alias("at"), count(acc, x).alias("n"), F.greatest(acc["most"], count(acc, x)).alias("most")))
    starts = F.array_sort(F.transform("hits", lambda x, i: F.struct(
        (x["at"] - x["o"]).alias("s"), (i + 1).alias("i"), x["o"].alias("o"))))
    hits = (hits.withColumn("same", same["most"]).withColumn("all", starts)
            .withColumn("starts", F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["s"] < x["s"]))))

    def near(x: Column) -> Column:
        low = F.greatest(x["i"] - F.col("same") * (x["o"] + SLACK + 1), F.lit(1))
        high = x["i"] + F.col("same") * (F.greatest(F.col("n") + SLACK - x["o"], F.lit(0)) + 1)
        return F.filter(F.slice("hits", low, high - low + 1), lambda y: y["at"].between(
            x["s"] - SLACK, x["s"] + F.col("n") - 1 + SLACK))

    share = F.transform("starts", lambda x: F.struct(
        x["s"].alias("start"), (F.size(F.array_distinct(F.transform(near(x), lambda y: y["o"]))) / F.col("n")).alias("c")))
    regions = (hits.select("id", "t", "n", F.explode(share).alias("r")).where(F.col("r.c") >= least)
               .select("id", F.struct(F.col("r.c").alias("c"), F.col("n"), (-F.col("t")).alias("u"),
                                      F.col("r.start").alias("a"), (F.col("r.start") + F.col("n")).alias("z")).alias("r")))
    # a region meets others in its own stretch of the text and the two beside it: a group is bounded by the notices
    longest = max(r["n"] for r in rows)
    stretch = F.floor(F.col("r.a") / F.lit(longest))
    per = (regions.select("id", "r", stretch.alias("own"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("in"))
           .groupBy("id", "in").agg(F.collect_list("r").alias("ys"),
                                    F.collect_list(F.when(F.col("own") == F.col("in"), F.col("r"))).alias("rs")))
    better = lambda y, x: F.struct(y["c"], y["n"], y["u"]) > F.struct(x["c"], x["n"], x["u"])
    kept = F.filter("rs", lambda x: ~F.exists(
        "ys", lambda y: (y["u"] != x["u"]) & (y["a"] < x["z"]) & (x["a"] < y["z"]) & better(y, x)))
    names = F.element_at(F.array(*[F.lit(name) for name, _ in notices]), 1 - F.col("r.u"))
    best = F.max(F.struct(F.col("r.c").alias("c"), (-F.col("r.a")).alias("a")))
    return (per.select("id", F.explode(kept).alias("r")).groupBy("id", names.alias("license"))
            .agg(best.alias("b")).select(F.col("id").alias(id_col), "license", F.col("b.c").alias("containment"),
                                         (-F.col("b.a")).alias("first_word")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return scan(read_table(spark, sf_dir, "documents"))


_VALUES = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in row)) for i, row in enumerate(NOTICES))
_ORACLE = f"""
WITH texts AS (
  SELECT 0 AS kind, CAST(doc_id AS BIGINT) AS id, text FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT 1, t, text FROM (VALUES {_VALUES}) v(t, license, text)),
w AS (SELECT kind, id, list_filter(string_split_regex(lower(text), '{_SPLIT}'), lambda x: x <> '') AS w FROM texts),
s AS (SELECT kind, id, i AS pos, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS sh
      FROM (SELECT kind, id, w, unnest(range(greatest(0, len(w) - 2))) AS i FROM w)),
t AS (SELECT id AS t, sh, min(pos) AS o, count(*) OVER (PARTITION BY id) AS n FROM s WHERE kind = 1 GROUP BY id, sh),
h AS (SELECT s.id, t.t, t.n, s.pos, t.o FROM s JOIN t USING (sh) WHERE s.kind = 0),
c AS (SELECT DISTINCT id, t, n, pos - o AS start FROM h),
r AS (SELECT c.id, c.t, c.n, c.start, count(DISTINCT h.o) / c.n AS share
      FROM c JOIN h ON h.id = c.id AND h.t = c.t AND h.pos BETWEEN c.start - {SLACK} AND c.start + c.n - 1 + {SLACK}
      GROUP BY c.id, c.t, c.n, c.start HAVING count(DISTINCT h.o) / c.n >= {LEAST}),
k AS (SELECT * FROM r x WHERE NOT EXISTS (
  SELECT 1 FROM r y WHERE y.id = x.id AND y.t <> x.t AND y.start < x.start + x.n AND x.start < y.start + y.n
    AND (y.share > x.share OR y.share = x.share AND (y.n > x.n OR y.n = x.n AND y.t < x.t)))),
l AS (SELECT k.id, v.license, k.share, k.start FROM k JOIN (VALUES {_VALUES}) v(t, license, text) USING (t))
SELECT id AS doc_id, license, max(share) AS containment,
  CAST(min(start) FILTER (WHERE share = best) AS INTEGER) AS first_word
FROM (SELECT *, max(share) OVER (PARTITION BY id, license) AS best FROM l) GROUP BY id, license"""

QUERIES = {"op9_licenses": op9_licenses}
ORACLE = {"op9_licenses": _ORACLE}
