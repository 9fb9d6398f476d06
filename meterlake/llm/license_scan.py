"""License scan by a positional rare-token index, in DataFrame operations only.

A template is a label, its words and a mandatory key phrase inside them. A first pass counts
the documents that hold each licence word (the words of all templates), which gives integer
weights of inverse document frequency. A key phrase can only stand in a file that holds its
rarest word, so the index lists each key phrase under that one word, with the word's place in
it. The second pass looks up the rarest words that a file holds, each place of such a word
gives a place for the phrase by relative position, and the phrase is verified whole there. A
verified base phrase is a base label. A verified template is then laid over the file from that
place: its share is the weight of the template's words found at their relative positions, and
its label is given from ``min_share`` on. No row moves after the first pass's counts, which
are as many as the templates have words.

Defined cases: a null text is the empty text and has no words; a place of a base phrase counts
once for each phrase; overlapping places all count; rows repeating a doc_id are files of their
own; columns of the caller stay out of the result but for ``doc_id``; an empty table gives no
rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm._spark import free_name

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_SHARE = 0.6


class Template(NamedTuple):
    label: str
    text: str
    key: str  # words of the text, one after the other
    base: bool = False


# The base phrases, then usual notices of licences.
BASE = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
)
NOTICES = (
    Template("mit", "released under the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    Template("proprietary", "all rights reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """Maximal runs of digits, letters and characters beyond ASCII, A to Z lower-cased."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _place(template: Template) -> int:
    """Where the key phrase starts inside the template."""
    words, key = template.text.split(), template.key.split()
    found = [i for i in range(len(words)) if words[i : i + len(key)] == key]
    if not key or not found:
        raise ValueError(f"the key phrase of {template.label} is not in its text")
    return found[0]


def word_weights(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[str, int]:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each word of the templates, over all documents."""
    words = sorted({w for t in templates for w in t.text.split()})
    held = docs.select(F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, words))).alias("held"))
    # the total rides along as one more word, so the texts are read once
    counted = held.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}  # as many rows as the templates have words
    total = found.get("", 0)
    table = docs.sparkSession.createDataFrame([(w, total, found.get(w, 0)) for w in words], "word string, total long, df long")
    weighed = table.select("word", F.floor(F.log((F.lit(2) * F.col("total") + 2) / (F.lit(2) * F.col("df") + 1)) * 1000).cast("long").alias("weight"))
    return {r["word"]: r["weight"] for r in weighed.collect()}


def _index(templates: tuple[Template, ...], weights: dict[str, int]) -> list[dict]:
    """Each template under the rarest word of its key phrase (the first of equal ones)."""
    out = []
    for t in templates:
        key, words = t.key.split(), t.text.split()
        anchor = max(key, key=weights.__getitem__)
        out.append({"label": t.label, "base": t.base, "anchor": anchor, "at": key.index(anchor), "key": key, "from": _place(t), "words": words, "weights": [weights[w] for w in words]})
    return out


def _literal(entry: dict) -> Column:
    strings = lambda xs: F.array(*map(F.lit, xs))
    return F.struct(
        F.lit(entry["label"]).alias("label"), F.lit(entry["base"]).alias("base"), F.lit(entry["anchor"]).alias("anchor"), F.lit(entry["at"]).alias("at"), strings(entry["key"]).alias("key"),
        F.lit(entry["from"]).alias("from"), strings(entry["words"]).alias("words"), F.array(*[F.lit(w).cast("long") for w in entry["weights"]]).alias("weights"), F.lit(sum(entry["weights"])).cast("long").alias("whole"),
    )


def find_licenses(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = BASE + NOTICES, min_share: float = MIN_SHARE) -> DataFrame:
    """All columns of ``docs``, then ``w``, its words, and ``found``: label, base, start and share of each verified phrase.

    Where the caller has a column of such a name, the new one gets an underscore in front.
    """
    named, out = free_name(docs, "w"), free_name(docs, "found")
    entries = _index(templates, word_weights(docs, text, templates))
    anchors = sorted({e["anchor"] for e in entries})
    table = F.array(*map(_literal, entries))
    w = F.col(named)

    def share(t: Column, start: Column) -> Column:
        hit = F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0).cast("long"), lambda total, i: total + F.when(F.get(w, start + i) == F.get(t["words"], i), F.get(t["weights"], i)).otherwise(0))
        return F.when(t["whole"] > 0, hit / t["whole"]).otherwise(F.lit(1.0))

    def at(p: Column) -> Column:
        begins = lambda t: p - t["at"]
        fits = F.filter(table, lambda t: (t["anchor"] == F.get(w, p)) & (begins(t) >= 0) & (F.slice(w, F.greatest(begins(t), F.lit(0)) + 1, F.size(t["key"])) == t["key"]))
        return F.transform(fits, lambda t: F.struct(t["label"].alias("label"), t["base"].alias("base"), begins(t).alias("start"), share(t, begins(t) - t["from"]).alias("share")))

    split = docs.withColumn(named, words_of(F.col(text)))
    places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull())
    kind = "array<struct<label:string,base:boolean,start:int,share:double>>"
    looked = F.when(F.arrays_overlap(w, F.array(*map(F.lit, anchors))), F.filter(F.flatten(F.transform(places, at)), lambda f: f["base"] | (f["share"] >= min_share)).cast(kind))
    return split.withColumn(out, F.coalesce(looked, F.array().cast(kind)))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, min_share: float = MIN_SHARE) -> DataFrame:
    """Counts, places, labels and the best share of each file."""
    found = find_licenses(docs.select("doc_id", "text"), "text", templates, min_share).select("doc_id", F.size("w").cast("long").alias("n_words"), "found")
    base = F.filter("found", lambda f: f["base"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda f: f["label"]))), ",")
    starts = F.transform(base, lambda f: f["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = BASE + NOTICES, min_share: float = MIN_SHARE) -> str:
    rows = ", ".join(f"('{t.label}', {str(t.base).lower()}, string_split('{t.text}', ' '), string_split('{t.key}', ' '), {_place(t)})" for t in templates)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS k, * FROM (VALUES {rows}) AS v(label, base, ws, ks, f)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') AS w
  FROM documents
), vocab AS (SELECT DISTINCT unnest(ws) AS word FROM t), n AS (SELECT count(*) AS total FROM documents),
df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT r, unnest(w) AS word FROM d) JOIN vocab USING (word) GROUP BY word),
weight AS (SELECT word, floor(ln((2 * total + 2) / (2 * coalesce(df, 0) + 1)) * 1000)::bigint AS weight FROM vocab CROSS JOIN n LEFT JOIN df USING (word)),
part AS (SELECT k, unnest(range(0, len(ws))) AS i, unnest(ws) AS word FROM t), piece AS (SELECT k, i, word, weight FROM part JOIN weight USING (word)),
total AS (SELECT k, sum(weight) AS whole FROM piece GROUP BY k),
cand AS (SELECT r, k, w, f, label, base, ks, unnest(range(0, greatest(len(w) - len(ks) + 1, 0))) AS s FROM d, t WHERE list_has_all(w, ks)),
place AS (SELECT * EXCLUDE (ks) FROM cand WHERE w[s + 1:s + len(ks)] = ks),
share AS (
  SELECT r, place.k, s, any_value(label) AS label, any_value(base) AS base,
    CASE WHEN any_value(whole) > 0 THEN coalesce(sum(weight) FILTER (WHERE s - f + i >= 0 AND w[s - f + i + 1] = word), 0)::double / any_value(whole)::double ELSE 1.0 END AS share
  FROM place JOIN piece USING (k) JOIN total USING (k) GROUP BY r, place.k, s
), found AS (SELECT * FROM share WHERE base OR share >= {min_share}::double)
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::bigint AS n_words, (count(s) FILTER (WHERE base))::bigint AS n_base, (min(s) FILTER (WHERE base))::bigint AS first_word, (max(s) FILTER (WHERE base))::bigint AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0)::double AS score
FROM d LEFT JOIN found USING (r) GROUP BY r
"""
