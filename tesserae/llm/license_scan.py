"""Licence scans with a positional index of the templates' key phrases.

Of each template the word of its key phrase with the highest IDF in the corpus is looked up, in every file and at every
place: a place p of such a word, q words behind the template's beginning, proposes that it begins at p - q. A proposal is then checked word by word against the template, words
weighed by IDF, and counts only if the template's key phrase stands whole at its place. All of it happens inside the row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import ascii_lower, table, whole_text, words

#: Characters that words are not made of.
OUTSIDE = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Base phrases and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Template: label, text, key phrase. The texts are how the licences announce themselves (fixed values).
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc", "this work is licensed under a creative commons attribution", "creative commons attribution"),
    ("public-domain", "this is free and unencumbered software released into the public domain", "into the public domain"),
)
#: Template words that say nothing about a licence; they count when a proposal is checked but are never looked up.
FUNCTION_WORDS = set("a and any are as at by can for form free in into is it may of or person that the this to under use with without you work".split())
#: The weighed share of a template that must stand in its place.
COVER = 0.6
Template = tuple[str, str, str]


def _key_places(templates: Sequence[Template]) -> list[int]:
    """Where each template's key phrase begins, in words. It must stand in the template and have a word that is looked up."""
    out = []
    for label, text, key in templates:
        t, k = text.split(), key.split()
        places = [i for i in range(len(t)) if k and t[i : i + len(k)] == k]
        if not places or set(k) <= FUNCTION_WORDS:
            raise ValueError(f"the key phrase of a template of {label} isn't in it or says nothing")
        out.append(places[0])
    return out


def word_counts(df: DataFrame, found: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows, and for each licence word in how many rows of `found` it stands: as many numbers as the templates have words."""
    sums = [F.sum(F.array_contains(found, w).cast("bigint")).alias(f"c{i}") for i, w in enumerate(vocabulary)]
    row = df.where(F.size(found) > 0).agg(*sums).first()
    return df.count(), {w: row[i] or 0 for i, w in enumerate(vocabulary)}


def _literal(values: list, kind: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")


def scan(df: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """All rows of `df` with lic_n_words, lic_n_base, lic_first_word, lic_last_word, lic_base_labels, lic_labels, lic_score.

    Base labels come from consecutive words alone; lic_labels adds the templates that pass. The score is 1 where a base
    phrase stands, else the largest weighed share of a template that passed, else 0. Null texts are empty: no words, no
    labels (empty strings), null places. Rows are independent of each other but for the corpus-wide IDF. No rows: no rows.
    The work is in proportion to a text's words, whatever they are. Columns of `df` with these names are replaced.

    `templates`: (label, text, key phrase), of lower-case words with single spaces; a text may be a whole licence.
    """
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    body = ascii_lower(whole_text(text))
    rows = df.withColumn("_lic_w", words(body, OUTSIDE))
    placed = F.transform("_lic_w", lambda w, i: F.struct(w.alias("w"), i.alias("p")))
    anchors = sorted(w for w in vocabulary if w not in FUNCTION_WORDS)
    rows = rows.withColumn("_lic_hits", F.filter(placed, lambda x: x.w.isin(anchors)))
    # the corpus statistics: one pass that keeps only sums
    seen = df.select(F.array_distinct(F.filter(words(body, OUTSIDE), lambda w: w.isin(anchors))).alias("found"))
    n, counts = word_counts(seen, "found", vocabulary)
    idf = {w: math.log((n + 1) / (counts[w] + 1)) + 0.01 for w in vocabulary}
    # a template counts only where its key phrase stands, so the rarest word of each key phrase finds all its places
    lead: dict[str, list[tuple[int, int]]] = {}
    for t, ((_, _, key), start) in enumerate(zip(templates, _key_places(templates))):
        w, q = min(((w, start + i) for i, w in enumerate(key.split()) if w not in FUNCTION_WORDS), key=lambda x: (-idf[x[0]], x))
        lead.setdefault(w, []).append((t, q))
    lists = F.create_map(*(x for w in sorted(lead) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in lead[w])))))
    proposed = F.flatten(
        F.transform(
            F.filter("_lic_hits", lambda x: x.w.isin(sorted(lead))),
            lambda x: F.transform(F.element_at(lists, x.w), lambda y: F.struct(y.t.alias("t"), (x.p - y.q).alias("o"))),
        )
    )
    rows = rows.withColumn("_lic_try", F.when(F.size("_lic_hits") > 0, proposed))
    texts = F.array(*(_literal(text.split(), "string") for _, text, _ in templates))
    # function words weigh little, however rare they are in the corpus
    shares = F.array(*(_literal(_shares(text.split(), idf), "double") for _, text, _ in templates))
    keys = F.array(*(_literal(key.split(), "string") for _, _, key in templates))
    starts = _literal(_key_places(templates), "int")
    w = F.col("_lic_w")

    def checked(x: Column) -> Column:
        template, share = F.get(texts, x.t), F.get(shares, x.t)
        weighed = F.zip_with(F.transform(template, lambda v, q: F.coalesce(F.get(w, x.o + q) == v, F.lit(False))), share, lambda same, s: F.when(same, s).otherwise(0.0))
        cover = F.aggregate(weighed, F.lit(0.0), lambda a, s: a + s)
        key = F.forall(F.transform(F.get(keys, x.t), lambda v, q: F.coalesce(F.get(w, x.o + F.get(starts, x.t) + q) == v, F.lit(False))), lambda same: same)
        return F.struct(x.t.alias("t"), F.when(key, cover).otherwise(0.0).alias("cover"))

    rows = rows.withColumn("_lic_passed", F.when(F.size("_lic_try") > 0, F.filter(F.transform("_lic_try", checked), lambda x: x.cover >= COVER)))
    places = [_places(w, phrase.split(), label) for phrase, label in PHRASES.items()]
    rows = rows.withColumn("_lic_base", F.when(F.size("_lic_hits") > 0, F.concat(*places)))
    names = _literal([label for label, _, _ in templates], "string")
    none = F.array().cast("array<string>")
    base = F.coalesce(F.array_distinct(F.transform("_lic_base", lambda x: x.label)), none)
    more = F.coalesce(F.transform("_lic_passed", lambda x: F.get(names, x.t)), none)
    best = F.coalesce(F.array_max(F.transform("_lic_passed", lambda x: x.cover)), F.lit(0.0))
    made = {
        "lic_n_words": F.size("_lic_w").cast("bigint"),
        "lic_n_base": F.coalesce(F.size("_lic_base"), F.lit(0)).cast("bigint"),
        "lic_first_word": F.array_min(F.transform("_lic_base", lambda x: x.p)).cast("bigint"),
        "lic_last_word": F.array_max(F.transform("_lic_base", lambda x: x.p)).cast("bigint"),
        "lic_base_labels": F.array_join(F.array_sort(base), ","),
        "lic_labels": F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ","),
        "lic_score": F.when(F.size("_lic_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), best)),
    }
    return rows.withColumns(made).drop("_lic_w", "_lic_hits", "_lic_try", "_lic_passed", "_lic_base")


def _places(w: Column, phrase: list[str], label: str) -> Column:
    """(p, label) for each place p at which the phrase's words stand consecutively."""

    def there(x: Column) -> Column:
        return _all([x.w == phrase[0], *(F.coalesce(F.get(w, x.p + i) == v, F.lit(False)) for i, v in enumerate(phrase) if i)])

    return F.transform(F.filter("_lic_hits", there), lambda x: F.struct(x.p.alias("p"), F.lit(label).alias("label")))


def _shares(template: list[str], idf: dict[str, float]) -> list[float]:
    weight = [0.25 if w in FUNCTION_WORDS else idf[w] for w in template]
    return [x / sum(weight) for x in weight]


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]
    return found.select("doc_id", *(F.col(f"lic_{c}").alias(c) for c in names), F.round("lic_score", 9).alias("score"))


def _sql() -> str:
    """The scan as DuckDB SQL, for tables whose ids are unique."""
    keys = _key_places(TEMPLATES)
    rows = []
    for t, (label, text, key) in enumerate(TEMPLATES):
        inside = range(keys[t], keys[t] + len(key.split()))
        rows += [f"({t}, '{label}', {q}, '{w}', {str(w in FUNCTION_WORDS).lower()}, {str(q in inside).lower()})" for q, w in enumerate(text.split())]
    base = " UNION ALL ".join(
        f"SELECT doc_id, p, '{label}' AS label FROM hits JOIN d USING (doc_id) WHERE word = '{phrase.split()[0]}' AND " + " AND ".join(f"w[p + {i + 1}] = '{x}'" for i, x in enumerate(phrase.split()) if i)
        for phrase, label in PHRASES.items()
    )
    return f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{OUTSIDE}]+'), lambda x: x <> '') AS w FROM documents),
tpl(t, label, q, word, func, key) AS (VALUES {", ".join(rows)}),
voc AS (SELECT DISTINCT word, func FROM tpl),
hits AS (SELECT doc_id, word, p FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) JOIN voc USING (word) WHERE NOT func),
df AS (SELECT word, count(DISTINCT doc_id) AS c FROM hits GROUP BY word),
idf AS (SELECT voc.word, CASE WHEN func THEN 0.25 ELSE ln(((SELECT count(*) FROM d) + 1) / CAST(coalesce(c, 0) + 1 AS DOUBLE)) + 0.01 END AS v FROM voc LEFT JOIN df ON df.word = voc.word),
lead AS (SELECT * FROM (SELECT tpl.t, tpl.q, tpl.word, row_number() OVER (PARTITION BY tpl.t ORDER BY v DESC, tpl.word, tpl.q) AS k FROM tpl JOIN idf ON idf.word = tpl.word WHERE tpl.key AND NOT tpl.func) WHERE k = 1),
tries AS (SELECT DISTINCT h.doc_id, lead.t, h.p - lead.q AS o FROM hits h JOIN lead ON lead.word = h.word),
share AS (SELECT tpl.*, v / sum(v) OVER (PARTITION BY t) AS s FROM tpl JOIN idf ON idf.word = tpl.word),
cover AS (
  SELECT doc_id, t, o, any_value(label) AS label, sum(CASE WHEN same THEN s ELSE 0 END) AS cover, bool_and(same OR NOT key) AS whole
  FROM (SELECT z.doc_id, z.t, z.o, label, s, key, o + q >= 0 AND coalesce(w[o + q + 1] = word, false) AS same FROM tries z JOIN share x ON x.t = z.t JOIN d ON d.doc_id = z.doc_id)
  GROUP BY doc_id, t, o),
passed AS (SELECT doc_id, label, cover FROM cover WHERE whole AND cover >= {COVER}),
base AS ({base}),
b AS (SELECT doc_id, count(*) AS n, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM passed) GROUP BY doc_id),
c AS (SELECT doc_id, max(cover) AS cover FROM passed GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, round(CASE WHEN b.n > 0 THEN 1.0 ELSE least(1.0, coalesce(c.cover, 0)) END, 9) AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


SQL = _sql()
