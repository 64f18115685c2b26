"""Licence scan by a positional index of rare words.

Templates are sentences of licences with one mandatory key phrase each; base phrases are templates that are all key
phrase. Document frequencies of the templates' words are counted over the whole corpus. Each template has postings
under the two highest-IDF words of its key phrase, with their positions. A file's licence words are looked up, rarest
first: a template is proposed if the file has both of its words, each occurrence gives the template's start in the file,
and the starts that both postings give are kept. There the key phrase is verified word by word, and the rest of the
template's words are counted at their relative positions. Since the key phrase must be there whole, no place is missed
whichever of its words are indexed.

A label is found if its template's key phrase stands in the file and at least ``coverage`` of the template's words
stand at their positions. Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z is
lower-cased.

All work on the files is DataFrame functions; at most one count per template word (a few hundred) reaches the driver.

Defined cases: null and empty texts have no words and no labels (empty label strings, null positions, score 0);
repeated rows give one row each; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


# The base phrases, and sentences of well-known licences with their key phrases.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("mit", "released under the mit license", "mit license"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice shall be included"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses license 2 0"),
    Template("apache-2", "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "without warranties or conditions of any kind"),
    Template("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3"),
    Template("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2"),
    Template("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license as published"),
    Template("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license as published"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    Template("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "copy of the mpl was not distributed with this file"),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    Template("bsl-1", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    Template("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives 4 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy modify and or distribute this software"),
)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-casing beyond A-Z makes an ASCII letter of two characters only; texts with those take the slower way."""
    given = F.coalesce(text, F.lit(""))
    lower = F.when(given.rlike("[\u0130\u212a]"), F.translate(given, _UPPER, _LOWER)).otherwise(F.lower(given))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Texts with each word of a fixed vocabulary, over the whole corpus."""
    known = F.array(*map(F.lit, vocabulary))
    found = docs.select(F.explode(F.array_intersect(words(F.col(text_col)), known)).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in found}


def rarest(template: Template, frequency: dict[str, int]) -> list[tuple[str, int]]:
    """The key phrase's two highest-IDF words (one, if it has no other) and their positions in the template."""
    key = template.key.split()
    first = {w: k for k, w in reversed(list(enumerate(key)))}
    return [(w, template.key_at + first[w]) for w in sorted(first, key=lambda w: (frequency[w], first[w]))[:2]]


def _index(templates: tuple[Template, ...], frequency: dict[str, int]) -> Column:
    """The templates with their postings, those of the rarest words first."""

    def entry(t: Template) -> Column:
        (one, one_at), (two, two_at) = (rarest(t, frequency) * 2)[:2]
        return F.struct(
            F.lit(one).alias("one"), F.lit(one_at).alias("one_at"), F.lit(two).alias("two"), F.lit(two_at).alias("two_at"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
            F.lit(t.key_at).alias("key_at"), F.array(*map(F.lit, t.key.split())).alias("key"), F.array(*map(F.lit, t.words)).alias("words"),
        )

    return F.array(*map(entry, sorted(templates, key=lambda t: frequency[rarest(t, frequency)[0][0]])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, coverage: float = 0.6) -> DataFrame:
    """(id, n_words, places): places is an array of (label, base, start, coverage) of verified templates."""
    frequency = document_frequencies(docs, sorted({w for t in templates for w in t.key.split()}), text_col)
    index, anchors = _index(templates, frequency), sorted({w for t in templates for w, _ in rarest(t, frequency)})
    known = F.array(*map(F.lit, anchors))
    split = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).withColumn("own", F.array_intersect("w", known))
    asked = split.withColumn("proposed", F.filter(index, lambda t: F.array_contains(F.col("own"), t["one"]) & F.array_contains(F.col("own"), t["two"])))
    places = F.filter(F.transform(F.col("w"), lambda x, i: F.when(F.array_contains(F.col("own"), x), F.struct(x.alias("word"), i.alias("pos")))), lambda h: h.isNotNull())
    hits = asked.withColumn("hits", F.when(F.size("proposed") > 0, places))

    def starts(t: Column) -> Column:
        by_one, by_two = (F.transform(F.filter("hits", lambda h: h["word"] == t[name]), lambda h: h["pos"] - t[f"{name}_at"]) for name in ("one", "two"))
        return F.transform(F.array_intersect(by_one, by_two), lambda start: F.struct(start.alias("start"), t.alias("t")))

    candidates = F.flatten(F.transform("proposed", starts))
    in_place = F.filter(
        candidates,
        lambda c: F.when(c["start"] + c["t"]["key_at"] >= 0, F.slice(F.col("w"), F.greatest(c["start"] + c["t"]["key_at"], F.lit(0)) + 1, F.size(c["t"]["key"])) == c["t"]["key"]).otherwise(False),
    )
    measured = F.transform(
        in_place,
        lambda c: F.struct(
            c["t"]["label"].alias("label"), c["t"]["base"].alias("base"), c["start"].cast("long").alias("start"),
            (F.size(F.filter(F.transform(c["t"]["words"], lambda x, i: x == F.get(F.col("w"), c["start"] + i)), lambda same: same)) / F.size(c["t"]["words"])).alias("coverage"),
        ),
    )
    return hits.select("id", F.size("w").cast("long").alias("n_words"), F.filter(measured, lambda m: m["coverage"] >= coverage).alias("places"))


def report(scanned: DataFrame) -> DataFrame:
    """Per file: places of base phrases, their first and last start, base and all labels, the best coverage."""
    base = F.filter("places", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")

    return scanned.select(
        "id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda m: m["coverage"])), F.lit(0.0)).alias("score"),
    )
