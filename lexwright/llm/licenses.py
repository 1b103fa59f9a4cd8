"""License scan: a positional index of rare licence words.

No Python runs on the executors, and nothing is shuffled: each text is folded to
words once.  A file's own licence words of highest IDF are looked up in an index that has
every place of each of them in every template; postings shifted by the file's positions
are intersected by sorting, so the work grows with a file's rare licence words and not
with the number of templates.  The key phrase is then verified at the alignment.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwright.llm.common import ascii_lower

#: Base phrases and their labels (fixed values of the output contract).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, words of the template, mandatory key phrase), from the notices and titles of the licences themselves (fixed values).
#: The key phrase must stand in the file at the template's own place.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "apache license version 2 0 january 2004", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses license 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "will the authors be held liable"),
    ("bsl-1", "boost software license version 1 0 august 17th 2003", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "gnu general public license version 3 29 june 2007", "gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license", "either version 3 of the license"),
    ("gpl-2", "gnu general public license version 2 june 1991", "gnu general public license version 2"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license", "either version 2 of the license"),
    ("lgpl-3", "gnu lesser general public license version 3 29 june 2007", "gnu lesser general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license version 3 19 november 2007", "gnu affero general public license version 3"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2"),
    ("cc0-1", "creative commons cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "attribution noncommercial sharealike"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0", "spdx license identifier apache 2"),
    ("gpl-2", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2"),
    ("gpl-3", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3"),
    ("lgpl-3", "spdx license identifier lgpl 3 0", "spdx license identifier lgpl 3"),
    ("agpl-3", "spdx license identifier agpl 3 0", "spdx license identifier agpl 3"),
    ("bsd-3", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 3 clause"),
    ("bsd", "spdx license identifier bsd 2 clause", "spdx license identifier bsd 2 clause"),
    ("mpl-2", "spdx license identifier mpl 2 0", "spdx license identifier mpl 2"),
    ("isc", "spdx license identifier isc", "spdx license identifier isc"),
]

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How many of a template's highest-IDF words are indexed at least; an alignment needs two places of indexed words.
INDEXED = 3


class Index:
    """The licence words of highest IDF, and where each of them stands in which template."""

    def __init__(self, templates: list[tuple[str, str, str]]):
        self.words = [words.split() for _, words, _ in templates]
        df = Counter(w for words in self.words for w in set(words))
        self.idf = {w: round(1000 * math.log(1 + len(templates) / n)) for w, n in df.items()}
        # ties go to the word that stands first
        self.rare = {w for words in self.words for w in sorted(dict.fromkeys(words), key=lambda w: -self.idf[w])[:INDEXED]}
        self.postings = {w: [(t, q) for t, words in enumerate(self.words) for q, x in enumerate(words) if x == w] for w in sorted(self.rare)}
        keys = [k.split() for _, _, k in templates]
        self.key_at = [next(i for i in range(len(w)) if w[i : i + len(k)] == k) for w, k in zip(self.words, keys)]
        self.key_size = [len(k) for k in keys]
        self.mass = [sum(self.idf[w] for w in words) for words in self.words]


#: An alignment is one number: template, and the file's position of the template's first word (which may be before the file).
_SHIFT, _BEFORE = 33, 1 << 20


def _numbers(values: list[int]) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _candidates(index: Index) -> Column:
    """Alignments that two places of indexed words agree on: the postings of the file's rare words, shifted to the template's start."""
    posts = F.create_map(*[x for w, ps in index.postings.items() for x in (F.lit(w), F.array(*[F.lit((t << _SHIFT) - q + _BEFORE) for t, q in ps]))])
    starts = F.sort_array(F.flatten(F.transform("__hits", lambda h: F.transform(F.element_at(posts, h["w"]), lambda p: p + h["i"]))))
    return _let(starts, lambda a: F.array_distinct(F.filter(a, lambda x, j: F.coalesce(F.get(a, j - 1) == x, F.lit(False)))))


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _verified(index: Index) -> Column:
    """(template, share of its IDF mass) of each candidate at which the key phrase stands."""
    flat = F.split(F.lit(" ".join(w for words in index.words for w in words)), " ")
    idf = _numbers([index.idf[w] for words in index.words for w in words])
    first = _numbers([sum(map(len, index.words[:t])) for t in range(len(index.words))])
    size, mass, key_at, key_size = (_numbers(x) for x in (list(map(len, index.words)), index.mass, index.key_at, index.key_size))

    def look(x: Column) -> Column:
        t = F.shiftright(x, _SHIFT).cast("int")
        start = (x.bitwiseAND(F.lit((1 << _SHIFT) - 1)) - _BEFORE).cast("int")
        word = lambda j: F.get("__words", start + j.cast("int")) == F.get(flat, (F.get(first, t) + j).cast("int"))
        key = F.forall(F.sequence(F.get(key_at, t), F.get(key_at, t) + F.get(key_size, t) - 1), lambda j: F.coalesce(word(j), F.lit(False)))
        held = F.aggregate(F.sequence(F.lit(0).cast("long"), F.get(size, t) - 1), F.lit(0).cast("long"), lambda acc, j: acc + F.when(word(j), F.get(idf, (F.get(first, t) + j).cast("int"))).otherwise(0))
        return F.when(key, F.struct(t.alias("t"), (held / F.get(mass, t).cast("double")).alias("share")))

    return F.array_compact(F.transform("__starts", look))


def scan_licenses(docs: DataFrame, text: str = "text", accept: float = 0.6) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score to every row.

    Base: all places where a base phrase's words stand consecutively.  Method: labels of
    templates of which at least ``accept`` of the IDF mass stands at one alignment with
    the mandatory key phrase; score is the best such share.  Null and wordless texts have
    no words, empty labels, score 0 and null places.  Columns of these names are replaced.
    """
    index = Index(TEMPLATES)
    vocabulary = sorted(index.rare)
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [c for c in docs.columns if c not in new or c == text]
    folded = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), SEPARATORS, " "))
    d = docs.select(*[F.col(f"`{c}`") for c in kept], folded.alias("__folded"))
    # every word stands between two spaces of its own, so that neighbouring matches share none
    d = d.withColumn("__wide", F.concat(F.lit(" "), F.replace("__folded", F.lit(" "), F.lit("  ")), F.lit(" ")))
    spaces = lambda c: (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))) / 2
    d = d.withColumn("n_words", F.when(F.col("__folded") == "", 0).otherwise(spaces(F.col("__wide"))).cast("long"))
    counts, first, last, names = [], [], [], []
    for phrase, label in BASE.items():
        wide = " " + phrase.replace(" ", "  ") + " "
        n = ((F.octet_length("__wide") - F.octet_length(F.replace("__wide", F.lit(wide), F.lit("")))) / len(wide)).cast("long")
        counts.append(n)
        found = F.col("__wide").contains(wide)
        first.append(F.when(found, spaces(F.substring_index("__wide", wide, 1)).cast("long")))
        last.append(F.when(found, F.col("n_words") - spaces(F.substring_index("__wide", wide, -1)).cast("long") - len(phrase.split())))
        names.append(F.when(found, F.lit(label)))
    d = d.withColumns(
        {
            "n_base": reduce(lambda a, b: a + b, counts), "first_word": F.least(*first), "last_word": F.greatest(*last),
            "__names": F.array_compact(F.array(*names)),
            "__words": F.when(F.col("__folded") != "", F.split("__folded", " ")).otherwise(F.array().cast("array<string>")),
            "__may": reduce(lambda a, b: a | b, [F.col("__wide").contains(f" {w} ") for w in vocabulary]),
        }
    )
    hits = F.filter(F.transform("__words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(vocabulary))
    d = d.withColumn("__hits", F.when(F.col("__may"), hits).otherwise(F.array().cast("array<struct<i:int,w:string>>")))
    # texts with fewer than two places of rare licence words go no further
    some = F.size("__hits") > 1
    d = d.withColumn("__starts", F.when(some, _candidates(index)).otherwise(F.array().cast("array<long>")))
    d = d.withColumn("__found", F.when(F.size("__starts") > 0, _verified(index)).otherwise(F.array().cast("array<struct<t:int,share:double>>")))
    label = F.split(F.lit(",".join(x for x, _, _ in TEMPLATES)), ",")
    more = F.transform(F.filter("__found", lambda x: x["share"] >= accept), lambda x: F.get(label, x["t"]))
    every = F.array_sort(F.array_distinct(F.concat("__names", more)))
    return d.select(
        *[F.col(f"`{c}`") for c in kept], "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("__names")), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce(F.array_max(F.transform("__found", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
