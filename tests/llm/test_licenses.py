"""Licence notices as files have them, and the index against a plain search."""

import math
import re
from collections import Counter

from lexwright.llm import licenses

NOTICES = {
    "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n": "gpl-3",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3",
    "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License": "gpl-2",
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
    "# SPDX-License-Identifier: GPL-3.0-only": "gpl-3",
    "// SPDX-License-Identifier: MIT": "mit",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without": "bsd-3",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "Licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "Licensed under the Apache License, Version 2.0 (the License)": "apache-2",
}
PLAIN = ["", None, "the license of the driver", "a mozilla public house", "version 3 of the plan", "free of charge", "software is provided to any person", "spdx"]


def brute(text, accept=0.6):
    """Every template at every place, without an index."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    bodies = [b.split() for _, b, _ in licenses.TEMPLATES]
    df = Counter(w for b in bodies for w in set(b))
    idf = {w: round(1000 * math.log(1 + len(bodies) / n)) for w, n in df.items()}
    rare = set()
    for b in bodies:
        rare |= set(sorted(sorted(set(b), key=b.index), key=lambda w: -idf[w])[:3])
    best, labels = 0.0, set()
    for (label, _, key), b in zip(licenses.TEMPLATES, bodies):
        k = key.split()
        at = next(i for i in range(len(b)) if b[i : i + len(k)] == k)
        for s in range(-len(b), len(words)):
            same = [q for q in range(len(b)) if 0 <= s + q < len(words) and words[s + q] == b[q]]
            if sum(b[q] in rare for q in same) >= 2 and set(range(at, at + len(k))) <= set(same):
                share = sum(idf[b[q]] for q in same) / float(sum(idf[w] for w in b))
                best = max(best, share)
                if share >= accept:
                    labels.add(label)
    return labels, best


def test_notices(spark):
    """Each notice alone, within other words, with words left out, twice, and all in one text."""
    filler = "so they came and went " * 20
    texts = list(NOTICES) + [filler + n + "\n" + filler for n in NOTICES] + [n.replace("the ", "", 1) for n in NOTICES] + [n + " x " + n for n in NOTICES] + PLAIN + ["\n".join(NOTICES)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    for i, t in enumerate(texts):
        labels, best = brute(t)
        base = {label for p, label in licenses.BASE.items() if f" {p} " in " " + " ".join(re.findall("[a-z0-9]+", (t or "").lower())) + " "}
        assert got[i].labels == ",".join(sorted(labels | base)), (t, got[i].labels)
        assert abs(got[i].score - best) < 1e-12
    n = len(NOTICES)
    for i, label in enumerate(NOTICES.values()):
        assert label in got[i].labels.split(",") and label in got[n + i].labels.split(",") and label in got[3 * n + i].labels.split(",")
    assert all(got[4 * n + i].labels == "" for i in range(len(PLAIN)))
    assert set(got[4 * n + len(PLAIN)].labels.split(",")) == set(NOTICES.values())
