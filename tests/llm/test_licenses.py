"""License rules one by one, and all of them against a plain search."""

import random
import re

from tidemark.llm import licenses

SIGNATURES = licenses._signatures()


def sample(pattern):
    """A text that the pattern names: the first of alternatives, all that may be left out."""
    text = re.sub(r"\[a-z0-9 \]\{1,\d+\}\?", "the example project", pattern)
    text = re.sub(r"\[0-9 \]\{0,\d+\}\?", "2006 ", text)
    for varying, said in ((r"\[1-4\]", "4"), (r"\[05\]", "0"), (r"\[12\]", "2"), (r"\[0-9\]", "3")):
        text = re.sub(varying, said, text)
    while "(?:" in text:
        text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)
    return re.sub(r"(?<=[a-z ])\?", "", text)


def normalised(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", low).strip()


def plain(text, rules=licenses.RULES):
    norm = f" {normalised(text)} "
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
            first = norm[:m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" "), -r.priority, k, r))
    kept = []
    for a in found:
        def hides(b):
            if b is a or not (b[0] <= a[0] and b[1] >= a[1]) or b[4].priority < a[4].priority:
                return False
            if (b[0], b[1]) != (a[0], a[1]):
                return True
            return (b[2], b[3]) < (a[2], a[3])
        if a[4].base or not any(map(hides, found)):
            kept.append(a)
    base = [x for x in kept if x[4].base]
    said = lambda xs: ",".join(sorted({x[4].label for x in xs}))
    words = normalised(text).split(" ") if normalised(text) else []
    return (len(words), len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None), said(base),
            said(kept), max((x[4].confidence for x in kept), default=0.0), len(kept))


def test_more_than_two_hundred_signatures_and_a_sample_of_each(spark):
    distinct = {r.pattern for r in SIGNATURES} | {name for _, name, _ in licenses._NAMES} | {r.pattern for r in licenses._NOTICES}
    assert len(SIGNATURES) == len({r.pattern for r in SIGNATURES}) > 130 and len(distinct) > 200
    rows = [(k, f"Some words. {sample(r.pattern).capitalize()}!\n") for k, r in enumerate(SIGNATURES)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, r in enumerate(SIGNATURES):
        assert re.fullmatch(r.pattern, sample(r.pattern)), r.pattern
        assert r.label in plain(rows[k][1])[5].split(",") or got[k]["score"] >= r.confidence, (r.label, rows[k])
        assert tuple(got[k])[1:] == plain(rows[k][1]), rows[k]


def test_against_a_plain_search(spark):
    rng = random.Random(4)
    pieces = [sample(r.pattern) for r in SIGNATURES] + ["licensed under the Apache License, Version 2.0", "CC BY-NC-SA 4.0", "cc by",
              "All Rights Reserved.", "(c) Copyright 2001-2004", "SPDX-License-Identifier: GPL-3.0", "the MIT licence", "in the public domain",
              "released under the BSD", "general public license", "all rights", "été", "word", "license", "only", "1", "--", "\n\n"]
    rows = [(k, rng.choice([" ", ". ", "\n"]).join(rng.choices(pieces, k=rng.randint(0, 9)))) for k in range(250)]
    rows += [(250, None), (251, ""), (None, "cc by cc by"), (252, "\x01 all rights reserved \x01"), (252, "$0 \\ all rights reserved")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, norm string")
    got = sorted(map(str, map(tuple, licenses.scan(docs).collect())))
    assert got == sorted(str((i, *plain(t))) for i, t in rows)
