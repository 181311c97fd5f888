import random
import re

import pytest

from seqloom.llm import licenses as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Released under the MIT License.", "x\nUnder the mit license under-the MIT license!", "Licensed under the Apache License, Version 2.0.", "apache license version 21", "Licensed under CC BY-NC 4.0.",
    "CC BY\n\nNC", "This work is licensed under the GNU General Public License, version 3.", "This work is under the GNU General Public License version 3", "undér the mit license", "mit", None, "", "...",
    "the under license mit released", "Licensed under CC BY-SA 4.0. And the cc by nc, under THE mit license", "ünder the MIT License cc by nc cc by nc",
    "word " * 3000 + "under the mit license " + "tail " * 50,
]


def brute(text):
    t = (text or "").translate(LOWER)
    w = WORD.findall(t)
    starts, base = [], set()
    for label, phrase in L.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += at
        if at:
            base.add(label)
    more, score = windows(text or "")
    labels = set(filter(None, more.split(",")))
    join = lambda s: ",".join(sorted(s))
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), join(base), join(base | labels), 1.0 if starts else score)


def test_matches_brute_force(spark, docs, corpus, empty):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + i, r[1]) for i, r in enumerate(corpus)]
    got = {r.doc_id: tuple(r)[1:] for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == brute(t), t
    assert L.scan_licenses(docs).count() == len(corpus) and L.scan_licenses(empty).count() == 0


WRAPPED = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software", "mit"),
    ("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL", "mpl-2"),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0. If a copy */", "mpl-2"),
    ("Text before.\n\nLicensed under CC\nBY-SA 4.0.\nText after.", "cc-by-sa"),
    ("the of " * 3000 + "This work is licensed under\nthe GNU General Public License,\nversion 3.", "gpl-3"),
    # All words of a template, but far apart; and its words in a window with too many others.
    ("This source\ncode form is subject " + "word " * 50 + "\nto the terms of the Mozilla\nPublic License v. 2.0.", ""),
    ("licensed under one two\ncc three by four sa 4. 0", ""),
    ("licensed licensed under under\ncc cc by. by sa sa", ""),
]


def windows(text):
    w, labels, score = WORD.findall(text.translate(LOWER)), set(), 0.0
    for label, template in L.TEMPLATES:
        m, n = set(template.split()), -(-len(template.split()) * 10 // 9)
        if len(m & set(w)) < L.THRESHOLD * len(m) - 1e-9:
            continue
        share = max((len(set(w[i : i + n]) & m) for i in range(len(w))), default=0) / len(m)
        if share >= L.THRESHOLD - 1e-9:
            labels.add(label)
            score = max(score, share)
    return ",".join(sorted(labels)), score


def test_notices_over_several_lines(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WRAPPED)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.scan_licenses(rows).collect()}
    for i, (t, label) in enumerate(WRAPPED):
        assert got[i] == windows(t) and got[i][0] == label, t


def bodies(seed):
    """(label, text): each body among other words, wrapped as a comment in one of several styles, with a
    share of its words changed, lost or added to."""
    rng, out = random.Random(seed), []
    for label, body in L.BODIES:
        for share in (0.0, 0.02, 0.3):
            words = []
            for w in body.split():
                if rng.random() >= share:
                    words.append(w)
                elif rng.random() < 0.7:  # else the word is lost
                    words.append(f"x{rng.randrange(99)}")
            mark, wide = rng.choice(["", "# ", " * ", "// ", "; "]), rng.randint(4, 14)
            lines = [mark + " ".join(words[i : i + wide]) for i in range(0, len(words), wide)]
            around = [" ".join(f"of the w{rng.randrange(300)}" for _ in range(rng.randint(0, 300))) for _ in "ab"]
            out.append((label, share, f"{around[0]}\nCopyright (c) 2019 A. Name\n" + rng.choice(["\n", "\r\n"]).join(lines) + f"\n{around[1]}"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_bodies_wrapped_and_edited(spark, seed):
    """Bodies are found as brute force finds them: all that are whole or lightly edited, none with a
    third of their words changed; other labels only where a body holds another template."""
    made = bodies(seed)
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(made)], "doc_id long, text string")).collect()}
    within = {label: set(windows(body)[0].split(",")) for label, body in L.BODIES}
    assert len(within) >= 11 and within["bsd-3"] == {"bsd", "bsd-2", "bsd-3"} and within["mit"] == {"mit"}
    found = 0
    for i, (label, share, text) in enumerate(made):
        labels, score = windows(text)
        base = [k for k, phrase in L.PHRASES if f" {phrase} " in f" {L.plain_words(text)} "]
        assert got[i].labels == ",".join(sorted(set(labels.split(",")) - {""} | set(base))), (label, share)
        assert base or got[i].score == score
        met = set(filter(None, got[i].labels.split(",")))
        assert met <= within[label]
        if share == 0.0:
            assert met == within[label]
        found += share == 0.02 and label in met
    assert found == len(L.BODIES)


def test_no_templates(spark):
    rows = spark.createDataFrame([(1, "under the MIT license"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in L.scan_licenses(rows, templates=()).collect()}
    assert got == {1: ("mit", 1.0), 2: ("", 0.0), 3: ("", 0.0)}


def test_no_python_on_the_executors(docs):
    plan = L.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
