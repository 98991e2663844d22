"""Licence scans: held-out phrasings, brute force against the trained model, defined cases."""

import re
import textwrap

import numpy as np
import pytest

from sphaera.llm import license_scan as m

SCHEMA = "doc_id bigint, text string, row string, line string, gram string"
PLAIN = [f"the old house by the river number {i} was built of stone and is for this town" for i in range(60)] + [f"a work of {i} that you may see in any form and with others under the terms" for i in range(40)]
MODEL = m.train(PLAIN)


def brute(text):
    out = []
    for line in (text or "").split("\n"):
        w = m.words(line)
        if not set(re.split("[^a-z0-9\u0080-\U0010ffff]+", line.lower())) & set(MODEL.cues):
            continue
        e = np.exp(MODEL.scores(w) - MODEL.scores(w).max())
        p = e / e.sum()
        if p[0] >= 0.5:
            continue
        k = int(p[2:].argmax()) + 2
        like = max(len(m.pairs(w) & m.pairs(m.words(t))) / len(m.pairs(m.words(t))) for t in m.TEMPLATES[MODEL.classes[k]])
        out.append(MODEL.classes[k] if p[k] >= MODEL.threshold and like >= m.CONFIRM else m.UNKNOWN)
    return sorted(set(out)), len(out)


@pytest.mark.parametrize(
    ("line", "family"),
    [
        ("Released under the MIT License.", ["mit"]), ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]), ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]), ("licensed under cc by 4.0", ["cc-by"]),
        ("Code here is released under the MIT license, and so are its docs.", ["mit"]), ("Licensed under the Foo Bar License, see below.", ["unknown"]), ("All rights reserved.", ["unknown"]),
        ("the old house by the river", []), ("He was granted a free copy.", None),
    ],
)
def test_families(spark, line, family):
    docs = spark.createDataFrame([(1, f"Some text first.\n{line}\nand more", "", "", "")], SCHEMA)
    row = m.scan(docs, model=MODEL).first()
    assert (row.families, row.n_paragraphs) == brute(f"Some text first.\n{line}\nand more")
    assert family is None or row.families == family


def test_many_against_brute_force(spark):
    r = np.random.default_rng(3)
    # blank lines keep the paragraphs apart: lines next to each other may be one wrapped notice
    lines = PLAIN + [x for own in m.TEMPLATES.values() for x in own] + list(m.UNNAMED)
    texts = ["\n\n".join(" ".join(w for w in lines[int(k)].split(" ") if r.random() > 0.1) for k in r.integers(0, len(lines), 5)) for _ in range(60)]
    texts += [None, "", "\n\n", "license " * 30_000, "ünïcödé Lizenz"]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)] + [(0, texts[0], "", "", ""), (None, texts[1], "", "", "")], SCHEMA)
    found = m.scan(docs, model=MODEL).collect()
    assert len(found) == len(texts) + 2
    for row in found:
        assert (row.families, row.n_paragraphs) == brute(texts[1 if row.doc_id is None else row.doc_id])


def test_empty_table_and_no_python(spark):
    docs = spark.createDataFrame([], SCHEMA)
    out = m.scan(docs)
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
}


def test_notices_in_the_sample_stay_licences(spark):
    model = m.train(PLAIN + list(NOTICES.values()))
    assert all(set(m.words(x)) & set(model.cues) for own in m.TEMPLATES.values() for x in own)
    docs = spark.createDataFrame([(i, f"some text\n\n{t}", "", "", "") for i, t in enumerate(NOTICES.values())], SCHEMA)
    assert {r.doc_id: r.families for r in m.scan(docs, model=model).collect()} == {i: [k] for i, k in enumerate(NOTICES)}


REAL = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
}


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices(spark, mark):
    other = "the software and all associated documentation files, free of charge,"
    texts = {k: "some text before\n\n" + "\n".join(textwrap.wrap(t, 40, initial_indent=mark, subsequent_indent=mark)) + "\n\nand more" for k, t in REAL.items()}
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate([*texts.values(), "Permission is hereby granted, to any person\n\n" + other])], SCHEMA)
    found = {r.doc_id: r.families for r in m.scan(docs, model=MODEL).collect()}
    assert [found[i] for i in range(len(texts))] == [[k] for k in texts]
    assert "mit" not in found[len(texts)]


def test_lines_without_a_cue_score_as_an_empty_one():
    assert all(set(g.split(" ")) & set(MODEL.cues) for g in MODEL.vocabulary)
    for line in PLAIN:
        if not set(m.words(line)) & set(MODEL.cues):
            assert (MODEL.scores(m.words(line)) == MODEL.bias).all()
    assert MODEL.bias.argmax() == 0


def test_unseen_templates_are_taken_for_licences():
    n, licence, right = m.unseen_templates(PLAIN)
    assert n > 100 and licence > 0.9 * n and right > 0.5 * n


def test_plain_sentences_with_licence_words(spark):
    """Sentences that the fit has not seen, and two licences among them."""
    lines = ["My sister got her hunting license in May.", "The license of the taxi driver had expired.", "He lost his license again.", "Copyright is a matter of law."]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate([*lines, "Copyright 2021, all rights reserved.", "Redistribution in any form is prohibited."])], SCHEMA)
    assert {r.doc_id: r.families for r in m.scan(docs, model=MODEL).collect()} == {0: [], 1: [], 2: [], 3: [], 4: ["unknown"], 5: ["unknown"]}


def test_calibration_moves_the_threshold():
    """It depends on the held-out examples, and is not the end of its range."""
    assert 0.2 < MODEL.threshold < 0.99 and len({round(m.train(PLAIN, seed=s).threshold, 3) for s in (5, 6, 7)}) > 1


def test_many_notices_and_long_lines(spark):
    """Thousands of wrapped notices in one text, and a line of megabytes with a notice in it."""
    notice = textwrap.wrap(REAL["isc"], 60)
    many = "\n\n".join("\n".join(notice) for _ in range(2000))
    long = "the old house " * 100_000 + " Released under the MIT License. " + "by the river " * 100_000
    docs = spark.createDataFrame([(1, many, "", "", ""), (2, long, "", "", "")], SCHEMA)
    found = {r.doc_id: (r.families, r.n_paragraphs) for r in m.scan(docs, model=MODEL).collect()}
    assert found == {1: (["isc"], 2000), 2: (["mit"], 1)}


def test_probabilities_are_calibrated():
    """Of fresh variants judged with a probability of 0.8 or more, that share at least is right."""
    r, plain = np.random.default_rng(99), [m.words(x) for x in PLAIN]
    judged = []
    for k, name in enumerate(MODEL.classes[2:], 2):
        for x in m.TEMPLATES[name]:
            for t in m._variants(m.words(x), plain, r, 6):
                p = m._softmax(MODEL.scores(t))
                judged.append((p.max(), int(p.argmax()) == k))
    sure = [right for p, right in judged if p >= 0.8]
    assert len(sure) > 0.5 * len(judged) and np.mean(sure) > 0.8
