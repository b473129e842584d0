"""Licence notices in other words than the ones that train and confirm: precision and recall, printed and held to a floor."""

from tesserae.llm import licenses
from tests.llm.test_llm import SF, got, table

#: Written for this test; none of these sentences stands among the operator's notices.
NOTICES = [
    ("mit", "This code is distributed under the MIT licence."), ("mit", "MIT License. Copyright 2020 A. Author."), ("mit", "The library is available as open source under the terms of the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of these files, to use, copy, modify and merge them without restriction."),
    ("gpl", "You can use this package under the terms of the GNU General Public License version 2 or later."), ("gpl", "Distributed under the GNU Affero General Public License v3.0."), ("gpl", "All scripts are licensed under the GPL v2."),
    ("gpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("apache", "This project uses the Apache License, Version 2.0."), ("apache", "Code is available under the Apache 2.0 license."), ("apache", "Licensed to the foundation under the Apache License, Version 2.0."),
    ("bsd", "Distributed under a 3-clause BSD license."), ("bsd", "Use of this source code is governed by a BSD license."), ("bsd", "Redistribution and use of these files in source and binary forms, with or without modification, are permitted."),
    ("cc", "Text on this page is available under the Creative Commons Attribution-ShareAlike License."), ("cc", "Images are licensed under CC BY-SA 3.0."), ("cc", "The photographs are licensed under a Creative Commons Attribution 4.0 licence."),
    ("mpl", "The files are subject to the terms of the Mozilla Public License version 2.0."), ("epl", "Made available under the terms of the Eclipse Public License, version 2.0."),
    ("isc", "This module is released under the ISC license."), ("unlicense", "The example files are free and unencumbered software in the public domain."),
]
OTHERS = [
    "The driver showed his license to the officer.", "A license to fish costs ten dollars.", "The public was invited to the general meeting.", "She graduated from MIT in 1999.",
    "The Apache helicopter landed near the village.", "Terms and conditions apply to all tickets.", "Permission to land was granted at noon.", "Version 3 of the plan was approved.",
    "The warranty covers parts and labour for two years.", "Copyright law changed in 1976.", "Creative people share what they have in common.", "The eclipse was visible from the public square.",
    "Any person may obtain a copy of the report, free of charge.", "The software was distributed to all schools.", "Mozilla held its general assembly in spring.", "He modified the source of the river with a dam.",
    "All rights were reserved for the heirs.", "The general public license plates were recalled.", "Free software foundations are rare in this town.", "This work is hard.",
]


def test_precision_and_recall_on_other_wording(spark):
    model, level = licenses.train(spark.read.parquet(f"{SF}/documents.parquet"))
    known = {n.lower() for v in licenses.NOTICES.values() for n in v}
    assert not any(t.lower() in n for _, t in NOTICES for n in known)
    rows = [(i, t, "en", "s") for i, t in enumerate([t for _, t in NOTICES] + OTHERS)]
    out = {r["doc_id"]: r["license"] for r in got(licenses.license_scan(table(spark, rows), model, level))}
    named = [i for i, v in out.items() if v not in ("none", "unknown")]
    right = sum(i < len(NOTICES) and out[i] == NOTICES[i][0] for i in named)
    print(f"licences in other words: precision {right}/{len(named)}, recall {right}/{len(NOTICES)}, unknown {sum(out[i] == 'unknown' for i in range(len(NOTICES)))}, missed {[t for i, (_, t) in enumerate(NOTICES) if out[i] == 'none']}, wrong {[(rows[i][1], out[i]) for i in named if i >= len(NOTICES) or out[i] != NOTICES[i][0]]}")
    assert right >= 0.9 * len(named) and right >= 0.5 * len(NOTICES)


def test_every_sentence_trains_or_calibrates(spark):
    """Also of one document, and also those beyond 2000 characters of a paragraph."""
    text = " ".join(f"The license of driver number {k} was shown." for k in range(900))
    told = licenses.others(licenses.asked(table(spark, [(1, text, "en", "s"), (2, text + " Released under the MIT License.", "en", "s")])))
    by = {r["half"]: r["count"] for r in told.groupBy("half").count().collect()}
    assert sum(by.values()) == 900 and min(by.values()) > 400


def test_sentences_that_are_not_asked_about_change_nothing(spark, monkeypatch):
    """Held against a scan that asks the classifier about every sentence that has a word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cuts = [" ".join(n.split()[a : a + 7]) for v in licenses.NOTICES.values() for n in v for a in range(0, len(n.split()), 5)]
    rows = [(-1 - i, t) for i, t in enumerate([t for _, t in NOTICES] + OTHERS + cuts)]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    model, level = licenses.train(docs)
    out = sorted(licenses.license_scan(docs, model, level).collect())
    monkeypatch.setattr(licenses, "ASKED", "[a-z0-9]")
    assert sorted(licenses.license_scan(docs, model, level).collect()) == out and sum(r["n_licences"] for r in out) > 40
