import re

from tracelake.llm import license_scan
from tracelake.llm.license_scan import PHRASES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    words = WORD.findall((text or "").lower())
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), sorted({k for _, k in at})


TEXTS = [
    (1, "Some words.\nReleased under the MIT License. More words; MIT license"),
    (2, "Licensed under the Apache License, Version 2.0. And the GNU General Public License, version 3."),
    (3, "Licensed under CC BY-NC 4.0."),
    (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (5, "A license to fish. The apache helicopter. Public general mit."),
    (6, None),
    (7, ""),
    (8, "x " * 20000 + "Released under the MIT License."),
    (1, "Some words.\nReleased under the MIT License. More words; MIT license"),
    (None, "mit-license"),
    (9, "the license of the software in the terms of the work and this is the source"),
]


def test_base_equals_the_phrases_and_labels_add(make_docs):
    got = license_scan.scan(make_docs(TEXTS)).collect()
    seen = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=str)
    assert seen == sorted([(i, *base(t)) for i, t in TEXTS], key=str)
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[3][0] == ["cc"] and labels[4][0] == ["mit"] and labels[2][0] == ["apache", "gpl"]
    assert labels[5] == ([], 0.0) and labels[6] == ([], 0.0) and labels[9] == ([], 0.0)
    for r in got:
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 and (not r.base_labels or r.score > 0)


def test_empty_table(make_docs):
    assert license_scan.scan(make_docs([])).count() == 0


def test_a_label_is_not_crowded_out_by_the_words_of_others(make_docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    cc = "Licensed under CC BY-NC 4.0"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License"
    texts = [(i, f"Some prose {i}. {cc}.") for i in range(40)]
    texts += [(100, f"{mit}.\n{cc}."), (101, f"{bsd}.\n{mpl}.\n{mit}.\n{cc}.\nReleased under the BSD 3-Clause License."), (102, f"{mit}. " + "x " * 3000 + cc)]
    # words of the notice strewn about must not hide the phrase itself
    texts += [(103, "Redistribution, permitted modification, without use, or with: " * 3 + "in source and binary forms.")]
    got = {r.doc_id: r for r in license_scan.scan(make_docs(texts)).collect()}
    assert got[100].labels == got[102].labels == ["cc", "mit"]
    assert got[101].labels == ["bsd", "cc", "mit", "mpl"] and got[103].labels == ["bsd"] and got[0].labels == ["cc"]
    assert all(0 < r.score <= 1 for r in got.values())
