import random
import re
from re import _parser as parser

import pytest
from pyspark.sql import functions as F

from sonaria.llm import licenses


def sample(items, r):
    """A text that the parsed expression matches."""
    out = ""
    for kind, what in items:
        if kind is parser.LITERAL:
            out += chr(what)
        elif kind is parser.IN:
            k, v = r.choice(what)
            out += chr(v if k is parser.LITERAL else r.randint(*v))
        elif kind is parser.ANY:
            out += r.choice("ab ")
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            out += "".join(sample(what[2], r) for _ in range(r.randint(what[0], min(what[1], what[0] + 1))))
        elif kind is parser.SUBPATTERN:
            out += sample(what[-1], r)
        elif kind is parser.BRANCH:
            out += sample(r.choice(what[1]), r)
        else:
            assert kind is parser.ASSERT or kind is parser.ASSERT_NOT
    return out


def samples(r, n):
    return [(i, label, word, " ".join(sample(parser.parse(pattern), r).split())) for i, label, word, pattern, _ in licenses.rules() for _ in range(n)]


def test_every_match_holds_its_rules_keyword():
    lost = {(label, word, text) for _, label, word, text in samples(random.Random(5), 40) if word not in text}
    assert not lost


def test_every_rule_finds_its_own_examples(spark):
    """A match of a rule gives its label, unless a rule of higher priority holds or overlaps the match."""
    rules = licenses.rules()
    rows = samples(random.Random(9), 3)
    table = spark.createDataFrame([(k, f"so then, {t}, and so on") for k, (_, _, _, t) in enumerate(rows)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.labels.split(","), r.score) for r in licenses.scan(table).collect()}
    assert len(got) == len(rows)
    for k, (i, label, _, text) in enumerate(rows):
        labels, score = got[k]
        rivals = {rules[j][1] for j in range(len(rules)) if re.search(rules[j][3], f" so then {text} and so on ")}
        assert score > 0 and (label in labels or rivals & set(labels)), (label, text, labels)


def test_hundreds_of_rules_are_written_by_hand():
    assert len(licenses.NOTICES) >= 200 and len({p for _, _, p, _ in licenses.NOTICES}) == len(licenses.NOTICES)


@pytest.mark.parametrize(
    "text, labels, score",
    [
        # one lies within the other
        ("Licensed under the Mozilla Public License v 2.0", "mpl-2.0", 0.95),
        ("Mozilla Public License v 2.0", "mpl-2.0", 0.6),
        # they overlap in part: the notice stays, the name that begins within it goes
        ("Dual licensed under the Boost Software License. Distributed under the Boost Software License, Version 1.0", "boost", 1.0),
        ("This package may be used to endorse or promote products derived from this software without specific prior written permission of us", "bsd-3-clause", 1.0),
        # apart: both stay
        ("MIT license or the zlib license", "mit,zlib", 0.6),
    ],
)
def test_overlaps(spark, text, labels, score):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.labels, row.score) == (labels, score)


def test_every_rule_passes_the_gate(spark):
    r = random.Random(7)
    rows = [(sample(parser.parse(pattern), r).upper().replace(" ", ", "),) for _, _, _, pattern, _ in licenses.rules() for _ in range(12)]
    lost = spark.createDataFrame(rows, "text string").where(~licenses.gated(F.col("text"))).collect()
    assert not lost


@pytest.mark.parametrize(
    "text, label",
    [
        ("Attribution-ShareAlike 4.0", "cc-attribution-sharealike"),
        ("Attribution NonCommercial", "cc-attribution-noncommercial"),
        ("subject to the MIT terms", "mit"),
        ("to any person or organization obtaining a copy of the software and accompanying documentation", "boost"),
    ],
)
def test_texts_that_the_gate_lost(spark, text, label):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == label and row.score > 0
