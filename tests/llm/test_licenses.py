import random
import re
import textwrap

import duckdb
import pytest

from touchline.llm import licenses as n
from touchline.llm import queries
from touchline.llm.license_texts import BSD_3, MIT, TEMPLATES

DATA = "/root/testdata/sf0.001"


def words_of(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split()


def by_hand(text, templates=TEMPLATES):
    """The best run of words for each licence, over all runs within a template's bounds."""
    words, out = words_of(text), {}
    pairs = list(zip(words, words[1:], strict=False))
    for name, own in templates.items():
        for template in own:
            grams = set(zip(words_of(template), words_of(template)[1:], strict=False))
            for i in range(len(pairs)):
                if pairs[i] not in grams:
                    continue
                seen = set()
                for j in range(i, min(len(pairs), i + n.bounds(len(grams), n.LEAST_DICE)[1])):
                    seen |= {pairs[j]} & grams
                    dice = 2 * len(seen) / (j - i + 1 + len(grams))
                    if dice >= n.LEAST_DICE:
                        out[name] = max(out.get(name, (0, 0, 0)), (dice, -i, j + 1))
    return sorted((d, name, -i, j) for name, (d, i, j) in out.items())


def found(r):
    return [(x["dice"], x["license"], x["first"], x["last"]) for x in r["matches"] or []]


@pytest.fixture(scope="module")
def mangled():
    """Templates with words dropped, doubled or changed, wrapped anew, among other text."""
    rng, out = random.Random(9), []
    other = lambda k: " ".join(rng.choice("of the software this and license under a river stone".split()) for _ in range(k))
    for own in TEMPLATES.values():
        for template in own:
            for _ in range(3):
                words = template.split()
                for _ in range(rng.randrange(1 + len(words) // 8)):
                    at = rng.randrange(len(words))
                    words[at : at + 1] = rng.choice([[], ["other"], [words[at]] * 2])
                    words = words or ["x"]
                line = rng.choice([" ", "  ", "-", " / "]).join(words)
                line = rng.choice([line, line.upper(), textwrap.fill(line, 40), f"{line}\n{line}"])
                out.append(rng.choice([line, f"{other(20)}\n{line}\n{other(9)}", f"{other(5)} {line} {other(30)}"]))
    return out


def test_equals_all_runs(spark, mangled, odd_docs):
    docs = spark.createDataFrame(list(enumerate(mangled, 500)), "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    got = n.scan(docs.withColumnRenamed("doc_id", "doc_id").repartition(3)).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, repr(x[1]))
    ours = sorted(((r["doc_id"], found(r)) for r in got), key=key)
    theirs = sorted(((r["doc_id"], by_hand(r["text"])) for r in docs.collect()), key=key)
    assert ours == theirs
    assert sum(bool(x) for _, x in theirs) > 60
    for r in got:
        best = max(found(r), default=(None, None))
        assert (r["n_matches"], r["dice"], r["license"]) == (len(found(r)), best[0], best[1])


def test_whole_licences_wrapped_notices_and_notices_within_lines(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License, version 3."
    docs = [
        (1, "Copyright (c) 2020 Somebody\n" + MIT + "\n\nAnd a text.\n" * 20),
        (2, "\n".join("// " + x for x in textwrap.wrap(BSD_3, 60))),
        (3, gpl + "\n" + "A short sentence of its own.\n" * 20),
        (4, "A long paragraph. " * 30 + "It is licensed under CC BY-SA 4.0. " + "And it goes on. " * 30),
        (5, "Nothing of the kind, though this text is under no license and the public may use it."),
    ]
    got = {r["doc_id"]: r["license"] for r in n.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "BSD-3-Clause", 3: "GPL-3.0", 4: "CC-BY-SA-4.0", 5: None}


def test_documents_and_sql(documents, texts):
    got = n.scan(documents).collect()
    assert {r["doc_id"]: found(r) for r in got} == {d: by_hand(t) for d, t in texts.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    sql = con.execute(queries.ORACLE_SQL["op10_license_scan"]).fetchall()
    plain = lambda d, k, x, dice: (d, k, x, dice and round(dice, 12))
    assert sorted(plain(*x) for x in sql) == sorted(plain(r["doc_id"], r["n_matches"], r["license"], r["dice"]) for r in got)
    assert any(r["n_matches"] for r in got)


def test_enough_words_are_needed():
    """No choice of fewer words makes up the bigrams that a match shares."""
    rng = random.Random(1)
    for own in TEMPLATES.values():
        for template in own:
            grams = n.bigrams(words_of(template))
            least, k = n.bounds(len(grams), n.LEAST_DICE)[0], n.least_words(template, n.LEAST_DICE)
            vocabulary = sorted(set(words_of(template)))
            assert 0 < k <= len(vocabulary)
            for _ in range(50):
                few = set(rng.sample(vocabulary, k - 1))
                assert sum(set(g.split()) <= few for g in grams) < least


def test_native_and_empty(documents, no_docs):
    assert n.scan(no_docs).collect() == []
    plan = n.scan(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
