"""Line dedup against brute force; native plans."""

import hashlib
import re
from collections import Counter

import pytest
from cases import BLANKS, documents, empty, multiset
from pyspark.sql import functions as F

from lexspark.llm import linededup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, min_chars):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < min_docs]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def shared_rows(n=60):
    rows = [(i, f"Header line\n  own {i}\nSHARED by some \n\nfooter") for i in range(n)]
    rows += [(1000 + i, "\tHEADER LINE\x0b\nHeader line") for i in range(8)]
    rows += [(2000, "Éa\néa"), (2001, "\r\nfooter\r\n"), (2002, "\n")]
    return rows + [(3000 + i, "Shared by some") for i in range(5)]


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (3, 1), (66, 1), (10, 7), (1, 1), (2, 0)])
def test_against_brute_force(spark, min_docs, min_chars):
    rows = shared_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = linededup.dedup(docs, min_docs, min_chars).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert multiset(map(tuple, got)) == multiset(brute(rows, min_docs, min_chars))


def test_hard_cases_keep_their_columns(spark):
    docs, rows = documents(spark)
    got = linededup.dedup(docs, 3)
    assert set(got.columns) == set(docs.columns) | {"n_dropped"}
    got = got.collect()
    assert multiset((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == multiset(brute(rows, 3, 1))
    assert {(r.lang, r.score, r.slot) for r in got} == {("en", 1.5, "s")}
    assert linededup.dedup(empty(spark)).collect() == []


def test_without_a_broadcast(spark):
    rows = shared_rows(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = linededup.dedup(docs).select("doc_id", "text", "n_lines", "n_dropped").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert multiset(map(tuple, got)) == multiset(brute(rows, 10, 1))


def test_native(spark):
    docs, _ = documents(spark)
    plan = linededup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    digest = linededup.dedup(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.sha2("text", 256)).first()[0]
    assert digest == hashlib.sha256(b"").hexdigest()
