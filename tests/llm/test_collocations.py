"""Collocations against a version that counts all phrases of all texts."""

import random
import re
from collections import Counter

import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from tallyspark.llm import queries
from tallyspark.llm.collocations import collocations, frequent_phrases
from tallyspark.llm.common import Scratch


def counted(rows, longest):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, min_count, longest=5, inside=100, top=2000):
    f, n = counted(rows, longest)
    frequent = [(lang, p) for (lang, p), c in f.items() if c >= min_count and len(p) >= 2]
    out = []
    for lang, p in frequent:
        a = f[lang, p]
        around = any(q != p and 100 * f[other, q] >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for other, q in frequent if other == lang and len(q) > len(p))
        if not around:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    result, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return result


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def table(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    return df.withColumns({c: F.lit("x") for c in ("k", "phrase", "f", "n", "words", "cut", "score", "doc_id")})


ODD = [(None, None), ("en", ""), ("en", " \t "), ("en", "...!?"), (None, "und is its own. und is its own"), ("und", "und is its own"), ("xx", "a"), ("yy", "a b"), ("de", "Ärger ÄRGER é\x00é\x85x nbsp word 𝄞 𝄞"), ("de", "tab\tis a blank\x0bvertical\x0cfeed\rreturn")]


@pytest.mark.parametrize("bits", [1 << 15, 1 << 26])
def test_random_texts(spark, bits):
    rng = random.Random(1)
    rows = ODD * 3 + [(rng.choice(["en", "de", None]), "".join(rng.choice(["a", "b", "c", "of the", "New York City", "x y"]) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    assert got(collocations(table(spark, rows), min_count=5, bits=bits)) == sorted(brute(rows, 5))
    assert got(collocations(table(spark, rows), min_count=3, longest=3, inside_pct=60, top=7, bits=bits)) == sorted(brute(rows, 3, 3, 60, 7))


def test_levels_are_exact(spark):
    """All frequent phrases of all lengths with their counts, though the bitmap is nearly full."""
    rng = random.Random(2)
    rows = [("en", " ".join(rng.choices("abcdefgh", k=50))) for _ in range(60)]
    with Scratch(spark, "test") as scratch:
        grams, totals = frequent_phrases(table(spark, rows), scratch, 4, 5, bits=1 << 15)
        f, n = counted(rows, 5)
        assert {(r["lang"], r["k"], r["phrase"]): r["f"] for r in grams.collect()} == {(lang, len(p), " ".join(p)): c for (lang, p), c in f.items() if c >= 4}
        assert {r["lang"]: r["n"] for r in totals.collect()} == n


def test_products_beyond_64_bits(spark):
    """1000 * a * n passes 2**63 while the parts' counts stay small enough for a score."""
    from tallyspark.llm import collocations as module

    over = 1000 * 4_000_000_000_000 * 9_000_000_000_000
    df = spark.sql("SELECT 'en' AS lang, 'a b' AS phrase, 2 AS k, 4000000000000L AS f UNION ALL SELECT 'en', 'a', 1, 4000000000001L UNION ALL SELECT 'en', 'b', 1, 5000000000003L")
    real = module.frequent_phrases
    module.frequent_phrases = lambda *_: (df, spark.sql("SELECT 'en' AS lang, 9000000000000L AS n"))
    try:
        assert got(collocations(table(spark, []))) == [("en", 1, "a b", 4_000_000_000_000, 4_000_000_000_001, 5_000_000_000_003, 9_000_000_000_000, over // (4_000_000_000_001 * 5_000_000_000_003))]
    finally:
        module.frequent_phrases = real


def test_empty_table(spark):
    assert collocations(table(spark, [])).collect() == []


def test_query_against_sql(sf_dir, spark):
    """Whole tables are compared in test_ops; here with a lower threshold, so that all lengths occur."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    sql = queries.ORACLE_SQL["op12_collocations"].replace(">= 100", ">= 8")
    assert_same(collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=8).toPandas(), connect(sf_dir).execute(sql).df())
