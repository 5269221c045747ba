"""Counts of the compiled tokenizer against the tokenizers library."""

import random

import public_tokenizers
import pytest
from compare import connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import queries
from tallyspark.llm.token_count import StateMap, composed, count_tokens, token_counts
from tallyspark.llm.transducer import START, Transducer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = ["ab", "abcdefghij", "aeiou nst", "' srelvmtd", "0123 ", "é中𝄞 á　\x85", "the of in er re on at"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def compiled():
    return Transducer(PATH)


def random_texts(seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choices(a, k=rng.randint(0, longest))) for a in ALPHABETS for _ in range(n)]


def test_random_texts(compiled, library):
    rng = random.Random(5)
    texts = random_texts(1, 250, 60)
    texts += [bytes(rng.randrange(256) for _ in range(40)).decode("latin1") for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0x10000, 0x20000)])) for _ in range(30)) for _ in range(200)]
    texts += ["", "don't  we'll 's't ''s  \n\n x", " \n a\t\tb", "'re'r'll've", "a<|endoftext|>b<|endoftext|><|endoftext|>'s", "<|endoftext|", "a" * 5000]
    assert count_tokens(compiled, texts).tolist() == [library(t) for t in texts]


def test_few_states_kept(library):
    texts = random_texts(2, 60, 80)
    assert count_tokens(Transducer(PATH, states=50), texts).tolist() == [library(t) for t in texts]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        Transducer(public_tokenizers.path("word_bpe_49k.json"))


def test_maps_compose_in_any_grouping(compiled):
    """((a b) c) d = a (b (c d)) for maps that start with no state known."""
    heads = [b"abab" * 3, b"bb", b"a", b"abba" * 5]
    leaf = lambda h: StateMap(None, {}, lambda s: compiled.follow(s, h))
    a, b, c, d = map(leaf, heads)
    want = compiled.follow(START, b"".join(heads))
    assert a.then(b).then(c).then(d)(START) == want
    assert a.then(b.then(c.then(d)))(START) == want
    assert composed([leaf(h) for h in heads])(START) == want


@pytest.mark.parametrize("how", [{}, {"chunk": 64}, {"chunk": 300}, {"chunk": 37, "tried": 0}, {"chunk": 500, "tried": 2}])
def test_chunks(spark, library, how):
    rng = random.Random(3)
    texts = [None, "", "<|endoftext|>", "a<|endoftext|>b<|endoftext|><|endoftext|>don't", "x" * 5000, "ab" * 3000, " " * 3001 + "a", "\n" * 2000, "é" * 1500, "aé𝄞" * 900, "'" * 2500, "it's " * 700 + "<|endoftext|>" + "'re" * 400]
    texts += ["".join(rng.choices(a, k=4000)) for a in (*ALPHABETS, "' \nas中1", "0123456789abcdef")]
    rows = [*enumerate(texts), (None, "z" * 700), (5, "ab" * 3000), (5, "ab" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "at", "chunk", "before", "special")})
    got = sorted(((r["doc_id"] is None, r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(df, PATH, **how).collect())
    want = sorted(((i is None, i), len((t or "").encode()), library(t or ""), library(t or "") > 1024) for i, t in rows)
    assert got == want


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query(spark, sf_dir, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.QUERIES["op13_token_counts"](spark, sf_dir).collect()}
    rows = connect(sf_dir).execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    assert got == {i: (len(t.encode()), n := library(t), n > 1024) for i, t in rows}
