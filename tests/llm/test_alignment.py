"""Token alignment against a version that compares all pairs of byte ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import bpe, queries
from tallyspark.llm.alignment import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def ranges():
    """Ids with byte ranges by both libraries, None where a text has no tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    symbols = bpe._byte_of_symbol()

    def placed(ids, parts, whole):
        if b"".join(parts) != whole:
            return None
        out, at = [], 0
        for i, p in zip(ids, parts, strict=True):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out

    def of(text):
        if not text:
            return None
        whole = (" " + text).encode()
        e = a.encode(" " + text, add_special_tokens=False)
        ids = b.encode(text)
        x = placed(e.ids, [bytes(symbols[c] for c in t) for t in e.tokens], whole)
        y = placed(ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids], whole)
        return None if x is None or y is None else (x, y)

    return of


def brute(rows, ranges):
    linked, pairs, texts = [], Counter(), []
    for i, text in rows:
        found = ranges(text)
        if found is None:
            linked.append([])
            texts.append((i, 0, 0, 0, ""))
            continue
        x, y = found
        own = [(a, b) for a, s, e in x for b, t, f in y if s < f and t < e] if len(x) * len(y) < 200_000 else walked(x, y)
        linked.append(own)
        pairs.update(own)
        cuts = sorted({e for _, _, e in x} & {f for _, _, f in y})
        groups = [(",".join(str(a) for a, s, e in x if lo <= s and e <= hi), ",".join(str(b) for b, t, f in y if lo <= t and f <= hi)) for lo, hi in zip([0, *cuts], cuts, strict=False)] if len(cuts) < 400 else grouped(x, y)
        texts.append((i, len(x), len(y), len(groups), hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in pairs.items():
        best[b] = max(n, best.get(b, 0))
    return sorted((repr(i), a, b, g, len(own), sum(pairs[p] == best[p[1]] for p in own), sum(pairs[p] for p in own), sha) for (i, a, b, g, sha), own in zip(texts, linked, strict=True))


def walked(x, y):
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        out.append((x[i][0], y[j][0]))
        i, j = i + (x[i][2] <= y[j][2]), j + (y[j][2] <= x[i][2])
    return out


def grouped(x, y):
    out, i, j = [], 0, 0
    while i < len(x):
        k, m = i + 1, j + 1
        while x[k - 1][2] != y[m - 1][2]:
            if x[k - 1][2] < y[m - 1][2]:
                k += 1
            else:
                m += 1
        out.append((",".join(str(a) for a, _, _ in x[i:k]), ",".join(str(b) for b, _, _ in y[j:m])))
        i, j = k, m
    return out


def rows_of(df):
    return sorted((repr(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect())


TEXTS = [None, "", " ", "one", "Hello  World", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ is not a space", "a▁b", "don't\n\n\tstop", "é𝄞 中文 \x00\x85", "x" * 3000, "\r\nline", "aaa bbb " * 300, "naïve façade — “quoted”", "😀" * 40]


@pytest.mark.parametrize("hot", [0, 5, 1 << 16])
def test_small_texts(spark, ranges, hot):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices(a, k=rng.randint(1, 120))) for a in ("ab", "the of and in ", "é中𝄞 a1▁", "0123 .,-\n") for _ in range(25)]
    rows = [*enumerate(texts), (3, "one"), (3, "one"), (None, "Hello  World")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "keys", "ns", "key", "total", "best")})
    assert rows_of(token_alignment(df, A, B, hot=hot)) == brute(rows, ranges)


def test_empty_table(spark):
    assert token_alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_query(spark, sf_dir, ranges):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.QUERIES["op11_token_alignment"](spark, sf_dir)) == brute(rows, ranges)


def test_long_blanks_and_other_vocabularies():
    """White space that is longer than the fast encoder bears, and files whose ids aren't ranks."""
    texts = [" " * 70_000 + "a", "\n" * 3_000_000 + " b", "x" * 100_000, "a<|endoftext|>b", "'s't  \n x"]
    for special in (True, False):
        library = Tokenizer.from_file(A)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = not special
        assert [bpe.ranks(A, special).encode(t) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError):
        bpe.Ranks(public_tokenizers.path("word_bpe_49k.json"), True)
