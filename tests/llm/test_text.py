from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from graphmill.llm import bpe, encoding, packing, splitting

SCHEMA = "doc_id long, text string, source string, ids string"


@pytest.fixture(scope="module")
def truth():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_is_exact(truth):
    pick = random.Random(7)
    parts = ["a", "the", "ing", " ", "\n", "é", "漢", "\x1c", "🚀", "12", "_", "-", "'s", "'S", "\t", "\u3000", "\r\n", "xxxxx", "<|endoftext|>", "ẞ", "\u200b"]
    encoder = bpe.encoder()
    for _ in range(1500):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 25)))
        assert encoder.encode(text) == truth.encode_ordinary(text)
        assert encoder.count(text) == len(encoder.encode(text))
    for text in ("a" * 20_000, " " * 20_000, "aA" * 3000, "=-" * 3000, "é" * 3000):
        assert encoder.encode(text) == truth.encode_ordinary(text)


def test_token_ids_of_null_empty_and_repeated(spark, truth):
    docs = spark.createDataFrame([(1, "The graph", "s", "x"), (2, "", None, "x"), (3, None, "s", None), (4, " \n", "s", ""), (5, "The graph", "s", "")], SCHEMA)
    got = {r.doc_id: r.out for r in docs.select("doc_id", encoding.token_ids(F.col("text")).alias("out")).collect()}
    assert got[1] == got[5] == truth.encode_ordinary("The graph") and got[2] == [] and got[3] is None and got[4] == truth.encode_ordinary(" \n")
    assert docs.limit(0).select(encoding.token_ids(F.col("text")).alias("out")).collect() == []


def test_best_two_fit():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        sizes = rng.integers(1, 2049, n) if n != 3000 else rng.integers(1, 600, n)
        where = packing.best_two_fit(sizes, 2048)
        used = np.bincount(where, weights=sizes) if n else np.zeros(0)
        assert len(where) == n and (used <= 2048).all()
        if n == 3000:
            assert sizes.sum() / (len(used) * 2048) > 0.995
    assert len(set(packing.best_two_fit(np.array([2048, 2048, 1]), 2048))) == 3


def test_packing_keeps_all_tokens(spark):
    texts = ["word " * n for n in (3, 5000, 700, 700, 700, 1, 2048)] + ["", None, " "]
    docs = spark.createDataFrame([(i, t, "s", "") for i, t in enumerate(texts)], SCHEMA)
    rows = packing.pack_texts(docs, "doc_id", "text").collect()
    count = {i: bpe.encoder().count(t) for i, t in enumerate(texts) if t}
    for i, n in count.items():
        own = sorted((r.start_token, r.n_tokens) for r in rows if r.item_id == i)
        assert sum(s for _, s in own) == n and [a for a, _ in own] == list(range(0, n, 2048))
        assert len(own) == 1 or n > 2048
    for box in {r.container_id for r in rows}:
        used = sum(r.n_tokens for r in rows if r.container_id == box)
        assert used <= 2048 and all(r.used_tokens == used for r in rows if r.container_id == box)
    assert {r.item_id for r in rows} == set(count)
    assert packing.pack_texts(docs.limit(0), "doc_id", "text").count() == 0


def _check_pieces(text, limit, overlap):
    pieces = splitting.cuts(text, 5, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (_, end, _, _), (start, *_) in zip(pieces, pieces[1:], strict=False):
        assert start == end - overlap
    for start, end, first, last in pieces:
        assert 0 < end - start <= limit
        assert first == 5 + text[:start].count("\n") and last == 5 + text[: end - 1].count("\n")


def test_cuts_of_any_text():
    pick = random.Random(1)
    for _ in range(120):
        text = "".join(pick.choice(["x" * pick.randint(1, 90), "\n", "\n\n", "    ", "}", "{", ";", "# a\n", "\r\n", "ü🚀"]) for _ in range(pick.randint(1, 300)))
        _check_pieces(text, 200, 20)
    for text in ("a" * 10_000, "\n" * 9_000, "}" * 9000, "x;" * 5000):
        _check_pieces(text, 4000, 200)


def test_cuts_at_natural_boundaries():
    body = "".join(f"def f{i}(x):\n" + "    y = x\n" * 30 + "    return y\n\n\n" for i in range(40))
    ends = splitting.cut_points(body)
    assert all(body[e:].startswith("def ") for e in ends[:-1])
    with pytest.raises(ValueError):
        splitting.cut_points("x", 10, 10)


def test_markup_is_cut_at_headings_and_lists(spark):
    body = "".join(f"# Part {i}\n\n" + "".join(f"- item {k} of the list in words\n" for k in range(60)) + "\n" for i in range(8))
    ends = splitting.cut_points(body, markdown=True)
    assert len(ends) > 3 and all(body[e:].startswith(("# Part", "- item")) for e in ends[:-1])
    rows = spark.createDataFrame([("d", "1", 1, body, None, "a/README.md"), ("d", "2", 1, body, None, None)], "entity_id string, version string, start_line int, source_code string, ingested_at timestamp_ntz, file_path string")
    got = splitting.split_entities(rows).collect()
    assert [r.piece[200:].startswith(("# Part", "- item")) for r in got if r.version == "1" and r.piece_no] == [True] * (len(ends) - 1)


def test_split_entities(spark):
    schema = "entity_id string, version string, start_line int, source_code string, ingested_at timestamp_ntz, piece string, file_path string"
    big = "line of code\n" * 400
    from datetime import datetime as T

    rows = [("a", "1", 7, big, T(2025, 1, 1), "", None), ("a", "1", 7, big, T(2025, 1, 2), "", None), ("b", "1", None, "x" * 4001, None, None, None), ("c", "1", 1, "y" * 4000, None, "", None), ("d", None, 1, None, None, "", None), ("e", "1", 1, "", None, "", None)]
    df = spark.createDataFrame(rows, schema)
    got = splitting.split_entities(df).collect()
    assert {r.entity_id for r in got} == {"a", "b"} and len([r for r in got if r.entity_id == "a"]) == 2
    first = min((r for r in got if r.entity_id == "a"), key=lambda r: r.piece_no)
    assert first.start_line == 7 and big.startswith(first.piece) and max(len(r.piece) for r in got) <= 4000
    assert splitting.split_entities(df.limit(0)).count() == 0
