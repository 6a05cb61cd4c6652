"""Alignment of two tokenizers against a plain version, and its defined cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridpulse.llm import alignment, queries

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, block long, pair string"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def random_text(rng, n):
    kinds = [
        lambda: chr(rng.randrange(32, 127)), lambda: rng.choice(" \n\t  "), lambda: chr(rng.randrange(0xA0, 0x2000)), lambda: chr(rng.randrange(0x2000, 0xD7FF)),
        lambda: chr(rng.randrange(0xE000, 0x1FFFF)), lambda: rng.choice(["the ", "Über", "İΣ.", "don't", "</s>", "<s>", "<|endoftext|>", "1234 ", "▁", "<0x41>", "\x00"])]
    return "".join(rng.choice(kinds)() for _ in range(n))


def plain(tokenizers, texts):
    """Per text the contract's columns, by sets of byte places."""
    a, b = tokenizers
    letters, out, pairs = alignment.byte_letters(), [], Counter()
    for text in texts:
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            p = b.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append(([], [], 0, "", []))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
        cuts, groups, links, x, y = sorted(set(ends_a) & set(ends_b)), [], [], 0, 0
        for cut in cuts:
            i, j = ends_a.index(cut, x) + 1, ends_b.index(cut, y) + 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
            links.append((ids_a[i - 1], ids_b[j - 1]))
            x, y = i, j
        pairs.update(links)
        out.append((ids_a, ids_b, len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    most = {}
    for (_, i), n in pairs.items():
        most[i] = max(n, most.get(i, 0))
    return [
        (len(ids_a), len(ids_b), n, len(links), sum(pairs[p] == most[p[1]] for p in links), sum(pairs[p] for p in links), digest)
        for ids_a, ids_b, n, digest, links in out]


def run(spark, texts, **options):
    rows = [(k, t, 7, "clash") for k, t in enumerate(texts)]
    got = alignment.align_corpus(spark.createDataFrame(rows, DOCS), A, B, **options).collect()
    assert len(got) == len(texts)
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)]


def test_equals_the_plain_version(spark, tokenizers):
    rng = random.Random(8)
    texts = [random_text(rng, rng.randrange(1, 60)) for _ in range(200)]
    texts += [None, "", " ", "a", "▁", "two▁words", "The cat sat on the mat. " * 40, texts[0], texts[0], "naïve café — déjà vu", "日本語のテキスト", "🙂🙃"]
    want = plain(tokenizers, texts)
    assert run(spark, texts) == want == run(spark, texts, block_bytes=200)
    assert sum(w[0] > 0 for w in want) > 100 and (0, 0, 0, 0, 0, 0, "") in want


def test_the_byte_side_gives_the_files_own_ids(tokenizers):
    rng = random.Random(5)
    side = alignment.byte_side(A)
    texts = [random_text(rng, rng.randrange(1, 40)) for _ in range(5000)] + [" " * 3000, "ab" * 5000, "\n" * 999 + "x"]
    texts = [t for t in texts if t]
    assert side.encode(texts) == [e.ids for e in tokenizers[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_pointer_jumping_over_long_chains():
    # Sides shifted against each other by one byte share only the last end.
    a_end, b_end = np.array([*range(2, 2001, 2), 2001]), np.array([*range(1, 2001, 2), 2001])
    ends = alignment.terminals(a_end, b_end)
    assert set(ends.tolist()) == {len(a_end) - 1}
    both = alignment.terminals(np.array([1, 3, 4]), np.array([1, 2, 4]))
    assert both.tolist() == [0, 2, 2, 0, 2, 2]


def test_long_texts_and_no_rows(spark, tokenizers):
    long = "word " * 60_000 + "x" * 20_000
    assert run(spark, [long, "word"], block_bytes=1000) == plain(tokenizers, [long, "word"])
    empty = spark.createDataFrame([], DOCS)
    assert alignment.align_corpus(empty, A, B).collect() == []
    missing = spark.createDataFrame([(None, "a b", 1, "x"), (None, "a b", 1, "x")], DOCS)
    assert [r.doc_id for r in alignment.align_corpus(missing, A, B).collect()] == [None, None]


def test_registered_query_equals_the_plain_version(spark, tokenizers):
    got = queries.op11_alignment(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("text")).collect()}
    want = dict(zip(docs, plain(tokenizers, list(docs.values()))))
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got} == want
