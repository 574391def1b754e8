"""Alignment against a plain merge of the whole tokenizers' output, text by text."""

from __future__ import annotations

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from millrace.llm import alignment, queries

FILES = [queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")]
TEXTS = [
    None,
    "",
    " ",
    "a",
    "two  spaces,\tand\n\n lines   of it 12345 don't",
    "naïve café  ﬁne 漢字 and 🙂🙂 <|endoftext|> <s> </s>",
    "a ́b ▁ c   d e  ",
    "holds ▁ the mark that stands for a space",
    "x" * 300 + " y" * 300,
    "nul \x00 and \x1c controls \x7f",
    " leading and trailing ",
]


def plain(texts):
    """Rows as the contract states them, with nothing shared with the operator."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable}
    letters |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in printable)}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        tokens_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        tokens_b = [bytes_b(i) for i in ids_b]
        if b"".join(tokens_a) != (" " + text).encode() or b"".join(tokens_b) != (" " + text).encode():
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([*map(len, tokens_a)]), np.cumsum([*map(len, tokens_b)])
        links = []
        for i, end in enumerate(ends_a):
            start = end - len(tokens_a[i])
            for j, other in enumerate(ends_b):
                if other - len(tokens_b[j]) < end and start < other:
                    links.append((ids_a[i], ids_b[j]))
                if other - len(tokens_b[j]) >= end:
                    break
        counts.update(links)
        cuts = sorted({*ends_a} & {*ends_b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(
                ",".join(str(x) for x, e in zip(ids_a, ends_a) if low < e <= cut)
                + "|"
                + ",".join(str(x) for x, e in zip(ids_b, ends_b) if low < e <= cut)
            )
            low = cut
        found.append((ids_a, ids_b, links, groups))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    for one in found:
        if one is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            ids_a, ids_b, links, groups = one
            yield (
                len(ids_a), len(ids_b), len(groups), len(links),
                sum(counts[x] == top[x[1]] for x in links),
                sum(counts[x] for x in links),
                sha256(";".join(groups).encode()).hexdigest(),
            )


def operator(spark, texts, **more):
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").repartition(3)
    rows = alignment.align_texts(docs, *FILES, **more).orderBy("doc_id").collect()
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return [tuple(r[n] for n in names) for r in rows]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 40, 0])
def test_alignment_equals_a_plain_merge(spark, shared, heavy):
    path = "/root/testdata/sf0.001/documents.parquet"
    texts = TEXTS + [r.text[:700] for r in spark.read.parquet(path).head(30)] + TEXTS
    assert operator(spark, texts, heavy=heavy) == [*plain(texts)]


def test_long_texts_in_pieces_and_lanes(spark, shared, monkeypatch):
    from millrace.llm.alignment import TwoTokenizers, _align, _Document, _pieces

    text = " ".join(f"wort{i % 97} {'x' * (i % 23)} é{i}" for i in range(900))
    (expected,) = plain([text])
    monkeypatch.setattr(alignment, "_PIECE", 500)
    tokenizers = TwoTokenizers(*FILES)
    for pass_units in (1, 7, 10_000):
        doc = _Document(1)
        units = [(doc, piece) for piece in _pieces(tokenizers, text)]
        assert len(units) > 10 and " ".join(piece for _, piece in units) == text
        for at in range(0, len(units), pass_units):
            _align(tokenizers, units[at : at + pass_units])
        got = (doc.n_a, doc.n_b, doc.groups, doc.links, doc.digest.hexdigest())
        assert got == (*expected[:4], expected[6])
        assert sum(int(t.sum()) for t in doc.times) == doc.links


def test_remembered_chunks_are_bounded(spark, shared, monkeypatch):
    from millrace.llm.alignment import TwoTokenizers

    monkeypatch.setattr(alignment, "_KEPT", 10)
    tokenizers = TwoTokenizers(*FILES)
    tokenizers.learn([f"word{i}" for i in range(11)])
    tokenizers.bound()
    assert not tokenizers.known and tokenizers.learn(["word3"]).tolist() == [0]


def test_awkward_and_empty_tables(spark, awkward, nothing):
    rows = alignment.align_texts(awkward, *FILES).collect()
    assert len(rows) == 9
    same = [r for r in rows if r.doc_id in (1, None)]
    assert len(same) == 3 and len({r.groups_sha256 for r in same}) == 1 and same[0].n_a > 0
    empty = [r for r in rows if r.doc_id in (2, 3)]
    assert [tuple(r)[1:] for r in empty] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert alignment.align_texts(nothing, *FILES).count() == 0
