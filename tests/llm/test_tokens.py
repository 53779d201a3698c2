"""Byte-level BPE and token counts against the libraries."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from skein.llm import bpe, queries

RANKS, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
rnd = random.Random(1)
ODD = [
    None, "", " ", "a" * 5000, " " * 300, "\x1c\x85 x\u200b", "it's 123 <|endoftext|> ok", "".join(rnd.choice("ab ") for _ in range(3000)),
    "".join(rnd.choice("abcdefgh") for _ in range(8000)), "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(3000)), "\U0001f600\U0001f600\r\n\t x", "\n\n\n  a", "abab" * 400, "e\u0301",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(open(RANKS, "rb").read()), special_tokens={})


def test_encode_and_decode(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, token_ids string")
    coded = bpe.encode(df, RANKS, PATTERN)
    back = {r.doc_id: (r.token_ids, bytes(r.decoded)) for r in bpe.decode(coded, RANKS, PATTERN).collect()}
    for i, t in enumerate(ODD):
        assert back[i] == (library.encode_ordinary(t or ""), (t or "").encode()), i
    assert bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0


def test_bpe_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_merge_order_on_odd_vocabularies(seed):
    """Ranks in any order: merging one place at a time is what counts."""
    r = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 330:
        tokens.add(b"".join(r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(2, 5))))
    several = sorted(x for x in tokens if len(x) > 1)
    r.shuffle(several)
    ranks = {x: i for i, x in enumerate([bytes([b]) for b in range(256)] + several)}
    enc = bpe.Encoder(ranks)
    pieces = ["".join(r.choice("abc") for _ in range(r.randint(1, 40))).encode() for _ in range(200)]

    def plain(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    assert [x.tolist() for x in enc.encode_pieces(pieces)] == [plain(p) for p in pieces]


def test_counts(spark, sf):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, P.path("byte_bpe_50k.json"), PATTERN).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False)) for i, t in enumerate(ODD)}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op10_token_counts(spark, sf).collect():
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    assert bpe.token_counts(df.limit(0), P.path("byte_bpe_50k.json"), PATTERN).count() == 0
