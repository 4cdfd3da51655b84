import base64
import hashlib
import random

import pytest

from sparkloom.llm import byte_bpe, media, token_counts

tokenizers = pytest.importorskip("public_tokenizers")
MODEL, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


def test_token_counts_of_odd_texts(spark):
    counter = token_counts.Counter(tokenizers.path(MODEL))
    rng = random.Random(4)
    texts = ["", " ", "  ", "a ", " a", "a  b", "▁", "a▁b", "▁ ▁", "\n", "<s> </s> <unk>", "x" * 5000, "a" * 70 + " b", "　\xa0 ​", "é́ ﬁ"] + ["".join(rng.choice("ab \n\té日▁0🙂") for _ in range(rng.randrange(120))) for _ in range(300)]
    assert counter(texts) == [len(x) for x in counter.model.encode(texts)]
    assert [counter([t])[0] for t in texts[:15]] == [len(counter.model.encode(t)) for t in texts[:15]]


def test_a_worker_forgets_words(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    counter = token_counts.Counter(tokenizers.path(MODEL))
    texts = [" ".join(f"qx{i}z{j}" for j in range(9)) for i in range(30)]
    assert [counter([t])[0] for t in texts] == [len(counter.model.encode(t)) for t in texts]


def test_long_pieces():
    """Runs without a break are one piece each; merges in it are found by the segment tree."""
    import tiktoken

    path = tokenizers.path(RANKS)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = byte_bpe.Encoder(byte_bpe.ranks_of(path), tokenizers.PATTERN)
    rng = random.Random(5)
    texts = ["a" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(15_000)), "日本語" * 3000, " " * 3000 + "x", ""]
    for text, (ids, n, raw) in zip(texts, encoder(texts), strict=True):
        want = library.encode_ordinary(text)
        assert (ids, n, raw) == (",".join(map(str, want)), len(want), text.encode())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(none, tokenizers.path(MODEL)).count() == 0
    assert byte_bpe.byte_bpe(none, tokenizers.path(RANKS), tokenizers.PATTERN).count() == 0


def test_stored_media_are_what_is_digested(spark):
    docs = spark.createDataFrame([(1, None), (2, "ab" * 500), (3, "ab" * 500)], "doc_id long, text string")
    stored = {r.doc_id: bytes(r.media) for r in media.stored_media(docs).collect()}
    got = {r.doc_id: r for r in media.media_digests(docs).collect()}
    for d, data in stored.items():
        assert (got[d].media_bytes, got[d].media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert got[d].feature.startswith(f"{got[d].width}x{got[d].height}:")
    assert tuple(got[2])[1:] == tuple(got[3])[1:] and got[1].feature != got[2].feature
