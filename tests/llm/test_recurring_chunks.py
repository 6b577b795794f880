"""The encoder of packing keeps chunks that recur when it lets go of those met once."""

from __future__ import annotations

import public_tokenizers

from quillstone.llm import packing


def test_chunks_that_recur_are_encoded_once_or_twice(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 5)
    encoder = packing.ChunkEncoder(str(public_tokenizers.path("word_bpe_49k.json")))
    asked, plain = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda chunks: asked.extend(chunks) or plain(chunks))
    texts = [" ".join(["common", *(f"rare{n}x{k}" for k in range(4))]).encode() for n in range(8)]
    got = [encoder([t])[0] for t in texts]
    assert asked.count(b"common") == 1
    assert got == [b"".join(plain(t.split())) for t in texts]
